"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; suffix sums over the distinct lengths then answer, for
every context limit at once, how many documents are longer, how many tokens there are, and how many
remain when each document is cut at the limit. Suffix sums are taken in blocks of lengths: the totals of
blocks are summed over a few rows, the rest within each block, so no task gets all lengths.

The corpus is encoded once: ``suffix_sums`` keeps the histogram, a row for each distinct length, in a
checkpoint and reads it twice.

Defined cases: null and empty texts have length 0. Documents of equal length are one row. Repeated rows
count once each. A very long text is encoded whole, by one task. An empty table gives an empty histogram,
no quantile, and 0 for every limit. Only the text column is read, so other columns can have any names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.llm.session import checkpointed, map_slices
from sonarlake.llm.tokens import encoder

#: Lengths of a block of suffix sums.
BLOCK = 64


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""

    def work(batches):
        counts: Counter = Counter()
        for b in batches:
            counts.update(map(len, encoder(vocabulary).ids(b.column(0).to_pylist())))
            if len(counts) > 50_000:
                yield emit(counts)
                counts.clear()
        yield emit(counts)

    def emit(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n"])

    return map_slices(docs.select(F.col(text).cast("string")), work, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: documents and tokens of that length, of longer ones, in all, and what a cut there keeps.

    ``docs_longer`` and ``tokens_longer`` are of strictly longer documents; ``tokens_truncated`` is the sum
    of min(length, limit) over all documents with this length as limit; ``share_at_most`` is the exact
    cumulative share of documents, so quantiles are read off by the first row that reaches it.
    """
    own = checkpointed(hist).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bd").over(after), zero).alias("ad"), F.coalesce(F.sum("bt").over(after), zero).alias("at"),
        F.sum("bd").over(everything).alias("total_docs"), F.sum("bt").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(blocks, "block").select(
        "n_tokens", "n_docs", "tokens", "total_docs", "total_tokens",
        (F.col("ad") + F.coalesce(F.sum("n_docs").over(within), zero)).alias("docs_longer"),
        (F.col("at") + F.coalesce(F.sum("tokens").over(within), zero)).alias("tokens_longer"),
    )
    return out.withColumn("tokens_truncated", F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).withColumn(
        "share_at_most", (F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Documents and tokens that each context limit keeps, from the suffix sums alone.

    The longest length within a limit stands for it; a limit below all lengths keeps that many tokens of each.
    """
    wanted = sorted({int(x) for x in limits})
    below = lambda x: F.max(F.when(F.col("n_tokens") <= x, F.struct("n_tokens", "docs_longer", "tokens_longer")))
    one = sums.agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"), F.array(*(below(x) for x in wanted)).alias("best"))
    rows = one.select("d", "t", F.explode(F.arrays_zip(F.array(*(F.lit(x).cast("long") for x in wanted)).alias("context_limit"), "best")).alias("x"))
    zero, longer = F.lit(0).cast("long"), F.coalesce("x.best.docs_longer", "d", F.lit(0).cast("long"))
    within = F.coalesce(F.col("t") - F.col("x.best.tokens_longer"), zero)
    return rows.select(
        F.col("x.context_limit").alias("context_limit"), (F.coalesce("d", zero) - longer).alias("docs_whole"), longer.alias("docs_cut"),
        (within + F.col("x.context_limit") * longer).alias("tokens_kept"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of the documents doesn't exceed."""
    wanted = sorted({float(x) for x in shares})
    first = lambda q: F.min(F.when(F.col("total_docs") - F.col("docs_longer") >= F.ceil(F.lit(q) * F.col("total_docs")), F.col("n_tokens")))
    one = sums.agg(F.array(*(first(q) for q in wanted)).alias("n"))
    rows = one.select(F.explode(F.arrays_zip(F.array(*(F.lit(q) for q in wanted)).alias("share"), F.col("n").alias("n"))).alias("x"))
    return rows.select("x.share", F.col("x.n").alias("n_tokens")).where("n_tokens IS NOT NULL")
