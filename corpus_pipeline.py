"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes all documents that its predecessor kept and returns the columns of documents; the last
returns the packed pieces.

Defined cases: empty tables give no pieces. Columns other than those of documents are left out, so their names can't
clash. Very long texts pass each stage whole. Ties are settled as the stages say: of near-duplicates the least id stays, a passage
stays where the least id has it. Of rows that repeat, one stays; null, empty and blank texts are near-duplicates of each other, so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.llm import decontam, neardup, packing, suffixdedup, toxicity
from sonarlake.llm.queries import learnable
from sonarlake.llm.session import fresh_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable)
    scored = toxicity.with_scores(docs.select(*COLUMNS), model, name="toxicity")
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, which SimHash fingerprints and vantage-point trees find."""
    return neardup.keep_first(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    cut = suffixdedup.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    judged = decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("NOT contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL expresses neither the model's scores nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
