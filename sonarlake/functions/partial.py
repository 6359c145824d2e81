"""Signal statistics of clips that are cut in parts: a state for each part, and a merge that gives the whole clip's.

A state is a struct of sums, extremes, the runs at both ends and the outer samples, so a neighbour can be joined without
the samples: jumps, edges and silent runs reach over the border. The merge is associative over neighbours; ``clip_stats``
first merges runs of FAN parts, so no list holds more than FAN states until a clip has more than FAN * FAN parts.

Defined cases: an empty part changes nothing. A clip whose parts are all empty has the statistics of an empty clip.
Parts go by their number; a number that repeats is merged twice, as its samples are there twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.functions import signal

#: States of a clip that are merged at once.
FAN = 1024
_RUNS = ("lead", "tail", "quiet_lead", "quiet_tail")


def state(a: Column, silence: float = signal.SILENCE, edge: float = signal.EDGE) -> Column:
    """What a part's samples come to."""
    n = F.size(a).cast("long")
    total = lambda f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    run = lambda x, level: F.coalesce(F.nullif(F.array_position(F.transform(x, lambda v: level(v)), True), F.lit(0)) - 1, n)
    active, loud = (lambda v: F.abs(v) > edge), (lambda v: F.coalesce(~(F.abs(v) < silence), F.lit(True)))

    def step(s, x):
        now = F.when(F.abs(x) < silence, s["now"] + 1).otherwise(F.lit(0).cast("long"))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    zero = F.lit(0).cast("long")
    longest = F.aggregate(a, F.struct(zero.alias("now"), zero.alias("best")), step, lambda s: s["best"])
    return F.struct(
        n.alias("n"), total(lambda x: x).alias("sum"), total(lambda x: x * x).alias("square"), signal.peak(a).alias("peak"),
        signal.clipping(a).alias("clipping"), signal.has_nan(a).alias("has_nan"), signal.has_inf(a).alias("has_inf"),
        F.size(F.filter(a, lambda x: F.abs(x) < silence)).cast("long").alias("quiet"), signal.max_jump(a).alias("jump"),
        F.get(a, F.lit(0)).cast("double").alias("first"), F.get(a, F.size(a) - 1).cast("double").alias("last"),
        run(a, active).alias("lead"), run(F.reverse(a), active).alias("tail"), run(a, loud).alias("quiet_lead"), run(F.reverse(a), loud).alias("quiet_tail"), longest.alias("longest"),
    )


def merged(x: Column, y: Column) -> Column:
    """The state of two neighbours."""
    border = F.when((x["n"] > 0) & (y["n"] > 0), F.abs(y["first"] - x["last"])).otherwise(F.lit(0.0))
    ahead = lambda k: F.when(x[k] == x["n"], x["n"] + y[k]).otherwise(x[k])
    behind = lambda k: F.when(y[k] == y["n"], y["n"] + x[k]).otherwise(y[k])
    return F.struct(
        *((x[k] + y[k]).alias(k) for k in ("n", "sum", "square")), F.greatest(x["peak"], y["peak"]).alias("peak"), *((x[k] | y[k]).alias(k) for k in ("clipping", "has_nan", "has_inf")),
        (x["quiet"] + y["quiet"]).alias("quiet"), F.greatest(x["jump"], y["jump"], border).alias("jump"),
        F.when(x["n"] > 0, x["first"]).otherwise(y["first"]).alias("first"), F.when(y["n"] > 0, y["last"]).otherwise(x["last"]).alias("last"),
        ahead("lead").alias("lead"), behind("tail").alias("tail"), ahead("quiet_lead").alias("quiet_lead"), behind("quiet_tail").alias("quiet_tail"),
        F.greatest(x["longest"], y["longest"], x["quiet_tail"] + y["quiet_lead"]).alias("longest"),
    )


def folded(states: Column) -> Column:
    """An array of neighbouring states as one."""
    return F.aggregate(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0))), F.element_at(states, 1), merged)


def finished(s: Column, rate: Column, channels: Column | None = None, subtype: Column | None = None) -> Column:
    """``signal.stats`` of the whole clip."""
    n = F.nullif(s["n"], F.lit(0))
    seconds = lambda frames: F.coalesce(F.try_divide(frames.cast("double"), rate), F.lit(0.0))
    return F.struct(
        rate.alias("sample_rate"), (F.lit(1) if channels is None else channels).alias("channels"), s["n"].alias("frames"), seconds(s["n"]).alias("duration"), s["peak"].alias("peak"),
        F.coalesce(F.sqrt(s["square"] / n), F.lit(0.0)).alias("rms"), s["clipping"].alias("clipping"), s["has_nan"].alias("has_nan"), s["has_inf"].alias("has_inf"),
        (F.lit(None).cast("string") if subtype is None else subtype).alias("subtype"), F.coalesce(s["sum"] / n, F.lit(0.0)).alias("dc_offset"), F.coalesce(s["quiet"] / n, F.lit(1.0)).alias("silence_ratio"),
        s["jump"].alias("max_sample_jump"), F.struct(seconds(s["lead"]).alias("start"), seconds(s["tail"]).alias("end")).alias("edge_silence_seconds"), seconds(s["longest"]).alias("longest_silence_seconds"),
    )


def clip_states(parts: DataFrame, clip: list[str], part: str = "chunk", samples: str = "samples", silence: float = signal.SILENCE, edge: float = signal.EDGE) -> DataFrame:
    """One row per clip with ``state``; only states are shuffled."""
    rows = parts.select(*clip, F.col(part).alias("_p"), state(F.col(samples), silence, edge).alias("_s"))
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda r: r["_s"])
    runs = rows.groupBy(*clip, F.floor(F.col("_p") / FAN).alias("_p")).agg(ordered().alias("_l")).select(*clip, "_p", folded(F.col("_l")).alias("_s"))
    return runs.groupBy(*clip).agg(ordered().alias("_l")).select(*clip, folded(F.col("_l")).alias("state"))


def clip_stats(parts: DataFrame, clip: list[str], rate: str = "sample_rate", channels: str | None = None, subtype: str | None = None, part: str = "chunk", samples: str = "samples",
               silence: float = signal.SILENCE, edge: float = signal.EDGE) -> DataFrame:
    """One row per clip with ``stats``; rate, channels and subtype are equal in all parts of a clip."""
    facts = [c for c in (rate, channels, subtype) if c]
    whole = clip_states(parts, [*clip, *facts], part, samples, silence, edge)
    named = lambda c: None if c is None else F.col(c)
    return whole.select(*clip, finished(F.col("state"), F.col(rate), named(channels), named(subtype)).alias("stats"))
