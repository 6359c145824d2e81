"""Attempt planning, early stop, ranking and first-occurrence selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarlake.functions.align import accepted_automatically

# Generation profiles (steps, early stop, experimental) and the seed stride.
PROFILES = {
    "production": ([10, 20, 30], True, False),
    "fast": ([10], True, True),
    "balanced": ([10, 20], True, True),
    "quality": ([10, 20, 30], True, True),
    "ultimate": ([30, 30, 30], False, False),
}
SEED_STRIDE, SEED_SPACE = 3365, 2**32
MAX_CANDIDATES, MAX_STEPS = 5, 100


def profiles(spark: SparkSession) -> DataFrame:
    """The profile dimension: name, steps, early_stop, experimental."""
    rows = ", ".join(f"('{k}', array({', '.join(map(str, s))}), {str(e).lower()}, {str(x).lower()})" for k, (s, e, x) in PROFILES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, steps, early_stop, experimental)")


def profile_error(steps: Column) -> Column:
    bad = (F.size(steps) < 1) | (F.size(steps) > MAX_CANDIDATES) | F.exists(steps, lambda s: ~s.between(1, MAX_STEPS))
    return F.when(F.coalesce(bad, F.lit(True)), "configuration_error")


def seed_of(seed: Column, position: Column) -> Column:
    return F.pmod(seed.cast("long") + position * SEED_STRIDE, F.lit(SEED_SPACE))


def custom_steps(steps: Column, candidates: Column) -> Column:
    """The schedule without a profile: the same steps for each candidate."""
    return F.array_repeat(steps, candidates)


def plan_error(candidates: Column, seed: Column, steps: Column) -> Column:
    fine = candidates.between(1, MAX_CANDIDATES) & seed.between(0, SEED_SPACE - 1) & steps.between(1, MAX_STEPS)
    return F.when(~F.coalesce(fine, F.lit(False)), "configuration_error")


def plan_attempts(lines: DataFrame, steps: str = "steps", seed: str = "seed") -> DataFrame:
    """One row per attempt: candidate (from 1), attempt_seed, inference_timesteps."""
    rows = lines.select(*lines.columns, F.posexplode(steps).alias("_pos", "inference_timesteps"))
    return rows.withColumn("candidate", F.col("_pos") + 1).withColumn("attempt_seed", seed_of(F.col(seed), F.col("_pos"))).drop("_pos")


def rank_key(qc: Column, transcript: Column, cer: Column) -> list[Column]:
    """Best first: no failures, no transcript failure, a pass, the least error rate (missing counts as 1)."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [1 - yes(qc == "FAIL"), 1 - yes(transcript == "FAIL"), yes(qc == "PASS"), -F.coalesce(cer, F.lit(1.0))]


def rank_candidates(attempts: DataFrame, line: list[str], position: list[str], qc: str = "qc", transcript: str = "transcript", cer: str = "cer") -> DataFrame:
    """Adds ``rank`` and ``recommended``; only PASS and WARN are eligible, and the first of equals wins."""
    key = rank_key(F.col(qc), F.col(transcript), F.col(cer))
    eligible = F.coalesce(F.col(qc).isin("PASS", "WARN"), F.lit(False))
    order = Window.partitionBy(*line).orderBy(eligible.desc(), *(k.desc() for k in key), *position)
    ranked = attempts.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("recommended", (F.col("rank") == 1) & eligible)


def select_best(attempts: DataFrame, line: list[str], position: list[str], qc: str = "qc", transcript: str = "transcript", cer: str = "cer") -> DataFrame:
    """The recommended attempt of each line: a least key, which tasks find before rows move; lines without an eligible one have none."""
    key = [-k for k in rank_key(F.col(qc), F.col(transcript), F.col(cer))]
    order = F.struct(*(k.alias(f"k{n}") for n, k in enumerate(key)), *position)
    eligible = attempts.where(F.col(qc).isin("PASS", "WARN"))
    best = eligible.groupBy(*line).agg(F.min_by(F.struct(*attempts.columns), order).alias("_best"))
    return best.select("_best.*").withColumns({"rank": F.lit(1), "recommended": F.lit(True)})


def early_stop(attempts: DataFrame, line: list[str], position: list[str], qc: str = "qc", transcript: str = "transcript", enabled: Column | None = None) -> DataFrame:
    """The attempts up to the first that is accepted, which is the last to run.

    Where ``enabled`` (a profile's flag) is false or null all attempts run; a schedule without a profile has no flag.
    """
    before = Window.partitionBy(*line).orderBy(*position).rowsBetween(Window.unboundedPreceding, -1)
    accepted = accepted_automatically(F.col(qc), F.col(transcript))
    done = F.max(accepted if enabled is None else accepted & F.coalesce(enabled, F.lit(False))).over(before)
    return attempts.withColumn("_done", F.coalesce(done, F.lit(False))).where("NOT _done").drop("_done")


def first_occurrence(df: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """The first row of each key, by position."""
    order = Window.partitionBy(*key).orderBy(*position)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def newest_valid(revisions: DataFrame, project: list[str], number: str = "revision", valid: str = "valid") -> DataFrame:
    """Per project the newest valid revision (null if none) and the next free number."""
    return revisions.groupBy(*project).agg(
        F.max(F.when(F.col(valid), F.col(number))).alias("reusable"), (F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_revision"),
    )


def attempts_to_run(plan: DataFrame, outputs: DataFrame, errors: DataFrame, output: str = "output", hash: str = "attempt_hash") -> DataFrame:
    """Each attempt's ``action``: reuse an equal output, stop at a conflicting one, skip an equal failure, else run."""
    made = outputs.select(F.col(output).alias("_o"), F.col(hash).alias("_oh"))
    failed = errors.select(F.col(output).alias("_e"), F.col(hash).alias("_eh"))
    joined = plan.join(made, F.col(output) == F.col("_o"), "left").join(failed, F.col(output) == F.col("_e"), "left")
    action = (
        F.when(F.col("_o").isNotNull() & (F.col("_oh") == F.col(hash)), "reuse").when(F.col("_o").isNotNull(), "conflict")
        .when(F.col("_eh") == F.col(hash), "skip").otherwise("run")
    )
    return joined.withColumn("action", action).drop("_o", "_oh", "_e", "_eh")


def remaining(lines: DataFrame, completed: DataFrame, on: list[str]) -> DataFrame:
    """Lines that aren't complete yet."""
    return lines.join(completed.select(*on).distinct(), on, "left_anti")
