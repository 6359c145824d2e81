"""Request validation as columns: violations are data, so a bad row never fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges, enumerations, limits, and the codes of errors.
RANGES = {"seed": (0, 2**32 - 1), "inference_timesteps": (1, 100), "cfg_value": (2.0, 10.0), "warmup_patches": (0, 10), "max_tokens": (2, 10000), "candidates": (1, 5)}
NORMALIZATION_PROFILES, MODES = ("none", "dialogue", "narration"), ("design", "controllable", "ultimate")
TEXT_MAX, NAME = 5000, r"^[A-Za-z0-9_-]+\z"
PREPARATION_KEYS = ("text_original", "text_normalized", "text_spoken", "text_expected", "normalization", "pronunciation")
DECISIONS, RATING = ("approve", "reject", "rate"), (1, 5)
PEAK_DBFS, LUFS, MAX_BOOST = (-20.0, -0.1), (-36.0, -9.0), 12.0
REFERENCE_SECONDS, REFERENCE_RATE, REFERENCE_SILENCE = (5, 15), 16_000, 2
OOM_WORDS = ("out of memory", "insufficient memory", "allocation", "metal device")


def when_all(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in rules)))


def first_of(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that a row breaks; null if it breaks none."""
    out = F.when(F.lit(False), F.lit(""))
    for c, name in rules:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return out


def blank(text: Column) -> Column:
    """Nothing but (Unicode) white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") == ""


def out_of_range(column: str) -> Column:
    low, high = RANGES[column]
    return ~F.col(column).between(low, high)


def option_violations(columns: list[str]) -> Column:
    """Range rules of the options that are present; a missing value takes its default and breaks nothing."""
    return when_all(*((out_of_range(c), f"{c}_range") for c in RANGES if c in columns))


def line_violations(text: Column, mode: Column, instruct: Column, character: Column, id: Column) -> Column:
    return when_all(
        (blank(text), "text_blank"), (F.length(text) > TEXT_MAX, "text_too_long"), (~mode.isin(*MODES), "mode_unknown"),
        ((mode == "design") & blank(instruct), "design_needs_instruct"), ((mode != "design") & blank(character), "clone_needs_character"),
        (~F.coalesce(id.rlike(NAME), F.lit(False)), "id_charset"),
    )


def preparation_violations(preparation: Column, text: Column, keys: Column) -> Column:
    """A preparation is complete, and speaks the line's text."""
    needed = F.array(*(F.lit(k) for k in PREPARATION_KEYS))
    return F.when(preparation.isNotNull(), when_all(
        (F.size(F.array_except(needed, keys)) > 0, "preparation_incomplete"), (~F.coalesce(preparation["text_spoken"] == text, F.lit(False)), "preparation_text_differs"),
    )).otherwise(F.array().cast("array<string>"))


def repeated_ids(lines: DataFrame, project: list[str], id: str) -> DataFrame:
    """Adds ``id_repeated``: another line of the project has the same id."""
    return lines.withColumn("id_repeated", F.count("*").over(Window.partitionBy(*project, id)) > 1)


def safe_component(name: Column) -> Column:
    """A path component that stays where it is put."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\\x00]"), F.lit(False))


def contained(path: Column, root: Column) -> Column:
    """Whether a path, with its dots resolved, is under a root."""
    empty = F.array().cast("array<string>")
    walk = F.aggregate(
        F.split(path, "/"), empty,
        lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p)),
    )
    return F.startswith(F.concat(F.lit("/"), F.array_join(walk, "/")), F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def review_error(decision: Column, reviewer: Column, listened: Column, ratings: Column, notes: Column, qc: Column, transcript: Column) -> Column:
    """The first rule that a review breaks, in the order in which they are asked."""
    approve = decision == "approve"
    bad = F.exists(F.map_values(ratings), lambda r: r.isNull() | F.isnan(r) | ~r.between(*RATING))
    return first_of(
        (~F.coalesce(decision.isin(*DECISIONS), F.lit(False)), "decision_unknown"), (blank(reviewer), "reviewer_required"),
        (~F.coalesce(listened, F.lit(False)), "listening_required"), (bad, "rating_range"), (approve & (qc == "FAIL"), "failed_audio"),
        (approve & ((qc == "WARN") | ~F.coalesce(transcript == "PASS", F.lit(False))) & blank(notes), "notes_required"),
    )


def mastering_error(peak_dbfs: Column, lufs: Column, gain: Column) -> Column:
    bad = lambda c, low, high: c.isNotNull() & (F.isnan(c) | ~c.between(low, high))
    return first_of((bad(peak_dbfs, *PEAK_DBFS), "peak_range"), (bad(lufs, *LUFS), "loudness_range"), (gain > MAX_BOOST, "boost_too_large"))


def reference_rules(s: Column) -> tuple[Column, Column]:
    """Refusals and advice for a reference clip, from its statistics."""
    refused = when_all((s["has_nan"] | s["has_inf"], "not_finite"), (s["clipping"], "clipping"), (s["peak"] <= 1e-5, "silent"))
    advice = when_all(
        (~s["duration"].between(*REFERENCE_SECONDS), "duration"), (s["sample_rate"] < REFERENCE_RATE, "sample_rate"),
        (s["channels"] != 1, "channels"), (s["longest_silence_seconds"] > REFERENCE_SILENCE, "silence"),
    )
    return refused, advice


def complete_take(length: Column, has_metadata: Column) -> Column:
    return (length > 1024) & has_metadata


def usable_selection(choice: Column) -> Column:
    return F.coalesce(choice.isin(1, 2, 3), F.lit(False))


def split_selection_key(key: Column) -> tuple[Column, Column]:
    """``character/style``; later slashes belong to the style."""
    parts = F.split(key, "/", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def is_out_of_memory(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(False)
    for w in OOM_WORDS:
        out = out | F.contains(low, F.lit(w))
    return out


def calibration_sample(listened: Column, reviewer: Column, transcript: Column, correct: Column, recognized: Column) -> Column:
    return F.coalesce(listened, F.lit(False)) & ~blank(reviewer) & ~blank(transcript) & correct.eqNullSafe(F.lit(True)) & recognized.isNotNull()


def rtf(seconds: Column, duration: Column) -> Column:
    """Real-time factor; null without a duration."""
    return F.try_divide(seconds, F.nullif(duration, F.lit(0)))


def json_defaults(source: Column, defaults: dict[str, object]) -> Column:
    """Fields of a JSON object as texts; a default stands for a key that is missing, not for one that is null."""
    keys = F.json_object_keys(source)
    field = lambda k, v: F.when(F.array_contains(keys, k), F.get_json_object(source, f"$.{k}")).when(keys.isNotNull(), F.lit(v).cast("string")).alias(k)
    return F.struct(*(field(k, v) for k, v in defaults.items()))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns and nulls take a default. A column can't tell a null from a missing key; both are filled."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})
