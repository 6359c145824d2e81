"""The review ledger as state: each candidate's reviews in the order of their time, however they come in.

A stream of events, candidates and reviews, is keyed by the audio's hash. What comes in is held until the watermark has passed
its time, which a timer tells; then events are taken in order. A candidate opens its ledger. A review is checked by the
rules of ``validate.review_error``; the first one that approves or rejects closes the ledger. A review that repeats an id, comes
after the decision or more than OPEN seconds after the candidate, or has no candidate by then, is refused. ``ledger`` gives
the same rows for tables, by windows.

The rules are columns, and what they depend on in the candidate has few values; so they are asked for each of these
beforehand, and the state only picks an answer. No rule is written twice.

Defined cases: candidates that repeat count once, the earliest, and of one time the least qc and transcript. Events of one
time go by kind (candidates first), then review id. Events older than the watermark are dropped by Spark before the state
sees them. Null keys, times and review ids are refused as ``event_invalid`` in the batch and dropped in the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sonarlake import ship
from sonarlake.operators.validate import review_error

#: Seconds that a candidate may be reviewed for, and how late an event may come.
OPEN, LATE = 7 * 24 * 3600, "1 hour"
STATUSES = ("PASS", "WARN", "FAIL")
CLOSING = ("approve", "reject")
EVENT = "kind string, audio_sha256 string, time timestamp, review_id string, decision string, reviewer string, listened boolean, ratings map<string,double>, notes string, qc string, transcript string"
LEDGER = T.StructType([T.StructField("audio_sha256", T.StringType()), T.StructField("review_id", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("error_code", T.StringType())])


def _statuses(qc: Column, transcript: Column) -> Column:
    """What the rules see of a candidate, as one of few texts."""
    return F.concat_ws("/", F.when(qc.isin(*STATUSES), qc).otherwise(""), F.when(transcript == "PASS", transcript).otherwise(""))


def answers() -> Column:
    """The rules' answer to a review, by what they see of its candidate; fine reviews have an empty one."""
    c = F.col
    every = [(q, t) for q in (*STATUSES, "") for t in ("PASS", "")]
    rule = lambda q, t: F.coalesce(review_error(c("decision"), c("reviewer"), c("listened"), c("ratings"), c("notes"), F.lit(q or None).cast("string"), F.lit(t or None).cast("string")), F.lit(""))
    return F.create_map(*(x for q, t in every for x in (F.lit(f"{q}/{t}"), rule(q, t))))


def _prepared(events: DataFrame) -> DataFrame:
    known = F.when(F.col("kind") == "candidate", _statuses(F.col("qc"), F.col("transcript")))
    return events.select("kind", "audio_sha256", "time", F.unix_millis("time").alias("ms"), F.coalesce("review_id", F.lit("")).alias("review_id"), "decision", known.alias("status"), answers().alias("answers"))


def ledger(events: DataFrame, open_seconds: int = OPEN) -> DataFrame:
    """(audio_sha256, review_id, decision, error_code) of the reviews of a table of events."""
    rows = _prepared(events).withColumn("_bad", F.col("audio_sha256").isNull() | F.col("ms").isNull() | ((F.col("kind") == "review") & (F.col("review_id") == "")))
    first = rows.where("kind = 'candidate' AND NOT _bad").groupBy("audio_sha256").agg(F.min(F.struct("ms", "status")).alias("c")).select(F.col("audio_sha256").alias("_key"), "c.*").withColumnRenamed("ms", "_from").withColumnRenamed("status", "_status")
    reviews = rows.where("kind = 'review'").drop("status").join(first, F.col("audio_sha256") == F.col("_key"), "left")
    again = F.row_number().over(Window.partitionBy("audio_sha256", "review_id").orderBy("ms")) > 1
    there = F.coalesce(F.col("_from") <= F.col("ms"), F.lit(False))
    late = F.col("ms") > F.col("_from") + open_seconds * 1000
    own = F.when(F.col("_bad"), "event_invalid").when(F.col("_again"), "review_repeated").when(~there, "candidate_changed").when(late, "review_late").otherwise(F.nullif(F.get(F.array(F.col("answers")[F.col("_status")]), F.lit(0)), F.lit("")))
    judged = reviews.withColumn("_again", again).withColumn("_own", own)
    closes = F.col("_own").isNull() & F.col("decision").isin(*CLOSING)
    before = Window.partitionBy("audio_sha256").orderBy("ms", "review_id").rowsBetween(Window.unboundedPreceding, -1)
    decided = F.coalesce(F.max(F.when(closes, 1)).over(before), F.lit(0)) == 1
    keeps = F.col("_own").isNull() | F.col("_own").isin("event_invalid", "review_repeated", "candidate_changed", "review_late")
    error = F.when(~keeps & decided, "already_decided").when(F.col("_own").isNotNull(), F.col("_own")).when(decided, "already_decided")
    return judged.select("audio_sha256", F.nullif("review_id", F.lit("")).alias("review_id"), "decision", error.alias("error_code"))


class Reviews(StatefulProcessor):
    def __init__(self, open_seconds: int):
        self.open_seconds = open_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "kind string, ms long, review_id string, decision string, status string, answers string")
        self.seen = handle.getMapState("seen", "review_id string", "n int")
        # From when on the candidate is there, what the rules see of it, and whether it is decided.
        self.candidate = handle.getValueState("candidate", "since long, status string, decided boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.held.appendValue((r["kind"], r["ms"], r["review_id"], r["decision"], r["status"], r["answers"]))
            self.handle.registerTimer(r["ms"] + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = [tuple(r) for r in self.held.get()]
        now = sorted((r for r in rows if r[1] < due), key=lambda r: (r[1], r[0] != "candidate", r[4] or "", r[2]))
        rest = [r for r in rows if r[1] >= due]
        if not now:
            return
        self.held.put(rest) if rest else self.held.clear()
        for kind, ms, review, decision, status, answer in now:
            known = self.candidate.get() if self.candidate.exists() else None
            if kind == "candidate":
                if known is None:
                    self.candidate.update((ms, status, False))
                continue
            yield Row(audio_sha256=key[0], review_id=review, decision=decision, error_code=self._taken(known, ms, review, decision, answer))

    def _taken(self, known, ms: int, review: str, decision: str, answer: str) -> str | None:
        if self.seen.containsKey((review,)):
            return "review_repeated"
        self.seen.updateValue((review,), (1,))
        if known is None:
            return "candidate_changed"
        since, status, decided = known
        if ms > since + self.open_seconds * 1000:
            return "review_late"
        if decided:
            return "already_decided"
        error = json.loads(answer)[status] or None
        if error is None and decision in CLOSING:
            self.candidate.update((since, status, True))
        return error

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, open_seconds: int = OPEN, late: str = LATE) -> DataFrame:
    """``ledger`` of a stream of events. The state store must be RocksDB's, which arbitrary state asks for."""
    ship(events.sparkSession)
    rows = _prepared(events.withWatermark("time", late)).where("audio_sha256 IS NOT NULL AND ms IS NOT NULL AND (kind <> 'review' OR review_id <> '')")
    rows = rows.withColumn("answers", F.to_json("answers"))  # state holds plain values
    return rows.groupBy("audio_sha256").transformWithState(statefulProcessor=Reviews(open_seconds), outputStructType=LEDGER, outputMode="Append", timeMode="EventTime")
