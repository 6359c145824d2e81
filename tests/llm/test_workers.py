import random

import pyarrow as pa
from llm_helpers import prose
from pyspark.sql import functions as F

from sonarlake.llm import decontam, packing, session, tokens
from sonarlake.llm.tokencount import length_histogram


def held(df):
    """What the workers of a map stage after others still have of them, in its tasks."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(decontam._MEMO) + len(tokens._ENCODERS)] * b.num_rows, pa.int64())], ["n"])

    return [r["n"] for r in session.map_slices(df, work, "n long").collect()]


def test_workers_carry_nothing_into_later_stages(spark, docs):
    rng = random.Random(5)
    some = docs([(i, prose(rng, 30)) for i in range(64)]).repartition(8)
    items = spark.createDataFrame([("i", prose(rng, 20))], "item_id string, text string")
    assert decontam.decontaminate(some, items).count() == 64
    assert set(held(some)) == {0}
    assert length_histogram(some).agg(F.sum("n_docs")).first()[0] == 64
    assert set(held(some)) == {0}
    assert packing.pack_documents(some).agg(F.sum("length")).first()[0] > 64
    assert set(held(some)) == {0}


def test_caches_stay_for_a_stage(monkeypatch):
    class Task:
        def __init__(self, stage):
            self.stage = stage

        def stageId(self):
            return self.stage

    emptied = []
    monkeypatch.setattr(session, "KEPT", [lambda: emptied.append(session._stage)])
    monkeypatch.setattr(session, "_stage", None)
    for stage in (None, 3, 3, 4, None, 4, 3):
        monkeypatch.setattr(session.TaskContext, "get", staticmethod(lambda s=stage: None if s is None else Task(s)))
        session.enter_stage()
    assert emptied == [3, 4, 3]
