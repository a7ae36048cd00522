from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.operators.canonical import canonical
from spanloom.operators.revisions import latest_revision
from spanloom.operators.sessions import session_fold
from spanloom.operators.spans import session_spans
from spanloom.streaming import state as S

SPAN = ["session_id", "span_key", *S._SPAN]


def event(r: random.Random, id_: int) -> tuple:
    kind = r.choice(["message", "lifecycle", "lifecycle", "tool_call", "tool_result", "agent_message", "usage"])
    subtype = {"lifecycle": r.choice(["task_started", "task_complete", "turn_started", "turn_complete", "other"]), "message": "user_message"}.get(kind)
    occurred = r.choice([None, r.randrange(40) * 500_000])
    at = occurred if occurred is not None else r.randrange(40) * 500_000
    return (
        r.randrange(3), id_, at, occurred, r.choice([50, 100]), kind, subtype, r.choice(["human", "unknown", None]), r.choice([None, None, "final_answer"]), r.choice([None, "completed"]),
        r.choice([None, None, "t1", "t2"]), r.choice([None, "c1", "c2"]), r.choice([None, "s"]), "v1", r.choice([None, "k1", "k2", "k3"]), r.random() < 0.1,
    )


class Stream:
    def __init__(self, spark, base, make, schema):
        self.spark, self.base, self.make, self.schema = spark, f"file://{base}", make, schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self, mode="append"):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        with S.rocks(self.spark):
            writer = self.make(source).writeStream.outputMode(mode).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True)
            if mode == "append":
                q = writer.format("parquet").option("path", f"{self.base}/out").start()
            else:
                q = writer.foreachBatch(lambda d, n: d.withColumn("batch_id", F.lit(n)).write.mode("append").parquet(f"{self.base}/out")).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return self.spark.read.parquet(f"{self.base}/out")


def whole(spark, rows):
    e = spark.createDataFrame(rows, S.EVENT).filter("NOT is_replay").dropDuplicates(["id"])
    return sorted(map(tuple, session_spans(canonical(e)).select(SPAN).collect()), key=str)


def shown(store):
    return sorted(map(tuple, latest_revision(store, ["session_id", "span_key"], "revision").select(SPAN).collect()), key=str)


def test_revisions_lead_to_what_a_recomputation_finds(spark, tmp_path):
    r = random.Random(11)
    rows = [event(r, i) for i in range(90)]
    r.shuffle(rows)  # so most events are late
    stream = Stream(spark, tmp_path, S.span_revisions, S.EVENT)
    stream.add(rows[:40])
    first = stream.run()
    assert shown(first) == whole(spark, rows[:40])
    n = first.count()
    stream.add(rows[:40])  # delivered again, after a restart
    assert stream.run().count() == n
    stream.add(rows[40:60])
    stream.add(rows[60:])
    last = stream.run()
    assert shown(last) == whole(spark, rows)
    assert last.filter("is_tombstone").count() > 0
    numbers = last.groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("revision").alias("d"), F.max("revision").alias("m")).collect()
    assert all(x["n"] == x["d"] == x["m"] for x in numbers)
    per_key = {}
    for x in sorted(last.collect(), key=lambda x: (x["session_id"], x["revision"])):
        value = tuple(x[c] for c in S._SPAN)
        assert per_key.get((x["session_id"], x["span_key"])) != value  # no revision repeats the one before
        per_key[x["session_id"], x["span_key"]] = value


def test_a_timer_gathers_corrections(spark, tmp_path):
    blank = dict.fromkeys(S._EVENT) | {"session_id": 1, "source_priority": 100, "is_replay": False, "event_kind": "lifecycle", "normalizer_version": "v1"}
    row = lambda **x: tuple((blank | x).values())
    stream = Stream(spark, tmp_path, None, S.EVENT)
    stream.add([row(id=1, at=0, event_subtype="task_started", turn_id="t"), row(id=3, at=1_000_000, event_subtype="task_started")])
    source = spark.readStream.schema(S.EVENT).parquet(f"{stream.base}/in")
    with S.rocks(spark):
        q = S.span_revisions(source, settle_ms=3000).writeStream.option("checkpointLocation", f"{stream.base}/checkpoint").trigger(processingTime="200 milliseconds").format("parquet").option("path", f"{stream.base}/out").start()
    until = time.time() + 60

    def rows():
        return spark.read.schema(S.REVISION).parquet(f"{stream.base}/out").collect() if list(tmp_path.glob("out/_spark_metadata/*")) else []

    try:
        stream.add([row(id=2, at=5_000_000, event_subtype="task_complete", turn_id="t")])
        got = []
        while time.time() < until and not any(x["state"] == "interval" for x in got):
            time.sleep(1)
            assert q.exception() is None
            got = rows()
    finally:
        q.stop()
    assert {(x["span_key"], x["state"], x["end_at"]) for x in got} >= {("turn:t", "interval", 5_000_000), ("task:3", "open", 2_000_000)}


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_sessions(spark, tmp_path, seed):
    schema = "session_id long, batch_seq long, person_id long, actor_role string, started_at long, title string, branch string"
    r = random.Random(seed)
    rows = [(r.randrange(4), i, r.choice([1, 1, 1, 2, None]), r.choice(["unknown", "primary", "worker"]), r.choice([None, r.randrange(100)]), r.choice([None, f"t{i}"]), r.choice([None, f"b{i}"])) for i in range(40)]
    r.shuffle(rows)
    stream = Stream(spark, tmp_path, lambda d: S.folded_sessions(d, ["title", "branch"]), schema)
    stream.add(rows[:15])
    stream.run("update")
    stream.add(rows[15:])
    stream.add(rows[:10])
    got = stream.run("update")
    last = got.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in got.columns if c not in ("session_id", "batch_id")]), "batch_id").alias("x")).select("session_id", "x.*")
    want = session_fold(spark.createDataFrame(rows, schema), ["session_id"], ["title", "branch"])
    assert sorted(map(tuple, last.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert not got.filter("batch_id = 3").count()  # what came again changes nothing


class Handle:
    """State in dictionaries that counts its calls."""

    def __init__(self):
        self.calls = 0

    def getMapState(self, *_):  # noqa: N802
        return Kept(self)

    getValueState = getMapState  # noqa: N815


class Kept(dict):
    def __init__(self, handle):
        self.handle = handle

    def _call(self, x):
        self.handle.calls += 1
        return x

    containsKey = lambda self, k: self._call(k in self)  # noqa: E731, N815
    getValue = lambda self, k: self._call(self[k])  # noqa: E731, N815
    updateValue = lambda self, k, v: self._call(self.update({k: v}))  # noqa: E731, N815


def test_state_is_called_by_session_not_by_event():
    """A small session takes three calls however many events it gets; a large one, kept by entries, leads to the same revisions."""
    r = random.Random(5)
    rows = [event(r, i) for i in range(300)]
    packed = [Row(session_id=e[0], row=json.dumps({k: v for k, v in zip(S._EVENT[1:], e[1:], strict=True) if v is not None})) for e in rows]
    found = []
    for small in (S.SMALL, 0, 2000):
        handle, spans = Handle(), S.SpanRevisions(small=small)
        spans.init(handle)
        found.append([x for at in range(0, 300, 60) for x in spans.handleInputRows((0,), iter(packed[at : at + 60]), None)])
        assert handle.calls <= 3 * 3 * 5 or small < S.SMALL
    assert found[0] == found[1] == found[2]
    handle, fold = Handle(), S.SessionFold(["event_subtype"])
    fold.init(handle)
    parts = [Row(session_id=e[0], row=json.dumps({"batch_seq": e[1], "event_subtype": e[6], "actor_role": "primary", "started_at": e[2], "person_id": 1})) for e in rows]
    assert len(list(fold.handleInputRows((0,), iter(parts), None))) == 3 and handle.calls <= 3 * 3
    assert not list(fold.handleInputRows((0,), iter(parts), None))


@pytest.mark.parametrize("small", [S.SMALL, 0])
def test_a_preferred_event_without_a_span_is_known_in_later_batches(small):
    """It keeps those it is preferred to out of the spans, though its own batch revises none; in a large session as well."""
    blank = dict.fromkeys(S._EVENT[1:]) | {"source_priority": 100, "is_replay": False, "event_kind": "lifecycle", "normalizer_version": "v1", "scope_key": "s", "logical_event_key": "k"}
    row = lambda **x: Row(session_id=1, row=json.dumps({k: v for k, v in (blank | x).items() if v is not None}))
    meta = row(id=1, at=1, occurred_at=1, event_subtype="session_meta")
    later = [row(id=i, at=i, occurred_at=i, event_subtype=x) for i, x in ((2, "task_started"), (3, "task_complete"))]
    handle, spans = Handle(), S.SpanRevisions(small=small)
    spans.init(handle)
    assert not [x for batch in ([meta], later, [meta]) for x in spans.handleInputRows((0,), iter(batch), None)]
    calls = handle.calls
    assert not list(spans.handleInputRows((0,), iter([meta, *later]), None))
    assert handle.calls - calls <= 4  # what came again is read and not written
