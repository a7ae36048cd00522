from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators.revisions import latest_revision
from spanloom.streaming import incremental as I

EVENT = "id long, session_id long, at long"
STORE = "session_id long, n long, last long, is_tombstone boolean, batch_id long"


def reduce(events):
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))


def _write(spark, rows, path):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def _run(spark, base, parents=None):
    stream = spark.readStream.schema(EVENT).parquet(f"{base}/in")
    q = I.keep_current(stream, f"{base}/events", f"{base}/store", f"{base}/checkpoint", reduce, ["session_id"], ["n", "last"], STORE, parents)
    q.awaitTermination(120)
    assert q.exception() is None
    return I.read_store(spark, f"{base}/store", STORE)


def test_late_and_repeated_events_leave_the_batch_result(spark, tmp_path):
    base = f"file://{tmp_path}"
    _write(spark, [(1, 1, 10), (2, 1, 20), (3, 2, 5)], f"{base}/in")
    first = _run(spark, base)
    assert sorted((r["session_id"], r["n"], r["last"]) for r in first.collect()) == [(1, 2, 20), (2, 1, 5)]
    _write(spark, [(4, 1, 1), (3, 2, 5), (5, 3, 7)], f"{base}/in")  # late, repeated, new
    store = _run(spark, base)
    assert store.filter("batch_id = 1").count() == 2  # session 2 has not changed
    now = latest_revision(store.withColumnRenamed("batch_id", "revision_id"), ["session_id"])
    whole = reduce(spark.read.schema(EVENT).parquet(f"{base}/in").dropDuplicates(["id"]))
    assert sorted((r["session_id"], r["n"], r["last"]) for r in now.collect()) == sorted((r["session_id"], r["n"], r["last"]) for r in whole.collect())
    assert _run(spark, base).count() == store.count()  # nothing new, nothing appended


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    want = spark.createDataFrame([(1, 2, 3)], "session_id long, n long, last long")
    for _ in range(2):
        I.append_revisions(want, I.read_store(spark, path, STORE), ["session_id"], ["n", "last"], 0, path)
    assert I.read_store(spark, path, STORE).count() == 1
    I.append_revisions(want.limit(0), I.read_store(spark, path, STORE), ["session_id"], ["n", "last"], 1, path)
    rows = I.read_store(spark, path, STORE).filter("batch_id = 1").collect()
    assert [(r["session_id"], r["is_tombstone"]) for r in rows] == [(1, True)]


def test_children_of_touched_sessions_are_touched(spark, tmp_path):
    base = f"file://{tmp_path}"
    _write(spark, [(1, 1, 10), (2, 2, 20)], f"{base}/in")
    parents = lambda s: s.createDataFrame([(2, 1)], "session_id long, parent_session_id long")
    _run(spark, base, parents)
    _write(spark, [(3, 1, 11)], f"{base}/in")
    store = _run(spark, base, parents)
    assert sorted(r["session_id"] for r in store.filter("batch_id = 1").collect()) == [1]


def test_bucket_counts(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2024-01-01 00:05:00'), (1L, TIMESTAMP '2024-01-01 00:09:59'), (2L, TIMESTAMP '2024-01-01 00:10:00') AS t(person_id, observed_at)").write.parquet(path)
    q = I.bucket_counts(spark.readStream.schema("person_id long, observed_at timestamp").parquet(path)).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["person_id"], r["bucket_at"].minute, r["n_events"]) for r in spark.table("buckets").collect()) == [(1, 0, 2), (2, 10, 1)]
