"""Operators that write: projection runs, published results; and FIFO pairs over ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import checks, projection
from spanloom.operators.intervals import fifo_pairs, fifo_pairs_spread
from spanloom.operators.revisions import latest_revision

from .events import EVENT, S, event

E = "part string, id long, at long, start boolean"


@pytest.mark.parametrize("seed", range(3))
def test_ranges_give_what_one_window_gives(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 8 + ["b", "c", None]), i, r.randrange(60), r.random() < (0.35, 0.5, 0.65)[seed]) for i in range(400)]
    d = spark.createDataFrame(rows, E)
    one = sorted(map(str, fifo_pairs(d, "part", "at", "id", F.col("start")).collect()))
    spread = fifo_pairs_spread(d, "part", "at", "id", F.col("start"))
    assert sorted(map(str, spread.select("part", "start_id", "start_at", "end_id", "end_at").collect())) == one


def test_a_hot_part_lies_in_several_ranges(spark):
    n = 4000
    d = spark.range(n).select(F.lit("hot").alias("part"), "id", F.col("id").alias("at"), (F.col("id") % 2 == 0).alias("start"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fifo_pairs_spread(d, "part", "at", "id", F.col("start"))
        assert got.filter("end_id = start_id + 1").count() == n // 2 == got.count()
        dealt = d.repartitionByRange("part", "at", "id").groupBy(F.spark_partition_id()).count().collect()
        assert max(x["count"] for x in dealt) < n / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


GRID = "person_id long, display_name string, bucket_at long, agents long, subagents long, others long, prompts long, day_agents long, day_subagents long, day_others long"


def test_only_a_result_that_keeps_its_rules_is_published(spark):
    rows = [(1, "a", b, 1, 0, 0, 2, 1, 0, 0) for b in range(3)]
    good = spark.createDataFrame(rows, GRID)
    whole = {"three buckets each": "count(*) % 3 = 0"}
    assert checks.published(good, "grid", checks.GRID, whole).count() == 3
    assert checks.published(good.limit(0), "grid", checks.GRID, whole).count() == 0
    bad = spark.createDataFrame([*rows, (1, None, 3, 5, 0, 0, -1, 1, 0, 0)], GRID)
    with pytest.raises(checks.BrokenRules) as e:
        checks.published(bad, "grid", checks.GRID, whole)
    assert e.value.counts == {"bucket within day": 1, "counts": 1, "named": 1, "three buckets each": -1}


NOW = 40 * 60 * 60 * S


def sessions(spark, n=3):
    return spark.createDataFrame([(i, 1, 0, None) for i in range(1, n + 1)], "session_id long, person_id long, started_at long, parent_session_id long")


def run(spark, path, rows, n, now=NOW):
    receipts = projection.run_projection(spark.createDataFrame(rows, EVENT), sessions(spark), path, now, ("v1",), n)
    return sorted(r["session_id"] for r in receipts.collect())


def shown(spark, path):
    last = latest_revision(projection.evidence_store(spark, path)[1], projection.EVIDENCE_KEYS)
    return sorted((r["evidence_kind"], r["source_event_id"]) for r in last.collect())


def test_projection_runs(spark, tmp_path):
    path, at = f"file://{tmp_path}/evidence", NOW - 60 * 60 * S
    first = [event(1, at=at), event(2, at=at + S, session_id=2, event_kind="tool_call", event_subtype=None, message_role=None, message_origin=None)]
    assert run(spark, path, first, 1) == [1, 2]
    assert shown(spark, path) == [("activity", 1), ("activity", 2), ("prompt", 1)]
    assert run(spark, path, first, 2) == []  # nothing new, no receipt, no revision
    # A preferred record of the same thing comes late: the former is taken back.
    keyed = [event(3, at=at, session_id=3, logical_event_key="k"), event(4, at=at, session_id=3, logical_event_key="k", source_priority=200)]
    assert run(spark, path, [*first, keyed[0]], 3) == [3]
    assert run(spark, path, [*first, *keyed], 4) == [3]
    assert ("activity", 3) not in shown(spark, path) and ("activity", 4) in shown(spark, path)
    # The run again leaves the same; a session with a future event is refused until its time has come.
    assert run(spark, path, [*first, *keyed], 4) == [3]
    later = event(5, at=NOW + 3600 * S, session_id=2)
    assert run(spark, path, [*first, *keyed, later], 5) == []
    assert run(spark, path, [*first, *keyed, later], 6, NOW + 2 * 3600 * S) == [1, 2, 3]
    assert ("activity", 5) in shown(spark, path)


def test_revisions_without_a_receipt_do_not_count(spark, tmp_path):
    path, at = f"file://{tmp_path}/evidence", NOW - 60 * 60 * S
    run(spark, path, [event(1, at=at)], 1)
    spark.read.parquet(f"{path}/revisions").withColumn("revision_id", F.lit(9).cast("long")).withColumn("source_event_id", F.lit(77).cast("long")).withColumn("run", F.lit(9)).write.mode("append").partitionBy("run").parquet(f"{path}/revisions")
    assert ("activity", 77) not in shown(spark, path)


def test_threads_that_write_leave_the_setting_as_it_was(spark):
    from concurrent.futures import ThreadPoolExecutor

    from spanloom.sources import scratch

    before = spark.conf.get(scratch._CLEANUP, "false")
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda n: scratch.written(spark.range(n), "threads").count(), range(1, 9)))
    assert counts == list(range(1, 9)) and spark.conf.get(scratch._CLEANUP, "false") == before


def test_a_frame_ranks_its_sessions_only(spark):
    from spanloom.operators.canonical import activity

    e = spark.createDataFrame([event(1, at=0), event(2, at=50 * S, session_id=2), event(3, at=200 * S, session_id=3), event(4, at=210 * S, session_id=1), event(5, at=95 * S, session_id=3)], EVENT)
    framed = activity(e, sessions(spark), 0, 1000 * S, ("v1",), frame=(100 * S, 205 * S))
    assert sorted(r["id"] for r in framed.collect()) == [1, 3, 4, 5]  # session 1 by its event within the padding, all of its own
    assert "LeftSemi" in framed._jdf.queryExecution().optimizedPlan().toString()
