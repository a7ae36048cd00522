from __future__ import annotations

from spanloom.functions import expr as X
from spanloom.operators import projection as P
from spanloom.operators.revisions import diff_revisions

from .events import ANNOUNCED, EVENT, STRUCTURED, S, event, native

VERSIONS = ("v1",)


def project(spark, rows, start=0, end=1000 * S, started=0):
    sessions = spark.createDataFrame([(i, started, None) for i in range(4)], "session_id long, started_at long, parent_session_id long")
    got = P.evidence(spark.createDataFrame(rows, EVENT), sessions, start, end, VERSIONS)
    assert got.columns == [*P.EVIDENCE_KEYS, *P.EVIDENCE_VALUES]
    return got


def ids(df, kind="activity"):
    return sorted(r["source_event_id"] for r in df.filter(df["evidence_kind"] == kind).collect())


def test_two_forms_of_a_message_count_once(spark):
    form = lambda i, at, **more: event(i, at=at, native_item_id=f"i{i}", **STRUCTURED, **more)
    rows = [
        event(1, at=10 * S), form(2, 11 * S), event(3, at=100 * S, content_sha256="i"), form(4, 103 * S, content_sha256="i"), event(5, at=200 * S), form(6, 201 * S), form(7, 201 * S),
        event(8, at=300 * S, **ANNOUNCED), form(9, 303 * S, message_role="assistant", message_origin="unknown"),
    ]
    # 3 and 4 are too far apart, 5 has two partners; of the assistant's forms the announced one goes.
    assert ids(project(spark, rows)) == [1, 3, 4, 5, 6, 7, 9]
    apart = [event(1, at=10 * S), form(2, 11 * S, generation_seq=1), event(3, at=50 * S, turn_id="t"), form(4, 50 * S)]
    assert ids(project(spark, apart)) == [1, 2, 3, 4]


def test_neighbouring_copies_keep_the_first(spark):
    rows = [event(1, at=10 * S, record_index=4), event(2, at=10 * S + 50_000, record_index=5), event(3, at=10 * S + 60_000, record_index=7), event(4, at=10 * S + 70_000, record_index=8, start_offset=1)]
    got = project(spark, rows)
    assert ids(got) == [1, 3, 4] and ids(got, "prompt") == [1, 3, 4]


def test_winners_are_chosen_over_the_padded_window_before_the_cut(spark):
    key = {"logical_event_key": "k"}
    rows = [event(1, at=5 * S, **key), event(2, at=12 * S, source_priority=50, **key), event(3, at=13 * S)]
    assert ids(project(spark, rows, start=10 * S)) == [3]  # the winner lies within the padding, before the window
    assert ids(project(spark, rows, start=20 * S, end=30 * S)) == []
    assert ids(project(spark, rows, started=6 * S)) == [3]
    assert ids(project(spark, rows)) == [1, 3]
    assert ids(project(spark, [event(4, at=1 * S, **key), *rows], start=10 * S)) == [3]
    far = [event(1, at=1 * S, **key), event(2, at=12 * S, source_priority=50, **key)]
    assert ids(project(spark, far, start=10 * S)) == [2]  # the better one is out of sight


def test_prompt_identities(spark):
    at = native(500 * S)
    rows = [
        event(1, at=10 * S, native_item_id="n", content_sha256="a"), event(2, at=20 * S, actor_role="worker"), event(3, at=30 * S, content_sha256="p"), event(4, at=31 * S, content_sha256="p", native_item_id=at, **STRUCTURED),
        event(5, at=40 * S, logical_event_key="k"), event(6, at=41 * S, logical_event_key="k", source_priority=50, native_item_id="m1", **STRUCTURED), event(7, at=50 * S, logical_event_key="z", native_item_id="m2", **STRUCTURED),
        event(8, at=60 * S, content_bytes=0), event(9, at=61 * S, error_code="e"), event(10, at=62 * S, message_origin="parent_agent"), event(11, at=63 * S, content_sha256="q"), event(12, at=64 * S, scope_key=None, logical_event_key="k", content_sha256="r"),
    ]
    got = {r["source_event_id"]: (r["prompt_identity"], r["observed_at"], r["anchor_observed_at"]) for r in project(spark, rows).filter("evidence_kind = 'prompt'").collect()}
    assert got == {
        1: ("native:n", 10 * S, 10 * S), 3: (f"native:{at}", 500 * S, 30 * S), 5: ("native:m1", 40 * S, 40 * S), 11: ("event:11", 63 * S, 63 * S), 12: ("event:12", 64 * S, 64 * S),
    }


def test_rerun_and_corrections(spark):
    got = project(spark, [event(1, at=10 * S), event(2, at=20 * S)])
    stored = got.selectExpr("*", "false AS is_tombstone")
    assert diff_revisions(got, stored, P.EVIDENCE_KEYS, P.EVIDENCE_VALUES).collect() == []
    later = project(spark, [event(1, at=10 * S), event(3, at=20 * S)])
    actions = sorted((r["evidence_kind"], r["source_event_id"], r["action"]) for r in diff_revisions(later, stored, P.EVIDENCE_KEYS, P.EVIDENCE_VALUES).collect())
    assert actions == [("activity", 2, "tombstone"), ("activity", 3, "insert"), ("prompt", 2, "tombstone"), ("prompt", 3, "insert")]


def test_windows_and_activation(spark):
    start, end = P.covered(1_000_000 * X.BUCKET + 5)
    assert end == 1_000_001 * X.BUCKET and end - start == P.COVERED
    assert P.day_window(1_000_000 * X.BUCKET + 5) == (1_000_000 * X.BUCKET - X.DAY, 1_000_000 * X.BUCKET)
    none = spark.createDataFrame([], "session_id long")
    jobs = spark.createDataFrame([("complete",), ("running",)], "status string")
    assert P.activation_ready(none, jobs.filter("status = 'complete'")).first()["ready"]
    assert not P.activation_ready(none, jobs).first()["ready"]


def test_runs_refuse_the_future_and_repeat_no_receipt(spark):
    now = 1_000_000 * X.BUCKET
    start, end = P.covered(now)
    c = spark.createDataFrame([(1, 10, 2, None), (2, 20, 3, 20), (3, 30, 4, None)], "session_id long, last_id long, n long, last_future_id long")
    old = spark.createDataFrame([(1, 1, 10, 2, "p1", start, end), (3, 1, 29, 3, "p1", start, end)], "session_id long, receipt_id long, last_id long, n long, projector_version string, covered_from long, covered_through long")
    ready, fresh = P.projection_run(c, old, now, "p1")
    assert sorted(r[0] for r in ready.collect()) == [1, 3]
    assert [(r["session_id"], r["last_id"]) for r in fresh.collect()] == [(3, 30)]


def test_projected_grid_is_the_raw_one_without_copies(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import canonical, detail, grid

    end = 4 * X.BUCKET
    rows = [event(i, at=i * 40 * S, session_id=i % 3, actor_role=("primary", "worker", "unknown")[i % 3], logical_event_key="k" if i % 5 == 0 else None, native_item_id=f"n{i % 4}", content_sha256=f"h{i}") for i in range(60)]
    sessions = spark.createDataFrame([(i, 0, None) for i in range(3)], "session_id long, started_at long, parent_session_id long")
    events = spark.createDataFrame(rows, EVENT)
    revisions = P.evidence(events, sessions, 0, end, VERSIONS).withColumn("revision_id", F.lit(1)).withColumn("is_tombstone", F.lit(False))
    people = spark.createDataFrame([(1, "A"), (2, "B")], "person_id long, display_name string")
    got = P.projected_grid(revisions, people, 0, end, end).drop("latest_at")
    can = canonical.activity(events, sessions, 0, end, VERSIONS)
    prompts = detail.prompts(events, 0, end, VERSIONS).groupBy("person_id", X.bucket_start(F.col("prompt_at")).alias("bucket_at")).agg(F.count(F.lit(1)).alias("prompts"))
    raw = grid.bucket_grid(people, [grid.bucket_activity(can, 0, end), grid.day_totals(can, 0, end), prompts], 0, end).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, raw.collect()))
    payload = {r["person_id"]: r["payload"] for r in grid.day_payload(raw).collect()}
    assert payload[2] == "[[0,0,0,0],[0,0,0,0],[0,0,0,0],[0,0,0,0]]" and payload[1].count("[") == 5


def test_evidence_needs_no_more_than_what_is_about_its_window(spark):
    edges = [-7, -6, -5, 0, 5, 99, 100, 105, 106, 107]
    rows = [event(1 + n, at=at * S, **more) for n, (at, more) in enumerate((at, more) for at in edges for more in ({}, {"native_item_id": native(50 * S), **STRUCTURED}, {"native_item_id": native(500 * S), **STRUCTURED}))]
    rows += [event(100, at=5000 * S), event(101, at=5000 * S, native_item_id=native(20 * S), **STRUCTURED), event(102, at=50 * S, normalizer_version="other")]
    events = spark.createDataFrame(rows, EVENT)
    few = P.about(events, 0, 100 * S, VERSIONS)
    kept = {r["id"] for r in few.collect()}
    assert 101 in kept and not kept & {1, 100, 102}
    sessions = spark.createDataFrame([(i, 0, None) for i in range(4)], "session_id long, started_at long, parent_session_id long")
    told = lambda df: sorted(map(str, P.evidence(df, sessions, 0, 100 * S, VERSIONS).collect()))
    assert told(few) == told(events)
