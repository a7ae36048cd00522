from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from spanloom.functions import expr as X
from spanloom.operators import canonical, checks, detail, freshness, grid, intervals, jobs, pairing, predicates, revisions, sessions
from .events import EVENT, STRUCTURED, S, event, native


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_canonical_prefers_priority_then_time_then_id(spark):
    k = {"logical_event_key": "k"}
    rows = [
        event(1, source_priority=50, **k), event(2, **k), event(3, occurred_at=None, **k), event(4), event(5, logical_event_key="other"), event(6, event_kind="usage", **k), event(7, session_id=2, **k),
        event(8, scope_key=None, **k), event(9, scope_key=None, **k), event(10, scope_key="stream:1", **k), event(11, normalizer_version="v2", **k),
    ]
    for order in (rows, rows[::-1]):
        assert ids(canonical.canonical(spark.createDataFrame(order, EVENT))) == [2, 4, 5, 6, 7, 8, 9, 10, 11]


def test_canonical_ties(spark):
    k = {"logical_event_key": "k"}
    rows = [event(8, occurred_at=None, **k), event(7, occurred_at=100, **k), event(9, occurred_at=100, **k)]
    assert ids(canonical.canonical(spark.createDataFrame(rows, EVENT))) == [7]


def test_eligibility(spark):
    rows = [
        event(1), event(2, is_replay=True), event(3, actor_role="automation"), event(4, actor_role=None), event(5, event_kind="error"), event(6, event_kind="lifecycle", event_subtype="hook"), event(7, event_kind="lifecycle", event_subtype="task_started"),
        event(8, actor_role="worker"), event(9, event_kind="usage"), event(10, event_kind="agent_message"), event(11, event_kind="agent_spawn"), event(12, **STRUCTURED), event(13, native_item_id="i", **STRUCTURED), event(14, event_kind="plan"),
    ]
    df = spark.createDataFrame(rows, EVENT)
    assert ids(df.filter(predicates.is_activity())) == [1, 5, 7, 8, 10, 11, 13]
    more = [event(20, message_origin="parent_agent"), event(21, message_role="assistant"), event(22, content_sha256=None), event(23, content_bytes=0), event(24, error_code="e"), event(25, content_bytes=None)]
    assert ids(spark.createDataFrame([*rows, *more], EVENT).filter(predicates.is_prompt())) == [1, 12, 13]


def test_activity_leaves_out_what_a_session_copied_from_before_its_start(spark):
    """A child's records from before its start are its parent's history; winners are chosen first, so a key whose winner
    is such a copy is gone. The start counts to the millisecond, and native ids tell when a record was made."""
    m = lambda n: n * 60 * S
    copied = lambda i, session, at, seen, **more: event(i, session_id=session, at=seen, native_item_id=native(at, i), **more)
    key = {"logical_event_key": "same", "scope_key": "session:7"}
    rows = [
        copied(1, 1, m(10), m(10)), copied(2, 2, m(20), m(61), actor_role="worker"), copied(3, 3, m(120), m(122), actor_role="worker"), copied(4, 4, m(30), m(62), actor_role="unknown"), event(5, session_id=4, at=m(70), actor_role="unknown"),
        event(6, session_id=5, at=m(65), actor_role="worker"), copied(7, 6, m(40), m(40) + 1000, actor_role="guardian"), copied(8, 7, m(50), m(63), **key), event(9, session_id=7, at=m(80), source_priority=10, **key),
        event(10, session_id=8, at=m(90), actor_role="unknown"), event(11, session_id=9, at=m(100), actor_role="automation"), event(12, session_id=1, at=m(200)), event(13, session_id=1, at=m(11), normalizer_version="v0"),
    ]
    sessions = [(1, 0, None), (2, m(60), 1), (3, m(121), 1), (4, m(60), 1), (5, m(60), 1), (6, m(40) + 500, 1), (7, m(60), None), (8, m(60), None), (9, m(60), None)]
    got = canonical.activity(spark.createDataFrame(rows, EVENT), spark.createDataFrame(sessions, "session_id long, started_at long, parent_session_id long"), 0, m(150), ("v1",))
    assert {r["id"]: r["actor_role"] for r in got.collect()} == {1: "primary", 5: "worker", 6: "worker", 7: "guardian", 10: "unknown"}


def test_roster(spark):
    people = spark.createDataFrame([(1, " Ann ", "k1", "a@a.example", None), (2, None, "k2", "b@a.example", "smoke"), (3, "", "k3", "c@a.example", "x"), (4, "D", "k4", "d@b.example", None), (5, "E", "k5", "e@a.example@b", None), (6, "F", "k6", None, None)], "person_id long, name string, identity_key string, email string, external_id string")
    got = {r["person_id"]: r["display_name"] for r in predicates.roster(people, "a.example").collect()}
    assert got == {1: "Ann", 3: "k3"}


def _greedy(rows):
    """rows (at, id, starts): each start takes the earliest later completion that is free."""
    rows = sorted(rows)
    ends = [r for r in rows if not r[2]]
    used, out = set(), []
    for at, i, starts in rows:
        if starts:
            e = next((x for x in ends if (x[0], x[1]) > (at, i) and x[1] not in used), None)
            if e:
                used.add(e[1])
            out.append((i, e and e[1]))
    return sorted(out, key=str) + sorted([(None, e[1]) for e in ends if e[1] not in used], key=str)


def test_fifo_pairs_are_greedy(spark):
    r = random.Random(7)
    rows = [(part, r.randint(0, 8), part * 1000 + i, r.random() < 0.5) for part in range(120) for i in range(r.randint(0, 14))]
    got: dict = {}
    for x in intervals.fifo_pairs(spark.createDataFrame(rows, "part long, at long, id long, s boolean"), "part", "at", "id", F.col("s")).collect():
        got.setdefault(x["part"], []).append((x["start_id"], x["end_id"]))
    for part in {x[0] for x in rows}:
        want = _greedy([x[1:] for x in rows if x[0] == part])
        assert sorted(got[part], key=str) == sorted(want, key=str)


def _turns(spark, rows):
    df = spark.createDataFrame(rows, "turn string, id long, at long, event_kind string, event_subtype string, message_origin string, phase string")
    return {r["turn"]: r for r in intervals.turn_spans(df, ["turn"]).collect()}


def test_turn_spans(spark):
    got = _turns(spark, [
        ("open", 1, 10 * S, "lifecycle", "task_started", None, None), ("open", 2, 11 * S, "message", "user_message", "human", None),
        ("whole", 3, 10 * S, "message", "user_message", "human", None), ("whole", 4, 12 * S, "lifecycle", "turn_started", None, None), ("whole", 5, 20 * S, "message", "message", "unknown", "final_answer"), ("whole", 6, 22 * S, "lifecycle", "turn_complete", None, None),
        ("answer", 7, 10 * S, "message", "user_message", "human", None), ("answer", 8, 15 * S, "message", "message", None, "final_answer"),
        ("back", 9, 10 * S, "lifecycle", "task_complete", None, None), ("back", 10, 12 * S, "lifecycle", "task_started", None, None),
    ])
    assert (got["open"]["state"], got["open"]["start_id"], got["open"]["end_at"], got["open"]["end_id"]) == ("open", 1, 11 * S, None)
    assert tuple(got["whole"])[1:] == ("turn", 12 * S, 22 * S, 4, 6, "interval", "lifecycle")
    assert tuple(got["answer"])[1:] == ("turn", 10 * S, 15 * S, 7, 8, "interval", "estimated")
    assert (got["back"]["state"], got["back"]["start_at"], got["back"]["end_at"], got["back"]["end_id"]) == ("point", 12 * S, 13 * S, 9)


def test_tool_spans(spark):
    rows = [
        ("pair", 1, 10 * S, "tool_call", None), ("pair", 2, 9 * S, "tool_result", None), ("pair", 3, 12 * S, "tool_result", "completed"), ("open", 4, 10 * S, "tool_call", "running"),
        ("done", 5, 10 * S, "tool_call", "completed"), ("lone", 6, 10 * S, "tool_result", None), ("late", 7, 10 * S, "tool_call", None), ("late", 8, 9 * S, "tool_result", None),
    ]
    df = spark.createDataFrame(rows, "call string, id long, at long, event_kind string, tool_status string")
    got = {r["call"]: (r["start_at"], r["end_at"], r["start_id"], r["end_id"], r["state"]) for r in intervals.tool_spans(df, ["call"]).collect()}
    assert got["pair"] == (10 * S, 12 * S, 1, 3, "interval")
    assert got["open"] == (10 * S, 11 * S, 4, None, "open")
    assert got["done"][4] == "point" and got["lone"] == (10 * S, 11 * S, 6, None, "point")
    assert got["late"] == (10 * S, 11 * S, 7, 8, "point")


def test_task_spans(spark):
    rows = [(1, 1, 10 * S, "task_started"), (1, 2, 12 * S, "task_complete"), (1, 3, 13 * S, "task_complete"), (1, 4, 20 * S, "task_started")]
    df = spark.createDataFrame(rows, "part long, id long, at long, event_subtype string")
    got = sorted((r["start_at"], r["end_at"], r["state"]) for r in intervals.task_spans(df, "part").collect())
    assert got == [(10 * S, 12 * S, "interval"), (13 * S, 14 * S, "point"), (20 * S, 21 * S, "open")]


def test_mutual_unique_pairs_are_brute_force(spark):
    r = random.Random(3)
    a = [(i, r.choice([1, 2, None]), r.randint(0, 400)) for i in range(60)]
    b = [(100 + i, r.choice([1, 2, None]), r.randint(0, 400)) for i in range(60)]
    near = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= 4]
    want = sorted(p for p in near if sum(q[0] == p[0] for q in near) == 1 and sum(q[1] == p[1] for q in near) == 1)
    df = lambda rows: spark.createDataFrame(rows, "id long, k long, at long")
    assert sorted(map(tuple, pairing.mutual_unique_pairs(df(a), df(b), ["k"], 4).collect())) == want and want


def test_adjacent_copies(spark):
    rows = [("b", 0, "h", 0, 0, 10), ("b", 1, "h", 50_000, 10, 20), ("b", 2, "h", 300_000, 20, 30), ("b", 3, "i", 300_001, 30, 40), ("c", 1, "h", 0, 0, 5), ("b", 4, "i", 300_002, 41, 50)]
    df = spark.createDataFrame(rows, "b string, i long, hash string, at long, s long, e long")
    assert [tuple(r) for r in pairing.adjacent_copies(df, "b", "i", ["hash"], at="at", start="s", end="e").collect()] == [("b", 1)]


def test_revisions(spark):
    r = spark.createDataFrame([("a", 1, 10, False), ("a", 2, 11, False), ("b", 1, 5, False), ("b", 3, None, True), ("c", 4, 7, False)], "k string, revision_id long, v long, is_tombstone boolean")
    assert sorted((x["k"], x["v"]) for x in revisions.latest_revision(r, ["k"]).collect()) == [("a", 11), ("c", 7)]
    assert sorted((x["k"], x["v"]) for x in revisions.latest_revision(r, ["k"], cutoff=F.lit(1)).collect()) == [("a", 10), ("b", 5)]
    last = revisions.latest_revision(r, ["k"], drop_tombstones=False)
    want = spark.createDataFrame([("a", 11), ("b", 1), ("d", None)], "k string, v long")
    got = {x["k"]: x["action"] for x in revisions.diff_revisions(want, last, ["k"], ["v"]).collect()}
    assert got == {"b": "correct", "c": "tombstone", "d": "insert"}
    done = spark.createDataFrame([("a", 1, 11, False), ("b", 2, 1, False), ("d", 3, None, False), ("c", 4, None, True)], r.schema)
    assert revisions.diff_revisions(want, done, ["k"], ["v"]).collect() == []
    assert [x["k"] for x in revisions.duplicate_keys(want.union(want.limit(1)), ["k"]).collect()] == ["a"]


def test_grid_is_dense(spark):
    people = spark.createDataFrame([(1, "A"), (2, "B")], "person_id long, display_name string")
    e = [event(1, observed_at=0, session_id=1), event(2, observed_at=S, session_id=1), event(3, observed_at=2 * S, session_id=2, actor_role="worker"), event(4, observed_at=700 * S, session_id=3)]
    df = spark.createDataFrame(e, EVENT).withColumn("effective_at", F.col("observed_at"))
    end = 4 * X.BUCKET
    g = grid.bucket_grid(people, [grid.bucket_activity(df, 0, end), grid.day_totals(df, 0, end), spark.createDataFrame([(2, 0, 3)], "person_id long, bucket_at long, prompts long")], 0, end)
    rows = {(r["person_id"], r["bucket_at"] // X.BUCKET): (r["agents"], r["subagents"], r["prompts"], r["day_agents"]) for r in g.collect()}
    assert len(rows) == 8 and rows[1, 0] == (1, 1, 0, 2) and rows[1, 1] == (1, 0, 0, 2) and rows[2, 0] == (0, 0, 3, 0)
    assert {r["person_id"]: r["active_seconds"] for r in grid.active_seconds(g).collect()} == {1: 1200, 2: 0}
    assert checks.incomplete_people(g, 4).collect() == [] and checks.beyond_day(g).collect() == []
    assert grid.global_peak(g).first()["peak"] == 2
    assert [r["person_id"] for r in grid.ranked(grid.person_metrics(g), "active_seconds", "person_id").orderBy("rank").collect()] == [1, 2]


def test_one_prompt_for_each_identity_across_sessions(spark):
    rows = [event(1, native_item_id="n", content_sha256="a"), event(2, session_id=2, native_item_id="n", content_sha256="b"), event(3, content_sha256="c"), event(4, at=2000 * S), event(5, person_id=2, native_item_id="n", content_sha256="d")]
    assert ids(detail.prompts(spark.createDataFrame(rows, EVENT), 0, 1000 * S, ("v1",))) == [1, 3, 5]


def test_pages(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(20)], "at long, id long")
    seen, cursor = [], None
    while True:
        page = [tuple(r) for r in detail.keyset_page(df, ["at", "id"], cursor, 6).collect()]
        seen += page[:6]
        if len(page) <= 6:
            break
        cursor = page[5]
    assert seen == sorted((i % 4, i) for i in range(20))
    head = spark.createDataFrame([("h",)], "head string")
    assert detail.header_and_page(head, df.limit(0)).count() == 1


def test_visible_commits(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "commit_id long")
    assert ids(detail.visible(df, F.lit(3)), "commit_id") == [0, 1, 2, 3]


def test_work_detail(spark):
    a = spark.createDataFrame([event(1), event(2, **STRUCTURED), event(3, event_kind="tool_call"), event(4, session_id=2), event(5, actor_role="worker"), event(6, event_kind="reasoning", content_excerpt=None)], EVENT).withColumn("effective_at", F.col("observed_at"))
    page = detail.work_detail(a, F.lit(1), "agent", 0, 100 * S, (0, 0), 1).collect()
    assert [(r["n_events"], r["id"]) for r in page] == [(4, 1), (4, 2)] and page[0]["summary"] == "words"
    rest = detail.work_detail(a, F.lit(1), "agent", 0, 100 * S, (2 * S, 2), 1).collect()
    assert [(r["n_events"], r["id"]) for r in rest] == [(4, None)]


def test_sessions(spark):
    parts = spark.createDataFrame([(1, 1, "t1", "unknown", 5, 1), (1, 2, None, "worker", 3, 1), (1, 3, "t3", "unknown", 9, 2), (2, 1, None, "unknown", 1, 1)], "session_id long, batch_seq long, title string, actor_role string, started_at long, person_id long")
    got = {r["session_id"]: r for r in sessions.session_fold(parts, ["session_id"], ["title"]).collect()}
    assert (got[1]["title"], got[1]["actor_role"], got[1]["started_at"], got[1]["person_changed"]) == ("t3", "worker", 3, True)
    assert (got[2]["title"], got[2]["actor_role"]) == (None, "unknown")
    tree = spark.createDataFrame([(1, "w", "a", None), (2, "w", "b", "a"), (3, "x", "c", "a"), (4, "w", "d", "d")], "session_id long, ws string, native_id string, parent_native_id string")
    up = {r["session_id"]: r["parent_session_id"] for r in sessions.resolve_parents(tree, ["ws"]).collect()}
    assert up == {1: None, 2: 1, 3: None, 4: None}
    s = spark.createDataFrame(list(up.items()), "session_id long, parent_session_id long")
    assert ids(sessions.affected(s, s.filter("session_id = 1").select("session_id")), "session_id") == [1, 2]
    e = spark.createDataFrame([event(1), event(2), event(3, session_id=2)], EVENT)
    a, b = (sorted(map(tuple, sessions.fingerprint(x, "session_id", ["event_kind", "observed_at"]).collect())) for x in (e, e.repartition(3)))
    assert a == b


def test_staleness(spark):
    e = spark.createDataFrame([event(1), event(2), event(3, session_id=2), event(4, session_id=3)], EVENT)
    receipts = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 2), (2, 1, 3, 2)], "session_id long, receipt_id long, last_id long, n long")
    assert ids(revisions.staleness(sessions.coordinates(e), receipts, ["session_id"]), "session_id") == [2, 3]


def test_queue(spark):
    job = "id long, stream string, start_at long, status string, available_at long, lease_until long, attempts int"
    rows = [(1, "a", 0, "running", 0, 90, 1), (2, "a", 10, "ready", 0, None, 0), (3, "b", 0, "ready", 0, None, 0), (4, "b", 5, "ready", 0, None, 0), (5, "c", 0, "running", 0, 5, 1), (6, "d", 0, "retry", 200, None, 2), (7, "e", 0, "ready", 0, None, 8), (8, "f", 0, "complete", 0, None, 1), (9, "f", 9, "ready", 0, None, 0)]
    assert ids(jobs.claimable(spark.createDataFrame(rows, job), F.lit(100))) == [1, 3, 5, 9]
    state = spark.createDataFrame([("running", "done", 1, 1, 1), ("running", "done", 1, 1, 2), ("running", "failed", 8, 1, 1), ("running", "failed", 2, 1, 1), ("running", "expired", 2, 1, 1)], "s string, o string, a int, c int, g int")
    assert [r[0] for r in state.select(jobs.next_state(*[F.col(c) for c in "soacg"])).collect()] == ["complete", "ready", "dead", "retry", "ready"]
    now = spark.createDataFrame([("k1", 5, 1, "running", "backfill"), ("k2", 9, 1, "complete", "backfill")], "k string, target_id long, generation int, status string, workload_class string")
    asked = jobs.coalesce_targets(spark.createDataFrame([("k1", 7, "live"), ("k1", 6, "backfill"), ("k3", 1, "backfill")], "k string, target_id long, workload_class string"), ["k"])
    got = {r["k"]: tuple(r)[1:] for r in jobs.enqueue(now, asked, ["k"]).collect()}
    assert got == {"k1": (7, 2, "running", "live"), "k2": (9, 1, "complete", "backfill"), "k3": (1, 1, "ready", "backfill")}
    ages = [0, 130, 125, 90, 50, 70, 55, 60, 200]
    over = jobs.overloaded(spark.createDataFrame([("x", i, a) for i, a in enumerate(ages)], "p string, at long, age long"), "p", "at", "age")
    assert [r["overloaded"] for r in over.orderBy("at").collect()] == [False, False, True, True, True, True, True, False, False]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in (1, 2, 7, 20)], "n int").select(X.backoff(F.col("n"))).collect()] == [5, 10, 300, 300]


def test_freshness(spark):
    now = 100 * X.MINUTE
    e = spark.createDataFrame([event(1, observed_at=95 * X.MINUTE), event(2, observed_at=60 * X.MINUTE, person_id=2), event(3, observed_at=75 * X.MINUTE, person_id=3), event(4, observed_at=101 * X.MINUTE)], EVENT)
    pending = spark.createDataFrame([(94 * X.MINUTE,), (99 * X.MINUTE,)], "enqueued_at long")
    r = freshness.freshness(e, e.filter("id <> 1"), pending, now).first()
    assert (r["raw_watermark"], r["canonical_watermark"], r["n_pending"], r["delayed"]) == (95 * X.MINUTE, 75 * X.MINUTE, 2, True)
    assert {x["person_id"]: x["status"] for x in freshness.person_freshness(e, now).collect()} == {1: "active", 2: "inactive", 3: "recent"}


def test_broken_rows(spark):
    df = spark.createDataFrame([(1, 0, 5, 5, "a" * 64), (2, 5, 5, 0, "a" * 64), (3, 0, 5, 4, "x"), (4, None, 5, 5, "b" * 64)], "id long, start long, end long, n_bytes long, sha256 string")
    assert {r["id"]: r["broken"] for r in checks.broken(df, checks.RANGES).collect()} == {2: ["positive range"], 3: ["size", "hash"], 4: ["positive range", "size"]}


def test_numbered_follows_the_order_over_all_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x")).repartition(5)
    rows = grid.numbered(df, [F.col("x").desc()], "n").collect()
    assert [r["x"] for r in sorted(rows, key=lambda r: r["n"])] == sorted((r["x"] for r in rows), reverse=True)
    assert sorted(r["n"] for r in rows) == list(range(1, 1001))
    assert grid.numbered(df.limit(0), [F.col("x").desc()], "n").count() == 0


def test_bounds_are_errors(spark):
    df = spark.range(5).withColumnRenamed("id", "observed_at")
    assert [r[0] for r in detail.capped(df, ["observed_at"], 5).collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="more than 4"):
        detail.capped(df, ["observed_at"], 4)
    assert revisions.refuse_future(df, 4).agg(F.sum("observed_at")).first()[0] == 10
    with pytest.raises(Exception, match="an event lies after"):
        revisions.refuse_future(df, 3).collect()
    with pytest.raises(Exception, match="a time lies after now"):
        df.select(X.recency(F.col("observed_at"), F.lit(2))).collect()
