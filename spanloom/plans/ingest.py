"""Queries over records, native events, queues and identities, each with its twin in SQL. They join the catalog's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import detail, grid, intervals, jobs, revisions, sessions
from ..sources import normalize, records
from ..sources import testdata as T
from . import catalog as C
from .catalog import CAN, CURSOR, EV, query

# Records of byte streams. The SQL pieces are CTEs.

LINES = """ln AS (SELECT doc_id, s.i AS i, CASE WHEN s.i < s.n THEN s.x || chr(10) ELSE s.x END AS record FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x, 'n': len(string_split(text, chr(10)))})) AS s FROM documents)),
le AS (SELECT *, octet_length(encode(record)) AS size, CAST(sum(octet_length(encode(record))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM ln WHERE record <> ''),
lo AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS record_index, e - size AS s, e FROM le)"""
CHUNK = 2048


def _lines(spark, sf_dir):
    return records.locators(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"""WITH RECURSIVE {LINES},
nx AS (SELECT a.doc_id, a.s, coalesce(max(b.e) FILTER (b.e <= a.s + {CHUNK}), max(a.e)) AS e FROM lo a JOIN lo b ON a.doc_id = b.doc_id AND b.s >= a.s AND b.s < a.s + {CHUNK} GROUP BY 1, 2),
ch AS (SELECT doc_id, s, e, CAST(0 AS BIGINT) AS chunk FROM nx WHERE s = 0 UNION ALL SELECT nx.doc_id, nx.s, nx.e, chunk + 1 FROM ch JOIN nx ON nx.doc_id = ch.doc_id AND nx.s = ch.e)
SELECT doc_id, chunk, s AS start, e AS end FROM ch""")
def chunked_lines(spark, sf_dir):
    packed = records.chunks(_lines(spark, sf_dir), "doc_id", CHUNK)
    return packed.groupBy("doc_id", "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"))


@query(f"WITH {LINES} SELECT doc_id, record_index // 10 AS batch_seq, count(*) AS n_records, min(s) AS start, max(e) AS end FROM lo GROUP BY 1, 2")
def record_batches(spark, sf_dir):
    b = records.batches(_lines(spark, sf_dir), "doc_id", 10)
    return b.groupBy("doc_id", "batch_seq").agg(F.count(F.lit(1)).alias("n_records"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("SELECT doc_id, sha256(text) AS sha256, true AS complete FROM documents WHERE octet_length(encode(text)) > 4096")
def reassembled_texts(spark, sf_dir):
    """Long texts cut into fragments and put together again."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    plan = records.fragment_plan(d.select("doc_id", F.octet_length("raw").alias("n")), ["doc_id"], "n", 4096)
    piece = F.substring(F.col("raw"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    f = d.join(plan, "doc_id").select("doc_id", "fragment_index", "fragment_count", F.sha2("raw", 256).alias("record_sha256"), piece.alias("body"))
    return records.reassemble(f, ["doc_id"]).select("doc_id", F.sha2("body", 256).alias("sha256"), "complete")


# Native records as events.

_THREAD = {  # a record's text and what it must become, by k % 8
    0: """'{"type":"event_msg","payload":{"type":"user_message","turn_id":"t' || k || '","message":"hello ' || k || '"}}'""",
    1: """'{"type":"response_item","payload":{"type":"message","role":"assistant","turn_id":"t' || k || '","id":"i' || id || '","content":[{"type":"output_text","text":"a' || k || '"},{"type":"image"},{"type":"output_text","text":"b"}]}}'""",
    2: """'{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":' || k * 10 || ',"cached_input_tokens":' || k * 3 || ',"output_tokens":' || k * 4 || ',"reasoning_output_tokens":' || k || ',"total_tokens":' || k * 14 || '}}}}'""",
    3: """'{"type":"response_item","payload":{"type":"function_call","name":"f' || k || '","call_id":"c' || id || '"}}'""",
    4: """'{"type":"response_item","payload":{"type":"function_call_output","call_id":"c' || id || '"}}'""",
    5: """'{"type":"event_msg","payload":{"type":"error","code":"E' || k || '"}}'""",
    6: """'{"type":"response_item","payload":{"type":"reasoning","id":"r' || id || '"}}'""",
    7: """'{"type":"event_msg","payload":{"type":"task_started","turn_id":"t' || k || '"}}'""",
}
_THREAD_SQL = f"CASE k % 8 {' '.join(f'WHEN {i} THEN {x}' for i, x in _THREAD.items())} END"
_by_k = lambda **c: "CASE k % 8 " + " ".join(f"WHEN {n[1:]} THEN {x}" for n, x in c.items()) + " END"


@query(f"""WITH {EV} SELECT concat('s', session_id) AS stream, id AS record_index, concat('session:s', session_id) AS scope_key,
  {_by_k(k0="'message'", k1="'message'", k2="'usage'", k3="'tool_call'", k4="'tool_result'", k5="'error'", k6="'reasoning'", k7="'lifecycle'")} AS event_kind,
  {_by_k(k0="'user_message'", k1="'message'", k2="'token_count'", k3="'function_call'", k4="'function_call_output'", k5="'error'", k6="'reasoning'", k7="'task_started'")} AS event_subtype,
  {_by_k(k0="'user'", k1="'assistant'")} AS message_role, {_by_k(k0="'human'", k1="'unknown'")} AS message_origin, {_by_k(k0="'message:user:t' || k", k1="'message:assistant:t' || k || ':i' || id")} AS logical_event_key,
  {_by_k(k0="sha256('hello ' || k)", k1="sha256('a' || k || chr(10) || 'b')")} AS content_sha256, CASE k % 8 WHEN 2 THEN CAST(k AS BIGINT) * 14 END AS total_tokens, {_by_k(k5="'E' || k")} AS error_code, {_by_k(k3="'f' || k")} AS tool_name FROM ev""")
def thread_events(spark, sf_dir):
    e = T.activity_events(spark, sf_dir)
    own = F.concat(F.lit("s"), F.col("session_id").cast("string"))
    rows = e.select(own.alias("stream"), F.col("id").alias("record_index"), F.expr(_THREAD_SQL).alias("record"), F.lit("ok").alias("parse_status"), F.lit(None).cast("string").alias("occurred_at"), own.alias("seen_session_id"), F.lit(None).cast("string").alias("seen_parent_id"))
    return normalize.normalize_threads(rows).select(
        "stream", "record_index", "scope_key", "event_kind", "event_subtype", "message_role", "message_origin", "logical_event_key", "content_sha256", F.col("usage.total").alias("total_tokens"), "error_code", "tool_name"
    )


# Hooks by id % 6: the end of a turn, of a session, of a response, of a subagent's response; another schema; another payload.
_PAYLOAD = """CASE id % 6 WHEN 1 THEN concat('{"hook_event_name":"SessionEnd","session_id":"s', session_id, '","reason":"clear"}') WHEN 3 THEN concat('{"hook_event_name":"SubagentStop","session_id":"p', session_id, '","agent_id":"s', session_id, '"}')
  ELSE concat('{"hook_event_name":"Stop","session_id":"s', session_id, '","n":', id, '}') END"""
_UUID = "concat('00000000-0000-4000-8000-', lpad(CAST(id % 100000000000 AS STRING), 12, '0'))"


@query(f"""WITH {EV}, h AS (SELECT *, id % 6 AS m, {_UUID} AS uuid, 'transcript:hook:' || sha256({_PAYLOAD}) AS own FROM ev)
SELECT concat('s', session_id) AS stream, id AS record_index, 'lifecycle' AS event_kind, CASE m WHEN 0 THEN 'turn_complete' WHEN 1 THEN 'session_end' WHEN 4 THEN 'hook_invalid' WHEN 5 THEN 'hook_invalid' ELSE 'response_complete_unlinked' END AS event_subtype,
  CASE m WHEN 4 THEN 'invalid_hook_schema' WHEN 5 THEN 'invalid_hook_payload_hash' END AS error_code, CASE WHEN m = 0 THEN 'transcript:lifecycle:' || uuid || ':turn_complete' WHEN m < 4 THEN own END AS logical_event_key,
  CASE WHEN m = 0 THEN 'transcript:prompt:' || uuid END AS turn_id, CASE WHEN m = 1 THEN 'clear' END AS phase, CASE WHEN m = 3 THEN 'worker' ELSE 'primary' END AS actor_role FROM h""")
def hook_events(spark, sf_dir):
    e = T.activity_events(spark, sf_dir).select("id", F.expr("id % 6").alias("m"), F.col("session_id").cast("string").alias("session_id"), F.expr(_PAYLOAD).alias("payload"), F.expr(_UUID).alias("uuid"))
    own, above = F.concat(F.lit("s"), "session_id"), F.when(F.col("m") == 3, F.concat(F.lit("p"), "session_id"))
    record = F.to_json(F.struct(
        F.lit("hook").alias("type"), F.when(F.col("m") == 4, "hook.v0").otherwise("hook.v1").alias("schema_version"), F.when(F.col("m") == 1, "SessionEnd").when(F.col("m") == 3, "SubagentStop").otherwise("Stop").alias("dispatch_event_name"),
        F.lit("2024-01-14T12:00:00Z").alias("collector_observed_at"), F.translate(F.base64(F.col("payload").cast("binary")), "\r\n", "").alias("payload_base64"),
        F.sha2(F.when(F.col("m") == 5, "other").otherwise(F.col("payload")).cast("binary"), 256).alias("payload_sha256"), own.alias("native_session_id"), above.alias("parent_native_session_id"),
        F.when(F.col("m") == 0, F.lit(10)).alias("transcript_byte_count"), F.when(F.col("m") == 0, F.sha2(F.lit("t").cast("binary"), 256)).alias("transcript_sha256"),
        F.when(F.col("m") == 0, F.col("uuid")).alias("terminal_assistant_uuid"), F.when(F.col("m") == 0, F.col("uuid")).alias("turn_anchor_id"),
    ))
    rows = e.select(own.alias("stream"), F.col("id").alias("record_index"), record.alias("record"), F.lit("ok").alias("parse_status"), F.lit(None).cast("string").alias("occurred_at"), own.alias("seen_session_id"), above.alias("seen_parent_id"))
    return normalize.normalize_hooks(rows, "hook.v1").select("stream", "record_index", "event_kind", "event_subtype", "error_code", "logical_event_key", "turn_id", "phase", "actor_role")


# Spans, states and queues.


@query(f"""WITH {CAN}, t0 AS (SELECT session_id, id, effective_at AS ea, event_subtype = 'task_started' AS st FROM can WHERE event_kind = 'lifecycle' AND event_subtype IN ('task_started', 'task_complete')),
t1 AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE -1 END) OVER (PARTITION BY session_id ORDER BY ea, id) AS b FROM t0),
t2 AS (SELECT *, least(0, min(b) OVER (PARTITION BY session_id ORDER BY ea, id)) AS low FROM t1),
t3 AS (SELECT *, NOT st AND low < coalesce(lag(low) OVER (PARTITION BY session_id ORDER BY ea, id), 0) AS lone FROM t2),
t4 AS (SELECT *, row_number() OVER (PARTITION BY session_id, st, lone ORDER BY ea, id) AS n FROM t3),
p AS (SELECT coalesce(a.session_id, z.session_id) AS session_id, a.id AS sid, a.ea AS sat, z.id AS eid, z.ea AS eat FROM (SELECT * FROM t4 WHERE st) a FULL JOIN (SELECT * FROM t4 WHERE NOT st AND NOT lone) z ON a.session_id = z.session_id AND a.n = z.n
  UNION ALL SELECT session_id, NULL, NULL, id, ea FROM t4 WHERE lone)
SELECT session_id, 'task' AS span_kind, coalesce(sat, eat) AS start_at, CASE WHEN eat > sat THEN eat ELSE coalesce(sat, eat) + 1000000 END AS end_at, coalesce(sid, eid) AS start_id, CASE WHEN sid IS NOT NULL THEN eid END AS end_id,
  CASE WHEN sid IS NULL THEN 'point' WHEN eid IS NULL THEN 'open' WHEN eat > sat THEN 'interval' ELSE 'point' END AS state, CASE WHEN eat > sat THEN 'lifecycle' ELSE 'estimated' END AS basis FROM p""")
def task_spans(spark, sf_dir):
    e = C._canonical(spark, sf_dir).filter("event_kind = 'lifecycle' AND event_subtype IN ('task_started', 'task_complete')")
    return intervals.task_spans(e.withColumn("at", F.col("effective_at")), "session_id")


_ROW = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("id", "event_kind", "observed_at", "content_sha256"))
_PARTS = ", ',', ".join(f"sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT))" for at in (1, 16, 31, 46))


@query(f"WITH {EV}, h AS (SELECT session_id, sha256({_ROW}) AS h FROM ev) SELECT session_id, sha256(concat({_PARTS})) AS state_hash FROM h GROUP BY 1")
def state_fingerprints(spark, sf_dir):
    return sessions.fingerprint(T.activity_events(spark, sf_dir), "session_id", ["event_kind", "observed_at", "content_sha256"])


@query(f"""WITH {EV}, j AS (SELECT session_id, max(id) AS t, CASE session_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' ELSE 'ready' END AS status, CASE WHEN session_id % 2 = 0 THEN 'live' ELSE 'backfill' END AS w FROM ev WHERE event_kind = 'message' GROUP BY 1),
q AS (SELECT session_id, max(id) AS t, CASE WHEN bool_or(k % 5 = 0) THEN 'live' ELSE 'backfill' END AS w FROM ev WHERE event_kind IN ('tool_call', 'tool_result') GROUP BY 1)
SELECT coalesce(j.session_id, q.session_id) AS session_id, greatest(j.t, q.t) AS target_id, CAST((j.t IS NOT NULL)::INT + (q.t IS NOT NULL)::INT AS INTEGER) AS generation,
  CASE WHEN q.t IS NOT NULL AND status IS DISTINCT FROM 'running' THEN 'ready' ELSE status END AS status, CASE WHEN j.w = 'live' OR q.w = 'live' THEN 'live' ELSE 'backfill' END AS workload_class FROM j FULL JOIN q ON j.session_id = q.session_id""")
def enqueued_jobs(spark, sf_dir):
    e = T.activity_events(spark, sf_dir)
    s = F.col("session_id")
    present = e.filter("event_kind = 'message'").groupBy("session_id").agg(F.max("id").alias("target_id"))
    present = present.select("session_id", "target_id", F.lit(1).alias("generation"), F.when(s % 3 == 0, "running").when(s % 3 == 1, "complete").otherwise("ready").alias("status"), F.when(s % 2 == 0, "live").otherwise("backfill").alias("workload_class"))
    asked = e.filter("event_kind IN ('tool_call', 'tool_result')").select("session_id", F.col("id").alias("target_id"), F.when(F.col("k") % 5 == 0, "live").otherwise("backfill").alias("workload_class"))
    return jobs.enqueue(present, jobs.coalesce_targets(asked, ["session_id"]), ["session_id"])


@query(f"WITH {EV} SELECT id, session_id AS stream, min(observed_at) FILTER (event_kind <> 'error' AND k % 5 = 0) OVER (PARTITION BY session_id) AS oldest_live_at FROM ev")
def oldest_live_jobs(spark, sf_dir):
    j = T.activity_events(spark, sf_dir).select("id", F.col("session_id").alias("stream"), F.col("observed_at").alias("start_at"), F.when(F.col("event_kind") == "error", "complete").otherwise("ready").alias("status"), F.when(F.col("k") % 5 == 0, "live").otherwise("backfill").alias("workload_class"))
    return jobs.with_oldest_live(j).select("id", "stream", "oldest_live_at")


@query(f"SELECT count(*) FILTER (action = 'insert') AS n_inserted, count(*) FILTER (action = 'correct') AS n_corrected, count(*) FILTER (action = 'tombstone') AS n_tombstoned, count(*) AS n_appended FROM ({C.SQL['revision_diff']}) x")
def receipt_totals(spark, sf_dir):
    return revisions.receipt_totals(C.revision_diff(spark, sf_dir))


# Pages, times and identities.


@query(f"WITH {EV}, p AS (SELECT id, effective_at FROM ev WHERE (effective_at, id) > ({CURSOR[0]}, {CURSOR[1]}) ORDER BY effective_at, id LIMIT 51) SELECT p.*, content_bytes, content_excerpt FROM p JOIN ev USING (id)")
def page_with_payload(spark, sf_dir):
    e = C._events(spark, sf_dir)
    page = detail.keyset_page(e.select("id", "effective_at"), ["effective_at", "id"], CURSOR, 50)
    return detail.with_payload(page, e.select("id", "content_bytes", "content_excerpt"), "id")


@query(f"WITH {EV} SELECT id, native_at, strftime(make_timestamp(observed_at), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS observed_text, observed_at AS read_back FROM ev")
def native_times(spark, sf_dir):
    shown = X.rfc3339_text(F.col("observed_at"))
    return T.activity_events(spark, sf_dir).select("id", X.uuid7_micros(F.col("native_item_id")).alias("native_at"), shown.alias("observed_text"), X.rfc3339_micros(shown).alias("read_back"))


_SHOWN = "concat(coalesce(name, identity_key), ' (x) !*~', chr(39), '/&é')"


@query(f"""WITH {T.PEOPLE_SQL} SELECT person_id, 'dev-' || substr(sha256(encode(email) || '\\x00'::BLOB || encode(identity_key)), 1, 32) AS collector_key, replace(replace(replace(replace(replace(url_encode({_SHOWN}), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS path_part,
  rtrim(translate(to_base64(encode({_SHOWN})), '+/', '-_'), '=') AS token, person_id % 5 > 1 AS is_email, CASE split_part(email, '@', 2) WHEN 'a.example' THEN 'w1' WHEN 'b.example' THEN 'w2' END AS workspace FROM pe""")
def routing_keys(spark, sf_dir):
    email, shown = F.col("email"), F.expr(_SHOWN)
    given = F.when(F.col("person_id") % 5 == 0, F.concat(email, F.lit("."))).when(F.col("person_id") % 5 == 1, F.concat(email, F.lit(" "))).otherwise(email)
    return T.people(spark, sf_dir).select(
        "person_id", X.collector_key("dev", email, F.col("identity_key")).alias("collector_key"), X.encode_uri_component(shown).alias("path_part"), X.base64url(shown.cast("binary")).alias("token"),
        X.valid_email(given).alias("is_email"), X.workspace_of(email, {"a.example": "w1", "b.example": "w2"}).alias("workspace"),
    )


@query(f"""WITH {EV}, a AS (SELECT person_id, max(observed_at) // {X.BUCKET} * {X.BUCKET} AS z FROM ev GROUP BY 1)
SELECT person_id, CAST(i AS INTEGER) AS tick, z - {X.DAY} + i * {X.DAY // 12} AS at FROM a, range(13) t(i)""")
def axis_ticks(spark, sf_dir):
    """Of the day up to each person's last bucket."""
    end = X.bucket_start(F.max("observed_at"))
    last = T.activity_events(spark, sf_dir).groupBy("person_id").agg(end.alias("z"))
    return last.select("person_id", F.posexplode(grid.axis_ticks(F.col("z") - X.DAY, F.col("z"))).alias("tick", "at"))
