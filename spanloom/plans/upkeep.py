"""Queries over what is kept up to date as data arrives: keyed state, a forest of pointers, an index, byte streams. Each leads
through several batches to what its twin says of the whole table."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detail, forest, projection, revisions, search
from ..sources import bytelines, objects, scratch, tokens
from ..sources import testdata as T
from ..streaming import state
from .catalog import _FIRST, _IS_KEYED, _PARTS, COPIES, DAY_END, EV, VERSIONS, _activity_sql, _events, _prompt_sql, query


def _place(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it goes when the driver exits."""
    path = f"{scratch.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(scratch.delete, spark, path)
    return path


def _arrivals(rows: DataFrame, path: str) -> None:
    """rows as files in no order of time, so that any batch brings late rows; every tenth is delivered twice."""
    again = F.when(F.xxhash64("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows.withColumn("__copy", F.explode(again)).repartition(F.xxhash64("id", "__copy")).drop("__copy").write.parquet(path)


def _streamed(spark: SparkSession, rows: DataFrame, label: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream of rows, made into another, has written when all has arrived, in at least three batches; of one that
    updates, with batch_id."""
    base = _place(spark, label)
    _arrivals(rows, f"{base}/in")
    files = len(spark.read.parquet(f"{base}/in").inputFiles())
    out = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 3)).parquet(f"{base}/in"))
    with state.rocks(spark):
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            q = writer.format("parquet").option("path", f"{base}/out").start()
        else:
            q = writer.foreachBatch(lambda d, n: d.withColumn("batch_id", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{n}")).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(out.schema).parquet(f"{base}/out") if mode == "append" else spark.read.schema(out.schema.add("batch_id", "long")).parquet(f"{base}/out/*")


_SPANS = "session_id, span_key, span_kind, start_at, end_at, start_id, end_id, state, basis"
_SHAPE = """CASE WHEN e IS NULL THEN 'open' WHEN e[1] > s[1] THEN 'interval' ELSE 'point' END AS state, CASE WHEN e[1] > s[1] THEN {basis} ELSE 'estimated' END AS basis"""
_LIFE = "event_kind = 'lifecycle' AND event_subtype = '{0}'"


@query(f"""WITH {EV}, c AS (SELECT *, source_at AS t, CASE WHEN event_kind = 'message' AND k % 7 = 0 THEN 'final_answer' END AS phase, concat('tool:call:', session_id, '-', k % 5) AS call, CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'running' END AS status
  FROM (SELECT *, NOT ({_IS_KEYED}) OR {_FIRST} = min({_FIRST}) OVER ({_PARTS}) AS preferred FROM ev WHERE NOT is_replay) WHERE preferred),
tu AS (SELECT session_id, concat('turn:', turn_id) AS span_key, coalesce(min((t, id)) FILTER ({_LIFE.format('task_started')}), min((t, id)) FILTER (message_origin = 'human'), min((t, id))) AS s, bool_or({_LIFE.format('task_started')}) AS began,
  max((t, id, {_LIFE.format('task_complete')})) FILTER ({_LIFE.format('task_complete')} OR message_origin IS DISTINCT FROM 'human' AND phase = 'final_answer') AS e
  FROM c WHERE turn_id IS NOT NULL AND event_kind IN ('message', 'agent_message', 'reasoning', 'tool_call', 'tool_result', 'lifecycle', 'error') GROUP BY 1, 2),
tc AS (SELECT session_id, call, min((t, id, status)) AS s FROM c WHERE event_kind = 'tool_call' GROUP BY 1, 2),
tr AS (SELECT session_id, call, s, coalesce(min((t, id)) FILTER (t > s[1]), min((t, id))) AS e FROM c LEFT JOIN tc USING (session_id, call) WHERE event_kind = 'tool_result' GROUP BY 1, 2, 3),
tp AS (SELECT session_id, coalesce(tr.call, tc.call) AS span_key, tc.s, tr.e FROM tc FULL JOIN tr USING (session_id, call)),
q AS (SELECT *, event_subtype = 'task_started' AS st, sum(CASE WHEN event_subtype = 'task_started' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id ORDER BY t, id) AS b FROM c WHERE turn_id IS NULL AND event_kind = 'lifecycle' AND event_subtype IN ('task_started', 'task_complete')),
m AS (SELECT *, least(0, min(b) OVER (PARTITION BY session_id ORDER BY t, id)) AS m FROM q),
u AS (SELECT *, NOT st AND m < coalesce(lag(m) OVER (PARTITION BY session_id ORDER BY t, id), 0) AS lone FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, st, lone ORDER BY t, id) AS n FROM u),
ta AS (SELECT a.session_id, (a.t, a.id) AS s, CASE WHEN z.id IS NOT NULL THEN (z.t, z.id) END AS e FROM n a LEFT JOIN n z ON z.session_id = a.session_id AND z.n = a.n AND NOT z.st AND NOT z.lone WHERE a.st)
SELECT session_id, span_key, 'turn' AS span_kind, s[1] AS start_at, CASE WHEN e[1] > s[1] THEN e[1] ELSE s[1] + 1000000 END AS end_at, s[2] AS start_id, e[2] AS end_id, {_SHAPE.format(basis="CASE WHEN began AND e[3] THEN 'lifecycle' ELSE 'estimated' END")} FROM tu
UNION ALL SELECT session_id, span_key, 'tool', coalesce(s[1], e[1]), CASE WHEN e[1] > s[1] THEN e[1] ELSE coalesce(s[1], e[1]) + 1000000 END, coalesce(s[2], e[2]), CASE WHEN s IS NOT NULL THEN e[2] END,
  CASE WHEN e[1] > s[1] THEN 'interval' WHEN s IS NOT NULL AND e IS NULL AND s[3] <> 'completed' THEN 'open' ELSE 'point' END, CASE WHEN e[1] > s[1] THEN 'paired_events' ELSE 'estimated' END FROM tp
UNION ALL SELECT session_id, concat('task:', s[2]), 'task', s[1], CASE WHEN e[1] > s[1] THEN e[1] ELSE s[1] + 1000000 END, s[2], e[2], {_SHAPE.format(basis="'lifecycle'")} FROM ta
UNION ALL SELECT session_id, concat('task-complete:', id), 'task', t, t + 1000000, id, NULL, 'point', 'estimated' FROM n WHERE lone""")
def stateful_spans(spark, sf_dir):
    """The spans that are left when all events have arrived in a stream with keyed state."""
    e = _events(spark, sf_dir).withColumn("at", F.coalesce("occurred_at", "observed_at", "received_at"))
    e = e.withColumn("phase", F.when((F.col("event_kind") == "message") & (F.col("k") % 7 == 0), "final_answer"))
    e = e.withColumn("tool_status", F.when(F.col("k") % 2 == 0, "completed").otherwise("running"))
    e = e.withColumn("tool_call_id", F.concat_ws("-", F.col("session_id").cast("string"), (F.col("k") % 5).cast("string")))
    names = [x.split(" ")[0] for x in state.EVENT.split(", ")]
    e = e.select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in state.EVENT.split(", ")])
    rows = _streamed(spark, e.select(names), "spans", state.span_revisions, "append")
    return revisions.latest_revision(rows, ["session_id", "span_key"], "revision").select(_SPANS.split(", "))


@query(f"""WITH {EV} SELECT session_id, arg_max(event_subtype, id) FILTER (event_subtype IS NOT NULL) AS event_subtype, arg_max(logical_event_key, id) FILTER (logical_event_key IS NOT NULL) AS logical_event_key,
  coalesce(arg_max(actor_role, id) FILTER (actor_role <> 'unknown'), 'unknown') AS actor_role, min(occurred_at) AS started_at, min(person_id) AS person_id, min(person_id) <> max(person_id) AS person_changed FROM ev GROUP BY 1""")
def stateful_sessions(spark, sf_dir):
    """Sessions folded in keyed state from parts that arrive in any order."""
    names = ["event_subtype", "logical_event_key"]
    parts = _events(spark, sf_dir).select("session_id", "id", F.col("id").alias("batch_seq"), F.col("person_id").cast("long").alias("person_id"), "actor_role", F.col("occurred_at").alias("started_at"), *names)
    rows = _streamed(spark, parts, "sessions", lambda d: state.folded_sessions(d, names), "update")
    rest = [c for c in rows.columns if c not in ("session_id", "batch_id")]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("x")).select("session_id", "x.*")


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn AS node, CASE WHEN turn > 0 AND turn % 11 <> 10 THEN greatest(turn - 1 - turn % 2, 0) END AS parent, CASE WHEN role = 'user' AND length(text) % 5 = 0 THEN concat('p', turn) END AS named,
  CASE WHEN role <> 'system' AND turn % 3 > 0 THEN concat('r', turn) END AS own FROM conversations),
w AS (SELECT conv_id, node, node AS at, 0 AS step FROM n UNION ALL SELECT w.conv_id, w.node, n.parent, step + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.node = w.at WHERE n.parent IS NOT NULL AND n.named IS NULL)
SELECT CAST(w.conv_id AS VARCHAR) AS part, CAST(w.node AS VARCHAR) AS node, coalesce(arg_min(n.named, step), arg_max(n.own, step)) AS value FROM w JOIN n ON n.conv_id = w.conv_id AND n.node = w.at GROUP BY ALL""")
def turn_carry_over(spark, sf_dir):
    """Turn ids inherited in three batches that tear conversations apart, so that parents come before, with and after."""
    turn = F.col("turn").cast("long")
    c = T.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("part"), turn.cast("string").alias("node"), F.when((turn > 0) & (turn % 11 != 10), F.greatest(turn - 1 - turn % 2, F.lit(0))).cast("string").alias("parent"),
        F.when((F.col("role") == "user") & (F.length("text") % 5 == 0), F.concat(F.lit("p"), turn.cast("string"))).alias("named"),
        F.when((F.col("role") != "system") & (turn % 3 > 0), F.concat(F.lit("r"), turn.cast("string"))).alias("own"),
    )
    path = _place(spark, "forest")
    for n in range(3):
        forest.extend_forest(c.filter(F.pmod(F.xxhash64("part", "node"), F.lit(3)) == n), path, n)
    return forest.read_forest(spark, path).select("part", "node", "value")


@query(r"""SELECT doc_id AS id FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents) WHERE list_contains(w, 'that') AND list_contains(w, 'and')""")
def indexed_search(spark, sf_dir):
    """Documents with both words, from an index of two commits."""
    docs, path = T.table(spark, sf_dir, "documents"), _place(spark, "index")
    for n in range(2):
        search.append_segment(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == n), path, n)
    return search.search(spark, path, "And, That!")


@query("""WITH t AS (SELECT conv_id % 8 AS part, concat('{"type":"', role, '","payload":{"type":"', turn % 4, '"},"n":', turn, ',"x":"', replace(replace(substr(text, 1, 200), chr(10), ' '), '"', ''), CASE WHEN turn % 9 = 8 THEN '' ELSE '"}' END) AS line, conv_id, turn FROM conversations)
SELECT part, row_number() OVER w - 1 AS record_index, CAST(coalesce(sum(strlen(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, sha256(concat(line, chr(10))) AS record_sha256,
  CASE WHEN turn % 9 = 8 THEN 'malformed' ELSE 'ok' END AS parse_status, CASE WHEN turn % 9 <> 8 THEN CAST(turn % 4 AS VARCHAR) END AS native_payload_type FROM t WINDOW w AS (PARTITION BY part ORDER BY conv_id, turn)""")
def byte_locators(spark, sf_dir):
    """Records of eight files of JSON lines, read by splits."""
    turn = F.col("turn").cast("string")
    text = F.replace(F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit(""))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","payload":{"type":"'), (F.col("turn") % 4).cast("string"), F.lit('"},"n":'), turn, F.lit(',"x":"'), text, F.when(F.col("turn") % 9 == 8, "").otherwise('"}'))
    path = _place(spark, "lines")
    lines = T.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).alias("part"), "conv_id", "turn", line.alias("line"))
    lines.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "line").write.partitionBy("part").text(path)
    found = bytelines.locate(bytelines.read_records(spark, path))
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "record_index", "start", "record_sha256", "parse_status", "native_payload_type")


_NOW = DAY_END - 1
_FROM, _TO = projection.covered(_NOW)
#: The events that had arrived by the end of the covered window.
_ARRIVED = EV.replace("ev AS (", "every AS (", 1) + f", ev AS (SELECT * FROM every WHERE observed_at < {_TO})"


@query(f"""WITH {_activity_sql(_FROM - projection.PADDING, _TO + projection.PADDING).replace(EV, _ARRIVED)}, {COPIES}, {_prompt_sql(_FROM, _TO, projection.PADDING)},
e AS (SELECT 'activity' AS evidence_kind, id AS source_event_id, person_id, session_id, effective_at AS observed_at, CAST(NULL AS VARCHAR) AS prompt_identity FROM cac WHERE effective_at BETWEEN {_FROM} AND {_TO} - 1
  UNION ALL SELECT 'prompt', id, person_id, session_id, prompt_at, prompt_identity FROM standing WHERE prompt_at BETWEEN {_FROM} AND {_TO} - 1)
SELECT * FROM e""")
def projection_runs(spark, sf_dir):
    """What two runs leave: one while a third of the events had not come, one when all had; a third finds nothing to do."""
    e = _events(spark, sf_dir).filter(F.col("observed_at") < _TO)
    sessions, path = scratch.written(T.activity_sessions(e), "sessions"), _place(spark, "evidence")
    projection.run_projection(e.filter("id % 3 <> 1"), sessions, path, _NOW, VERSIONS, 1)
    projection.run_projection(e, sessions, path, _NOW, VERSIONS, 2)
    if not projection.run_projection(e, sessions, path, _NOW, VERSIONS, 3).isEmpty():
        raise AssertionError("a run over the same events has written receipts")
    _, rows = projection.evidence_store(spark, path)
    return revisions.latest_revision(rows, projection.EVIDENCE_KEYS).select("evidence_kind", "source_event_id", "person_id", "session_id", "observed_at", "prompt_identity")


@query("""WITH b AS (SELECT conv_id, string_agg(concat('{"role":"', role, '","turn":', turn, '}', chr(10)), '' ORDER BY turn) AS body FROM conversations GROUP BY 1)
SELECT concat('workspaces/w1/collectors/c', conv_id % 4, '/thread/conv-', conv_id, '/generations/0-g/0-', strlen(body), '-', sha256(body), '.jsonl.gz') AS object, sha256(body) AS source_sha256 FROM b""")
def stored_objects(spark, sf_dir):
    """Each conversation as an object that was written, written again, and read back whole."""
    c = T.table(spark, sf_dir, "conversations")
    line = F.concat(F.lit('{"role":"'), "role", F.lit('","turn":'), F.col("turn").cast("string"), F.lit("}\n"))
    b = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").cast("binary").alias("body"))
    b = b.select(
        F.lit("w1").alias("workspace_id"), F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("collector_key"), F.lit("thread").alias("source_kind"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_stream_key"),
        F.lit(0).alias("generation_seq"), F.lit("g").alias("generation_key"), F.lit(0).alias("start_offset"), F.octet_length("body").alias("end_offset"), "body",
    )
    path = _place(spark, "objects")
    for _ in range(2):
        objects.write_objects(b, path)
    found = objects.read_objects(spark, path)
    return found.select(F.regexp_extract("path", "(workspaces/.*)$", 1).alias("object"), F.sha2("body", 256).alias("source_sha256"))


_UUID = "concat('0190a1b2-0000-7000-8000-', lpad(lower(hex({})), 12, '0'))"


@query(f"""WITH p AS (SELECT {_UUID.format('c_custkey')} AS person_id, c_name AS name FROM customer), f AS (SELECT * FROM p ORDER BY person_id LIMIT 20) SELECT person_id, name FROM p WHERE person_id > (SELECT max(person_id) FROM f) ORDER BY person_id LIMIT 21""")
def people_pages(spark, sf_dir):
    """The second page of people, by the cursor that the first one gives."""
    p = T.table(spark, sf_dir, "customer").select(F.expr(_UUID.format("c_custkey")).alias("person_id"), F.col("c_name").alias("name"))
    first = detail.people_page(p, tokens.decode_people_cursor("")).collect()  # a page
    more = tokens.encode_people_cursor(first[tokens.PEOPLE_PAGE - 1]["person_id"]) if len(first) > tokens.PEOPLE_PAGE else None
    return detail.people_page(p, tokens.decode_people_cursor(more)) if more else p.limit(0)
