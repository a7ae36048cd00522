"""The star-schema tables seen as activity events, people and transcript records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# An event's columns over a row of one of two tables, in SQL that both engines read. `src` is e for rows of `events`, where
# the number k in a row's properties says what a source would, and c for `conversations`, whose messages are recorded in up
# to three forms: as submitted or announced (0), as a copy right after (1) and as a structured item (2).
_MESSAGE = "(src = 'c' AND tag <> 'system')"
_NATIVE = "concat('msg_', substr(lpad(lower(hex(CAST(floor(us / 1000) AS BIGINT))), 12, '0'), 1, 8), '-', substr(lpad(lower(hex(CAST(floor(us / 1000) AS BIGINT))), 12, '0'), 9, 4), '-7000-8000-', lpad(lower(hex(id % 100000)), 12, '0'))"
_KINDS = {
    "event_kind": f"""CASE WHEN {_MESSAGE} THEN CASE WHEN tag = 'assistant' AND form < 2 THEN 'agent_message' ELSE 'message' END WHEN src = 'c' OR tag = 'signup' THEN 'lifecycle'
      WHEN tag = 'view' THEN CASE WHEN k % 13 = 12 THEN 'agent_message' ELSE 'message' END WHEN tag = 'click' THEN CASE WHEN k % 10 = 7 THEN 'agent_spawn' ELSE 'tool_call' END
      WHEN tag = 'purchase' THEN CASE WHEN k % 10 = 3 THEN 'usage' ELSE 'tool_result' END ELSE CASE WHEN k % 3 = 1 THEN 'reasoning' ELSE 'error' END END""",
}
_FIELDS = {
    "event_subtype": """CASE event_kind WHEN 'agent_message' THEN 'agent_message' WHEN 'message' THEN CASE WHEN (src = 'c' AND form < 2) OR (src = 'e' AND k % 2 = 0) THEN 'user_message' ELSE 'message' END
      WHEN 'lifecycle' THEN CASE WHEN k % 7 = 5 THEN 'session_meta' WHEN k % 2 = 0 THEN 'task_started' ELSE 'task_complete' END END""",
    "actor_role": "CASE WHEN src = 'c' THEN 'primary' WHEN person_id % 29 = 28 THEN 'automation' WHEN session_id % 5 < 2 THEN 'primary' WHEN session_id % 5 = 2 THEN 'worker' WHEN session_id % 5 = 3 THEN 'guardian' ELSE 'unknown' END",
    "scope_key": "CASE WHEN k % 11 <> 10 THEN concat('session:', session_id) END",
    "normalizer_version": "CASE WHEN src = 'c' THEN 'threads.v1' WHEN k % 17 = 16 THEN 'threads.v0' WHEN k % 2 = 0 THEN 'threads.v1' ELSE 'transcripts.v1' END",
    "logical_event_key": "CASE WHEN src = 'e' AND k % 4 <> 0 THEN concat('L', k % 3) END",
    "turn_id": "CASE WHEN src = 'e' AND k % 6 = 5 THEN concat('t', k % 5) END",
    "source_priority": "50 + 50 * (k % 3)",
    "native_item_id": f"CASE WHEN (src = 'e' AND k % 5 = 2) OR (src = 'c' AND form = 2 AND k % 3 = 0) THEN {_NATIVE} WHEN src = 'e' AND k % 5 = 3 THEN concat('item-', k % 10) END",
    "message_role": f"CASE WHEN {_MESSAGE} THEN tag WHEN event_kind = 'agent_message' THEN 'assistant' WHEN event_kind = 'message' THEN CASE WHEN k % 2 = 0 OR k % 4 = 1 THEN 'user' ELSE 'assistant' END END",
    "content_sha256": f"CASE WHEN {_MESSAGE} THEN concat('c', session_id, '-', n % 2) WHEN k % 20 <> 19 THEN concat('h', k % 10) END",
    "content_bytes": "CASE WHEN src = 'e' AND k % 12 = 11 THEN 0 ELSE k + 1 END",
    "content_excerpt": "CASE WHEN k % 3 <> 1 THEN concat('k', k) END",
    "error_code": "CASE WHEN src = 'e' AND k % 23 = 22 THEN 'native_error' END",
    "occurred_at": "CASE WHEN k % 10 <> 9 THEN us END",
    "observed_at": "us",
    "received_at": "us + 3600000000",
    "is_replay": "k % 25 = 24",
    "batch_id": "concat('b', session_id)",
    "record_index": "CASE WHEN src = 'c' THEN n * 4 + form ELSE id END",
    "native_type": "CASE WHEN form = 2 THEN 'response_item' ELSE 'event_msg' END",
    "native_payload_type": "CASE WHEN event_kind = 'message' AND (src = 'e' OR form < 2) THEN 'user_message' WHEN event_kind = 'message' THEN 'message' WHEN event_kind = 'agent_message' THEN 'agent_message' END",
    "collector_key": "concat('c', person_id)",
    "source_kind": "'thread'",
    "source_stream_key": "concat('s', session_id)",
    "generation_key": "'g'",
    "generation_seq": "0",
    "content_key": "k % 10",
}
_AFTER = {
    "message_origin": "CASE WHEN message_role = 'user' THEN CASE WHEN k % 9 = 8 THEN 'parent_agent' ELSE 'human' END WHEN message_role = 'assistant' THEN 'unknown' END",
    "start_offset": "CAST(record_index AS BIGINT) * 100",
    "end_offset": "CAST(record_index AS BIGINT) * 100 + 100",
}
_DAY_START = 1_705_233_600_000_000
#: When a conversation's message is recorded, in microseconds.
_SAID_AT = f"{_DAY_START} - 7200000000 + (conv_id * 37 % 1560) * 60000000 + n * (CASE WHEN conv_id % 5 = 0 THEN 1000000 ELSE 47000000 END) + CASE form WHEN 1 THEN CASE WHEN conv_id % 4 = 0 THEN 160000 ELSE 60000 END WHEN 2 THEN (conv_id + n) % 5 * 700000 ELSE 0 END"
_RECORDED = "form = 0 OR (form = 1 AND role = 'user' AND n % 3 = 0) OR (form = 2 AND role <> 'system' AND n % 4 <> 3)"
_COLUMNS = ["id", "person_id", "session_id", *_KINDS, *_FIELDS, *_AFTER, "k", "value"]


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `events` and the messages of `conversations` as activity events."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("person_id"), (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)).alias("session_id"), micros(F.col("ts")).alias("us"), k.alias("k"), "value",
        F.lit("e").alias("src"), F.col("event_type").alias("tag"), F.lit(0).alias("form"), F.lit(0).cast("long").alias("n"),
    )
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("n"), "role", F.explode(F.array(*map(F.lit, range(3)))).alias("form")).filter(_RECORDED)
    c = c.select(
        (F.lit(10**12) + F.col("conv_id") * 100_000 + F.col("n") * 4 + F.col("form")).alias("id"), (F.col("conv_id") % 30 + 1).alias("person_id"), (F.col("conv_id") + 900_000).alias("session_id"), F.expr(_SAID_AT).alias("us"),
        ((F.col("conv_id") + F.col("n") * 7) % 24).cast("int").alias("k"), F.col("n").cast("double").alias("value"), F.lit("c").alias("src"), F.col("role").alias("tag"), "form", "n",
    )
    both = e.unionByName(c)
    for step in (_KINDS, _FIELDS, _AFTER):
        both = both.selectExpr("*", *[f"{x} AS {name}" for name, x in step.items()])
    return both.select(_COLUMNS)


def _step(columns: dict[str, str], of: str) -> str:
    return f"SELECT *, {', '.join(f'{x} AS {name}' for name, x in columns.items())} FROM ({of})"


#: The same view for an engine that reads SQL only; a prefix for WITH.
EVENTS_SQL = f"""ev AS (SELECT {', '.join(_COLUMNS)}, coalesce(native_at, occurred_at, observed_at, received_at) AS effective_at, coalesce(occurred_at, observed_at, received_at) AS source_at, native_at FROM (
  SELECT *, CASE WHEN regexp_matches(native_item_id, '^[a-z][a-z0-9]*_[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$')
    THEN CAST(concat('0x', replace(regexp_extract(native_item_id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}'), '-', '')) AS BIGINT) * 1000 END AS native_at FROM (
  {_step(_AFTER, _step(_FIELDS, _step(_KINDS, f"""
  SELECT event_id AS id, user_id AS person_id, user_id * 10 + (day(ts) - 1) // 7 AS session_id, epoch_us(ts) AS us, CAST(props->>'$.k' AS INTEGER) AS k, value, 'e' AS src, event_type AS tag, 0 AS form, CAST(0 AS BIGINT) AS n FROM events
  UNION ALL SELECT 1000000000000 + conv_id * 100000 + n * 4 + form, conv_id % 30 + 1, conv_id + 900000, {_SAID_AT}, CAST((conv_id + n * 7) % 24 AS INTEGER), CAST(n AS DOUBLE), 'c', role, form, n
  FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS n, role, CAST(unnest([0, 1, 2]) AS INTEGER) AS form FROM conversations) WHERE {_RECORDED}""")))})))"""


def activity_sessions(events: DataFrame) -> DataFrame:
    """The sessions of activity events: every third began an hour after its first event, which is what it copied from
    another; every fourth has a parent."""
    s = events.groupBy("session_id").agg(F.min("person_id").alias("person_id"), F.min("observed_at").alias("__first"))
    late = F.when(F.col("session_id") % 3 == 0, 3_600_000_000).otherwise(0)
    return s.select("session_id", "person_id", (F.col("__first") + late + 500).alias("started_at"), F.when(F.col("session_id") % 4 == 0, F.col("session_id") + 1).alias("parent_session_id"))


SESSIONS_SQL = """se AS (SELECT session_id, min(person_id) AS person_id, min(observed_at) + CASE WHEN session_id % 3 = 0 THEN 3600000000 ELSE 0 END + 500 AS started_at,
  CASE WHEN session_id % 4 = 0 THEN session_id + 1 END AS parent_session_id FROM ev GROUP BY session_id)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    domain = F.get(F.array(*map(F.lit, ("a.example", "b.example", "c.example", "d.example", "e.example"))), F.col("c_nationkey") % 5)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 17 != 0, F.col("c_name")).alias("name"),
        F.concat(F.lit("cust:"), key).alias("identity_key"), F.concat(F.lit("u"), key, F.lit("@"), domain).alias("email"),
        F.when(F.col("c_custkey") % 50 == 49, "smoke").alias("external_id"),
    )


PEOPLE_SQL = """pe AS (
  SELECT c_custkey AS person_id, CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS name, concat('cust:', c_custkey) AS identity_key,
    concat('u', c_custkey, '@', ['a.example','b.example','c.example','d.example','e.example'][1 + c_nationkey % 5]) AS email,
    CASE WHEN c_custkey % 50 = 49 THEN 'smoke' END AS external_id FROM customer)"""
