"""Native records of agent sessions, read on schema from JSON, as typed events.

Input rows are records: stream (of bytes), record_index, record (text), parse_status (ok, malformed, unknown, fragment),
occurred_at (text or number, kept as it is), and what the collector observed: seen_session_id, seen_parent_id. A batch is
one stream's rows. Output is one row per event, in the order of (record_index, projection_index).

Two shapes of records are known. In a thread a record has `type` and `payload`, and one says what the session is. In a
transcript a record has `uuid`, `parentUuid` and `message`, whose content blocks become events of their own. Everything is
expressions over VARIANT, so nothing leaves the JVM. What a record says is read once and written as plain columns, as the rules
below read most of them several times. A record whose JSON names a key twice does not parse and counts as
malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import content_hash, cumulative_usage, excerpt, message_usage
from .scratch import written

# Native types by the kind of event that they are.
LIFECYCLE = ("task_started", "task_complete", "turn_started", "turn_complete")
TOOL_CALLS = ("function_call", "custom_tool_call", "local_shell_call", "computer_call", "web_search_call")
TOOL_RESULTS = ("function_call_output", "custom_tool_call_output", "local_shell_call_output", "computer_call_output")
TEXT_BLOCKS = ("input_text", "output_text", "text")
THOUGHTS = ("thinking", "redacted_thinking")

EVENT = [
    "stream", "record_index", "projection_index", "session_id", "scope_key", "logical_event_key", "source_priority", "event_kind", "event_subtype", "phase", "actor_role", "occurred_at",
    "native_item_id", "parent_item_id", "turn_id", "tool_call_id", "tool_name", "tool_status", "message_role", "message_origin", "model", "usage", "error_code", "content_sha256", "content_bytes", "content_excerpt",
]


def text(v: Column, path: str) -> Column:
    """A member that is a string with more than white space, trimmed; null for anything else. Casts alone would take
    numbers and booleans for strings."""
    s = F.try_variant_get(v, path, "string")
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(is_text & s.rlike(r"\S"), F.regexp_replace(s, r"^\s+|\s+$", ""))


def member(v: Column, path: str) -> Column:
    """A member that is an object."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def whole(v: Column, path: str) -> Column:
    """A member that is a number without fraction, not negative and below 2 ** 53."""
    found = F.try_variant_get(v, path, "variant")
    n = F.try_variant_get(found, "$", "double")
    number = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(number & (n >= 0) & (n < float(1 << 53)) & (n == F.floor(n)), n.cast("long"))


def whole_or_zero(v: Column, path: str) -> Column:
    """As whole(), 0 where there is no such member."""
    return F.when(F.try_variant_get(v, path, "variant").isNull(), F.lit(0).cast("long")).otherwise(whole(v, path))


def flag(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return F.coalesce((F.schema_of_variant(found) == "BOOLEAN") & F.try_variant_get(found, "$", "boolean"), F.lit(False))


def blocks(content: Column) -> Column:
    """The content's blocks; empty unless it is an array."""
    return F.coalesce(F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>")), F.array().cast("array<variant>"))


def message_text(content: Column) -> Column:
    """A string as it is, or the texts of an array's text blocks, one a line; null without any."""
    plain = F.try_variant_get(content, "$", "string")
    of_block = lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).when(text(b, "$.type").isin(*TEXT_BLOCKS), text(b, "$.text"))
    parts = F.array_compact(F.transform(blocks(content), of_block))
    return F.when(F.schema_of_variant(content) == "STRING", F.when(F.trim(F.regexp_replace(plain, r"\s+", " ")) != "", plain)).when(F.size(parts) > 0, F.array_join(parts, "\n"))


def assistant_origin(role: Column) -> Column:
    return F.when(role.isin("worker", "guardian", "automation"), "worker").otherwise("unknown")


def _first(c: Column, order: Column) -> Column:
    return F.min(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("c"))))["c"]


def _last(c: Column, order: Column) -> Column:
    return F.max(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("c"))))["c"]


def _parsed(records: DataFrame) -> DataFrame:
    body = F.regexp_replace("record", r"[\r\n]+$", "")
    v = F.when(F.col("parse_status") == "ok", F.try_parse_json(body))
    v = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return records.withColumn("v", v)


def _event(**columns) -> Column:
    """An event's own columns; names that are not given are null."""
    kinds = {"projection_index": "int", "source_priority": "int", "usage": "struct<input:bigint,cached:bigint,output:bigint,reasoning:bigint,total:bigint>", "content_bytes": "int"}
    own = ["projection_index", "logical_event_key", "source_priority", "event_kind", "event_subtype", "phase", "native_item_id", "parent_item_id", "turn_id", "tool_call_id", "tool_name", "tool_status", "message_role", "message_origin", "model", "usage", "error_code", "content_sha256", "content_bytes", "content_excerpt"]
    value = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(*[value(columns.get(k)).cast(kinds.get(k, "string")).alias(k) for k in own])


def _content(t: Column, wanted: Column) -> dict[str, Column]:
    """Hash, size and excerpt of a message, or what is wrong with it."""
    return {
        "content_sha256": F.when(wanted, content_hash(t)), "content_bytes": F.when(wanted, F.octet_length(t)), "content_excerpt": F.when(wanted, excerpt(t)),
        "empty": F.when(wanted & t.isNull(), "empty_message_content"),
    }


def thread_fields(parsed: DataFrame) -> DataFrame:
    """What a record's JSON says, as plain columns of a written table: sessions and events both read this one. A description and a
    context stay JSON, as few records are one."""
    v, p, total, native, kind = F.col("v"), F.col("p"), F.col("total"), F.col("native"), F.col("kind")
    # Each step is read several times by the next, so Spark keeps them apart and works each out once.
    first = parsed.withColumn("p", member(v, "$.payload")).withColumn("native", text(v, "$.type"))
    second = first.withColumn("kind", text(p, "$.type")).withColumn("content", F.try_variant_get(p, "$.content", "variant")).withColumn("total", F.when((native == "event_msg") & (text(p, "$.type") == "token_count"), member(p, "$.info.total_token_usage")))
    event = v.isNotNull() & (native == "event_msg")
    f = second.select(
        "stream", "record_index", "parse_status", "occurred_at", "seen_session_id", "seen_parent_id", v.isNotNull().alias("ok"), "native", "kind",
        text(p, "$.role").alias("said_role"), F.when(event, text(p, "$.message")).otherwise(message_text(F.col("content"))).alias("said"),
        text(p, "$.turn_id").alias("turn"), text(p, "$.id").alias("own"), text(p, "$.phase").alias("said_phase"), text(p, "$.call_id").alias("call"), text(p, "$.name").alias("name"), text(p, "$.status").alias("status"),
        F.when(event & (kind == "error"), text(p, "$.code")).alias("code"), F.when(native.isin("session_meta", "turn_context"), text(p, "$.model")).alias("model"),
        whole(total, "$.input_tokens").alias("input"), whole_or_zero(total, "$.cached_input_tokens").alias("cached"), whole(total, "$.output_tokens").alias("output"), whole_or_zero(total, "$.reasoning_output_tokens").alias("thought"), whole(total, "$.total_tokens").alias("total"),
        F.when(native == "session_meta", F.to_json(p)).alias("meta"), F.when(native == "turn_context", F.to_json(p)).alias("context"),
    )
    return written(f, "records")


def thread_sessions(parsed: DataFrame) -> DataFrame:
    """What a batch's first description and last context say of its session."""
    return _described(thread_fields(parsed))


def _described(fields: DataFrame) -> DataFrame:
    order = F.col("record_index")
    s = fields.groupBy("stream").agg(
        _first(F.col("meta"), order).alias("meta"), _last(F.col("context"), order).alias("context"), F.max("seen_session_id").alias("seen"), F.max("seen_parent_id").alias("seen_parent"),
    )
    m, c = F.try_parse_json("meta"), F.try_parse_json("context")
    source = F.try_variant_get(m, "$.source", "variant")
    agent = member(m, "$.source.subagent")
    named = F.lower(text(m, "$.source"))
    role = (
        F.when(F.col("meta").isNull(), "unknown")
        .when(agent.isNotNull(), F.when(F.lower(F.to_json(agent)).contains("guardian"), "guardian").otherwise("worker"))
        .when(named.contains("automation"), "automation")
        .when(named.isNotNull() | source.isNull() | F.is_variant_null(source), "primary")
        .otherwise("unknown")
    )
    own = F.coalesce(text(m, "$.id"), F.col("seen"))
    declared = text(m, "$.session_id")
    return s.select(
        "stream", own.alias("session_id"), F.coalesce(text(m, "$.parent_thread_id"), F.when(declared != own, declared)).alias("parent_session_id"), role.alias("actor_role"), text(m, "$.title").alias("title"),
        F.coalesce(text(c, "$.model"), text(m, "$.model")).alias("session_model"), F.coalesce(text(c, "$.cwd"), text(m, "$.cwd")).alias("cwd"),
        F.coalesce(text(m, "$.git.branch"), text(c, "$.git.branch"), text(c, "$.branch")).alias("branch"),
    )


def normalize_threads(records: DataFrame) -> DataFrame:
    """One event per record."""
    fields = thread_fields(_parsed(records))
    ok, native, kind = F.col("ok"), F.col("native"), F.col("kind")
    event, item = ok & (native == "event_msg"), ok & (native == "response_item")
    role = F.when(event & (kind == "user_message"), "user").when(event & (kind == "agent_message"), "assistant").when(item & (kind == "message") & F.col("said_role").isin("user", "assistant"), F.col("said_role"))
    joined = fields.join(_described(fields), "stream", "left").withColumn("role", role)
    role, said = F.col("role"), F.col("said")
    is_message = role.isNotNull()
    turn, own, phase = F.col("turn"), F.col("own"), F.when(item & is_message, F.col("said_phase"))
    key = F.when(is_message & turn.isNotNull(), F.when(role == "user", F.concat(F.lit("message:user:"), turn)).otherwise(F.concat(F.lit("message:assistant:"), turn, F.lit(":"), F.coalesce(own, phase))))
    usage = F.when(event & (kind == "token_count"), cumulative_usage(*map(F.col, ("input", "cached", "output", "thought", "total"))))
    kinds = (
        F.when(ok & native.isin("session_meta", "turn_context"), "lifecycle")
        .when(event & (kind == "agent_message"), "agent_message")
        .when(is_message, "message")
        .when(usage.isNotNull(), "usage")
        .when(event & kind.isin(*LIFECYCLE), "lifecycle")
        .when(event & (kind == "tool_output"), "tool_result")
        .when(event & (kind == "error"), "error")
        .when(item & (kind == "message"), "ignored")
        .when(item & (kind == "reasoning"), "reasoning")
        .when(item & kind.isin(*TOOL_CALLS), "tool_call")
        .when(item & kind.isin(*TOOL_RESULTS), "tool_result")
        .otherwise("unknown")
    )
    subtype = F.when(ok & native.isin("session_meta", "turn_context"), native).when(item & (kind == "message") & ~is_message, F.concat(F.lit("message:"), F.coalesce("said_role", F.lit("unknown")))).otherwise(F.coalesce(kind, native))
    content = _content(said, is_message)
    error = (
        F.when(~ok, F.concat(F.lit("native_"), F.when(F.col("parse_status") == "ok", "malformed").otherwise(F.col("parse_status"))))
        .when(event & (kind == "token_count") & usage.isNull(), "invalid_token_count")
        .when(event & (kind == "error"), F.coalesce("code", F.lit("native_error")))
        .otherwise(content.pop("empty"))
    )
    e = _event(
        projection_index=0, logical_event_key=key, source_priority=F.when(item & is_message & (role == "user"), 50).otherwise(100), event_kind=kinds, event_subtype=subtype, phase=phase, native_item_id=own, turn_id=turn,
        tool_call_id=F.col("call"), tool_name=F.when(item & kind.isin(*TOOL_CALLS), F.coalesce("name", kind)).when(item & kind.isin(*TOOL_RESULTS), F.col("name")), tool_status=F.col("status"), message_role=role,
        message_origin=F.when(role == "user", "human").when(role == "assistant", assistant_origin(F.col("actor_role"))), model=F.coalesce(F.when(ok & native.isin("session_meta", "turn_context"), F.col("model")), F.col("session_model")),
        usage=usage, error_code=error, **content,
    )
    return _flat(joined.withColumn("e", e))


def _flat(df: DataFrame) -> DataFrame:
    scope = F.coalesce(F.concat(F.lit("session:"), F.col("session_id")), F.concat(F.lit("stream:"), F.col("stream")))
    return df.withColumn("scope_key", scope).select("stream", "record_index", "session_id", "scope_key", F.coalesce("actor_role", F.lit("unknown")).alias("actor_role"), "occurred_at", "e.*").select(EVENT)


def transcript_fields(parsed: DataFrame) -> DataFrame:
    """What a record's JSON says, as plain columns of a written table: sessions, turns and events all read this one."""
    v, m, used = F.col("v"), F.col("m"), F.col("used")
    either = lambda x, *paths: F.coalesce(*[text(x, p) for p in paths])
    # Each step is read several times by the next, so Spark keeps them apart and works each out once.
    first = parsed.withColumn("m", member(v, "$.message"))
    second = first.withColumn("content", F.try_variant_get("m", "$.content", "variant")).withColumn("used", member(m, "$.usage"))
    of_block = lambda b: F.struct(text(b, "$.type").alias("kind"), text(b, "$.id").alias("id"), text(b, "$.name").alias("name"), text(b, "$.tool_use_id").alias("of"), flag(b, "$.is_error").alias("failed"))
    f = second.select(
        "stream", "record_index", "parse_status", "occurred_at", "seen_session_id", "seen_parent_id", v.isNotNull().alias("ok"), m.isNotNull().alias("has_message"), used.isNotNull().alias("has_usage"),
        text(v, "$.uuid").alias("uuid"), either(v, "$.parentUuid", "$.parent_uuid").alias("parent"), text(v, "$.type").alias("native"), text(v, "$.subtype").alias("subtype"), flag(v, "$.isMeta").alias("is_meta"), flag(v, "$.isSidechain").alias("side"),
        either(v, "$.promptId", "$.prompt_id").alias("prompt"), either(v, "$.requestId", "$.request_id").alias("request"), either(v, "$.sessionId", "$.session_id").alias("declared"), either(v, "$.agentId", "$.agent_id").alias("agent"),
        text(v, "$.customTitle").alias("title"), text(v, "$.cwd").alias("cwd"), text(v, "$.gitBranch").alias("branch"),
        text(m, "$.id").alias("message_id"), text(m, "$.role").alias("message_role"), text(m, "$.model").alias("model"), either(m, "$.stop_reason", "$.stopReason").alias("stop"),
        message_text(F.col("content")).alias("said"), F.transform(blocks(F.col("content")), of_block).alias("blocks"),
        whole(used, "$.input_tokens").alias("plain"), whole_or_zero(used, "$.cache_read_input_tokens").alias("read"), whole_or_zero(used, "$.cache_creation_input_tokens").alias("made"), whole(used, "$.output_tokens").alias("out"),
    )
    return written(f, "records")


def transcript_sessions(fields: DataFrame) -> DataFrame:
    order = F.col("record_index")
    head = F.when(F.col("ok"), F.struct("declared", "agent", "side", "title"))
    s = fields.groupBy("stream").agg(
        _first(head, order).alias("h"), _first(F.when(F.col("native") == "assistant", F.col("model")), order).alias("session_model"), _last(F.col("cwd"), order).alias("cwd"), _last(F.col("branch"), order).alias("branch"),
        F.max("seen_session_id").alias("seen"), F.max("seen_parent_id").alias("seen_parent"),
    )
    own = F.coalesce("seen", "h.agent", "h.declared")
    parent = F.coalesce(F.col("seen_parent"), F.when(F.col("h.agent").isNotNull() & (F.col("h.declared") != own), F.col("h.declared")))
    role = F.when(parent.isNotNull() | F.col("h.side"), "worker").when(own.isNotNull(), "primary").otherwise("unknown")
    return s.select("stream", own.alias("session_id"), parent.alias("parent_session_id"), role.alias("actor_role"), F.col("h.title").alias("title"), "session_model", "cwd", "branch")


def inherited(nodes: DataFrame, part: str = "stream", node: str = "node", parent: str = "parent", named: str = "named", own: str = "own", rounds: int = 24) -> DataFrame:
    """part, node, value: what a node's nearest ancestor (itself included) is `named`; without any such, what the topmost
    of its ancestors that has one calls its `own`.

    Pointers double: after k rounds a node knows 2 ** k ancestors and points beyond them, so a chain of any length takes
    a logarithm of joins. Each round's lineage is cut by a checkpoint. A cycle never leaves `rounds`, and its nodes get
    what the walk has met by then.
    """
    spark = nodes.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = nodes.select(F.col(part).alias("part"), F.col(node).alias("node"), F.col(parent).alias("ptr"), F.col(named).alias("near"), F.col(own).alias("top"))
    real = known.select(F.col("part").alias("p"), F.col("node").alias("n"))
    known = known.join(real, (F.col("part") == F.col("p")) & (F.col("ptr") == F.col("n")), "left").select("part", "node", F.col("n").alias("ptr"), "near", "top").checkpoint()
    for _ in range(rounds):
        # A node that has found a name needs no more steps.
        if not known.filter("ptr IS NOT NULL AND near IS NULL").limit(1).count():
            break
        b = known.select(F.col("part").alias("p"), F.col("node").alias("n"), F.col("ptr").alias("next"), F.col("near").alias("near_b"), F.col("top").alias("top_b"))
        walks = (F.col("part") == F.col("p")) & (F.when(F.col("near").isNull(), F.col("ptr")) == F.col("n"))
        known = known.join(b, walks, "left").select("part", "node", F.col("next").alias("ptr"), F.coalesce("near", "near_b").alias("near"), F.coalesce("top_b", "top").alias("top")).checkpoint()
    return known.select(F.col("part").alias(part), F.col("node").alias(node), F.coalesce("near", "top").alias("value"))


def turn_ids(fields: DataFrame, prefix: str) -> DataFrame:
    """stream, uuid, turn_id: the prompt that a record names or inherits; without one its request, or itself if it is a
    submitted message."""
    result = F.exists("blocks", lambda b: F.coalesce(b["kind"] == "tool_result", F.lit(False)))
    submitted = (F.col("native") == "user") & ~F.col("is_meta") & F.col("said").isNotNull() & ~result
    name = lambda kind, c: F.concat(F.lit(f"{prefix}:{kind}:"), c)
    nodes = fields.filter("uuid IS NOT NULL").select(
        "stream", "record_index", F.col("uuid").alias("node"), "parent", name("prompt", F.col("prompt")).alias("named"),
        F.coalesce(name("request", F.col("request")), F.when(submitted, name("prompt", F.col("uuid")))).alias("own"),
    )
    last = Window.partitionBy("stream", "node").orderBy(F.desc("record_index"))
    return inherited(nodes.withColumn("n", F.row_number().over(last)).filter("n = 1")).select("stream", F.col("node").alias("uuid"), F.col("value").alias("turn_id"))


def normalize_transcripts(records: DataFrame, prefix: str = "transcript") -> DataFrame:
    """Events of each record: its message, its reasoning and tool blocks, its usage, its end of turn; records with none of
    these become one event too. prefix begins logical keys and turn ids, and tells sources of records apart."""
    fields = transcript_fields(_parsed(records))
    turns = turn_ids(fields, prefix)
    sessions = transcript_sessions(fields).select("stream", "session_id", "actor_role", "session_model")
    joined = fields.join(sessions, "stream", "left").join(turns, ["stream", "uuid"], "left")
    native, message_id, stop, said = F.col("native"), F.col("message_id"), F.col("stop"), F.col("said")
    own, role = F.coalesce("uuid", "message_id"), F.coalesce("message_role", "native")
    named = lambda kind, c, *rest: F.concat(F.lit(f"{prefix}:{kind}:"), c, *rest)
    base = {"native_item_id": own, "parent_item_id": F.col("parent"), "turn_id": F.col("turn_id"), "model": F.coalesce("model", "session_model"), "source_priority": 100}
    event = lambda **c: _event(**(base | c))

    content = _content(said, F.lit(True))
    content.pop("empty")
    origin = F.when(role != "user", assistant_origin(F.col("actor_role"))).when(F.col("is_meta"), "system").when(F.col("actor_role") == "primary", "human").otherwise("parent_agent")
    spoken = F.when(said.isNotNull(), event(event_kind="message", event_subtype=F.when(native == "user", "user_message").otherwise("message"), message_role=role, message_origin=origin, logical_event_key=named("message", own), **content))

    def of_block(b: Column, i: Column) -> Column:
        kind = b["kind"]
        return (
            F.when(kind.isin(*THOUGHTS), event(event_kind="reasoning", event_subtype=kind, logical_event_key=named("reasoning", own, F.lit(":block:"), i.cast("string"))))
            .when(kind == "tool_use", event(event_kind="tool_call", event_subtype=kind, tool_call_id=b["id"], tool_name=b["name"]))
            .when(kind == "tool_result", event(event_kind="tool_result", event_subtype=kind, tool_call_id=b["of"], tool_status=F.when(b["failed"], "failed").otherwise("completed")))
        )

    u = message_usage(*map(F.col, ("plain", "read", "made", "out")))
    counted = F.struct(u["input"].alias("input"), u["cached"].alias("cached"), u["output"].alias("output"), F.lit(0).cast("long").alias("reasoning"), u["total"].alias("total"))
    usage = F.when(F.col("has_usage") & u["total"].isNotNull(), event(event_kind="usage", event_subtype="message_usage", usage=counted, logical_event_key=named("usage", message_id), source_priority=F.when(stop.isNull(), 100).otherwise(110)))
    ended = F.when(stop != "tool_use", event(event_kind="lifecycle", event_subtype="turn_complete", logical_event_key=named("lifecycle", own, F.lit(":turn_complete"))))
    several = F.array_compact(F.concat(F.array(spoken), F.transform("blocks", of_block), F.array(usage, ended)))
    nothing = F.array(event(event_kind="ignored", event_subtype=F.concat(native, F.lit(":empty_content"))))

    ok, subtype = F.col("ok"), F.col("subtype")
    other = F.array(event(
        event_kind=F.when(ok & native.isin("system", "progress"), "lifecycle").otherwise("unknown"),
        event_subtype=F.when((native == "system") & (subtype == "turn_duration"), "turn_complete").otherwise(F.coalesce(subtype, native)),
        error_code=F.when(~ok, F.concat(F.lit("native_"), F.when(F.col("parse_status") == "ok", "malformed").otherwise(F.col("parse_status")))),
    ))
    is_message = ok & native.isin("user", "assistant") & F.col("has_message")
    found = F.when(F.coalesce(is_message, F.lit(False)), F.when(F.size(several) > 0, several).otherwise(nothing)).otherwise(other)
    each = joined.select("stream", "record_index", "session_id", "actor_role", "occurred_at", F.posexplode(found).alias("i", "x"))
    return _flat(each.withColumn("e", F.col("x").withField("projection_index", F.col("i"))))


# What a hook may report, and what a session's end may give as its reason.
HOOKS = ("Stop", "SubagentStop", "SessionEnd")
END_REASONS = ("clear", "resume", "logout", "prompt_input_exit", "bypass_permissions_disabled", "other")
_SHA, _UUID, _UTC = r"^[0-9a-f]{64}\z", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z\z"


def hook_fields(parsed: DataFrame) -> DataFrame:
    """What a hook's record and its payload say, as plain columns of a written table: checks read many of them several times."""
    v, p = F.col("v"), F.col("p")
    first = parsed.withColumn("encoded", text(v, "$.payload_base64")).withColumn("raw", F.try_to_binary("encoded", F.lit("base64")))
    second = first.withColumn("parsed", F.try_parse_json(F.try_validate_utf8(F.col("raw").cast("string")))).withColumn("p", F.when(F.schema_of_variant("parsed").startswith("OBJECT"), F.col("parsed")))
    f = second.select(
        "stream", "record_index", "parse_status", "occurred_at", "seen_session_id", "seen_parent_id", v.isNotNull().alias("ok"), text(v, "$.type").alias("native"), text(v, "$.schema_version").alias("version"),
        text(v, "$.dispatch_event_name").alias("hook"), text(v, "$.payload_sha256").alias("sha"), text(v, "$.collector_observed_at").alias("observed"), F.col("encoded").isNotNull().alias("has_payload"), F.sha2("raw", 256).alias("raw_sha"),
        text(v, "$.native_session_id").alias("session"), text(v, "$.parent_native_session_id").alias("parent"), whole(v, "$.transcript_byte_count").alias("count"), text(v, "$.transcript_sha256").alias("digest"),
        text(v, "$.terminal_assistant_uuid").alias("last"), text(v, "$.turn_anchor_id").alias("anchor"),
        text(p, "$.session_id").alias("paid"), text(p, "$.agent_id").alias("agent"), text(p, "$.hook_event_name").alias("paid_hook"), text(p, "$.reason").alias("reason"),
    )
    return written(f, "hooks")


def normalize_hooks(records: DataFrame, schema_version: str, hook_type: str = "hook", prefix: str = "transcript") -> DataFrame:
    """One lifecycle event per hook record: the end of a session, or of a response, which is the end of a turn only where
    the record binds it to a transcript. A record that fails a check says which; checks come in a fixed order, and the
    first that fails counts. Their payloads come in base64 with their hash."""
    fields = hook_fields(_parsed(records))
    hook, sha, observed = F.col("hook"), F.col("sha"), F.col("observed")
    session, parent, paid = F.col("session"), F.col("parent"), F.col("paid")
    sub = hook == "SubagentStop"
    count, digest, last, anchor = F.col("count"), F.col("digest"), F.col("last"), F.col("anchor")
    yes = lambda c: F.coalesce(c, F.lit(False))
    owner = F.when(sub, F.col("agent")).otherwise(paid)
    above = F.when(sub, paid)
    error = (
        F.when(~F.col("ok"), F.concat(F.lit("native_"), F.when(F.col("parse_status") == "ok", "malformed").otherwise(F.col("parse_status"))))
        .when(~yes((F.col("native") == hook_type) & (F.col("version") == schema_version)), "invalid_hook_schema")
        .when(~yes(observed.rlike(_UTC) & F.try_to_timestamp(observed).isNotNull()), "invalid_hook_observed_at")
        .when(~yes(hook.isin(*HOOKS)), "invalid_hook_event")
        .when(~yes(sha.rlike(_SHA) & F.col("has_payload")), "invalid_hook_payload")
        .when(~yes(F.col("raw_sha") == sha), "invalid_hook_payload_hash")
        .when(~yes(F.col("paid_hook") == hook), "invalid_hook_payload_event")
        .when(~yes((session == owner) & (session == F.col("seen_session_id"))) | ~parent.eqNullSafe(above) | ~parent.eqNullSafe(F.col("seen_parent_id")), "invalid_hook_session")
        .when((count.isNull() != digest.isNull()) | ~F.coalesce(digest.rlike(_SHA), F.lit(True)), "invalid_hook_transcript")
        .when(~F.coalesce(last.rlike(_UUID), F.lit(True)) | ~F.coalesce(anchor.rlike(_UUID), F.lit(True)) | yes((hook == "SessionEnd") & F.coalesce(last, anchor).isNotNull()), "invalid_hook_anchor")
        .when(last.isNotNull() & F.coalesce(count == 0, F.lit(True)), "invalid_hook_transcript")
    )
    bound = last.isNotNull() & anchor.isNotNull() & count.isNotNull() & digest.isNotNull()
    good = F.col("error").isNull()
    own = F.concat(F.lit(f"{prefix}:hook:"), sha)
    e = _event(
        projection_index=0, source_priority=120, event_kind="lifecycle", error_code=F.col("error"),
        event_subtype=F.when(~good, "hook_invalid").when(hook == "SessionEnd", "session_end").when(bound, "turn_complete").otherwise("response_complete_unlinked"),
        logical_event_key=F.when(good, F.when(bound, F.concat(F.lit(f"{prefix}:lifecycle:"), last, F.lit(":turn_complete"))).otherwise(own)),
        native_item_id=F.when(good & (hook != "SessionEnd"), last), turn_id=F.when(good & bound, F.concat(F.lit(f"{prefix}:prompt:"), anchor)),
        phase=F.when(good & (hook == "SessionEnd") & F.col("reason").isin(*END_REASONS), F.col("reason")),
    )
    role = F.when(F.col("seen_parent_id").isNotNull(), "worker").when(F.col("seen_session_id").isNotNull(), "primary").otherwise("unknown")
    out = fields.withColumn("error", error).withColumn("e", e).withColumn("session_id", F.col("seen_session_id")).withColumn("actor_role", role)
    return _flat(out.withColumn("occurred_at", F.when(good, observed).otherwise(F.col("occurred_at"))))
