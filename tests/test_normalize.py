from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from spanloom.operators import checks
from spanloom.sources import normalize as N

RECORD = "stream string, record_index long, record string, parse_status string, occurred_at string, seen_session_id string, seen_parent_id string"


def records(spark, *bodies, status="ok", seen="s1", parent=None, stream="st"):
    rows = [(stream, i, b if isinstance(b, str) else json.dumps(b) + "\n", status, None, seen, parent) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, RECORD)


def run(df, how=N.normalize_threads, **more):
    out = how(df, **more)
    assert out.columns == N.EVENT
    assert checks.broken(out, checks.EVENTS).collect() == []
    return out.orderBy("record_index", "projection_index").collect()


def item(kind, **more):
    return {"type": "response_item", "payload": {"type": kind, **more}}


def said(kind, **more):
    return {"type": "event_msg", "payload": {"type": kind, **more}}


def test_thread_records(spark):
    total = {"input_tokens": 100, "cached_input_tokens": 20, "output_tokens": 30, "reasoning_output_tokens": 10, "total_tokens": 130}
    got = run(records(
        spark,
        {"type": "session_meta", "payload": {"id": "t1", "source": "cli", "model": "m0", "git": {"branch": "main"}}},
        {"type": "turn_context", "payload": {"model": "m1"}},
        said("task_started", turn_id="u1"),
        said("user_message", message="Hello", turn_id="u1"),
        item("message", role="user", content=[{"type": "input_text", "text": " Hello "}, {"type": "image"}, "tail"], turn_id="u1"),
        item("reasoning"),
        item("function_call", name="ls", call_id="c1"),
        item("function_call_output", call_id="c1", status="completed"),
        item("message", role="assistant", content="Done", phase="final_answer", turn_id="u1"),
        item("message", role="developer", content="x"),
        said("token_count", info={"total_token_usage": total}),
        said("token_count", info={"total_token_usage": total | {"total_tokens": 131}}),
        said("token_count", info={"total_token_usage": total | {"input_tokens": "100"}}),
        said("error"),
        said("agent_message", message=""),
        item("web_search_call"),
    ))
    kinds = [(r["event_kind"], r["event_subtype"]) for r in got]
    assert kinds == [
        ("lifecycle", "session_meta"), ("lifecycle", "turn_context"), ("lifecycle", "task_started"), ("message", "user_message"), ("message", "message"), ("reasoning", "reasoning"), ("tool_call", "function_call"),
        ("tool_result", "function_call_output"), ("message", "message"), ("ignored", "message:developer"), ("usage", "token_count"), ("unknown", "token_count"), ("unknown", "token_count"), ("error", "error"),
        ("agent_message", "agent_message"), ("tool_call", "web_search_call"),
    ]
    assert {r["session_id"] for r in got} == {"t1"} and {r["actor_role"] for r in got} == {"primary"} and {r["scope_key"] for r in got} == {"session:t1"}
    assert [got[i]["model"] for i in (0, 1, 2)] == ["m0", "m1", "m1"]
    assert (got[3]["logical_event_key"], got[4]["logical_event_key"]) == ("message:user:u1", "message:user:u1")
    assert (got[3]["source_priority"], got[4]["source_priority"], got[8]["source_priority"]) == (100, 50, 100)
    assert got[4]["content_excerpt"] == "Hello\ntail" and got[3]["content_sha256"] == hashlib.sha256(b"Hello").hexdigest() and got[3]["content_bytes"] == 5
    assert got[8]["logical_event_key"] == "message:assistant:u1:final_answer" and got[8]["message_origin"] == "unknown" and got[3]["message_origin"] == "human"
    assert tuple(got[10]["usage"]) == (80, 20, 20, 10, 130)
    assert [got[i]["error_code"] for i in (11, 12, 13, 14)] == ["invalid_token_count", "invalid_token_count", "native_error", "empty_message_content"]
    assert (got[6]["tool_name"], got[6]["tool_call_id"], got[7]["tool_status"], got[15]["tool_name"]) == ("ls", "c1", "completed", "web_search_call")


def test_thread_roles_and_parents(spark):
    for source, role in (("Automation run", "automation"), ({"subagent": {"kind": "Guardian"}}, "guardian"), ({"subagent": {"kind": "x"}}, "worker"), ({"other": 1}, "unknown"), (None, "primary"), ("cli", "primary"), (5, "unknown")):
        meta = {"type": "session_meta", "payload": {"id": "a", "session_id": "b", "source": source}}
        df = N._parsed(records(spark, meta))
        r = N.thread_sessions(df).first()
        assert (r["actor_role"], r["parent_session_id"]) == (role, "b"), source
    assert run(records(spark, said("task_started"), seen=None))[0]["scope_key"] == "stream:st"


def test_what_does_not_parse(spark):
    got = run(records(spark, "{broken\n", "[1]\n", '{"a":1,"a":2}\n'))
    assert [r["error_code"] for r in got] == ["native_malformed"] * 3
    assert [r["error_code"] for r in run(records(spark, "piece", status="fragment"))] == ["native_fragment"]
    assert [r["error_code"] for r in run(records(spark, "piece", status="fragment"), N.normalize_transcripts)] == ["native_fragment"]
    assert run(records(spark, {}).filter(F.lit(False))) == []
    assert run(records(spark, {}).filter(F.lit(False)), N.normalize_transcripts) == []


def test_transcript_records(spark):
    got = run(records(
        spark,
        {"type": "user", "uuid": "u1", "sessionId": "x", "message": {"role": "user", "content": "Do it"}},
        {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "message": {"id": "m1", "role": "assistant", "model": "m", "content": [{"type": "thinking"}, {"type": "text", "text": "On it"}, {"type": "tool_use", "id": "c1", "name": "ls"}], "stop_reason": "tool_use", "usage": {"input_tokens": 10, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 2, "output_tokens": 7}}},
        {"type": "user", "uuid": "u2", "parentUuid": "a1", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True}]}},
        {"type": "assistant", "uuid": "a2", "parentUuid": "u2", "message": {"id": "m2", "content": [{"type": "text", "text": "Done"}], "stop_reason": "end_turn", "usage": {"input_tokens": 1, "output_tokens": -1}}},
        {"type": "user", "uuid": "u3", "parentUuid": "a2", "isMeta": True, "message": {"content": "meta"}},
        {"type": "system", "subtype": "turn_duration", "durationMs": 5},
        {"type": "assistant", "uuid": "a3", "message": {"content": []}},
        {"type": "summary", "summary": "s"},
    ), N.normalize_transcripts, prefix="p")
    assert [(r["record_index"], r["projection_index"], r["event_kind"], r["event_subtype"]) for r in got] == [
        (0, 0, "message", "user_message"), (1, 0, "message", "message"), (1, 1, "reasoning", "thinking"), (1, 2, "tool_call", "tool_use"), (1, 3, "usage", "message_usage"), (2, 0, "tool_result", "tool_result"),
        (3, 0, "message", "message"), (3, 1, "lifecycle", "turn_complete"), (4, 0, "message", "user_message"), (5, 0, "lifecycle", "turn_complete"), (6, 0, "ignored", "assistant:empty_content"), (7, 0, "unknown", "summary"),
    ]
    assert [r["turn_id"] for r in got] == ["p:prompt:u1"] * 9 + [None] * 3
    assert got[2]["logical_event_key"] == "p:reasoning:a1:block:0" and got[1]["logical_event_key"] == "p:message:a1" and got[7]["logical_event_key"] == "p:lifecycle:a2:turn_complete"
    assert tuple(got[4]["usage"]) == (10, 7, 7, 0, 24) and got[4]["logical_event_key"] == "p:usage:m1" and got[4]["source_priority"] == 110
    assert (got[5]["tool_call_id"], got[5]["tool_status"]) == ("c1", "failed")
    assert (got[0]["message_origin"], got[8]["message_origin"], got[1]["message_origin"]) == ("human", "system", "unknown")
    assert {r["session_id"] for r in got} == {"s1"}


def test_sidechains_are_workers(spark):
    df = records(spark, {"type": "user", "uuid": "u1", "sessionId": "x", "agentId": "g", "isSidechain": True, "message": {"content": "go"}}, seen=None)
    r = run(df, N.normalize_transcripts)[0]
    assert (r["session_id"], r["actor_role"], r["message_origin"]) == ("g", "worker", "parent_agent")


def test_inherited_names(spark):
    """Nearest named ancestor, else the topmost with a name of its own; long chains, cycles and foreign parents."""
    rows = [("s", f"n{i}", f"n{i - 1}" if i else None, "P" if i == 40 else None, f"o{i}" if i in (3, 90) else None) for i in range(100)]
    rows += [("t", "n5", "n4", None, "alone"), ("t", "c1", "c2", None, None), ("t", "c2", "c1", "C", None), ("t", "d1", "d2", None, None), ("t", "d2", "d1", None, None)]
    got = {(r["stream"], r["node"]): r["value"] for r in N.inherited(spark.createDataFrame(rows, "stream string, node string, parent string, named string, own string"), rounds=8).collect()}
    assert [got["s", f"n{i}"] for i in (0, 2, 3, 39, 40, 41, 90, 99)] == [None, None, "o3", "o3", "P", "P", "P", "P"]
    assert got["t", "n5"] == "alone" and got["t", "c1"] == "C" and got["t", "d1"] is None


def test_hook_records(spark):
    import base64

    sha = lambda b: hashlib.sha256(b).hexdigest()
    uuid, anchor = "0190a1b2-c3d4-7000-8000-000000000001", "0190a1b2-c3d4-7000-8000-000000000002"

    def hook(event="Stop", payload=None, **more):
        body = json.dumps({"hook_event_name": event, "session_id": "s1"} | (payload or {})).encode()
        base = {"type": "hook", "schema_version": "h1", "collector_observed_at": "2024-01-01T00:00:00.5Z", "dispatch_event_name": event, "payload_sha256": sha(body), "payload_base64": base64.b64encode(body).decode(), "native_session_id": "s1"}
        return {k: v for k, v in (base | more).items() if v is not None}

    bound = {"terminal_assistant_uuid": uuid, "turn_anchor_id": anchor, "transcript_byte_count": 9, "transcript_sha256": "a" * 64}
    bodies = [
        hook(**bound), hook(), hook("SessionEnd", {"reason": "logout"}), hook("SessionEnd", {"reason": "else"}), hook(schema_version="h2"), hook(collector_observed_at="2024-02-30T00:00:00Z"), hook("Start"), hook(payload_sha256="x"),
        hook(payload_sha256="b" * 64), hook(payload={"hook_event_name": "Other"}), hook(native_session_id="s2"), hook(transcript_byte_count=9), hook(**bound | {"turn_anchor_id": "x"}), hook(**bound | {"transcript_byte_count": 0}), "{broken",
    ]
    got = run(records(spark, *bodies), N.normalize_hooks, schema_version="h1")
    assert [r["error_code"] for r in got] == [
        None, None, None, None, "invalid_hook_schema", "invalid_hook_observed_at", "invalid_hook_event", "invalid_hook_payload", "invalid_hook_payload_hash", "invalid_hook_payload_event", "invalid_hook_session",
        "invalid_hook_transcript", "invalid_hook_anchor", "invalid_hook_transcript", "native_malformed",
    ]
    assert [r["event_subtype"] for r in got[:5]] == ["turn_complete", "response_complete_unlinked", "session_end", "session_end", "hook_invalid"]
    assert got[0]["logical_event_key"] == f"transcript:lifecycle:{uuid}:turn_complete" and got[0]["turn_id"] == f"transcript:prompt:{anchor}" and got[0]["occurred_at"] == "2024-01-01T00:00:00.5Z"
    assert (got[2]["phase"], got[3]["phase"]) == ("logout", None) and got[1]["logical_event_key"].startswith("transcript:hook:")


def test_members_are_read_once(spark):
    """What a record says is looked up when it is read, not again in each rule: a hook's plan has no look-up left, a thread's only
    those on the few descriptions of sessions."""
    looked = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("variant_get")
    df = records(spark, {"type": "event_msg", "payload": {"type": "user_message", "turn_id": "t", "message": "hello"}})
    assert looked(N.normalize_threads(df)) < 100
    assert looked(N.normalize_hooks(df, "h1")) == 0
