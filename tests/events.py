"""Activity events as test rows: defaults and what a case changes."""

from __future__ import annotations

S = 1_000_000
DEFAULTS = {
    "id": None, "person_id": 1, "session_id": 1, "event_kind": "message", "event_subtype": "user_message", "actor_role": "primary", "scope_key": "session:1", "normalizer_version": "v1", "logical_event_key": None, "turn_id": None,
    "source_priority": 100, "native_item_id": None, "message_role": "user", "message_origin": "human", "content_sha256": "h", "content_bytes": 5, "content_excerpt": "words", "error_code": None, "occurred_at": None, "observed_at": None,
    "received_at": None, "is_replay": False, "batch_id": "b", "record_index": None, "start_offset": None, "end_offset": None, "native_type": "event_msg", "native_payload_type": "user_message", "collector_key": "c", "source_kind": "thread",
    "source_stream_key": "s", "generation_key": "g", "generation_seq": 0,
}
_LONG = {"id", "person_id", "session_id", "content_bytes", "occurred_at", "observed_at", "received_at", "record_index", "start_offset", "end_offset", "generation_seq"}
EVENT = ", ".join(f"{c} {'long' if c in _LONG else 'int' if c == 'source_priority' else 'boolean' if c == 'is_replay' else 'string'}" for c in DEFAULTS)
STRUCTURED = {"event_subtype": "message", "native_type": "response_item", "native_payload_type": "message"}
ANNOUNCED = {"event_kind": "agent_message", "event_subtype": "agent_message", "message_role": "assistant", "message_origin": "unknown", "native_payload_type": "agent_message"}


def event(id_, **more):
    at = more.pop("at", id_ * S)
    index = more.get("record_index", id_ * 10)
    row = DEFAULTS | {"id": id_, "occurred_at": at, "observed_at": at, "received_at": at, "record_index": index, "start_offset": index * 10, "end_offset": index * 10 + 10} | more
    return tuple(row[c] for c in DEFAULTS)


def native(micros: int, tail: int = 1) -> str:
    """A native id that carries a time."""
    h = f"{micros // 1000:012x}"
    return f"msg_{h[:8]}-{h[8:]}-7000-8000-{tail:012x}"
