"""Which events count, and for whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import display_name, in_domain, millisecond_floor

# The kinds of events that are activity, and the subtypes of lifecycle events that are.
ACTIVITY_KINDS = ("message", "reasoning", "tool_call", "tool_result", "agent_spawn", "agent_message", "lifecycle", "error")
LIFECYCLE_SUBTYPES = ("task_started", "task_complete", "turn_started", "turn_complete")


def is_activity() -> Column:
    """Not replayed, not automation (a null role is dropped, as by SQL's <>), of an activity kind. A message needs a native
    id or to be a submitted one; of lifecycle events four subtypes count."""
    message = (F.col("event_kind") != "message") | F.col("native_item_id").isNotNull() | (F.col("event_subtype") == "user_message")
    lifecycle = (F.col("event_kind") != "lifecycle") | F.col("event_subtype").isin(*LIFECYCLE_SUBTYPES)
    return ~F.col("is_replay") & (F.col("actor_role") != "automation") & F.col("event_kind").isin(*ACTIVITY_KINDS) & message & lifecycle


def is_prompt() -> Column:
    """A message of a human user with content and without an error, said to a primary agent and not replayed."""
    human = (F.col("event_kind") == "message") & (F.col("message_origin") == "human") & (F.col("message_role") == "user")
    content = F.col("content_sha256").isNotNull() & (F.col("content_bytes") > 0) & F.col("error_code").isNull()
    return human & content & ~F.col("is_replay") & (F.col("actor_role") == "primary")


def is_conversation_source() -> Column:
    """What is said without key and turn and so may be recorded in two forms: an assistant's or a user's message whose
    native types are those of one form or the other, or a transcript's."""
    said = F.col("content_sha256").isNotNull() & F.col("logical_event_key").isNull() & F.col("turn_id").isNull()
    speaker = (F.col("message_role") == "assistant") | ((F.col("message_role") == "user") & F.col("message_origin").isin("human", "parent_agent"))
    announced = (F.col("event_kind") == "agent_message") & (F.col("event_subtype") == "agent_message") & (F.col("message_role") == "assistant") & (F.col("native_type") == "event_msg") & (F.col("native_payload_type") == "agent_message")
    message = (F.col("event_kind") == "message") & F.col("event_subtype").isin("message", "user_message") & F.col("message_role").isin("assistant", "user")
    formed = message & F.col("native_type").isin("event_msg", "response_item") & F.col("native_payload_type").isin("message", "user_message")
    transcribed = message & (F.col("source_kind") == "transcript") & F.col("native_type").isin("assistant", "user") & F.col("native_payload_type").isNull()
    return said & speaker & (announced | formed | transcribed)


def of_versions(versions: tuple[str, ...]) -> Column:
    """Events that a known normalizer made."""
    return F.col("normalizer_version").isin(*versions)


def after_session_start(observed: Column, started: Column) -> Column:
    return observed >= millisecond_floor(started)


def roster(people: DataFrame, domain: str, active: DataFrame | None = None) -> DataFrame:
    """People of a domain without the smoke-test identity (null identities stay), with roster_index by lower-case name."""
    out = people.filter(~F.col("external_id").eqNullSafe(F.lit("smoke")) & in_domain(F.col("email"), domain))
    if active is not None:
        out = out.join(active.select("person_id").distinct(), "person_id", "left_semi")
    return out.select("person_id", display_name(F.col("name"), F.col("identity_key")).alias("display_name"))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open ranges share a point."""
    return (start < other_end) & (other_start < end)
