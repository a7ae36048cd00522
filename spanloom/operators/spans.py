"""All activity spans of sessions, each under a key of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals

# The kinds of events that say when a turn was.
TURN_KINDS = ("message", "agent_message", "reasoning", "tool_call", "tool_result", "lifecycle", "error")
TASK_SUBTYPES = ("task_started", "task_complete")


def session_spans(events: DataFrame) -> DataFrame:
    """session_id, span_key, and the columns of a span (intervals.SPAN), of canonical events with at and id.

    turn:ID for events of a turn, tool:call:ID and tool:event:ID for calls and results with and without a call's id, task:ID
    for starts of tasks outside of turns with the completions they take in order, task-complete:ID for completions left over.
    """
    columns = ["session_id", "span_key", *intervals.SPAN]
    turns = intervals.turn_spans(events.filter(F.col("turn_id").isNotNull() & F.col("event_kind").isin(*TURN_KINDS)), ["session_id", "turn_id"])
    turns = turns.withColumn("span_key", F.concat(F.lit("turn:"), "turn_id"))
    call = F.coalesce(F.concat(F.lit("tool:call:"), "tool_call_id"), F.concat(F.lit("tool:event:"), F.col("id").cast("string")))
    tools = intervals.tool_spans(events.filter("event_kind IN ('tool_call', 'tool_result')").withColumn("span_key", call), ["session_id", "span_key"])
    alone = events.filter(F.col("turn_id").isNull() & (F.col("event_kind") == "lifecycle") & F.col("event_subtype").isin(*TASK_SUBTYPES))
    tasks = intervals.task_spans(alone, "session_id")
    left_over = (F.col("state") == "point") & F.col("end_id").isNull()
    tasks = tasks.withColumn("span_key", F.concat(F.when(left_over, "task-complete:").otherwise("task:"), F.col("start_id").cast("string")))
    return turns.select(columns).unionByName(tools.select(columns)).unionByName(tasks.select(columns))
