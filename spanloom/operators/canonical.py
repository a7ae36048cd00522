"""One event of those that represent the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import effective_at, effective_role
from .predicates import after_session_start, is_activity, of_versions

KEYS = ("session_id", "scope_key", "normalizer_version", "logical_event_key", "event_kind")


def keyed() -> Column:
    """Events that may represent the same thing as others; without a scope or a key each is its own."""
    return F.col("scope_key").isNotNull() & F.col("logical_event_key").isNotNull()


def preference() -> list[Column]:
    return [F.col("source_priority").desc(), F.col("occurred_at").asc_nulls_last(), F.col("id").asc()]


def canonical(events: DataFrame, keys: tuple[str, ...] = KEYS, order: list[Column] | None = None) -> DataFrame:
    """Unkeyed events, and of keyed ones the preferred of each key.

    One scan and one shuffle: an unkeyed event is a group by its id. The filter on the rank lets Spark drop all but the
    first of a key before it shuffles.
    """
    alone = F.when(~keyed(), F.col("id"))
    w = Window.partitionBy(*keys, alone).orderBy(*(order or preference()))
    return events.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def candidates(events: DataFrame, sessions: DataFrame, start: int, read_at: int, versions: tuple[str, ...]) -> DataFrame:
    """Activity of [start, read_at) with effective_at, its session's started_at, and actor_role as the session makes it
    (stored_actor_role has what the event says). The window is cut before anything is ranked, so that a key's winner is one
    of the window's, and a ranking costs the window and not the history."""
    e = events.filter(is_activity() & of_versions(versions)).withColumn("effective_at", effective_at(F.col("native_item_id"), F.col("occurred_at"), F.col("observed_at"), F.col("received_at")))
    e = e.filter((F.col("effective_at") >= start) & (F.col("effective_at") < read_at))
    s = sessions.select("session_id", "started_at", F.col("parent_session_id").isNotNull().alias("__child"))
    e = e.join(s, "session_id").withColumn("stored_actor_role", F.col("actor_role"))
    return e.withColumn("actor_role", effective_role(F.col("actor_role"), F.col("__child"))).drop("__child")


def relevant_sessions(events: DataFrame, start: int, end: int, versions: tuple[str, ...], padding: int = 6_000_000) -> DataFrame:
    """session_id of sessions with something that counts as activity in a frame or `padding` (two hops of pairing) about it. No
    other session can add to what the frame shows, so a question about it ranks these only. One narrow scan, combined before
    it shuffles."""
    e = events.filter(is_activity() & of_versions(versions))
    at = effective_at(F.col("native_item_id"), F.col("occurred_at"), F.col("observed_at"), F.col("received_at"))
    return e.filter((at >= start - padding) & (at < end + padding)).select("session_id").distinct()


def activity(events: DataFrame, sessions: DataFrame, start: int, read_at: int, versions: tuple[str, ...], frame: tuple[int, int] | None = None) -> DataFrame:
    """The canonical activity of a window, without what a session copied from before its start; with a frame, of the sessions
    that are active in it only, sessions' own rows included."""
    if frame is not None:
        relevant = relevant_sessions(events, *frame, versions)
        events, sessions = events.join(relevant, "session_id", "left_semi"), sessions.join(relevant, "session_id", "left_semi")
    return canonical(candidates(events, sessions, start, read_at, versions)).filter(after_session_start(F.col("effective_at"), F.col("started_at")))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a map-side combined aggregation, so a hot key costs a row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, "__top.*").select(*df.columns)
