"""Sessions folded from batches, and the tree they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_fold(parts: DataFrame, keys: list[str], attributes: list[str], order: str = "batch_seq") -> DataFrame:
    """One row per session from its batches: the last known value of each attribute, the last role that is not unknown,
    the least start; person_changed tells sessions that two people claim."""
    last = lambda c, cond: F.max(F.when(cond, F.struct(order, c)))[c].alias(c)
    return parts.groupBy(*keys).agg(
        *[last(a, F.col(a).isNotNull()) for a in attributes],
        F.coalesce(F.max(F.when(F.col("actor_role") != "unknown", F.struct(order, "actor_role")))["actor_role"], F.lit("unknown")).alias("actor_role"),
        F.min("started_at").alias("started_at"), F.min("person_id").alias("person_id"), (F.min("person_id") != F.max("person_id")).alias("person_changed"),
    )


def resolve_parents(sessions: DataFrame, scope: list[str], native: str = "native_id", parent: str = "parent_native_id", id_: str = "session_id") -> DataFrame:
    """sessions with parent_session_id: the session of the same scope that bears the parent's native id."""
    known = sessions.select(*[F.col(c).alias(f"__p_{c}") for c in scope], F.col(native).alias("__p_native"), F.col(id_).alias("parent_session_id"))
    on = (F.col(parent) == F.col("__p_native")) & (F.col(id_) != F.col("parent_session_id"))
    for c in scope:
        on &= F.col(c) == F.col(f"__p_{c}")
    return sessions.join(known, on, "left").select(*sessions.columns, "parent_session_id")


def affected(sessions: DataFrame, touched: DataFrame, id_: str = "session_id", parent: str = "parent_session_id") -> DataFrame:
    """Sessions touched or whose parent was."""
    t = touched.select(F.col(id_).alias("__t")).distinct()
    own = sessions.join(t, F.col(id_) == F.col("__t"), "left_semi")
    below = sessions.join(t, F.col(parent) == F.col("__t"), "left_semi")
    return own.select(id_).union(below.select(id_)).distinct()


def coordinates(events: DataFrame, key: str = "session_id", at: str = "observed_at", until: int | None = None) -> DataFrame:
    """Per key the last event, how many there are, and the last beyond `until`."""
    future = F.max(F.when(F.col(at) > (until if until is not None else (1 << 62)), F.col("id")))
    return events.groupBy(key).agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"), future.alias("last_future_id"))


def fingerprint(events: DataFrame, key: str, columns: list[str], order: str = "id") -> DataFrame:
    """A hash of each key's rows, equal when they are, whatever order they come in: `order` is hashed with its row, and rows'
    hashes are summed in four parts. So a key's rows fold into four numbers before they are shuffled, and none is collected."""
    sized = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    h = events.select(key, F.sha2(F.concat(*map(sized, [order, *columns])).cast("binary"), 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("long").cast("decimal(20,0)")).cast("string")
    return h.groupBy(key).agg(F.sha2(F.concat_ws(",", *map(part, (1, 16, 31, 46))).cast("binary"), 256).alias("state_hash"))
