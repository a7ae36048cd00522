"""Pairs of events that are two records of one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tolerance_pairs(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, left_at: str = "at", right_at: str = "at", left_id: str = "id", right_id: str = "id") -> DataFrame:
    """left_id, right_id of rows with equal keys (nulls are equal) at most `tolerance` apart.

    Times are cut into slots of the tolerance and a left row visits its slot and both neighbours, so a key with many
    rows is not compared in full: the join is on the keys and the slot.
    """
    width = max(1, tolerance)
    slot = lambda c: F.floor(F.col(c) / width)
    a = left.select(F.col(left_id).alias("left_id"), F.col(left_at).alias("__a"), *[F.col(k).alias(f"__l_{k}") for k in keys], F.explode(F.array(*[slot(left_at) + d for d in (-1, 0, 1)])).alias("__l_slot"))
    b = right.select(F.col(right_id).alias("right_id"), F.col(right_at).alias("__b"), *[F.col(k).alias(f"__r_{k}") for k in keys], slot(right_at).alias("__r_slot"))
    same = (F.col("__l_slot") == F.col("__r_slot")) & (F.abs(F.col("__a") - F.col("__b")) <= tolerance)
    for k in keys:
        same &= F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}"))
    return a.join(b, same).select("left_id", "right_id")


def mutual_unique_pairs(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, **names: str) -> DataFrame:
    """Tolerance pairs whose sides have no other partner."""
    pairs = tolerance_pairs(left, right, keys, tolerance, **names)
    once = lambda side, other: pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias(other)).filter("n = 1").select("left_id", "right_id")
    return once("left_id", "right_id").join(once("right_id", "left_id"), ["left_id", "right_id"])


def adjacent_copies(records: DataFrame, batch: str, index: str, same: list[str], at: str | None = None, tolerance: int = 100_000, start: str | None = None, end: str | None = None, null_safe: tuple[str, ...] = ()) -> DataFrame:
    """batch, index of records that repeat the one just before: next index, equal `same` columns (nulls are equal in those
    of null_safe) and, where named, contiguous byte ranges and times within the tolerance."""
    before = records.select(F.col(batch).alias("__batch"), (F.col(index) + 1).alias("__index"), *[F.col(c).alias(f"__{c}") for c in same], *([F.col(at).alias("__at")] if at else []), *([F.col(end).alias("__end")] if end else []))
    on = (F.col(batch) == F.col("__batch")) & (F.col(index) == F.col("__index"))
    for c in same:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}")) if c in null_safe else F.col(c) == F.col(f"__{c}")
    if at:
        on &= F.abs(F.col(at) - F.col("__at")) <= tolerance
    if start and end:
        on &= F.col(start) == F.col("__end")
    return records.join(before, on).select(batch, index)


# How far apart two records of one thing may be, in microseconds.
PROMPT_TOLERANCE, ASSISTANT_TOLERANCE, ADJACENT_TOLERANCE = 2_000_000, 3_000_000, 100_000
#: What two forms of one message have in common besides their time.
CONTEXT = ["person_id", "session_id", "actor_role", "stored_actor_role", "content_sha256", "scope_key", "collector_key", "source_kind", "source_stream_key", "generation_key", "generation_seq"]
#: The place of a record among its stream's.
SOURCE = ["collector_key", "source_kind", "source_stream_key", "generation_key", "generation_seq"]


def submitted_form() -> Column:
    """The form in which a client reports a submitted message, without an id of its own."""
    return (F.col("event_subtype") == "user_message") & (F.col("native_type") == "event_msg") & (F.col("native_payload_type") == "user_message") & F.col("native_item_id").isNull()


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")
