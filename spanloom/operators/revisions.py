"""Append-only histories: the latest revision of each key, and what to append to reach a desired state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import latest_per_key


def latest_revision(revisions: DataFrame, keys: list[str], order: str = "revision_id", cutoff: Column | None = None, drop_tombstones: bool = True) -> DataFrame:
    """The last revision of each key up to the cutoff. Tombstones go only after the choice: a key whose last revision is
    one is gone, not back at an earlier one."""
    seen = revisions if cutoff is None else revisions.filter(F.col(order) <= cutoff)
    last = latest_per_key(seen, keys, [order])
    return last.filter("NOT is_tombstone") if drop_tombstones else last


def diff_revisions(desired: DataFrame, latest: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, values, is_tombstone, action: insert for new keys, correct for changed ones, tombstone for vanished ones
    that are not tombstoned yet. A rerun appends nothing. latest holds the last revisions, tombstones included."""
    want = desired.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*values).alias("__want"))
    have = latest.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.when(~F.col("is_tombstone"), F.struct(*values)).alias("__have"), F.lit(True).alias("__known"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"__k_{k}") == F.col(f"__h_{k}")
    both = want.join(have, on, "full")
    action = (
        F.when(F.col("__want").isNotNull() & F.col("__known").isNull(), "insert")
        .when(F.col("__want").isNotNull() & ~F.col("__want").eqNullSafe(F.col("__have")), "correct")
        .when(F.col("__want").isNull() & F.col("__have").isNotNull(), "tombstone")
    )
    out = both.withColumn("action", action).filter("action IS NOT NULL")
    return out.select(*[F.coalesce(f"__k_{k}", f"__h_{k}").alias(k) for k in keys], *[F.col(f"__want.{v}").alias(v) for v in values], (F.col("action") == "tombstone").alias("is_tombstone"), "action")


def receipt_totals(changes: DataFrame) -> DataFrame:
    """One row of what a run appends: how many revisions of each action, and in all."""
    n = lambda action: F.count(F.when(F.col("action") == action, 1))
    return changes.agg(n("insert").alias("n_inserted"), n("correct").alias("n_corrected"), n("tombstone").alias("n_tombstoned"), F.count(F.lit(1)).alias("n_appended"))


def refuse_future(events: DataFrame, until: int, at: str = "observed_at") -> DataFrame:
    """events; a row later than `until` fails the job that meets it, so a run never records a state that it can't have seen
    whole."""
    late = F.raise_error(F.concat(F.lit("an event lies after the run's time: "), F.col(at).cast("string")))
    return events.withColumn(at, F.when(F.col(at) > until, late.cast("long")).otherwise(F.col(at)))


def duplicate_keys(desired: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a desired state names twice; it must be empty."""
    return desired.groupBy(*keys).count().filter("count > 1")


def staleness(coordinates: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose last receipt does not prove their present source (last_id, n); missing receipts count."""
    last = latest_per_key(receipts, keys, ["receipt_id"]).select(*keys, F.col("last_id").alias("proved_id"), F.col("n").alias("proved_n"))
    joined = coordinates.join(last, keys, "left")
    return joined.filter(~(F.col("last_id").eqNullSafe(F.col("proved_id")) & F.col("n").eqNullSafe(F.col("proved_n"))))
