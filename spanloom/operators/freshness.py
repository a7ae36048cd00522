"""How far the data reaches, and what waits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import MINUTE, recency


def freshness(events: DataFrame, canonical: DataFrame, pending: DataFrame, now: int, horizon: int = 30 * MINUTE) -> DataFrame:
    """One row: raw and canonical watermarks in the horizon, what is pending and whether that delays."""
    raw = events.filter((F.col("observed_at") > now - horizon) & (F.col("observed_at") <= now)).agg(F.max("observed_at").alias("raw_watermark"))
    chosen = canonical.filter((F.col("observed_at") > now - horizon) & (F.col("observed_at") <= now)).agg(F.max("observed_at").alias("canonical_watermark"))
    waits = pending.agg(F.count(F.lit(1)).alias("n_pending"), F.min("enqueued_at").alias("oldest_pending"))
    return raw.join(chosen, F.lit(True), "left").join(waits, F.lit(True), "left").withColumn("delayed", F.coalesce((F.col("n_pending") > 0) & (now - F.col("oldest_pending") >= 300_000_000), F.lit(False)))  # single rows


def person_freshness(events: DataFrame, now: int) -> DataFrame:
    return events.filter(F.col("observed_at") <= now).groupBy("person_id").agg(F.max("observed_at").alias("latest_at")).withColumn("status", recency(F.col("latest_at"), F.lit(now)))


def merged_latest(people: DataFrame, fresh: DataFrame) -> DataFrame:
    """The later of two latest times; the one there is where the other is missing."""
    other = fresh.select("person_id", F.col("latest_at").alias("__other"))
    return people.join(other, "person_id", "left").withColumn("latest_at", F.greatest("latest_at", "__other")).drop("__other")
