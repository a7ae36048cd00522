"""Work to do, as a table: folding requests, choosing what runs next, and how a queue stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce_targets(requests: DataFrame, keys: list[str]) -> DataFrame:
    """One request per key: the furthest target; live if any asks live."""
    return requests.groupBy(*keys).agg(F.max("target_id").alias("target_id"), F.when(F.bool_or(F.col("workload_class") == "live"), "live").otherwise("backfill").alias("workload_class"))


def enqueue(jobs: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The jobs table after folded requests: targets only grow, a touched job gets a new generation and waits again
    unless it runs, live wins."""
    asked = requests.select(*keys, F.col("target_id").alias("__t"), F.col("workload_class").alias("__w"))
    both = jobs.join(asked, keys, "full")
    touched = F.col("__t").isNotNull()
    return both.select(
        *keys, F.greatest("target_id", "__t").alias("target_id"), (F.coalesce("generation", F.lit(0)) + touched.cast("int")).alias("generation"),
        F.when(touched & ~F.col("status").eqNullSafe(F.lit("running")), "ready").otherwise(F.col("status")).alias("status"),
        F.when((F.col("workload_class") == "live") | (F.col("__w") == "live"), "live").otherwise("backfill").alias("workload_class"),
    )


def claimable(jobs: DataFrame, now: Column, most_attempts: int = 8) -> DataFrame:
    """Of each stream the head of the line (least start, then id), if it may run now: waiting jobs that are due and
    running ones whose lease ended."""
    open_ = jobs.filter(F.col("status").isin("ready", "retry", "running"))
    first = open_.withColumn("__n", F.row_number().over(Window.partitionBy("stream").orderBy("start_at", "id"))).filter("__n = 1").drop("__n")
    due = (F.col("status").isin("ready", "retry") & (F.col("available_at") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") < now))
    return first.filter(due & (F.col("attempts") < most_attempts))


def next_state(status: Column, outcome: Column, attempts: Column, claimed_generation: Column, generation: Column, most_attempts: int = 8) -> Column:
    """What a job becomes: a success with a newer generation waits again; a failure retries until attempts run out."""
    return (
        F.when(outcome == "done", F.when(claimed_generation < generation, "ready").otherwise("complete"))
        .when(outcome == "failed", F.when(attempts >= most_attempts, "dead").otherwise("retry"))
        .when(outcome == "expired", F.when(attempts >= most_attempts, "dead").otherwise("ready"))
        .otherwise(status)
    )


def with_oldest_live(jobs: DataFrame) -> DataFrame:
    """jobs with oldest_live_at: when the first of its stream's ready live jobs began. Folded per stream before it is joined
    back, so no window holds a stream."""
    live = (F.col("status") == "ready") & (F.col("workload_class") == "live")
    return jobs.join(jobs.groupBy("stream").agg(F.min(F.when(live, F.col("start_at"))).alias("oldest_live_at")), "stream")


def stream_heads(files: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Of each stream the file to send next, by generation, range and name; failed streams block."""
    if failed is not None:
        files = files.join(failed.select("stream").distinct(), "stream", "left_anti")
    w = Window.partitionBy("stream").orderBy("generation", "start", "end", "name")
    return files.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def queue_health(jobs: DataFrame, keys: list[str], at: str) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_jobs"), F.min(at).alias("oldest"))


def overloaded(samples: DataFrame, part: str, at: str, age: str, enter: int = 120, leave: int = 60, needed: int = 2) -> DataFrame:
    """samples with overloaded: on after `needed` samples in a row of at least `enter` seconds, off after as many of at
    most `leave`. The state is the last of the two kinds of run ends before a sample."""
    w = Window.partitionBy(part).orderBy(at)
    back = w.rowsBetween(-(needed - 1), 0)
    full = F.count(F.lit(1)).over(back) == needed
    on, off = full & (F.min(age).over(back) >= enter), full & (F.max(age).over(back) <= leave)
    turn = F.when(on, True).when(off, False)
    return samples.withColumn("__turn", turn).withColumn("overloaded", F.coalesce(F.last("__turn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))).drop("__turn")
