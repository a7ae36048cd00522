"""Activity kept up to date as events arrive: per micro-batch only touched sessions are worked out again.

Events are appended as files; a batch's sessions, and those below them, are recomputed from all of their events and held
against the last revisions, so what is appended is exactly the difference. A late event makes a correction, a batch that
is delivered twice makes nothing. Events and revisions are append-only Parquet, partitioned by a hash of the session and
the batch that wrote them: a batch reads the slots of its sessions only, and one that runs again replaces its own partitions
and no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.revisions import diff_revisions, latest_revision
from ..operators.sessions import affected


SLOTS = 256  # sessions are dealt to so many folders; a store's number never changes


def slot(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(SLOTS)).cast("int")


def read_store(spark: SparkSession, path: str, schema: StructType | str, slots: list[int] | None = None) -> DataFrame:
    """All rows of a store, or those of some slots; none where nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([], schema).schema
    rows = spark.read.schema(StructType(wanted.fields).add("slot", "integer")).parquet(path)
    return (rows if slots is None else rows.filter(F.col("slot").isin(slots))).select(wanted.names)


def append_revisions(desired: DataFrame, history: DataFrame, keys: list[str], values: list[str], batch_id: int, path: str, touched: DataFrame | None = None, touched_key: str = "session_id") -> None:
    """Write what leads from the history to the desired state as the batch's revisions. Only keys of touched sessions are
    compared; the history is read without the batch's own rows, so a second run of it writes the same."""
    before = history.filter(F.col("batch_id") < batch_id)
    if touched is not None:
        before = before.join(touched, touched_key, "left_semi")
    last = latest_revision(before.withColumnRenamed("batch_id", "revision_id"), keys, drop_tombstones=False)
    changes = diff_revisions(desired, last, keys, values).drop("action")
    placed = changes.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("slot", slot(F.col(touched_key)))
    placed.write.mode("overwrite").partitionBy("slot", "batch_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def keep_current(
    events: DataFrame, events_path: str, store_path: str, checkpoint: str, reduce: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str],
    store_schema: str, parents: Callable[[SparkSession], DataFrame] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """A query over a stream of events (with session_id and id) that appends them once and keeps `reduce`'s result, by
    session_id among its keys, as revisions.

    parents gives session_id, parent_session_id, where sessions below a touched one change with it. Exactly once: batches
    are numbered by the checkpoint and both writes of a batch replace its own partition.
    """
    schema = events.schema

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        placed = rows.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("slot", slot(F.col("session_id")))
        placed.write.mode("overwrite").partitionBy("slot", "batch_id").option("partitionOverwriteMode", "dynamic").parquet(events_path)
        stored = StructType(schema.fields).add("batch_id", "long")
        touched = read_store(spark, events_path, stored).filter(F.col("batch_id") == batch_id).select("session_id").distinct()
        if parents is not None:
            touched = touched.union(affected(parents(spark), touched)).distinct()
        touched = touched.persist()
        slots = [r["slot"] for r in touched.select(slot(F.col("session_id")).alias("slot")).distinct().collect()]  # at most SLOTS
        mine = read_store(spark, events_path, stored, slots).filter(F.col("batch_id") <= batch_id).drop("batch_id").dropDuplicates(["id"]).join(touched, "session_id", "left_semi")
        append_revisions(reduce(mine), read_store(spark, store_path, store_schema, slots), keys, values, batch_id, store_path, touched)
        touched.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def bucket_counts(events: DataFrame, at: str = "observed_at", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per person and bucket from a stream with a timestamp column; state of a bucket is dropped `late` after it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "person_id").agg(F.count(F.lit(1)).alias("n_events")).select("person_id", F.col("window.start").alias("bucket_at"), "n_events")
