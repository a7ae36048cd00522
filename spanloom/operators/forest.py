"""What nodes inherit from their ancestors, kept as batches of nodes come in any order.

Each node is stored with its path compressed: `value` found on the way (the nearest `named`, else the `own` of the topmost
that has one), and `waits`, the id of the topmost known ancestor's parent where that isn't known yet. A batch is joined with
the stored nodes that its parents name and with those that wait for its nodes, and only these are walked, by pointer
doubling; so a chain that grew over many batches costs one step. What a node's ancestor brings late changes those that
waited for it, and they are appended again with their new value.

The store is append-only Parquet by slot (a hash of the part, so a batch reads its parts' slots only) and batch; the last row
of a node holds. A batch that runs again replaces its own rows. A node's first record stands. Ids are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, write
from .canonical import latest_per_key

SLOTS = 64
#: Pointers double this often at most, so paths within a batch may have 2 ** ROUNDS nodes; a cycle never ends before.
ROUNDS = 24
COLUMNS = ["part", "node", "near", "top", "waits"]
SCHEMA = "part string, node string, near string, top string, waits string, value string, batch_id long, slot int"


def slot(part: Column) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(SLOTS)).cast("int")


def read_forest(spark: SparkSession, path: str, slots: list[int] | None = None, before: int | None = None) -> DataFrame:
    """part, node, near, top, waits, value and batch_id of each node's last row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA).drop("slot")
    rows = spark.read.schema(SCHEMA).parquet(path)
    if slots is not None:
        rows = rows.filter(F.col("slot").isin(slots))
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    return latest_per_key(rows.drop("slot"), ["part", "node"], ["batch_id"])


def _once(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = write(df, label)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def extend_forest(nodes: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Add nodes (part, node, parent, named, own; strings) to the forest at path; the rows that were appended: new nodes, and
    stored ones whose value or open end has changed."""
    spark = nodes.sparkSession
    made: list[str] = []

    def once(df: DataFrame, label: str) -> DataFrame:
        out, at = _once(df, label)
        made.append(at)
        return out

    first = nodes.groupBy("part", "node").agg(F.min(F.struct("parent", "named", "own")).alias("x")).select("part", "node", "x.*")
    first = once(first, "nodes")
    slots = [r[0] for r in first.select(slot(F.col("part")).alias("s")).distinct().collect()]  # at most SLOTS
    stored = read_forest(spark, path, slots, batch_id).select(*COLUMNS)
    fresh = once(first.join(stored.select("part", "node"), ["part", "node"], "left_anti"), "fresh")
    # A root that names itself waits for nothing.
    parent = F.when(~F.col("parent").eqNullSafe(F.col("node")), F.col("parent"))
    begun = fresh.select("part", "node", F.col("named").alias("near"), F.col("own").alias("top"), F.when(F.col("named").isNull(), parent).alias("waits"))
    ids = fresh.select("part", F.col("node").alias("id")).distinct()
    parents = fresh.select("part", F.col("parent").alias("id")).filter("id IS NOT NULL").distinct()
    named = stored.join(parents, (stored["part"] == parents["part"]) & (stored["node"] == parents["id"]), "left_semi")
    waiting = stored.join(ids, (stored["part"] == ids["part"]) & (stored["waits"] == ids["id"]), "left_semi")
    old = named.unionByName(waiting).distinct()
    walk = once(begun.withColumn("changed", F.lit(True)).unionByName(old.withColumn("changed", F.lit(False))), "walk")
    for _ in range(ROUNDS):
        ahead = walk.select(F.col("part").alias("p"), F.col("node").alias("n"), F.col("near").alias("near_b"), F.col("top").alias("top_b"), F.col("waits").alias("waits_b"))
        met = F.col("n").isNotNull()
        on = (F.col("part") == F.col("p")) & (F.col("waits") == F.col("n"))
        near = F.coalesce("near", "near_b")
        stepped = walk.join(ahead, on, "left").select(
            "part", "node", near.alias("near"), F.when(met, F.coalesce("top_b", "top")).otherwise(F.col("top")).alias("top"),
            F.when(met, F.when(near.isNull(), F.col("waits_b"))).otherwise(F.col("waits")).alias("waits"), (F.col("changed") | met).alias("changed"), met.alias("met"),
        )
        stepped = once(stepped, "walk")
        walk = stepped.drop("met")
        if not stepped.filter("met").limit(1).count():
            break
    rows = walk.filter("changed").select(*COLUMNS, F.coalesce("near", "top").alias("value"), F.lit(batch_id).cast("long").alias("batch_id"), slot(F.col("part")).alias("slot"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch_id").parquet(path)
    for at in made:
        delete(spark, at)
    return spark.read.schema(SCHEMA).parquet(path).filter((F.col("batch_id") == batch_id) & F.col("slot").isin(slots))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The last rows of all nodes at another path, each under its batch's number."""
    rows = read_forest(spark, path).withColumn("slot", slot(F.col("part")))
    rows.hint("rebalance", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch_id").parquet(to)
