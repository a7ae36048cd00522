"""Connected components of a graph of long ids by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, recording, remove

ROUNDS = 60


def _mins(edges: DataFrame) -> DataFrame:
    """u and the least of its neighbours and itself; the aggregation combines before it shuffles. Written, as a join
    whose two sides are shuffled for it alone is one that Spark can split where a centre holds many edges."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_mins(both), F.col("u") == F.col("w")).filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_mins(down), F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u > v) are stars: each u has one v, and no v is a u. Ends combine before they shuffle."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not ends.filter("up > 1 OR up = 1 AND down > 0").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of edges (u, v).

    A star's centre may hold any share of the edges: minima combine on the map side and each join has one row per
    node on its other side, so Spark can split a large partition. Rounds grow with the logarithm of the largest
    component; each is written to the shared folder, which ends its lineage, and the one before is removed. They end
    when all edges are stars, so classes known before (node, root) are edges that cost no round.
    """
    spark = edges.sparkSession
    with recording() as old:
        now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        with recording() as made:
            now = materialize(_small_star(materialize(_large_star(now).distinct(), "large")).distinct(), "edges")
        remove(spark, old + made[:-1])
        old = made[-1:]
    raise RuntimeError("components did not settle")
