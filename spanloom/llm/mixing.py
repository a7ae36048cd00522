"""Mixing sources to target weights by systematic sampling.

A document of a source with target t and size s is expected t / s times. Along each source the expected copies
are summed, one random offset is added, and a document is taken once for each integer that its stretch crosses.

The order along a source runs over size classes, then a hash of doc_id, so every stretch of the source gets its
share of long and short documents and the words taken stay near the target. As all documents of a source expect
the same number of copies, the prefix sum is the rate times a rank. The rank is had without putting a source in
one task: documents are counted by (source, size class, hash slot) with map-side combination, a window over that
small table (at most SIZE_CLASSES * SLOTS rows a source) gives offsets, and documents are numbered within their
own slot.

Null source is a source of its own and comes last; null text has size 0; a source of size 0 has target 0 and
rate 0. Rows with the same doc_id are numbered like any others. An empty table gives an empty table. Word counts
must stay under 2 ** 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, pack

WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
SLOTS = 1024
#: Size classes per doubling of the size.
FINE = 8
SEED = "mix-1"


def text_size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(c: Column, digits: int) -> Column:
    """The first hexadecimal digits of md5 as a number; any engine can repeat it."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size with weight and target: percent of all sizes shared by weight, no target above most
    times its source, the excess reshared by weight among the others until none is above.

    The final level is where weight * level meets what is left: sources whose limit per weight lies below it stay
    at their limit. One row per source, so the window without partitions sorts only those.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % n).cast("long")
    ranked = sources.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    # Sources by limit per weight; those before a source are full if the level reached without it is above theirs.
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, from_here, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(everything) * percent
    level = (total - 100 * F.coalesce(F.sum("limit").over(before), F.lit(0))) / (100 * F.sum("weight").over(from_here))
    # The first source whose limit is not below the level that it and all later ones share fixes the level.
    levels = ranked.withColumn("__level", level).withColumn("__fits", F.col("weight") * F.col("__level") <= F.col("limit"))
    final = F.min(F.when(F.col("__fits"), F.struct((F.col("limit") / F.col("weight")).alias("r"), F.col("__level").alias("level")))).over(everything)["level"]
    return levels.withColumn("target", F.coalesce(F.least(F.col("limit").cast("double"), F.col("weight") * final), F.col("limit").cast("double"))).select("source", "source_size", "weight", "target")


def copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """doc_id, source, __h (the hash of doc_id), size, source_size, target, copies: a row for each row of docs, without texts."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_size(F.col(text)).alias("size"))
    slim = slim.withColumn("__h", _hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 12))
    slim = slim.withColumn("__class", F.floor(FINE * F.log2(F.col("size") + 1)).cast("int")).withColumn("__slot", (F.col("__h") % SLOTS).cast("int"))
    slim = materialize(slim, "sizes")  # counted, summed and ranked below, from one pass over the texts
    slots = slim.groupBy("source", "__class", "__slot").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size"))
    along = Window.partitionBy("source").orderBy("__class", "__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0)))
    sources = targets(slots.groupBy("source").agg(F.sum("__size").alias("source_size")))
    offset = _hash(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit(""))), 5) / float(2**20)
    sources = sources.withColumn("__offset", offset).withColumn("__rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0))
    slots = _on(slots.select("source", "__class", "__slot", "__before"), sources, ["source"])
    ranked = slim.withColumn("__rank", F.row_number().over(Window.partitionBy("source", "__class", "__slot").orderBy("__h", "doc_id")))
    placed = _on(ranked, slots, ["source", "__class", "__slot"])
    place = lambda r: F.floor(F.col("__rate") * r + F.col("__offset"))
    r = F.col("__before") + F.col("__rank")
    return placed.select("doc_id", "source", "__h", "size", "source_size", "target", (place(r) - place(r - 1)).cast("long").alias("copies"))


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where nulls are equal."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(other, same).drop(*[f"__r_{k}" for k in keys])


def digest(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, numbered by `copy` from 1 (which replaces a column of
    that name).

    Counts are joined back on (doc_id, source, size): of rows that agree in these so many are taken once or more, so
    many twice, which is a few numbers however many rows they are. Where such rows are not all taken alike, rows are
    numbered among their equals and the first ones are taken.
    """
    twin = Window.partitionBy("id", "source", "size").orderBy(F.lit(1))
    least = [f"__least_{k}" for k in range(1, MOST + 1)]
    counted = copies(docs, text, source, doc_id).groupBy("doc_id", "source", "size")
    counted = counted.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col("copies") >= k + 1).alias(c) for k, c in enumerate(least)]).filter(F.col(least[0]) > 0)
    counted = materialize(counted.select(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "__rows", *least), "copies")
    unlike = F.lit(False)
    for c in least:
        unlike |= (F.col(c) > 0) & (F.col(c) < F.col("__rows"))
    twins = counted.filter(unlike).limit(1).count() > 0  # else equal rows are taken alike, and texts move once
    packed = pack(docs, id=doc_id, source=source, size=text_size(docs[text]))
    joined = packed.join(counted, F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")))
    joined = joined.withColumn("n", F.row_number().over(twin) if twins else F.lit(1))
    times = sum((F.when(F.col("n") <= F.col(c), 1).otherwise(0) for c in least), F.lit(0)).cast("long")
    rest = [c for c in docs.columns if c.lower() != "copy"]
    return joined.filter(times > 0).select(*[F.col("row")[c].alias(c) for c in rest], F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER)] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2 * source_size AS cap,
         (150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (100 * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source IS NULL, source)),
t AS (
  SELECT source, source_size,
         coalesce(least(cap::DOUBLE, weight * (SELECT arg_min(level, cap::DOUBLE / weight) FROM l WHERE weight * level <= cap)), cap::DOUBLE) AS target,
         CAST('0x' || substr(md5('mix-1/' || coalesce(source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(8 * log2(d.size + 1)), d.h % 1024, d.h, d.doc_id) AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate * r + u) - floor(rate * (r - 1) + u) AS BIGINT) * size AS taken FROM r
"""
