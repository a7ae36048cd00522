"""Search for texts by their tokens over an inverted index that grows by segments.

A segment is what one commit adds: for each token and block of BLOCK document numbers, the sorted numbers within the block.
Segments are Parquet, partitioned by commit and by a hash of the token, and sorted by token within a file. A search reads the
partitions of its tokens and, by the files' statistics, little beside their rows; no text is read or cut again. A token that
every document holds is many rows of bounded length, not one list. Appending writes a segment and touches no other;
a commit that runs again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import tokens

#: Folders by token in each commit. An index's number never changes.
BUCKETS = 64
#: Document numbers of a posting list.
BLOCK = 1 << 16
SCHEMA = "token string, block long, places array<int>, commit_id long, bucket int"


def search_tokens(text: Column) -> Column:
    """The tokens of a text; null and a text without any have none."""
    return F.filter(tokens(F.coalesce(text, F.lit(""))), lambda t: t != "")


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, text: str, id_: str) -> DataFrame:
    """token, block, places (sorted numbers within the block): once for each document that has the token."""
    each = docs.select(F.col(id_).cast("long").alias("id"), F.explode(F.array_distinct(search_tokens(F.col(text)))).alias("token"))
    block = F.shiftright("id", (BLOCK - 1).bit_length())
    return each.groupBy("token", block.alias("block")).agg(F.sort_array(F.collect_set((F.col("id") - block * BLOCK).cast("int"))).alias("places"))


def append_segment(docs: DataFrame, path: str, commit_id: int, text: str = "text", id_: str = "doc_id") -> None:
    """Add the documents of one commit to the index at path. ids are not null and no other commit has them."""
    rows = postings(docs, text, id_).withColumn("commit_id", F.lit(commit_id).cast("long")).withColumn("bucket", bucket(F.col("token")))
    _write(rows, path)


def _write(rows: DataFrame, path: str) -> None:
    """A bucket is a file, or several where it is large: Spark deals it out by its size."""
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "block")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit_id", "bucket").parquet(path, compression="zstd")


def read_index(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """All postings, or those of commits up to a snapshot."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if snapshot is None else rows.filter(F.col("commit_id") <= snapshot)


def search(spark: SparkSession, path: str, asked: str, snapshot: int | None = None) -> DataFrame:
    """id of each document that has every token of `asked`; none for an `asked` without tokens.

    Lists of a block meet by their token's number before any id is written out: blocks that lack a token are dropped whole.
    """
    wanted = sorted(set(spark.range(1).select(search_tokens(F.lit(asked)).alias("t")).first()["t"]))
    index = read_index(spark, path, snapshot)
    if not wanted:
        return index.select(F.col("block").alias("id")).limit(0)
    # Buckets are worked out here, so that the scan prunes partitions by constants.
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket(F.col("t"))).distinct().collect()]
    found = index.filter(F.col("bucket").isin(buckets) & F.col("token").isin(wanted))
    lists = found.groupBy("commit_id", "block").agg(F.collect_list("places").alias("lists")).filter(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect)
    return lists.select("block", F.explode(both).alias("place")).select((F.col("block") * BLOCK + F.col("place")).alias("id"))


def compact(spark: SparkSession, path: str, to: str, commit_id: int) -> None:
    """One segment at another path of all commits up to commit_id, under that number; later commits follow it there."""
    whole = read_index(spark, path, commit_id).groupBy("token", "block").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    rows = whole.withColumn("commit_id", F.lit(commit_id).cast("long")).withColumn("bucket", bucket(F.col("token")))
    _write(rows, to)
