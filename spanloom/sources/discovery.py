"""What has become of the files of a folder since the last look, and whose transcripts they are, from their heads alone.

A listing is names, sizes and times, as Spark lists files without reading them. Executors then read a bounded head of each file by
range, whatever its size: one hash over as much of it as the last look had hashed, which tells a file that has grown from one
that was replaced, and one over the head as it is now, for the next look.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a prefix's hash; bytes and records in which a transcript says whose it is.
PREFIX_BYTES = 4096
IDENTITY_BYTES, IDENTITY_RECORDS = 256 << 10, 64
SNAPSHOT = "path string, length long, modified timestamp, prefix_length int, prefix_sha256 string"


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length and modified of the files below a folder; no content is read. Files without a byte aren't listed, so one is new
    when it gets its first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    return files.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def _read(path: str, n: int) -> bytes | None:
    """The first n bytes of a file, fewer if it ends; None if it isn't there any more."""
    system, at = pafs.FileSystem.from_uri(path)
    try:
        with system.open_input_file(at) as f:
            return f.read_at(min(n, f.size()), 0)
    except FileNotFoundError:
        return None


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        now, was = [], []
        for path, length, known in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("known").to_pylist(), strict=True):
            head = _read(path, min(PREFIX_BYTES, length))
            now.append((None, None) if head is None else (len(head), hashlib.sha256(head).hexdigest()))
            was.append(None if head is None or known is None or known > len(head) else hashlib.sha256(head[:known]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("path"), pa.array([n for n, _ in now], pa.int32()), pa.array([h for _, h in now], pa.string()), pa.array(was, pa.string())], ["path", "prefix_length", "prefix_sha256", "again_sha256"]
        )


def snapshot(files: DataFrame, before: DataFrame) -> DataFrame:
    """SNAPSHOT columns of files (a listing), with status against a snapshot of before: new, unchanged, appended (it is longer and
    begins as it did), truncated (it is shorter), rotated (it begins otherwise), changed (as long as before, but written since)
    and, for files of before only, gone (their old row). A file that goes while it is read is gone, or not there if it was new."""
    old = before.select(F.col("path").alias("__path"), F.col("length").alias("__length"), F.col("modified").alias("__modified"), F.col("prefix_length").alias("__n"), F.col("prefix_sha256").alias("__sha"))
    both = files.join(old, F.col("path") == F.col("__path"), "full")
    heads = both.filter("path IS NOT NULL").select("path", "length", F.col("__n").alias("known")).mapInArrow(_heads, "path string, prefix_length int, prefix_sha256 string, again_sha256 string")
    seen = both.join(heads.withColumnRenamed("path", "__of"), F.col("path") == F.col("__of"), "left")
    there = F.col("prefix_sha256").isNotNull()
    status = (
        F.when(~there, F.when(F.col("__path").isNotNull(), "gone"))
        .when(F.col("__path").isNull(), "new")
        .when(F.col("length") < F.col("__length"), "truncated")
        .when(~F.col("again_sha256").eqNullSafe(F.col("__sha")), "rotated")
        .when(F.col("length") > F.col("__length"), "appended")
        .when(F.col("modified") == F.col("__modified"), "unchanged")
        .otherwise("changed")
    )
    kept = lambda now, was: F.when(there, F.col(now)).otherwise(F.col(was)).alias(now)
    return seen.select(F.coalesce("path", "__path").alias("path"), kept("length", "__length"), kept("modified", "__modified"), kept("prefix_length", "__n"), kept("prefix_sha256", "__sha"), status.alias("status")).filter("status IS NOT NULL")


def generation_starts(status: Column) -> Column:
    """Whether a file's bytes count from its beginning again."""
    return status.isin("new", "truncated", "rotated")


def heads(files: DataFrame, most: int = IDENTITY_BYTES) -> DataFrame:
    """path and head, the first `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():  # one head at a time
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([_read(path, most)], pa.binary())], ["path", "head"])

    return files.select("path").mapInArrow(run, "path string, head binary")


def identities(files: DataFrame, names: dict[str, list[str]], most: int = IDENTITY_BYTES, records: int = IDENTITY_RECORDS) -> DataFrame:
    """path, a column for each of names (the one value that whole records of the head give at the first of its JSON paths that
    they have), and conflict: whether records give several. What can't be read as an object is passed over."""
    text = F.col("head").cast("string")
    whole = F.regexp_replace(text, r"[^\n]*\z", "")
    lines = F.slice(F.split(F.make_valid_utf8(whole), "\n"), 1, records)
    read = heads(files, most).select("path", F.transform(lines, F.try_parse_json).alias("v"))

    def value(paths: list[str]):
        return lambda v: F.coalesce(*[text_at(v, p) for p in paths])

    def text_at(v: Column, p: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")))

    found = read.select("path", *[F.array_distinct(F.array_compact(F.transform("v", value(paths)))).alias(name) for name, paths in names.items()])
    conflict = F.greatest(F.lit(0), *[F.size(n) for n in names]) > 1
    return found.select("path", *[F.when(F.size(n) == 1, F.get(n, F.lit(0))).alias(n) for n in names], conflict.alias("conflict"))
