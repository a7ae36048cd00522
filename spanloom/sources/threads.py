"""Recent threads from index databases: each file is a task's input and is opened in its memory, so it may lie wherever Spark
reads. A database is bounded by what a cell holds; a larger or unreadable one is a row with an error, not a failed job."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 512 << 20
SCHEMA = "database string, id string, rollout_path string, updated_at_ms long, error string"
# What a thread may come from, and the columns of its time with their units in milliseconds.
SOURCES = ("", "user", "subagent")
UPDATED = {"updated_at": 1000, "updated_at_ms": 1}


def recent_rows(content: bytes, cutoff_ms: int, limit: int) -> list[tuple[str, str, int]]:
    """id, path and time of threads changed since the cutoff that are not archived, newest first, ties by id downwards. Each of the
    time columns that there are is asked by its own order and limit; of one id's rows the last column's counts."""
    with sqlite3.connect(":memory:") as db:
        db.deserialize(content)
        there = {r[1] for r in db.execute("PRAGMA table_info(threads)")}
        times = [c for c in UPDATED if c in there]
        if not {"id", "rollout_path"} <= there or not times:
            raise ValueError("threads lacks an id, a path or a time")
        wanted = ["ifnull(archived, 0) = 0"] if "archived" in there else []
        if "thread_source" in there:
            wanted.append("ifnull(thread_source, '') IN ({})".format(", ".join(f"'{s}'" for s in SOURCES)))
        found: dict[str, tuple[str, str, int]] = {}
        for c in times:
            unit = UPDATED[c]
            sql = f"SELECT id, rollout_path, {c} * {unit} FROM threads WHERE {' AND '.join([f'{c} >= ?', *wanted])} ORDER BY {c} DESC, id DESC LIMIT ?"
            found |= {str(i): (str(i), p, t) for i, p, t in db.execute(sql, (cutoff_ms // unit, limit))}
    return sorted(found.values(), key=lambda r: (r[2] or 0, r[0]), reverse=True)[:limit]


def scan_threads(spark: SparkSession, path: str, cutoff_ms: int, limit: int, glob: str = "*.sqlite") -> DataFrame:
    """SCHEMA rows of all databases below path: the newest `limit` threads of each, or what is wrong with it."""
    limit = max(1, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, content = b.column("path")[i].as_py(), b.column("content")[i].as_py()
                try:
                    if content is None:
                        raise ValueError("too large")
                    rows = [(name, *r, None) for r in recent_rows(content, cutoff_ms, limit)]
                except (sqlite3.Error, ValueError) as e:
                    rows = [(name, None, None, None, str(e) or type(e).__name__)]
                kinds = {"database": pa.string(), "id": pa.string(), "rollout_path": pa.string(), "updated_at_ms": pa.int64(), "error": pa.string()}
                yield pa.RecordBatch.from_pydict({k: pa.array([r[j] for r in rows], kind) for j, (k, kind) in enumerate(kinds.items())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content")).mapInArrow(run, SCHEMA)


def newest(threads: DataFrame) -> DataFrame:
    """One row for each id of several databases: the newest, ties by database downwards."""
    rest = [c for c in threads.columns if c not in ("id", "updated_at_ms", "database")]
    top = threads.filter("error IS NULL").groupBy("id").agg(F.max(F.struct("updated_at_ms", "database", *rest)).alias("x"))
    return top.select(*[F.col("id") if c == "id" else F.col(f"x.{c}").alias(c) for c in threads.columns])
