"""Append-only byte streams: records, chunks, fragments and generations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

MAX_RECORDS = 20_000
FRAGMENT = 4 << 20
MAX_SOURCE = 16 << 20
MAX_LOGICAL = 100 << 20


def locators(files: DataFrame, key: str, text: str) -> DataFrame:
    """A row per newline-ended record, and for an unterminated tail: record_index, start, end (bytes, newline included),
    sha256 and parse_status."""
    lines = F.split(F.col(text), "\n")
    n = F.size(lines)
    whole = F.transform(lines, lambda x, i: F.when(i < n - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    records = F.filter(whole, lambda x: x != "")
    e = files.select(key, F.posexplode(records).alias("record_index", "record"))
    w = Window.partitionBy(key).orderBy("record_index")
    e = e.withColumn("end", F.sum(F.octet_length("record")).over(w))
    body = F.rtrim(F.regexp_replace("record", "\n$", ""))
    status = F.when(body == "", "malformed").when(F.try_parse_json(body).isNull(), "malformed").otherwise("ok")
    return e.select(key, "record_index", (F.col("end") - F.octet_length("record")).alias("start"), "end", F.sha2(F.col("record").cast("binary"), 256).alias("sha256"), status.alias("parse_status"))


def batches(records: DataFrame, key: str, most: int = MAX_RECORDS) -> DataFrame:
    """records with batch_seq: at most `most` records of a file in each."""
    return records.withColumn("batch_seq", F.floor(F.col("record_index") / most))


def chunks(records: DataFrame, key: str, size: int = 512 << 10) -> DataFrame:
    """records with chunk: a file's records are packed in order, and one that would end more than `size` bytes after its
    chunk began begins the next. So chunks end on a newline, and a record longer than that is a chunk of its own. Where a
    chunk begins depends on all before it, so a file is one sequential pass, sorted by Spark; it holds three numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, begin, n = object(), 0, 0
        for b in it:
            out = []
            for k, s, e in zip(b.column(key).to_pylist(), b.column("start").to_pylist(), b.column("end").to_pylist(), strict=True):
                if k != file:
                    file, begin, n = k, s, 0
                elif e - begin > size:
                    begin, n = s, n + 1
                out.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "chunk"])

    schema = StructType([*records.schema.fields, StructField("chunk", LongType())])
    return records.repartition(key).sortWithinPartitions(key, "start").mapInArrow(run, schema)


def fragment_plan(records: DataFrame, keys: list[str], size: str, piece: int = FRAGMENT, whole_up_to: int | None = None) -> DataFrame:
    """keys, fragment_index, fragment_count, start, end for records longer than whole_up_to; pieces of fixed size."""
    long = records.filter(F.col(size) > (whole_up_to if whole_up_to is not None else piece))
    count = F.ceil(F.col(size) / piece).cast("int")
    at = long.select(*keys, F.col(size).alias("__size"), count.alias("fragment_count"), F.explode(F.sequence(F.lit(0), count - 1)).alias("fragment_index"))
    return at.select(*keys, "fragment_index", "fragment_count", (F.col("fragment_index").cast("long") * piece).alias("start"), F.least(F.col("__size").cast("long"), (F.col("fragment_index").cast("long") + 1) * piece).alias("end"))


def reassemble(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body, complete: contiguous pieces in order whose whole has the announced hash. A record has at most
    MAX_LOGICAL bytes, which bounds its group."""
    g = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fragment_index", "body"))).alias("p"), F.max("fragment_count").alias("n"), F.max("record_sha256").alias("h"))
    body = F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["body"]))
    g = g.select(*keys, body.alias("body"), "n", "h", F.transform("p", lambda x: x["fragment_index"]).alias("i"))
    ordered = F.col("i") == F.sequence(F.lit(0), F.col("n") - 1)
    return g.select(*keys, "body", (ordered & (F.sha2("body", 256) == F.col("h"))).alias("complete"))


def unpack(objects: DataFrame, most: int = MAX_SOURCE) -> DataFrame:
    """path, body, error: gzip objects decompressed up to a bound and held against stored and source size and hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bodies, errors = [], []
            for raw in b.column("body").to_pylist():
                try:
                    d = zlib.decompressobj(31)
                    out = d.decompress(raw, most + 1)
                    error = "too_large" if len(out) > most else None if d.eof and not d.unused_data else "corrupt"
                except zlib.error:
                    out, error = b"", "corrupt"
                bodies.append(None if error else out), errors.append(error)
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c != "body"} | {"source": pa.array(bodies, pa.binary()), "error": pa.array(errors, pa.string())})

    o = objects.select("path", "body", "stored_size", "stored_sha256", "source_size", "source_sha256")
    stored = (F.octet_length("body") == F.col("stored_size")) & (F.sha2("body", 256) == F.col("stored_sha256"))
    o = o.withColumn("__ok", stored)
    out = o.mapInArrow(run, "path string, stored_size long, stored_sha256 string, source_size long, source_sha256 string, __ok boolean, source binary, error string")
    source = (F.octet_length("source") == F.col("source_size")) & (F.sha2("source", 256) == F.col("source_sha256"))
    error = F.when(~F.col("__ok"), "stored_mismatch").when(F.col("error").isNotNull(), F.col("error")).when(~source, "source_mismatch")
    return out.select("path", F.when(error.isNull(), F.col("source")).alias("body"), error.alias("error"))


def generations(snapshots: DataFrame, stream: str, at: str, identity: list[str], size: str) -> DataFrame:
    """snapshots with generation: it grows when a file's identity changes or it shrinks."""
    w = Window.partitionBy(stream).orderBy(at)
    changed = F.lag(size).over(w) > F.col(size)
    for c in identity:
        changed |= ~F.lag(c).over(w).eqNullSafe(F.col(c))
    new = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(changed, F.lit(False)).cast("int"))
    return snapshots.withColumn("__new", new).withColumn("generation", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def overlapping(ranges: DataFrame, stream: str, start: str = "start", end: str = "end", id_: str = "id", width: int = 1 << 20) -> DataFrame:
    """left_id < right_id of half-open ranges of a stream that share a byte. Ranges visit the slots they touch, so a
    stream's ranges are not compared in full; the pair counts in the slot where the later one begins."""
    slots = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    r = ranges.filter(F.col(start) < F.col(end)).select(stream, F.col(start).alias("s"), F.col(end).alias("e"), F.col(id_).alias("i"), slots.alias("slot"))
    a, b = r.alias("a"), r.alias("b")
    first = F.floor(F.greatest("a.s", "b.s") / width) == F.col("a.slot")
    on = (F.col(f"a.{stream}") == F.col(f"b.{stream}")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.i") < F.col("b.i")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")) & first
    return a.join(b, on).select(F.col(f"a.{stream}").alias(stream), F.col("a.i").alias("left_id"), F.col("b.i").alias("right_id"))


def recent_files(listing: DataFrame, cutoff) -> DataFrame:
    """Files changed since the cutoff, newest first, ties by path; listing is a binaryFile scan without content."""
    return listing.select("path", "modificationTime", "length").filter(F.col("modificationTime") >= cutoff).orderBy(F.desc("modificationTime"), "path")


def claimed_once(identities: DataFrame, file: str, id_: str) -> DataFrame:
    """Files whose head names exactly one transcript."""
    return identities.groupBy(file).agg(F.min(id_).alias(id_), F.count_distinct(id_).alias("__n")).filter("__n = 1").drop("__n")
