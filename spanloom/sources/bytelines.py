"""Records of large byte streams, read by splits.

Spark reads a file by ranges of bytes; each split yields the records that begin in it, as bytes, whatever they decode to. What
a split can't know, where its first record begins and how many came before, is a sum over the splits before it: splits are
counted first (lengths only), summed per file, and joined back. No file is in one cell or one task, and nothing is sorted
but a file's splits.

A file's records end with a newline; a tail without one is a record with terminated false. The reader drops a byte order mark
at a file's start, and it is put back. An empty file has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import rfc3339_micros

_MARK = "EFBBBF"
# How long a type's name may be, and where a record's time may stand.
LABEL_BYTES = 256
TIMES = ("timestamp", "occurred_at", "time")


def _ordered(lengths: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The place and number of each record within its split; a task's records come in order, split by split."""
    now, place, number = None, 0, 0
    for path, begin, length in lengths:
        new = (path != path.shift()) | (begin != begin.shift())
        if len(path) and (path.iloc[0], begin.iloc[0]) == now:
            new.iloc[0] = False
        run = new.cumsum()
        before = length.groupby(run).cumsum() - length
        index = length.groupby(run).cumcount()
        same = run == 0  # goes on where the last batch ended
        out = pd.DataFrame({"place": before + same * place, "number": index + same * number})
        if len(path):
            now = (path.iloc[-1], begin.iloc[-1])
            place, number = int(out["place"].iloc[-1] + length.iloc[-1]), int(out["number"].iloc[-1] + 1)
        yield out


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, record_index, start, end (bytes, newline included), terminated, record (binary, without its newline)."""
    within = F.pandas_udf("place long, number long")(_ordered)
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        m["file_path"].alias("path"), m["file_block_start"].alias("split"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("record"),
    )
    lines = lines.withColumn("length", F.octet_length("record").cast("long") + 1)
    splits = lines.groupBy("path", "split").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    missing = F.col("size") - F.sum("bytes").over(whole)  # 0 or 3 with a last newline, -1 or 2 without
    splits = splits.select(
        F.col("path").alias("of_path"), F.col("split").alias("of_split"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.when(missing >= 2, 3).otherwise(0).alias("mark"), missing.isin(-1, 2).alias("cut"), F.sum("n").over(whole).alias("n_all"),
    )
    placed = lines.withColumn("at", within("path", "split", "length"))
    joined = placed.join(splits, (F.col("path") == F.col("of_path")) & (F.col("split") == F.col("of_split")))
    index = F.col("n_before") + F.col("at.number")
    first = (index == 0) & (F.col("mark") > 0)
    terminated = ~(F.col("cut") & (index == F.col("n_all") - 1))
    start = F.when(index == 0, 0).otherwise(F.col("bytes_before") + F.col("at.place") + F.col("mark"))
    end = F.col("bytes_before") + F.col("at.place") + F.col("mark") + F.col("length") - F.when(terminated, 0).otherwise(1)
    record = F.when(first, F.concat(F.unhex(F.lit(_MARK)), F.col("record"))).otherwise(F.col("record"))
    return joined.select("path", index.alias("record_index"), start.alias("start"), end.alias("end"), terminated.alias("terminated"), record.alias("record"))


def _label(v: Column, path: str) -> Column:
    """A text member that isn't blank and not too long for a label."""
    found = F.try_variant_get(v, path, "string")
    return F.when((F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING") & found.rlike(r"\S") & (F.octet_length(found) <= LABEL_BYTES), found)


def locate(records: DataFrame) -> DataFrame:
    """records, instead of their bytes with record_sha256 (newline included), parse_status (malformed; unknown where the value is no
    object or names no type; ok), native_type, native_payload_type and occurred_at: the first of a record's times that reads as
    one. A record that names a key twice counts as malformed."""
    whole = F.when(F.col("terminated"), F.concat("record", F.unhex(F.lit("0A")))).otherwise(F.col("record"))
    text = F.when(F.is_valid_utf8(F.col("record").cast("string")), F.regexp_replace(F.col("record").cast("string"), r"[\r\n]+$", ""))
    read = records.withColumn("record_sha256", F.sha2(whole, 256)).withColumn("v", F.try_parse_json(text)).drop("record")
    v = F.col("v")
    object_ = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    kind = F.when(object_, _label(v, "$.type"))
    times = [F.try_variant_get(v, f"$.{c}", "string") for c in TIMES]
    texts = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) == "STRING", t) for c, t in zip(TIMES, times, strict=True)]
    shaped = [F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})\z"), t) for t in texts]
    time = F.coalesce(*shaped)
    return read.select(
        *[c for c in read.columns if c != "v"], F.when(v.isNull(), "malformed").when(kind.isNull(), "unknown").otherwise("ok").alias("parse_status"), kind.alias("native_type"),
        F.when(object_, _label(v, "$.payload.type")).alias("native_payload_type"), F.when(object_ & F.try_to_timestamp(time).isNotNull(), time).alias("occurred_at"),
    )
