"""Pieces that the training-data operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

#: White space between words, and its complement, as Java and RE2 both read them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: What separates alphanumeric words.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_recorders: list[list[str]] = []


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df, written once in the shared folder and read back. The files go when the driver exits, or by remove()."""
    path = scratch.write(df, label, compression)
    for tables in _recorders:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The tables that materialize() writes meanwhile, so that they can be removed once what they led to is written."""
    tables: list[str] = []
    _recorders.append(tables)
    try:
        yield tables
    finally:
        _recorders[:] = [x for x in _recorders if x is not tables]


def remove(spark: SparkSession, tables: list[str]) -> None:
    for path in tables:
        scratch.delete(spark, path)
    tables.clear()


def pack(docs: DataFrame, **named: str | Column) -> DataFrame:
    """All columns of docs as one struct, `row`, beside the named ones: whatever else docs has, no name clashes."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[(docs[c] if isinstance(c, str) else c).alias(k) for k, c in named.items()])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other code point alone."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column, separator: str = SPACE) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), separator), lambda w: w != "")
