"""Substring dedup: words in windows that an earlier document holds as well are removed.

A window is WINDOW consecutive words of one document, known by two Rabin-Karp hashes: polynomials over 64-bit word numbers
with different bases, each from two prefix sums. Windows are counted in Spark, and those whose words also start in a
document with a smaller id merge into maximal removal intervals.

Most windows need not be counted one by one. Equal windows have equal least GRAM-word hashes, and these change about every
twenty words, so windows come in runs of one least hash (`_anchors`). A run whose hash stands in no other document has no
equal window there. Runs are then compared whole, by a Rabin-Karp hash of all their words: if an earlier document has the same
run, all its windows go at once, and what else equals them equals that earlier run as well. What is left, the runs of the first
document of each kind where documents differ in kinds, is counted window by window. That loses nothing, whatever the texts are.

The order of documents is doc_id, null last; rows that agree in doc_id, or are both null, aren't smaller than each other, so
nothing of theirs goes because of the other. Null text has no words and is kept as it is; a text of fewer than WINDOW words
has no window; a text may lose all words. Very long texts are worked on in pieces of STEP windows. An empty table gives an
empty table; extra columns stay, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pack, recording, remove
from .tokens import mix, parts, powers, word_numbers

WINDOW = 50
#: Words of the hashes that stand for a run of windows.
GRAM = 10
#: Text bytes, and windows, worked on at once.
PART, STEP = 2 << 20, 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

#: For each byte 0 if it separates words, else itself; NUL belongs to a word, and 255 never occurs in UTF-8.
UNCHANGED = np.arange(256, dtype=np.uint8)
UNCHANGED[[0x20, *range(0x09, 0x0E)]] = 0
UNCHANGED[0] = 255


@functools.cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse modulo 2 ** 64."""
    return powers(base, n), powers(pow(base, -1, 1 << 64), n)


def rabin_karp(numbers: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """A hash of numbers[i : i + size] for each i that has so many."""
    if len(numbers) < size:
        return np.zeros(0, np.uint64)
    starts = np.arange(len(numbers) - size + 1)
    return _between(numbers, starts, starts + size, base)


def _between(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASES[1]) -> np.ndarray:
    """A hash of numbers[start : end] for each start and end."""
    up, down = _powers(base, 1 << len(numbers).bit_length())
    sums = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers * up[: len(numbers)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i that has so many."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def _columns(batch: pa.RecordBatch, rows: np.ndarray) -> dict[str, pa.Array]:
    take = pa.array(rows)
    return {c: batch.column(c).take(take) for c in ("id", "hash")}


def _anchors(window: int, gram: int):
    """Runs of windows with one least hash: id, hash, gram, whole (a hash of all its words), first and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", PART):
            numbers, begins = word_numbers(batch.column("text"), UNCHANGED)
            for at in range(0, len(numbers) - window + 1, STEP):
                some = numbers[at : at + STEP + window - 1]
                least = _least(rabin_karp(some, gram), window - gram + 1)
                starts = at + np.arange(len(least))
                row = np.searchsorted(begins, starts, "right") - 1
                whole = starts + window <= begins[row + 1]
                least, starts, row = least[whole], starts[whole], row[whole]
                if not len(starts):
                    continue
                new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])))
                first, last, own = starts[new], starts[np.append(new[1:], len(starts)) - 1], row[new]
                yield pa.RecordBatch.from_pydict(
                    _columns(batch, own)
                    | {
                        "gram": pa.array(least[new].view(np.int64)), "whole": pa.array(_between(some, first - at, last - at + window).view(np.int64)),
                        "first": pa.array((first - begins[own]).astype(np.int32)), "last": pa.array((last - begins[own]).astype(np.int32)),
                    }
                )

    return run


def _windows(window: int):
    """Both hashes of every window whose start lies in one of its row's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", PART):
            numbers, begins = word_numbers(batch.column("text"), UNCHANGED)
            runs = batch.column("runs")
            of = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            first, last = (begins[of] + flat.field(c).to_numpy() for c in ("first", "last"))
            edges = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(edges, first, 1)
            np.add.at(edges, last + 1, -1)
            wanted = np.cumsum(edges[:-1]) > 0
            for at in range(0, len(numbers) - window + 1, STEP):
                some = numbers[at : at + STEP + window - 1]
                starts = np.flatnonzero(wanted[at : at + len(some) - window + 1])
                if len(starts):
                    row = np.searchsorted(begins, starts + at, "right") - 1
                    hashes = {f"w{k}": pa.array(rabin_karp(some, window, base)[starts].view(np.int64)) for k, base in enumerate(_BASES)}
                    yield pa.RecordBatch.from_pydict(_columns(batch, row) | {"start": pa.array((starts + at - begins[row]).astype(np.int32))} | hashes)

    return run


def _merged(window: int):
    """Ranges of starts as maximal intervals of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lengths, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
            for i in range(batch.num_rows):
                ranges = batch.column("ranges")[i].values
                first, last = (ranges.field(c).to_numpy() for c in ("first", "last"))
                order = np.argsort(first, kind="stable")
                first, end = first[order], np.maximum.accumulate(last[order] + window)
                new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
                firsts.append(first[new])
                lengths.append(end[np.append(new[1:], len(first)) - 1] - first[new])
                sizes.append(sizes[-1] + len(new))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (firsts, lengths)], ["first", "length"])
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "hash": batch.column("hash"), "spans": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)})

    return run


def _shared(doc: str = "id") -> Column:
    """Whether rows of several documents are in a group."""
    return (F.min(doc) < F.max(doc)) | ((F.count(doc) > 0) & (F.count(doc) < F.count(F.lit(1))))


def removal_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, hash (of the text) and spans (first word, number of words; sorted, none touch) of each text that loses words.

    A window or run may stand in any share of the documents: counts combine before they shuffle, and in each join one side
    has one row per key, so Spark can split the other. All of them grow with the texts, so none is broadcast at any size.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    same_row = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash"))
    earlier = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("least") < F.col("id")))
    with recording() as made:
        runs = materialize(slim.mapInArrow(_anchors(window, gram), "id bigint, hash bigint, gram bigint, whole bigint, first int, last int"), "runs")
        shared = materialize(runs.groupBy("gram").agg(_shared().alias("shared")).filter("shared").select("gram"), "shared")
        runs = materialize(runs.join(shared.hint("merge"), "gram").withColumn("n", F.col("last") - F.col("first")), "runs")
        kinds = materialize(runs.groupBy("gram", "whole", "n").agg(F.min("id").alias("least")), "kinds")
        runs = materialize(runs.join(kinds.hint("merge"), ["gram", "whole", "n"]).select("id", "hash", "gram", "first", "last", earlier.alias("gone")), "runs")
        gone = runs.filter("gone").select("id", "hash", "first", "last")
        # Those of the first document of their kind, where other documents have other kinds.
        several = materialize(kinds.groupBy("gram").agg(_shared("least").alias("shared")).filter("shared").select("gram"), "several")
        wanted = runs.filter("NOT gone").join(several.hint("merge"), "gram").groupBy(F.col("id").alias("of_id"), F.col("hash").alias("of_hash")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
        own = slim.join(materialize(wanted, "wanted").hint("merge"), same_row).select("id", "hash", "text", "runs")
        windows = materialize(own.mapInArrow(_windows(window), "id bigint, hash bigint, start int, w0 bigint, w1 bigint"), "windows")
        repeated = windows.groupBy("w0", "w1").agg(F.min("id").alias("least"), _shared().alias("shared")).filter("shared").drop("shared")
        single = windows.join(materialize(repeated, "repeated").hint("merge"), ["w0", "w1"]).filter(earlier).select("id", "hash", F.col("start").alias("first"), F.col("start").alias("last"))
        ranges = gone.unionByName(single).groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
        spans = materialize(ranges.mapInArrow(_merged(window), "id bigint, hash bigint, spans array<struct<first: int, length: int>>"), "spans")
    remove(docs.sparkSession, made[:-1])
    return spans


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Words of a text, words in spans, and the other words joined by one space."""
    words = (text or "").encode().split()
    n = len(words)
    for s in reversed(spans or ()):
        del words[s["first"] : s["first"] + s["length"]]
    return n, n - len(words), b" ".join(words)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", PART):
        done = [(n, r, hashlib.sha256(kept).hexdigest()) for n, r, kept in map(kept_words, batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        n, removed, kept = zip(*done, strict=True) if done else ((), (), ())
        spans = [len(s or ()) for s in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string()),
        })


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", PART):
        texts = [t if s is None else kept_words(t, s)[2].decode() for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "kept"])


def _with_spans(docs: DataFrame, text: str, doc_id: str, window: int) -> DataFrame:
    spans = removal_spans(docs, text, doc_id, window).select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "spans")
    packed = pack(docs, id=docs[doc_id].cast("bigint"), hash=F.xxhash64(F.coalesce(docs[text], F.lit(""))), text=text)
    return packed.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left").select("row", "id", "text", "spans")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 of each row."""
    marked = _with_spans(docs.select("doc_id", "text"), "text", "doc_id", window).select("id", "text", "spans")
    return marked.mapInArrow(_digest, "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """docs without the words of repeated windows. A text that loses words has its other words joined by one space; a text
    that loses none stays as it is."""
    marked = _with_spans(docs, text, doc_id, window).select("row", "text", "spans")
    row = marked.schema["row"].dataType.simpleString()
    done = marked.mapInArrow(_cut, f"row {row}, kept string")
    return done.select(*[F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p FROM g JOIN f USING (g) WHERE least < doc_id),
r AS (SELECT doc_id, count(*) AS n, count(*) - count(CASE WHEN p - 1 = before THEN 1 END) AS runs FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
