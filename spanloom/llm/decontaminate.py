"""Benchmark decontamination on a positional inverted index.

The training texts are cut into segments of about SEGMENT bytes. A segment is one row that holds a complete index of
its documents: sorted term numbers, and for each the places where it stands. Building needs no shuffle; the segments
are written once to the shared folder and answer any number of benchmarks. Segments are bounded, so are the tasks, and
a lost executor costs the segments it was working on.

A search takes benchmark windows in blocks of bounded size (the block is what is broadcast; more windows mean more
blocks, not a larger broadcast). In each segment every window starts from its rarest term there; the lists of its other
terms, shifted by their offsets, are intersected with that term's places, rarer terms first. Exact matches have every
term at its place; proximity matches have every term within SLOP places of it.

Terms are compared as 64-bit numbers. Null text has no words. Documents are rows: rows with the same doc_id are
reported each. Benchmark rows with the same item_id are one item, null item_id counts as an item with an empty id,
items without words never match. Empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pack, recording, remove
from .tokens import ALNUM, parts, word_numbers

WINDOW = 10
SLOP = 2
SEGMENT = 2 << 20
#: Benchmark bytes in a block.
BLOCK = 16 << 20
#: Candidate places looked at together.
TOGETHER = 1 << 18

INDEX_SCHEMA = "segment string, ids array<bigint>, hashes array<bigint>, begins binary, terms binary, lists binary, places binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for n, batch in enumerate(parts(batches, "text", SEGMENT)):
        numbers, begins = word_numbers(batch.column("text"), ALNUM)
        order = np.argsort(numbers, kind="stable").astype(np.int32)
        terms, lists = np.unique(numbers[order], return_index=True)
        row = {
            "segment": [f"{TaskContext.get().partitionId()}-{n}"],
            "ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
            "hashes": pa.array([batch.column("hash").to_pylist()], pa.list_(pa.int64())),
        }
        row |= {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("begins", begins.astype(np.int32)), ("terms", terms), ("lists", lists.astype(np.int32)), ("places", order))}
        yield pa.RecordBatch.from_pydict(row)


def text_hash(text: str = "text") -> Column:
    """With the id it tells rows apart; rows that agree in both have the same text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per segment, as in INDEX_SCHEMA. It is written at once: segments are numbered by task, and every block of
    a search must see the same numbers."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_hash(text).alias("hash"), F.col(text).alias("text"))
    return materialize(slim.mapInArrow(_build, INDEX_SCHEMA), "index")


class Windows:
    """A block of benchmark windows: item (number of an item), and by length the terms, one row per window."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in rows})
        numbers, begins = word_numbers(pa.array([t for _, t in rows], pa.string()), ALNUM)
        found: dict[int, tuple[list, list]] = {}
        where = {i: k for k, i in enumerate(self.ids)}
        for k, (item, _) in enumerate(rows):
            ws = numbers[begins[k] : begins[k + 1]]
            size = min(window, len(ws))
            if size:
                terms, items = found.setdefault(size, ([], []))
                terms.append(np.lib.stride_tricks.sliding_window_view(ws, size))
                items.append(np.full(len(ws) - size + 1, where[item]))
        self.by_length = [(size, np.concatenate(t), np.concatenate(i)) for size, (t, i) in sorted(found.items())]


def _matches(terms: np.ndarray, lists: np.ndarray, places: np.ndarray, n: int, windows: Windows, slop: int):
    """Yields (length, items, starts, exact) of windows that stand, exactly or nearly, in a segment of n words."""
    counts = np.diff(lists, append=n)
    # Lists of all terms in one sorted array: a place of a term is its number here times 2 ** 32 plus the place.
    postings = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | places

    def stands(term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 32) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(postings, key), n - 1)
        return (postings[at] == key) & (place >= 0)

    for size, wanted, items in windows.by_length:
        ids = np.searchsorted(terms, wanted)
        known = (ids < len(terms)) & (terms[np.minimum(ids, len(terms) - 1)] == wanted)
        rows = np.flatnonzero(known.all(axis=1))  # a window with a term that stands nowhere is not here
        ids = ids[rows].astype(np.int64)
        rarity = np.argsort(counts[ids], axis=1, kind="stable")
        many = counts[ids[np.arange(len(rows)), rarity[:, 0]]] if len(rows) else np.zeros(0, np.int64)
        ends = np.cumsum(many)
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            own, rank = ids[at:stop], rarity[at:stop]
            first = own[np.arange(len(own)), rank[:, 0]]
            w = np.repeat(np.arange(len(own)), many[at:stop])
            step = np.arange(len(w)) - np.repeat(np.cumsum(many[at:stop]) - many[at:stop], many[at:stop])
            start = places[lists[first][w] + step].astype(np.int64) - rank[w, 0]
            for k in range(1, size):
                term, offset = own[w, rank[w, k]], rank[w, k]
                near = stands(term, start + offset)
                for d in range(1, slop + 1):
                    near |= stands(term, start + offset - d) | stands(term, start + offset + d)
                w, start = w[near], start[near]
            exact = np.ones(len(w), bool)
            for k in range(size):
                exact &= stands(own[w, k], start + k)
            yield size, items[rows[at + w]], start, exact
            at = stop


HITS_SCHEMA = "segment string, row int, doc_id bigint, hash bigint, n_words bigint, spans binary, items array<string>, near_items array<string>"


def _search(value, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = value.value
        for batch in batches:
            for i in range(batch.num_rows):
                x = {k: batch.column(k)[i] for k in batch.schema.names}
                get = lambda k, kind: np.frombuffer(x[k].as_buffer(), kind)  # noqa: B023, E731
                begins, places = get("begins", np.int32).astype(np.int64), get("places", np.int32)
                n_docs = len(begins) - 1
                spans: list[list] = [[] for _ in range(n_docs)]
                items: list[set] = [set() for _ in range(n_docs)]
                near: list[set] = [set() for _ in range(n_docs)]
                if len(places):
                    for size, found, start, exact in _matches(get("terms", np.uint64), get("lists", np.int32).astype(np.int64), places, len(places), windows, slop):
                        row = np.searchsorted(begins, np.maximum(start, 0), "right") - 1
                        whole = exact & (start + size <= begins[np.minimum(row + 1, n_docs)])
                        for r, s, item in zip(row[whole], start[whole], found[whole], strict=True):
                            spans[r].append((int(s - begins[r]), size))
                            items[r].add(windows.ids[item])
                        inside = ~whole & (start >= begins[row]) & (start + size <= begins[np.minimum(row + 1, n_docs)])
                        for r, item in {*zip(row[inside].tolist(), found[inside].tolist(), strict=True)}:
                            near[r].add(windows.ids[item])
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([x["segment"].as_py()] * n_docs, pa.string()),
                    "row": pa.array(range(n_docs), pa.int32()),
                    "doc_id": x["ids"].values if n_docs else pa.array([], pa.int64()),
                    "hash": x["hashes"].values if n_docs else pa.array([], pa.int64()),
                    "n_words": pa.array(np.diff(begins), pa.int64()),
                    "spans": pa.array([np.array(sorted(set(s)), np.int32).reshape(-1).tobytes() for s in spans], pa.binary()),
                    "items": pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                    "near_items": pa.array([sorted(s) for s in near], pa.list_(pa.string())),
                })

    return run


def search(index: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", slop: int = SLOP) -> DataFrame:
    """A row per indexed document, as in HITS_SCHEMA; spans holds pairs of first word and length.

    index is read once for each block of the benchmark; results of several blocks are merged per document.
    """
    spark = index.sparkSession
    asked = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    found = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        rows = [(r["i"], r["t"]) for r in block.toLocalIterator()]
        found.append(index.mapInArrow(_search(spark.sparkContext.broadcast(Windows(rows)), slop), HITS_SCHEMA))
    if blocks == 1:
        return found[0]
    both = found[0]
    for p in found[1:]:
        both = both.unionByName(p)
    listed = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.groupBy("segment", "row", "doc_id", "hash", "n_words").agg(F.array_join(F.transform(F.collect_list("spans"), F.hex), "").alias("spans"), listed("items"), listed("near_items")).withColumn("spans", F.unhex("spans"))


DIGEST_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near_items bigint"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = []
        for s in b.column("spans").to_pylist():
            last = n = 0
            for first, size in np.frombuffer(s, np.int32).reshape(-1, 2)[:].tolist() if s else ():
                n += max(0, first + size - max(first, last))
                last = max(last, first + size)
            hit.append(n)
        items, near = b.column("items").to_pylist(), b.column("near_items").to_pylist()
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"),
            "n_words": b.column("n_words"),
            "n_hit": pa.array(hit, pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": [n > 0 for n in hit],
            "n_near_items": pa.array([len(x) for x in near], pa.int64()),
        })


def digest(hits: DataFrame) -> DataFrame:
    return hits.mapInArrow(_digest, DIGEST_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, with all their columns, without those in which a benchmark window stands."""
    with recording() as made:
        hits = search(build_index(docs, text, doc_id), benchmark)
        bad = hits.filter(F.size("items") > 0).select(F.col("doc_id").alias("bad_id"), F.col("hash").alias("bad_hash")).distinct()
        bad = materialize(bad, "contaminated")
    remove(docs.sparkSession, made[:-1])
    packed = pack(docs, id=docs[doc_id].cast("bigint"), hash=text_hash(text))
    return packed.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
    list_filter(string_split_regex(lower_az(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower_az(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
dg AS (SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
m AS (SELECT rid, p, n, item_id FROM dg JOIN ig USING (n, g)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
""".replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
