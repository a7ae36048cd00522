"""Removal of long repeated byte strings, found by column-wise multi-document suffix sorting.

Equal strings of LENGTH bytes hold the same anchor at the same offset: the gram of GRAM bytes with the least hash, the
leftmost of equals. So every start of a LENGTH-byte string belongs to one anchor, and the starts of one anchor, with the
bytes they need, make a piece of at most 2 * LENGTH bytes. Two strings can only be equal if their anchors are.

1. A pass over the texts emits each piece's anchor hash, own hash and place, about one for 185 bytes.
2. Anchors that stand once are done: nothing in their pieces repeats. Where all pieces of an anchor are equal, all of
   each is a repeat. Both are settled by map-side combined counts.
3. Of what is left, one piece of each kind is sorted, class by class, with all pieces aligned at their anchors. Columns
   are taken right to left; each round inserts one symbol for each piece, which stably refines the order of the suffixes
   that begin there (the column's segment of the collection's Burrows-Wheeler transform is the symbols in that order),
   and renews the common prefixes of neighbours. A prefix of LENGTH bytes with a neighbour is a repeat.

Pieces bound the rounds, so documents may be of any length, and a batch bounds the memory of a task. As only suffixes at
the same column can be equal over LENGTH bytes, columns are kept as separate segments, and earlier ones are never
rewritten. A class with more than MOST kinds of pieces is not sorted in one task: each of its LENGTH-byte strings is
hashed instead and counted, exactly, with map-side combination.

Texts are UTF-8 bytes, null is empty, strings never cross rows. Rows are documents: the same text in two rows, whatever
their ids, is a repeat in both. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import _VALUES, mix, parts, powers, raw

LENGTH = 400
GRAM = 32
#: Kinds of pieces of one anchor that are sorted together, and pieces in a batch of classes.
MOST = 1 << 16
BATCH = 4096
#: Text bytes of a batch that are looked at together.
PART = 4 << 20
_CHUNK = 1 << 20
_LOW = np.uint64((1 << 21) - 1)
_STEPS = powers(0xD1342543DE82EF95, 64)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place on; gram is a power of two."""
    h, size = _VALUES[data], 1
    while size < gram:
        h = h[:-size] * _STEPS[size] + h[size:]
        size *= 2
    return mix(h)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """anchor, first start, last start and anchor hash of every piece of the concatenated rows."""
    starts_at = np.flatnonzero(np.diff(offsets) >= length)
    ok = np.zeros(len(data) + 1, np.int8)
    ok[offsets[starts_at]] += 1
    ok[offsets[starts_at + 1] - length + 1] -= 1
    ok = np.cumsum(ok, dtype=np.int8).astype(bool)
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), _CHUNK):
        own = data[at : at + _CHUNK + length - 1]
        if len(own) < length or not ok[at : at + _CHUNK].any():
            continue
        h = _gram_hashes(own, gram)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        start = np.flatnonzero(ok[at : at + len(low)])
        if not len(start):
            continue
        anchor = (low[start] & _LOW).astype(np.int64)
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
        first = np.concatenate([[0], cut])
        last = np.append(cut, len(start)) - 1
        yield anchor[first] + at, start[first] + at, start[last] + at, h[anchor[first]]


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text", PART):
            data, offsets = raw(b.column("text"))
            whole = memoryview(np.ascontiguousarray(data))
            for anchor, lo, hi, h in _pieces(data, offsets, length, gram):
                row = np.searchsorted(offsets, lo, "right") - 1
                own = np.fromiter((xxhash.xxh3_64_intdigest(whole[x:y], int(o)) for x, y, o in zip(lo.tolist(), (hi + length).tolist(), (anchor - lo).tolist(), strict=True)), np.uint64, len(lo))
                at = offsets[row]
                yield pa.RecordBatch.from_pydict({
                    "id": b.column("id").take(pa.array(row)), "hash": b.column("hash").take(pa.array(row)), "anchor": h.view(np.int64), "piece": own.view(np.int64),
                    "place": (anchor - at).astype(np.int32), "lo": (lo - at).astype(np.int32), "hi": (hi - at).astype(np.int32),
                })

    return run


def _extract(length: int):
    """Bytes of the wanted pieces of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text", PART):
            data, offsets = raw(b.column("text"))
            wanted = b.column("wanted")
            flat, counts = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), counts)
            lo, hi, place = (flat.field(k).to_numpy() for k in ("lo", "hi", "place"))
            whole = memoryview(np.ascontiguousarray(data))
            for at in range(0, len(row), BATCH):
                s = slice(at, at + BATCH)
                begin = offsets[row[s]] + lo[s]
                yield pa.RecordBatch.from_pydict({
                    "id": b.column("id").take(pa.array(row[s])), "hash": b.column("hash").take(pa.array(row[s])), "anchor": flat.field("anchor")[s],
                    "single": flat.field("single")[s], "lo": lo[s], "left": place[s] - lo[s],
                    "bytes": pa.array([bytes(whole[x : x + n]) for x, n in zip(begin.tolist(), (hi[s] - lo[s] + length).tolist(), strict=True)], pa.binary()),
                })

    return run


def repeated_starts(classes: np.ndarray, left: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each piece and column up to the anchor's, whether the length bytes from there stand in another piece of its
    class. classes are numbered and contiguous; left is how many bytes a piece has before its anchor."""
    n, middle = len(left), length - gram
    columns = middle + length
    sizes = np.diff(offsets)
    text = np.full((columns, n), 256, np.uint16)
    for at in range(0, n, 512):  # a stretch of pieces at a time, as places take more room than bytes
        own = slice(at, at + 512)
        row = np.repeat(np.arange(at, min(at + 512, n)), sizes[own])
        lo, hi = offsets[at], offsets[min(at + 512, n)]
        text[np.arange(lo, hi) - offsets[row] + middle - left[row], row] = data[lo:hi]
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    found = np.zeros((middle + 1, n), bool)
    block = classes.astype(np.int64) * 257
    for c in range(columns - 1, -1, -1):
        symbol = text[c][order]
        key = block + symbol
        if (key[1:] >= key[:-1]).all():
            after = common
            same = key[1:] == key[:-1]
            nearest = after[1:n]
        else:
            move = np.argsort(key, kind="stable")
            order, symbol, key = order[move], symbol[move], key[move]
            same = key[1:] == key[:-1]
            nearest = common[move[1:]]
            gaps = np.flatnonzero(same & (np.diff(move) > 1))
            if len(gaps):
                pairs = np.stack([move[gaps] + 1, move[gaps + 1] + 1], axis=1).reshape(-1)
                nearest[gaps] = np.minimum.reduceat(common, pairs)[::2]
        common = np.zeros(n + 1, np.int32)
        common[1:n] = np.where(same & (symbol[1:] != 256), np.minimum(nearest + 1, length), 0)
        if c <= middle:
            full = common >= length
            found[c, order[full[:-1] | full[1:]]] = True
    return found


SPANS = "id bigint, hash bigint, lo int, hi int"


def _sorted_classes(length: int, gram: int):
    """Streams pieces sorted by anchor and sorts whole classes in batches. Emits removed spans of single pieces."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        anchor = rows.column("anchor").to_numpy()
        single = rows.column("single").to_numpy(zero_copy_only=False)
        left, lo = rows.column("left").to_numpy(), rows.column("lo").to_numpy()
        column = rows.column("bytes").combine_chunks()
        data, offsets = raw(column if isinstance(column, pa.Array) else column.chunk(0))
        classes = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        found = repeated_starts(classes, left, data, offsets, length, gram) & single
        edge = np.diff(np.pad(found.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        piece, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        shift = lo[piece] + left[piece] - (length - gram)
        take = pa.array(piece)
        return pa.RecordBatch.from_pydict({
            "id": rows.column("id").combine_chunks().take(take), "hash": rows.column("hash").combine_chunks().take(take),
            "lo": (begin + shift).astype(np.int32), "hi": (end - 1 + shift + length).astype(np.int32),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < BATCH:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor = rows.column("anchor").to_numpy()
            cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if not len(cuts):
                continue
            done = int(cuts[-1])
            at = 0
            while at < done:
                stop = cuts[min(int(np.searchsorted(cuts, at + BATCH)), len(cuts) - 1)]
                yield work(rows.slice(at, int(stop) - at))
                at = int(stop)
            held = rows.slice(done).to_batches()
            n = rows.num_rows - done
        if n:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _strings(length: int):
    """Every length-byte string of a piece by its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, lo = b.column("bytes")[i].as_py(), b.column("lo")[i].as_py()
                n = len(text) - length + 1
                h = b"".join(xxhash.xxh3_128_digest(text[k : k + length]) for k in range(n))
                h = np.frombuffer(h, np.int64).reshape(-1, 2)
                same = lambda c, kind: pa.array([b.column(c)[i].as_py()] * n, kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"id": same("id", pa.int64()), "hash": same("hash", pa.int64()), "single": same("single", pa.bool_()), "start": np.arange(lo, lo + n, dtype=np.int32), "h1": h[:, 0], "h2": h[:, 1]})

    return run


def _both(a: str, b: str = "") -> Column:
    """Rows of the same text: ids may be null."""
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.hash") == F.col(f"{b}.hash"))


def _slim(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """id, hash (of the text), lo, hi: byte ranges covered by repeated strings; ranges may overlap and recur."""
    slim = _slim(docs, text, doc_id)
    kind = "id bigint, hash bigint, anchor bigint, piece bigint, place int, lo int, hi int"
    anchors = materialize(slim.mapInArrow(_anchors(length, gram), kind), "anchors")
    common = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("p"), F.max("piece").alias("q")).filter("n > 1")
    # Written, so that the join shuffles both its sides itself and Spark can split an anchor that many pieces share.
    common = materialize(common.select("anchor", (F.col("p") != F.col("q")).alias("mixed")), "common")
    repeated = materialize(anchors.join(common, "anchor"), "repeated")
    mixed = repeated.filter("mixed")
    kinds = mixed.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "hash", "place", "lo", "hi")).alias("first"))
    kinds = materialize(kinds.select("anchor", "piece", (F.col("n") == 1).alias("single"), "first.*"), "kinds")
    span = lambda df: df.select("id", "hash", "lo", (F.col("hi") + length).alias("hi"))
    copied = mixed.join(kinds.filter("NOT single").select("anchor", "piece"), ["anchor", "piece"])
    found = span(repeated.filter("NOT mixed")).unionByName(span(copied))

    wanted = kinds.groupBy("id", "hash").agg(F.collect_list(F.struct("anchor", "single", "place", "lo", "hi")).alias("wanted"))
    texts = slim.alias("s").join(wanted.alias("w"), _both("s", "w")).select("s.id", "s.hash", "s.text", "w.wanted")
    pieces = texts.mapInArrow(_extract(length), "id bigint, hash bigint, anchor bigint, single boolean, lo int, left int, bytes binary")
    crowded = kinds.groupBy("anchor").count().filter(F.col("count") > most).select("anchor")
    if crowded.limit(1).count():
        pieces = materialize(pieces, "pieces")
        strings = pieces.join(crowded, "anchor", "left_semi").mapInArrow(_strings(length), "id bigint, hash bigint, single boolean, start int, h1 bigint, h2 bigint")
        strings = materialize(strings, "strings")
        again = strings.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
        found = found.unionByName(strings.filter("single").join(again, ["h1", "h2"]).select("id", "hash", F.col("start").alias("lo"), (F.col("start") + length).alias("hi")))
        pieces = pieces.join(crowded, "anchor", "left_anti")
    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor")
    return found.unionByName(ordered.mapInArrow(_sorted_classes(length, gram), SPANS))


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, "text", PART):
        data, offsets = raw(b.column("text"))
        data = data.tobytes()
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        spans = b.column("spans").to_pylist()
        for i in range(b.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            kept, at, n, last = [], 0, 0, -1
            for x in sorted((s["lo"], s["hi"]) for s in spans[i] or ()):
                if x[0] > last:
                    n += 1
                    kept.append(text[at : x[0]])
                last = at = max(at, x[1])
            kept = b"".join([*kept, text[at:]])
            out["n_bytes"].append(len(text)), out["n_removed"].append(len(text) - len(kept)), out["n_spans"].append(n)
            out["kept"].append(kept.decode("utf-8", "ignore") if keep_text else hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c not in ("text", "spans")} | {k: pa.array(v, pa.string() if k == "kept" else pa.int64()) for k, v in out.items()})


def _with_spans(docs: DataFrame, text: str, doc_id: str, length: int, gram: int, most: int) -> DataFrame:
    spans = repeated_spans(docs, text, doc_id, length, gram, most).groupBy("id", "hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return _slim(docs, text, doc_id).alias("s").join(spans.alias("r"), _both("s", "r"), "left").select("s.id", "s.text", "r.spans")


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    cut = _with_spans(docs, "text", "doc_id", length, gram, most).mapInArrow(lambda it: _cut(it, False), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept string")
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, text: what is left of each; bytes of a cut character go with it."""
    gram = min(GRAM, 1 << max(0, (length // 4).bit_length() - 1))  # a power of two well below a short length
    cut = _with_spans(docs, text, doc_id, length, gram, MOST).mapInArrow(lambda it: _cut(it, True), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept string")
    return cut.select(F.col("id").alias(doc_id), "n_bytes", "n_removed", "n_spans", F.col("kept").alias(text))
