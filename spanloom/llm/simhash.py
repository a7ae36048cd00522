"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two that differ in at most 3 agree in one half but for at most one bit. Each half is
indexed whole and with each of its bits left out. Equal keys meet, pairs are verified on all bits, and only a
spanning star of each key's linked fingerprints is emitted, never all pairs.

Exact copies fold into their fingerprint before anything meets. Keys are sorted within partitions and streamed, so
a task holds one key's fingerprints at a time, and at most MOST of them: a key with more goes to a second level,
where the other half is cut and indexed the same way. There at most 18 bits are free, so a group has at most
2 ** 18 distinct fingerprints whatever the input. Nothing is dropped: all pairs of a crowded key meet in some
second-level key, because their other halves differ in at most 3 bits too.

Null and empty texts have fingerprint 0 and are linked like any others; texts of one or two words are one shingle.
Rows are told apart by doc_id and text. Null ids take part; a component of only null ids has a null component_id.
An empty table gives an empty table.

near_dedup has a contract of its own: two documents are near copies if their sets of five-word shingles have a Jaccard
similarity of SIMILARITY or more. Its fingerprints have 128 bits in SEGMENTS segments, so two that differ in at most
2 * SEGMENTS - 1 bits agree in one segment but for at most one bit; keys are segments with one bit left out. Pairs that meet
and are that near are candidates, and each is verified on the exact sets. What is missed is pairs whose fingerprints lie
further apart. Equal sets fold first. Rows of a key come sorted by the size of their set, and only sizes that the similarity
allows are compared. A pair belongs to the first key that both have, so near copies that meet in many keys are one pair.
Each document is paired with its next AHEAD candidates of a key; where one has more, or meets more than LOOKED near ones,
it and those that are left come again once these are verified, and then all candidates in different classes are paired,
so a large class costs no square of its size and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pack, recording, remove
from .components import components
from .tokens import SPACED, mix, parts, raw, word_numbers

SHINGLE = 3
DISTANCE = 3
#: Fingerprints of one key that are compared directly.
MOST = 4096
#: Text bytes of a batch that are looked at together.
PART = 4 << 20
_HALF = np.uint64(0xFFFFFFFF)

#: What near_dedup takes as near copies: words of a shingle, and the least Jaccard similarity of the sets of these.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS = 12
#: Candidates of one document in one key that are paired before classes are known.
AHEAD = 16
#: Near ones that a document meets in one key, pairs of earlier keys too, before it waits for the classes.
LOOKED = 256
#: Rows of keys that are compared at once.
ROWS = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    # bytes.lower and bytes.split know A-Z and ASCII white space only, as wanted.
    ws = text.lower().split()
    if not ws:
        return 0
    size = min(shingle, len(ws))
    total = np.zeros(64, np.int64)
    n = len(ws) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        part = ws[at : min(at + 65536, n) + size - 1]
        grams = map(b" ".join, zip(*[part[k:] for k in range(size)], strict=False))
        h = np.fromiter((digest(g, 42) for g in grams), np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text", PART):
            data, at = raw(b.column("text"))
            data = data.tobytes()
            found = np.fromiter((fingerprint(data[at[i] : at[i + 1]], shingle) for i in range(b.num_rows)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "hash": b.column("hash"), "fp": found.view(np.int64)})

    return run


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, hash (of the text), fp: the fingerprint's bits as a long."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    return slim.mapInArrow(_fingerprints(shingle), "doc_id bigint, hash bigint, fp bigint")


def _variants(values: np.ndarray, bits: int) -> np.ndarray:
    """One row per value: itself and itself without each bit, numbered above its bits."""
    masks = np.array([(1 << bits) - 1, *[((1 << bits) - 1) ^ (1 << i) for i in range(bits)]], np.uint64)
    return (values[:, None] & masks) | (np.arange(bits + 1, dtype=np.uint64) << np.uint64(bits))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 8192):
            x = fp[at : at + 8192]
            keys = np.concatenate([_variants(x & _HALF, 32), _variants(x >> np.uint64(32), 32) | np.uint64(1 << 40)], axis=1)
            yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1).view(np.int64), "sub": np.full(keys.size, -1, np.int64), "fp": np.repeat(x, keys.shape[1]).view(np.int64)})


def _subkeys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, fp = b.column("a").to_numpy(), b.column("b").to_numpy().view(np.uint64)
        other = np.where(key >> 40 & 1, fp & _HALF, fp >> np.uint64(32))  # the half that the key leaves open
        sub = np.concatenate([_variants(other & np.uint64(0xFFFF), 16), _variants(other >> np.uint64(16), 16) | np.uint64(1 << 30)], axis=1)
        yield pa.RecordBatch.from_pydict({"key": np.repeat(key, sub.shape[1]), "sub": sub.reshape(-1).view(np.int64), "fp": np.repeat(fp.view(np.int64), sub.shape[1])})


def _star(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the least one that each reaches within the group over links of at most distance bits."""
    m = len(fp)
    label = np.arange(m)
    rows = max(1, (1 << 22) // m)
    while True:
        before = label.copy()
        for at in range(0, m, rows):
            near = np.bitwise_count(fp[at : at + rows, None] ^ fp[None, :]) <= distance
            np.minimum(label[at : at + rows], np.where(near, label[None, :], m).min(axis=1), out=label[at : at + rows])
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    far = label != np.arange(m)
    return fp[far], fp[label[far]]


def _links(distance: int, most: int):
    """Streams rows sorted by (key, sub). Emits a, b: linked fingerprints, or crowded rows again as (key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple = ()
        crowded = None

        def emit(a, b, hot):
            return pa.RecordBatch.from_pydict({"hot": np.full(len(a), hot), "a": a.view(np.int64), "b": b.view(np.int64)})

        def groups(key, sub, fp, last):
            """All complete groups of the rows, and what may go on."""
            nonlocal rest, crowded
            cut = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.append(cut, len(key))
            if not last:
                rest = tuple(x[starts[-1] :] for x in (key, sub, fp))
                starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            out_a, out_b = [], []
            few = np.flatnonzero((sizes > 1) & (sizes <= 6))
            for d in range(1, 6):  # groups of a few: each row with the d-th after it
                own = few[sizes[few] > d]
                at = np.repeat(starts[own], sizes[own] - d)
                at = at + np.arange(len(at)) - np.repeat(np.cumsum(sizes[own] - d) - (sizes[own] - d), sizes[own] - d)
                near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
                out_a.append(fp[near]), out_b.append(fp[near + d])
            for g in np.flatnonzero(sizes > 6):
                x = fp[starts[g] : ends[g]]
                if crowded == (key[starts[g]], sub[starts[g]]) or (sub[starts[g]] == -1 and len(x) > most):
                    yield emit(np.full(len(x), key[starts[g]]), x, True)
                else:
                    a, b = _star(x, distance)
                    out_a.append(a), out_b.append(b)
            if out_a:
                yield emit(np.concatenate(out_a), np.concatenate(out_b), False)

        for batch in batches:
            x = [batch.column(c).to_numpy() for c in ("key", "sub")] + [batch.column("fp").to_numpy().view(np.uint64)]
            if rest:
                x = [np.concatenate(p) for p in zip(rest, x, strict=True)]
            if not len(x[0]):
                continue
            if crowded is not None:  # its rows pass through as they come
                same = (x[0] == crowded[0]) & (x[1] == crowded[1])
                yield emit(x[0][same], x[2][same], True)
                if same.all():
                    rest = ()
                    continue
                x = [v[~same] for v in x]
                crowded = None
            yield from groups(*x, False)
            if rest[1][0] == -1 and len(rest[0]) > most:
                crowded = (rest[0][0], rest[1][0])
                yield emit(rest[0], rest[2], True)
                rest = ()
        if rest and len(rest[0]):
            yield from groups(*rest, True)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """u, v: a star of linked fingerprints per key, from distinct fingerprints (fp)."""
    if distance > 3:
        raise ValueError("two halves find up to three differing bits")

    def meet(keyed: DataFrame) -> DataFrame:
        return keyed.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_links(distance, most), "hot boolean, a bigint, b bigint")

    first = materialize(meet(fps.mapInArrow(_keys, "key bigint, sub bigint, fp bigint")), "links")
    found = first.filter("NOT hot").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if first.filter("hot").limit(1).count():
        second = meet(first.filter("hot").mapInArrow(_subkeys, "key bigint, sub bigint, fp bigint"))
        found = found.unionByName(second.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.distinct()


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, root (a fingerprint that names its class), component_id (least doc_id of the class) for each fingerprint."""
    with recording() as made:
        least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        roots = components(links(least.select("fp"), distance))
        known = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        known = materialize(known, "classes")
    remove(prints.sparkSession, made[:-1])
    ids = materialize(known.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return known.drop("least").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, hash, fp, root, component_id: a row for each row of docs."""
    prints = materialize(fingerprints(docs, text, doc_id), "fingerprints")
    return prints.join(classes(prints), "fp").select("doc_id", "hash", "fp", "root", "component_id")


def _grams(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingles of each text, as numbers; a text of fewer words is one shingle."""
    numbers, begins = word_numbers(column, SPACED)
    for lo, hi in zip(begins[:-1], begins[1:], strict=True):
        size = min(NEAR_SHINGLE, hi - lo)
        h = np.zeros(hi - lo - size + 1 if size else 0, np.uint64)
        for k in range(size):
            h = mix(h) + numbers[lo + k : lo + k + len(h)]
        yield np.unique(mix(h))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, "text", PART):
        sets, sizes = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32)
        fps = np.zeros((2, b.num_rows), np.uint64)
        for i, grams in enumerate(_grams(b.column("text"))):
            sets[i], sizes[i] = xxhash.xxh64_intdigest(grams.tobytes(), 42), len(grams)
            for k, h in enumerate((grams, mix(grams + np.uint64(1)))):
                total = sum(np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(h), 65536))
                if len(h):
                    fps[k, i] = np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "hash": b.column("hash"), "set": sets.view(np.int64), "n": sizes, "f": fps[0].view(np.int64), "g": fps[1].view(np.int64)})


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, "text", PART):
        for i, grams in enumerate(_grams(b.column("text"))):
            yield pa.RecordBatch.from_pydict({"hash": b.column("hash")[i : i + 1], "grams": pa.array([grams.view(np.int64)], pa.list_(pa.int64()))})


def _segment_keys(segments: int):
    """at (key and size of the set), node, f, g: a row for each bit that is left out of its segment."""
    edges = np.linspace(0, 128, segments + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                node, n, f, g = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "f", "g"))
                bits = np.unpackbits(np.stack([f, g], axis=1).astype("<i8").view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                keys = np.empty((part.num_rows, 128), np.int64)
                for first, last in zip(edges[:-1], edges[1:], strict=True):
                    each = bits[:, first:last] << np.arange(last - first)
                    keys[:, first:last] = each.sum(axis=1)[:, None] - each
                keys = (np.arange(128) << 20 | keys) << 32 | n[:, None].astype(np.int64)
                yield pa.RecordBatch.from_pydict({"at": keys.reshape(-1), **{k: np.repeat(x, 128) for k, x in (("node", node), ("f", f), ("g", g))}})

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch], columns: list[str], least: int) -> Iterator[list[np.ndarray]]:
    """Columns of at least so many rows at once, cut between keys; rows are sorted by at."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        x = [b.column(c).to_numpy() for c in columns]
        if not len(x[0]):
            continue
        if rows >= least:
            cut = int(np.searchsorted(x[0] >> 32, held[-1][0][-1] >> 32, "right"))
            if cut < len(x[0]):
                held.append([v[:cut] for v in x])
                yield [np.concatenate(v) for v in zip(*held, strict=True)]
                held, rows, x = [], 0, [v[cut:] for v in x]
        held.append(x)
        rows += len(x[0])
    if held:
        yield [np.concatenate(v) for v in zip(*held, strict=True)]


def _reach(n: np.ndarray) -> np.ndarray:
    """The largest set that can be similar to one of n shingles."""
    return np.floor(n / SIMILARITY + 1e-6).astype(np.int64)


_MET = "hot boolean, at bigint, a bigint, b bigint, f bigint, g bigint"


def _first_keys(f: np.ndarray, g: np.ndarray, segments: int) -> np.ndarray:
    """The first key that pairs share, -1 if none; f and g are the bits that differ."""
    edges = [int(x) for x in np.linspace(0, 128, segments + 1)]
    keys, rest = np.full(len(f), -1), np.arange(len(f))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        mask = (1 << hi) - (1 << lo)
        x, y = f & np.uint64(mask & (1 << 64) - 1), g & np.uint64(mask >> 64)
        apart = np.bitwise_count(x) + np.bitwise_count(y)
        keys[rest[apart == 0]] = lo
        # The bits below a single one are as many as its place.
        place = np.where(x > 0, np.bitwise_count(x - np.uint64(1)).astype(np.int64), 64 + np.bitwise_count(y - np.uint64(1)).astype(np.int64))
        keys[rest[apart == 1]] = place[apart == 1]
        more = apart > 1
        rest, f, g = rest[more], f[more], g[more]
    return keys


def _ahead(distance: int, most: int, segments: int, looked: int):
    """Candidate pairs a, b, each in the first key that both have: each row and its next ones, `most` at most. Rows that have
    more, or are near more than `looked`, come again (hot), and so do those that they have not been held against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, node, *fps in _whole_keys(batches, ["at", "node", "f", "g"], ROWS):
            f, g = (x.view(np.uint64) for x in fps)  # numpy counts the bits of absolute values
            n = at & 0xFFFFFFFF
            left = np.searchsorted(at, (at - n) + _reach(n), "right") - 1 - np.arange(len(at))
            done, met, count = left.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            one, two = [], []
            now, d = np.flatnonzero(left > 0), 1
            while len(now):
                x, y = f[now] ^ f[now + d], g[now] ^ g[now + d]
                close = np.bitwise_count(x) + np.bitwise_count(y) <= distance
                near = now[close]
                met[near] += 1
                near = near[_first_keys(x[close], y[close], segments) == at[near] >> 52]
                count[near] += 1
                near = near[count[near] <= most]
                one.append(near), two.append(near + d)
                full = (count[now] > most) | (met[now] > looked)
                done[now[full]] = np.where(count[now[full]] > most, d - 1, d)
                now = now[~full & (left[now] > d)]
                d += 1
            a, b = (node[np.concatenate(x)] if x else node[:0] for x in (one, two))
            a, b = np.minimum(a, b), np.maximum(a, b)
            zero = np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_pydict({"hot": np.zeros(len(a), bool), "at": zero, "a": a, "b": b, "f": zero, "g": zero})
            stopped = np.flatnonzero(done < left)
            if len(stopped):
                ranges = np.zeros(len(at) + 1, np.int64)
                np.add.at(ranges, stopped + done[stopped] + 1, 1), np.add.at(ranges, stopped + left[stopped] + 1, -1)
                again = np.cumsum(ranges[:-1]) > 0
                again[stopped] = True
                yield pa.RecordBatch.from_pydict({"hot": np.ones(int(again.sum()), bool), "at": at[again], "a": node[again], "b": node[again], "f": fps[0][again], "g": fps[1][again]})

    return run


def _first_shared(key: int, f: np.ndarray, g: np.ndarray, segments: int) -> np.ndarray:
    """Whether no key before this one is shared too, for pairs that share this one; f and g are the bits that differ."""
    return _first_keys(f, g, segments) == key


def _across(distance: int, segments: int):
    """Candidate pairs a, b of different classes, each once: in the first key that both have. If they do not come in that
    key, the pair has come before. The key's largest class is not compared with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_keys(batches, ["at", "a", "f", "g", "root"], 1):
            cuts = np.flatnonzero(np.diff(columns[0] >> 32)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(columns[0])], strict=True):
                at, node, f, g, root = (x[lo:hi] for x in columns)
                roots, of, sizes = np.unique(root, return_inverse=True, return_counts=True)
                n, f, g = at & 0xFFFFFFFF, f.view(np.uint64), g.view(np.uint64)
                most = of == sizes.argmax()
                others = np.flatnonzero(~most)
                step = max(1, (1 << 20) // len(at))
                for k in range(0, len(others), step):
                    x = others[k : k + step, None]
                    near = np.bitwise_count(f[x] ^ f) + np.bitwise_count(g[x] ^ g) <= distance
                    near &= most | (np.arange(len(at)) > x)
                    i, j = np.nonzero(near & (root[x] != root) & (np.maximum(n[x], n) <= _reach(np.minimum(n[x], n))))
                    i = others[k + i]
                    first = _first_shared(int(at[0] >> 52), f[i] ^ f[j], g[i] ^ g[j], segments)
                    a, b = node[i[first]], node[j[first]]
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of pairs (a, b) whose texts' sets of shingles are similar; texts has hash and text."""
    wanted = pairs.select(F.col("a").alias("hash")).unionByName(pairs.select(F.col("b").alias("hash"))).distinct()
    grams = texts.join(wanted, "hash", "left_semi").dropDuplicates(["hash"]).mapInArrow(_shingles, "hash bigint, grams array<bigint>")
    grams = materialize(grams, "grams")
    side = lambda c: grams.select(F.col("hash").alias(c), F.col("grams").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.filter(both / (F.size("of_a") + F.size("of_b") - both) >= SIMILARITY).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", segments: int = SEGMENTS, ahead: int = AHEAD, looked: int = LOOKED) -> DataFrame:
    """doc_id, hash, root (the same in all of a class of near copies): a row for each row of docs."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    sets = materialize(texts.mapInArrow(_sets, "doc_id bigint, hash bigint, set bigint, n int, f bigint, g bigint"), "sets")
    nodes = materialize(sets.groupBy("set", "n", "f", "g").agg(F.min("hash").alias("node")), "nodes")
    texts, distance = texts.select("hash", "text"), 2 * segments - 1

    def by_key(rows: DataFrame, node: str) -> DataFrame:
        return rows.repartition(F.shiftright("at", 32)).sortWithinPartitions("at", node)

    keyed = nodes.filter("n > 0").mapInArrow(_segment_keys(segments), "at bigint, node bigint, f bigint, g bigint")
    met = materialize(by_key(keyed, "node").mapInArrow(_ahead(distance, ahead, segments, looked), _MET), "met")
    pairs = materialize(met.filter("NOT hot").select("a", "b").distinct(), "pairs")
    edges = materialize(_similar(pairs, texts), "similar")
    roots = components(edges)
    hot = met.filter("hot").drop("hot", "b")
    if hot.limit(1).count():
        # A row for each node, with the hot keys that it is in (128 at most), meets its class.
        own = hot.groupBy("a").agg(F.collect_list("at").alias("keys"), F.first("f").alias("f"), F.first("g").alias("g"))
        classed = own.join(roots, F.col("a") == F.col("node"), "left").select(F.explode("keys").alias("at"), "a", "f", "g", F.coalesce("root", "a").alias("root"))
        more = by_key(classed, "a").mapInArrow(_across(distance, segments), "a bigint, b bigint")
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(known.unionByName(materialize(_similar(more, texts), "similar")))
    known = nodes.join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("root"))
    return sets.join(known, "set").select("doc_id", "hash", "root")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each class, with all its columns: the one with the least doc_id, null ids last; of rows equal in
    id and text any one."""
    found = materialize(near_copies(docs, text, doc_id), "near")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"))).alias("s"))
    first = first.select(F.col("s.doc_id").alias("keep_id"), F.col("s.hash").alias("keep_hash"))
    packed = pack(docs, id=docs[doc_id].cast("bigint"), hash=F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    kept = packed.join(first, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash")), "left_semi")
    if found.groupBy("doc_id", "hash").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "hash"])
    return kept.select("row.*")
