"""Language-model scores: a word model of order ORDER with Katz backoff.

p(w | h) is the Good-Turing discounted count of (h, w) over the count of h where (h, w) was seen in training, however
seldom; else bow(h) * p(w | h') where h was seen, h' being h without its first word; else p(w | h'). Down at single words
the discounted counts leave a rest for one unknown word. bow(h) is what h's discounts leave over what h's followers leave
under h', so each history sums to one exactly. Counts above DISCOUNTED lose the same small part of one occurrence, which
keeps something for every history. Texts begin after ORDER - 1 start marks and end with an end token.

1. Texts become segments: packed word numbers of about SEGMENT bytes of text. A longer text is cut, each further piece
   beginning with the words before it.
2. Each segment asks for the corpus count of every distinct n-gram that it holds, of every order. Questions are dealt by
   ranges of the n-gram's hash, so a frequent n-gram, word or history is one entry a segment and burdens no task; a bucket
   takes about ENTRIES of them. It sums what the segments saw in training and answers each with the counts, whether a text
   outside training holds the n-gram, and which one segment speaks for it.
3. With its answers a segment scores its own tokens, order by order. Where it speaks for an n-gram it adds to the sums of
   the history, if a text outside training holds that (no other can ask for its weight); where a token backs off it asks.
   Both are rows, and weights, a table by order and history, meet them in a plain join.

Counts cover every training document and every n-gram of them. Words are compared as 64-bit numbers. Null text is empty:
one end token. A null doc_id counts as empty text in the split. Rows are documents of their own, so repeated rows are
each scored; an empty table gives an empty table; with no training documents every word is unknown.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, recording, remove
from .tokens import SPACED, give_back, mix, parts, word_numbers

ORDER = 3
#: Counts up to here have a discount of their own.
DISCOUNTED = 5
ENTRIES = 1_500_000
SEGMENT = 5 << 20
PIECE = 1 << 20
START, END = np.uint64(1), np.uint64(2)
PAD = ORDER - 1
#: A bucket's number has its order above this bit.
_SHIFT = 40
_A = np.uint64(0x9E3779B97F4A7C15)


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The n-grams that go on with a word."""
    return mix(key * _A + word)


def _pads() -> list[np.uint64]:
    """For each order the key of start marks alone, which is a history and no n-gram of its own."""
    one = np.array([START])
    out = [one]
    for _ in range(1, ORDER):
        out.append(_longer(out[-1], one))
    return [k[0] for k in out]


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte: the leading bytes of sorted keys and of small counts take next to nothing."""
    planes = [(a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    return zstandard.compress(pickle.dumps(planes, 5), 1)


def _unsqueeze(raw: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(zstandard.decompress(raw)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1))
    return out


@dataclass
class Segment:
    """Pieces of texts one after another, each PAD entries of context and then its tokens. row, doc, known and train are
    of pieces; known says that doc is not null; first, that the context is start marks."""

    words: np.ndarray
    entries: np.ndarray
    lengths: np.ndarray
    row: np.ndarray
    doc: np.ndarray
    known: np.ndarray
    train: np.ndarray
    first: np.ndarray

    def pack(self) -> bytes:
        return _squeeze(self.words, self.entries, self.lengths, self.row, self.doc, self.known, self.train, self.first)

    @staticmethod
    def unpack(raw: bytes) -> Segment:
        return Segment(*_unsqueeze(raw))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 32
    for b in parts(batches, "text", SEGMENT):
        numbers, begins = word_numbers(b.column("text"), SPACED)
        n = b.num_rows
        lengths = np.diff(begins) + PAD + 1
        ends = np.cumsum(lengths)
        stream = np.full(int(ends[-1]), START, np.uint64)
        place = np.arange(len(stream)) - np.repeat(ends - lengths, lengths)
        inner = place >= PAD
        inner[ends - 1] = False
        stream[inner] = numbers
        stream[ends - 1] = END
        row, train = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "train"))
        known = b.column("doc").is_valid().to_numpy(zero_copy_only=False)
        doc = b.column("doc").fill_null(0).to_numpy(zero_copy_only=False)
        # Only a text that fills a slice alone can be longer than a piece or two.
        cuts = [0] if n > 1 else range(0, len(stream) - PAD, PIECE)
        for at in cuts:
            end = len(stream) if n > 1 else min(len(stream), at + PIECE + PAD)
            words, entries = np.unique(stream[at:end], return_inverse=True)
            entries = entries.astype(np.uint16 if len(words) <= 65536 else np.uint32)
            one = lengths if n > 1 else np.array([end - at])
            s = Segment(words, entries, one.astype(np.int64), row.astype(np.int64), doc.astype(np.int64), known, train.astype(bool), np.full(n, at == 0))
            made += 1
            yield pa.RecordBatch.from_pydict({"segment": pa.array([made], pa.int64()), "entries": pa.array([len(entries)], pa.int64()), "data": pa.array([s.pack()], pa.binary())})


class Grams:
    """The n-grams of a segment: of each of some orders the sorted keys, for each entry the place of the n-gram that ends
    there, and for each key the entry of one of its occurrences. Entries too early in a piece for an order have the place
    of another."""

    def __init__(self, s: Segment, orders: range):
        x = s.words[s.entries]
        self.piece = np.repeat(np.arange(len(s.lengths)), s.lengths)
        self.place = np.arange(len(x)) - np.repeat(np.cumsum(s.lengths) - s.lengths, s.lengths)
        self.token = self.place >= PAD
        self.keys: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        self.one: dict[int, np.ndarray] = {}
        key = x
        for order in range(1, orders[-1] + 1):
            if order > 1:
                key = np.concatenate([x[:1], _longer(key[:-1], x[1:])])
            if order not in orders:
                continue
            whole = np.flatnonzero(self.place >= order - 1)
            by = whole[np.argsort(key[whole])]
            ranked = key[by]
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            at = np.zeros(len(x), np.int64)
            at[by] = np.cumsum(new) - 1
            self.keys[order], self.at[order], self.one[order] = ranked[new], at, by[new]


def _questions(order: int, buckets: int):
    """bucket, segment, block (keys, times seen in training, whether outside it) of every segment's n-grams of an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, raw in zip(b.column("segment").to_pylist(), b.column("data"), strict=True):
                s = Segment.unpack(raw.as_py())
                g = Grams(s, range(order, order + 1))
                keys, at = g.keys[order], g.at[order]
                train, whole = s.train[g.piece].astype(bool), g.place >= order - 1
                counted = train & whole & (g.token | (s.first[g.piece].astype(bool) & (g.place == PAD - 1)))
                times = np.bincount(at[counted], minlength=len(keys)).astype(np.uint32)
                outside = np.zeros(len(keys), np.uint8)
                outside[at[whole & ~train]] = 1
                cuts = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
                for k in range(buckets):
                    if cuts[k] < cuts[k + 1]:
                        part = slice(cuts[k], cuts[k + 1])
                        block = _squeeze(keys[part], times[part], outside[part])
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([(order << _SHIFT) + k], pa.int64()), "segment": pa.array([segment], pa.int64()), "block": pa.array([block], pa.binary())})
                del s, g, keys, at, train, whole, counted, times, outside
                give_back()

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (the other columns) that stand together with one value of `by`."""
    held, value = [], None
    for b in batches:
        rest = [b.column(i) for i, name in enumerate(b.schema.names) if name != by]
        for i, v in enumerate(b.column(by).to_pylist()):
            if v != value and held:
                yield value, held
                held = []
            value = v
            held.append(tuple(c[i].as_py() for c in rest))
    if held:
        yield value, held


_ANSWER = "segment bigint, bucket bigint, block binary, r bigint, n bigint"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each question a block of 4 * count + 2 * (held outside training) + (the segment speaks for it); and (order, r, n):
    n n-grams seen r times, for r = 0 how many occurrences, for r = -1 how many n-grams."""
    pads = _pads()
    for bucket, rows in _runs(batches, "bucket"):
        order = bucket >> _SHIFT
        blocks = [_unsqueeze(raw) for _, raw in rows]
        keys, times, outside = (np.concatenate([b[i] for b in blocks]) for i in range(3))
        sizes = [len(b[0]) for b in blocks]
        del blocks
        by = np.argsort(keys, kind="stable")
        ranked = keys[by]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        first = np.flatnonzero(new)
        total = np.add.reduceat(times[by].astype(np.uint64), first)
        held = np.maximum.reduceat(outside[by], first)
        group = np.cumsum(new) - 1
        seen = times[by] > 0
        _, speaker = np.unique(group[seen], return_index=True)
        answer = np.empty(len(keys), np.uint64)
        answer[by] = (total[group] << np.uint64(2)) | (held[group].astype(np.uint64) << np.uint64(1))
        answer[by[seen][speaker]] |= np.uint64(1)
        at = 0
        for (segment, _), n in zip(rows, sizes, strict=True):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int64()), "bucket": pa.array([bucket], pa.int64()), "block": pa.array([_squeeze(answer[at : at + n])], pa.binary()), "r": pa.array([None], pa.int64()), "n": pa.array([None], pa.int64())})
            at += n
        real = total[(total > 0) & (ranked[first] != pads[order - 1])].astype(np.int64)
        r, n = np.unique(np.minimum(real, DISCOUNTED + 2), return_counts=True)
        r, n = [0, -1, *r.tolist()], [int(real.sum()), len(real), *n.tolist()]
        yield pa.RecordBatch.from_pydict({"segment": pa.array([None] * len(r), pa.int64()), "bucket": pa.array([order] * len(r), pa.int64()), "block": pa.array([None] * len(r), pa.binary()), "r": pa.array(r, pa.int64()), "n": pa.array(n, pa.int64())})
        give_back()


def discounts(n: dict[int, int], most: int = DISCOUNTED) -> list[float]:
    """What counts 1 to most, and any above, keep: most + 1 numbers of which the last is what is taken off counts above.

    Good-Turing's (r + 1) n[r + 1] / n[r] with Katz's cut, so that what all lose is what was seen once; n[r] n-grams were
    seen r times. Where an estimate isn't between 0 and r, absolute discounting by n[1] / (n[1] + 2 n[2]) stands in, as it
    does above most."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    back = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    cut = (most + 1) * n.get(most + 1, 0) / n1 if n1 else 1.0
    out = []
    for r in range(1, most + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - cut) / (1 - cut) if n.get(r) and cut < 1 else 0.0
        out.append(r * d if 0 < d < 1 else r - back)
    return [*out, back]


@dataclass
class Constants:
    """A few numbers of the whole corpus: tokens, distinct ones, what counts of each order keep, and the unknown word."""

    tokens: int
    words: int
    kept: list[list[float]]
    unknown: float

    def gain(self, order: int, c: np.ndarray) -> np.ndarray:
        *small, back = self.kept[order - 1]
        return np.where(c > DISCOUNTED, c - back, np.array([0.0, *small])[np.minimum(c, DISCOUNTED)])

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.gain(1, c) / max(self.tokens, 1), self.unknown)


_FOUND = "kind int, row bigint, doc bigint, train boolean, n_tokens bigint, n_known bigint, base double, score double, order int, key bigint, n bigint, c bigint"
_TYPES = {"kind": pa.int32(), "row": pa.int64(), "doc": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "order": pa.int32(), "key": pa.int64(), "n": pa.int64(), "c": pa.int64()}
PIECES, WEIGHED, ASKED = 0, 1, 2


def _found(kind: int, size: int, **columns) -> pa.RecordBatch:
    columns = {"kind": np.full(size, kind)} | columns
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _TYPES.items()], names=list(_TYPES))


def _scores(k: Constants):
    """Rows of three kinds from each segment with its answers: sums of each piece; of histories, what their followers keep
    (score) and have at the order below (base); and which histories' weights a text asks for, how often (n), where c is
    the history's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pads = _pads()
        for _, rows in _runs(batches, "segment"):
            s = Segment.unpack(rows[0][1])
            g = Grams(s, range(1, ORDER + 1))
            answers = {order: np.concatenate([_unsqueeze(raw)[0] for bucket, raw in rows[1:] if bucket >> _SHIFT == order]) for order in range(1, ORDER + 1)}
            count = {order: (a >> np.uint64(2)).astype(np.int64) for order, a in answers.items()}
            n = len(s.lengths)
            # How often a key's history was seen: of the occurrence at entry i it is the one that ends at i - 1.
            below = lambda order, i: count[order - 1][g.at[order - 1][i - 1]]  # noqa: B023, E731
            value = np.zeros(len(g.piece))
            open_ = np.flatnonzero(g.token)
            for order in range(ORDER, 1, -1):
                c, of = count[order][g.at[order][open_]], below(order, open_)
                hit = c > 0
                value[open_[hit]] = np.log10(k.gain(order, c[hit]) / of[hit])
                open_, of = open_[~hit], of[~hit]
                i = open_[of > 0] - 1
                size = len(g.keys[order - 1])
                pairs, times = np.unique(g.piece[i] * size + g.at[order - 1][i], return_counts=True)
                which = pairs % size
                yield _found(ASKED, len(pairs), row=s.row[pairs // size], order=np.full(len(pairs), order - 1), key=g.keys[order - 1][which].view(np.int64), n=times, c=count[order - 1][which])
            c = count[1][g.at[1]]
            value[open_] = np.log10(k.word(c[open_]))
            base = np.log10((c + 1) / (k.tokens + k.words + 1))
            add = lambda x: np.bincount(g.piece, np.where(g.token, x, 0), n)  # noqa: B023, E731
            yield _found(
                PIECES, n, row=s.row, doc=pa.array(s.doc, pa.int64(), mask=~s.known.astype(bool)), train=s.train.astype(bool), n_tokens=add(1).astype(np.int64), n_known=add(c > 0).astype(np.int64), base=add(base), score=add(value)
            )
            for order in range(2, ORDER + 1):
                mine = ((answers[order] & np.uint64(1)) == 1) & (g.keys[order] != pads[order - 1])
                i = g.one[order][mine]
                history = g.at[order - 1][i - 1]
                wanted = (answers[order - 1][history] & np.uint64(2)) > 0
                i, history = i[wanted], history[wanted]
                gain = k.gain(order, count[order][mine][wanted])
                lower = count[order - 1][g.at[order - 1][i]]
                p = k.word(lower) if order == 2 else k.gain(order - 1, lower) / below(order - 1, i)
                which, group = np.unique(history, return_inverse=True)
                yield _found(WEIGHED, len(which), order=np.full(len(which), order - 1), key=g.keys[order - 1][which].view(np.int64), score=np.bincount(group, gain, len(which)), base=np.bincount(group, p, len(which)))
            del s, g, answers, count
            give_back()

    return run


def _in_runs(df: DataFrame, by: str, then: str, tasks: int) -> DataFrame:
    """Rows dealt by a column and sorted in their partitions, so that a task holds one value's rows at a time."""
    return df.repartition(max(1, tasks), by).sortWithinPartitions(by, then)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    train = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 != 2
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc"), train.alias("train"), F.col(text).alias("text"))
    with recording() as made:
        segments = materialize(slim.mapInArrow(_segments, "segment bigint, entries bigint, data binary"), "segments")
        entries, n_segments = segments.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.count(F.lit(1))).first()
        # A segment has a few distinct words where it has many distinct pairs.
        answers = None
        for order in range(1, ORDER + 1):  # one after another, so that the questions of one order only lie on disk
            buckets = max(1, math.ceil(entries / ENTRIES / (4 if order == 1 else 1)))
            asked = segments.select("segment", "data").mapInArrow(_questions(order, buckets), "bucket bigint, segment bigint, block binary")
            answered = materialize(_in_runs(asked, "bucket", "segment", buckets).mapInArrow(_answers, _ANSWER), f"answers-{order}")
            answers = answered if answers is None else answers.unionByName(answered)
        seen: dict[int, dict[int, int]] = {order: {} for order in range(1, ORDER + 1)}
        for order, r, n in answers.filter("segment IS NULL").groupBy("bucket", "r").agg(F.sum("n")).collect():  # a few rows
            seen[order][r] = n
        tokens, words = seen[1].get(0, 0), seen[1].get(-1, 0)
        k = Constants(tokens, words, [discounts(seen[order]) for order in range(1, ORDER + 1)], 1.0)
        if tokens:
            # All words keep together what their counts keep; the unknown word has what is left.
            *small, back = k.kept[0]
            lost = sum((r - x) * seen[1].get(r, 0) for r, x in enumerate(small, 1)) + back * (words - sum(seen[1].get(r, 0) for r in range(1, DISCOUNTED + 1)))
            k.unknown = lost / tokens
        both = segments.select("segment", F.lit(-1).cast("bigint").alias("bucket"), F.col("data").alias("block")).unionByName(answers.filter("segment IS NOT NULL").select("segment", "bucket", "block"))
        before = list(made)
        found = materialize(_in_runs(both, "segment", "bucket", n_segments).mapInArrow(_scores(k), _FOUND), "scored", compression="zstd")
        remove(spark, before)
        weights = found.filter(F.col("kind") == WEIGHED).groupBy("order", "key").agg(F.sum("score").alias("keep"), F.sum("base").alias("lower"))
        weights = materialize(weights, "weights")
        bow = F.log10((1 - F.col("keep") / F.col("c")) / (1 - F.col("lower")))
        backed = found.filter(F.col("kind") == ASKED).select("row", "order", "key", "n", "c").join(weights, ["order", "key"]).groupBy("row").agg(F.sum(F.col("n") * bow).alias("score"))
        pieces = found.filter(F.col("kind") == PIECES).select("row", "doc", "train", "n_tokens", "n_known", "base", "score")
        every = pieces.unionByName(backed, allowMissingColumns=True).groupBy("row").agg(F.max("doc").alias("doc"), F.bool_and("train").alias("train"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
        out = materialize(every, "katz")
    remove(spark, made[:-1])
    return out.select(
        F.col("doc").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
