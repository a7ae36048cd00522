"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Where neither tokenizer has a token that goes on behind a word into the space after it, a text is cut before such spaces, and
each distinct piece of a block of documents is encoded and aligned once: its tokens are exploded with their places, windowed sums
of their byte lengths say where each ends, and rows of both sides that meet on document and end are cuts. Running counts of cuts
number the groups. Two tokens are linked where their byte ranges overlap: as both sides cover the text, one link ends at each
distinct end, so links are the rows met on document and end with the next token of each side, and no range is compared with
another. A document's tokens, groups and links are those of its pieces, one after the other. With other tokenizers a text is one
piece.

Python encodes (on Arrow batches), and puts the groups of a document's pieces into a digest. Documents are dealt by a hash to
blocks, and the pieces that a document is the first of its block to hold go with it to a table bucketed by block, so that
explosion, windows and grouping stay in one task and nothing exploded is shuffled; the tables go through the disk in SLICES parts.
Byte lengths come from the vocabularies, broadcast: their size is that of the tokenizers, not of the data. The number of documents
that hold a pair is counted from a document's distinct pairs. The HOT most common pairs, a bounded table, are looked up by
broadcast, and the rest by a join on the pair.

Tokens are those of a space and the text. A text that is null or empty, or that a tokenizer does not give back byte for byte
(its normalization changed it), has no tokens. A document's tokens lie in one task, so a text must fit one. Rows that agree in
doc_id (null too) and text are one document: each row is reported, and they count once. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
import math
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .common import materialize, recording, remove
from .tokens import parts

#: Where the files of the tokenizers are, and those of the sides a and b.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
PART = 1 << 20
#: Text bytes of a block of documents (the more, the rarer are new pieces), those of a block where there would be fewer blocks than
#: cores, and the most blocks of a table.
BUCKET, LEAST, BUCKETS = 5 << 20, 1 << 20, 50_000
#: Parts in which the tables of tokens go through the disk.
SLICES = 2
#: Most common pairs that are looked up by broadcast.
HOT = 1 << 16
_MANY = 1 << 32


def _byte_values() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.cache
def encoder_a(path: str):
    """encode(texts) of a byte-level vocabulary, and the bytes of each token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    value = _byte_values()
    size = max(model.get_vocab(with_added_tokens=True).values()) + 1
    table = [b""] * size
    for piece, i in model.get_vocab(with_added_tokens=False).items():
        table[i] = bytes(value[c] for c in piece)
    ranked = _ranked(path, model, table)
    if ranked is not None:

        def by_ranks(texts):
            return [ranked.encode_ordinary(t) for t in texts]

        return by_ranks, table
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)], table


#: How a byte-level vocabulary with `use_regex` cuts text before its merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(path: str, model, table: list[bytes]):
    """The same encoder by ranks, which is faster, where the file is of the plain kind: each merge makes the token of its rank."""
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    before, bpe = said.get("pre_tokenizer") or {}, said["model"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in bpe.get("merges", ())]
    made = [bpe["vocab"].get("".join(m)) for m in merges]
    plain = (
        said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not bpe.get("ignore_merges")
        and made == list(range(256, 256 + len(merges))) and all(table[:256])
    )
    if not plain:
        return None
    ranks = {b: i for i, b in enumerate(table) if b and i < 256 + len(merges)}
    return tiktoken.Encoding("by-ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder_b(path: str):
    """encode(texts) of a piece vocabulary with byte fallback, and the bytes of each token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return lambda texts: model.encode(texts, num_threads=1), table


def _tables(folder: str, file_a: str, file_b: str):
    return encoder_a(os.path.join(folder, file_a)), encoder_b(os.path.join(folder, file_b))


#: Where a text is cut: before a space that follows a word and isn't the text's end. Python's white space has all that PATTERN's has.
CUT = re.compile(r"(?<=\S)(?= [\s\S])")
#: Where no space meets white space, each is such a place, or one behind a line's end that PATTERN leaves by itself.
WIDE = re.compile(r" \s|^ | \Z")


def cut(text: str) -> list[str]:
    """Pieces of a space and the text, each without the space that it begins with."""
    return [p[1:] for p in CUT.split(" " + text)] if WIDE.search(text) else text.split(" ")


@functools.cache
def cuts_apply(folder: str, file_a: str, file_b: str) -> bool:
    """Whether both tokenizers give for a text what they give for its pieces by CUT: a never puts a word and the space behind it
    into one part before it merges, b merges by rank, has no piece that holds both, and changes nothing before it encodes."""
    try:
        import tiktoken  # noqa: F401
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    with open(os.path.join(folder, file_b), "rb") as f:
        b = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    norm = b.normalizer_spec
    plain = (
        b.trainer_spec.model_type == b.trainer_spec.BPE and b.trainer_spec.byte_fallback and not b.trainer_spec.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap and not norm.normalization_rule_tsv and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    )
    return plain and not any(re.search("[^▁]▁", p.piece) for p in b.pieces) and encoder_a(os.path.join(folder, file_a))[0].__name__ == "by_ranks"


class _Pieces(dict):
    """Numbers of a block's pieces in the order in which they come; those that came since `new` was emptied, pieces that a side
    does not give back, and the documents seen."""

    def __init__(self):
        self.new, self.bad, self.rows, self.docs = [], set(), 0, set()

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


_ENCODED = "block bigint, row int, id bigint, hash bigint, codes array<int>, sizes array<int>, n_a int, tokens array<int>"
_ENCODED_KINDS = {
    "block": pa.int64(), "row": pa.int32(), "id": pa.int64(), "hash": pa.int64(), "codes": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "n_a": pa.int32(), "tokens": pa.list_(pa.int32()),
}


def _encode(folder: str, file_a: str, file_b: str):
    """A row for each document: row (its number in the block), codes (the numbers of its pieces; none if it has no tokens), and of
    the pieces that it is the first to hold the bytes (0: not given back, no tokens) and the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = cut if cuts_apply(folder, file_a, file_b) else lambda text: [text]
        sides = _tables(folder, file_a, file_b)
        lengths = [np.array([len(x) for x in table]) for _, table in sides]
        blocks: dict[int, _Pieces] = {}  # one, unless several meet in a task
        for batch in parts(batches, "text", PART):
            held = []
            for block, id_, hash_, text in zip(*[batch.column(c).to_pylist() for c in ("block", "id", "hash", "text")], strict=True):
                pieces = blocks.setdefault(block, _Pieces())
                if text and (id_, hash_) not in pieces.docs:
                    pieces.docs.add((id_, hash_))
                    held.append((block, pieces, id_, hash_, list(map(pieces.__getitem__, cuts(text))), pieces.new))
                    pieces.new = []
            new = [p for *_, own in held for p in own]
            whole = "".join([" " + p for p in new]).encode()
            sizes = np.array([len(p.encode()) + 1 for p in new], np.int64)
            stops = np.cumsum(sizes)
            encoded = _side_a(sides[0][0], new, cuts is cut), sides[1][0](new)
            tokens = [np.fromiter(itertools.chain.from_iterable(x), np.int32) for x in encoded]
            ends = [np.cumsum(size[t]) for size, t in zip(lengths, tokens, strict=True)]
            sound = all(b"".join(map(table.__getitem__, t.tolist())) == whole for (_, table), t in zip(sides, tokens, strict=True)) and all(np.isin(stops, e).all() for e in ends)
            if sound:
                at = [np.concatenate([[0], np.searchsorted(e, stops, "right")]) for e in ends]
            else:
                encoded = [[x if b"".join(map(table.__getitem__, x)) == b" " + p.encode() else None for p, x in zip(new, encode([f"{lead}{p}" for p in new]), strict=True)] for (encode, table), lead in zip(sides, (" ", ""), strict=True)]
                given = [x is not None and y is not None for x, y in zip(*encoded, strict=True)]
                for _, pieces, _, _, _, own in held:
                    pieces.bad.update(pieces[p] for p, g in zip(own, given, strict=False) if not g)
                    del given[: len(own)]
                good = [x is not None and y is not None for x, y in zip(*encoded, strict=True)]
                sizes = np.where(good, sizes, 0)
                encoded = [[x if g else [] for x, g in zip(e, good, strict=True)] for e in encoded]
                tokens = [np.fromiter(itertools.chain.from_iterable(e), np.int32) for e in encoded]
                at = [np.concatenate([[0], np.cumsum([len(x) for x in e], dtype=np.int64)]) for e in encoded]
            out = {k: [] for k in _ENCODED_KINDS}
            low = 0
            for block, pieces, id_, hash_, codes, own in held:
                high = low + len(own)
                a, b = (t[w[low] : w[high]] for t, w in zip(tokens, at, strict=True))
                if pieces.bad and not pieces.bad.isdisjoint(codes):
                    codes = []
                for k, v in zip(out, (block, pieces.rows, id_, hash_, codes, sizes[low:high].astype(np.int32), len(a), np.concatenate([a, b])), strict=True):
                    out[k].append(v)
                pieces.rows += 1
                low = high
            yield pa.RecordBatch.from_pydict({k: pa.array(v, _ENCODED_KINDS[k]) for k, v in out.items()})

    return run


def _side_a(encode, pieces: list[str], joined: bool) -> list[list[int]]:
    """Tokens of pieces in their order: of those that may stand one behind the other in one go."""
    if not joined:
        return encode([" " + p for p in pieces])
    runs, run = [], []
    for p in pieces:
        run.append(p)
        if p[-1:].isspace():  # it and white space of the next could be one part
            runs.append(run)
            run = []
    return encode([" " + " ".join(r) for r in [*runs, run] if r])


def vocabulary(spark: SparkSession, folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """side (0 or 1), token, length in bytes."""
    rows = [(side, i, len(b)) for side, (_, table) in enumerate(_tables(folder, file_a, file_b)) for i, b in enumerate(table)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["side", "token", "length"]).astype("int32"))


def met(tokens: DataFrame, lengths: DataFrame) -> DataFrame:
    """block, row, and one row for each distinct end of a token: end, ends (1: of a, 2: of b, 3: of both, a cut), a and b (the tokens
    that reach up to it: a link).

    tokens has block, row, n_a and tokens (those of a, then those of b)."""
    each = tokens.select("block", "row", "n_a", F.posexplode("tokens").alias("pos", "token")).withColumn("side", (F.col("pos") >= F.col("n_a")).cast("int"))
    each = each.join(F.broadcast(lengths), ["side", "token"])
    ends = each.select("block", "row", "side", "token", F.sum("length").over(Window.partitionBy("block", "row", "side").orderBy("pos")).cast("int").alias("end"))
    back = Window.partitionBy("block", "row").orderBy(F.col("end").desc(), "side")
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    token = lambda side: F.last(F.when(F.col("side") == side, F.col("token")), ignorenulls=True).over(upto)
    both = ends.select("block", "row", "end", "side", token(0).alias("a"), token(1).alias("b"), F.lag("end").over(back).alias("before"), F.lead("end").over(back).alias("after"))
    # Of two rows that meet, the second stands for both.
    both = both.filter(F.col("after").isNull() | (F.col("after") != F.col("end")))
    return both.select("block", "row", "end", F.when(F.col("before") == F.col("end"), 3).otherwise(F.col("side") + 1).cast("byte").alias("ends"), "a", "b")


def groups_texts(ends: np.ndarray, a: np.ndarray, b: np.ndarray, last: np.ndarray) -> list[str]:
    """The groups of each piece, `a1,a2|b1;a3|b2,b3`, from a block's rows of met() in order; last: where a piece's last row is."""
    is_cut = ends == 3

    def joined(values: pa.Array, at: np.ndarray, by: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]), pa.int32()), values), by)

    own = lambda tokens, bit: joined(pa.array(tokens[(ends & bit) > 0]).cast(pa.string()), np.cumsum((ends & bit) > 0)[is_cut], ",")
    groups = pc.binary_join_element_wise(own(a, 1), own(b, 2), "|")
    return joined(groups, np.cumsum(is_cut)[last], ";").to_pylist()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins, with the end of the last."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _summed(met_rows: pa.Table, docs: pa.Table) -> pa.Table:
    """One block: its documents with tokens, from the met rows of its pieces."""
    docs = docs.sort_by("of_row")
    sizes, size_at = _lists(docs.column("sizes"))
    row, end, ends, a, b = (met_rows.column(c).to_numpy() for c in ("row", "end", "ends", "a", "b"))
    # Bytes of all new pieces in the order of their numbers; a document's rows begin where the pieces of those before it end.
    stops = np.cumsum(sizes, dtype=np.int64)
    start = np.concatenate([[0], stops])[size_at[:-1]]
    first = np.zeros(int(docs.column("of_row").to_numpy().max(initial=-1)) + 1, np.int64)
    first[docs.column("of_row").to_numpy()] = start
    end = first[row] + end
    order = np.argsort(end)
    end, ends, a, b = end[order], ends[order], a[order], b[order]
    del row, order
    piece = np.searchsorted(stops, end)  # the first that reaches so far; one without tokens reaches no further than that before
    texts: list[str | None] = [None] * len(sizes)
    for i, text in zip(piece[np.append(piece[1:] != piece[:-1], True)].tolist() if len(piece) else [], groups_texts(ends, a, b, end == stops[piece]), strict=True):
        texts[i] = text
    n_a, n_b, n_groups, n_links = (np.bincount(piece[which], minlength=len(sizes)) for which in ((ends & 1) > 0, ends >= 2, ends == 3, ends > 0))
    link_at = np.concatenate([[0], np.cumsum(n_links)])
    links = a.astype(np.int64) * _MANY + b
    del end, ends, a, b, piece
    codes, code_at = _lists(docs.column("codes"))
    got = {k: [] for k in ("id", "hash", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
    for id_, hash_, low, high in zip(docs.column("id").to_pylist(), docs.column("hash").to_pylist(), code_at[:-1].tolist(), code_at[1:].tolist(), strict=True):
        if low == high:
            continue
        own = codes[low:high]
        n = n_links[own]
        where = np.repeat(link_at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, times = np.unique(links[where], return_counts=True)
        digested = hashlib.sha256(";".join(map(texts.__getitem__, own.tolist())).encode()).hexdigest()
        values = (id_, hash_, int(n_a[own].sum()), int(n_b[own].sum()), int(n_groups[own].sum()), len(where), digested, pairs, times.astype(np.int32))
        for k, v in zip(got, values, strict=True):
            got[k].append(v)
    kinds = {"id": pa.int64(), "hash": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
    out = pa.table({k: pa.array(got.pop(k), kind) for k, kind in kinds.items()})
    pa.default_memory_pool().release_unused()
    return out


_SUMMED = "id bigint, hash bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def _slim(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))


def aligned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """id, hash, n_a, n_b, n_groups, n_links, groups_sha256, and pairs (a * 2 ** 32 + b) with times, how often each is linked, of each
    document with tokens. Written."""
    spark = docs.sparkSession
    slim = _slim(docs, text, doc_id)
    lengths = vocabulary(spark, folder, file_a, file_b)
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(min(BUCKETS, max(1, -(-total // (BUCKET * SLICES)), min(spark.sparkContext.defaultParallelism, total // (LEAST * SLICES)))))
    dealt = slim.withColumn("__at", F.pmod(F.xxhash64("id", "hash"), F.lit(SLICES * buckets)))
    even = F.broadcast(_even(spark, buckets))
    done = None
    for k in range(SLICES):
        some = dealt.filter(F.col("__at") % SLICES == k).withColumn("at", F.floor(F.col("__at") / SLICES)).join(even, "at", "left")
        some = some.select(F.coalesce("block", "at").alias("block"), "id", "hash", "text").repartition(buckets, "block")
        with _bucketed(some.mapInArrow(_encode(folder, file_a, file_b), _ENCODED), buckets) as tokens:
            held = tokens.select(F.col("block").alias("of_block"), F.col("row").alias("of_row"), "id", "hash", "codes", "sizes")
            both = met(tokens, lengths).groupBy("block").cogroup(held.groupBy("of_block"))
            part = materialize(both.applyInArrow(_summed, _SUMMED), "aligned", "zstd")
        done = part if done is None else done.unionByName(part)
    return done


def _even(spark: SparkSession, buckets: int) -> DataFrame:
    """at (0 and on) and block: a number that Spark's hash puts into that of so many buckets, so that each gets one block. So many
    numbers are tried that none is left out but by a chance of 1 in 10 ** 8; it would then share a bucket."""
    tried = spark.range(int(buckets * (math.log(buckets) + 20)))
    return tried.groupBy(F.pmod(F.hash("id"), F.lit(buckets)).cast("long").alias("at")).agg(F.min("id").alias("block"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs (documents of aligned() that link it) and best: whether no pair of the same a has more. Written."""
    with recording() as made:
        counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
        most = counts.groupBy(_a(F.col("pair")).alias("a")).agg(F.max("docs").alias("most"))  # a row for each token at most
        known = materialize(counts.join(F.broadcast(most), _a(F.col("pair")) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "known")
    remove(rows.sparkSession, made[:-1])
    return known


def _a(pair: Column) -> Column:
    return F.shiftright(pair, 32)


def scores(rows: DataFrame, known: DataFrame) -> DataFrame:
    """id, hash, n_best and count_sum of each document of aligned()."""
    hot = materialize(known.orderBy(F.col("docs").desc(), "pair").limit(HOT), "hot")
    each = rows.select("id", "hash", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("id", "hash", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    found = each.join(F.broadcast(hot), "pair").unionByName(each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(known, "pair"))
    return found.groupBy("id", "hash").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row; zeros and '' without tokens."""
    rows = aligned(docs, text, doc_id, folder, file_a, file_b)
    sums = materialize(scores(rows, pair_counts(rows)), "scores")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    known = rows.drop("pairs", "times").join(sums.withColumnsRenamed({"id": "of_id", "hash": "of_hash"}), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")))
    known = known.select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), *numbers, "groups_sha256")
    every = _slim(docs, text, doc_id).select("id", "hash").join(known, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    return every.select(F.col("id").alias("doc_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


class _bucketed:
    """A table of rows bucketed by block in the shared folder, while the context lasts."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.rows, self.buckets, self.name = rows, buckets, f"tokens_{uuid.uuid4().hex}"

    def __enter__(self) -> DataFrame:
        spark = self.rows.sparkSession
        self.path = f"{scratch.shared_dir(spark)}/{self.name}"
        writer = self.rows.write.format("parquet").option("compression", "zstd").option("path", self.path)
        writer.bucketBy(self.buckets, "block").sortBy("block", "row").saveAsTable(self.name)
        return spark.table(self.name)

    def __exit__(self, *_):
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        scratch.delete(spark, self.path)
