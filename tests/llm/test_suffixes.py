from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import suffixes

from . import brute
from .corpora import clashing, docs, random_texts


def _texts(seed: int) -> list[str | None]:
    r = random.Random(seed)
    out: list[str | None] = [None, "", "a", "short é", "z" * 90, "ab" * 60, "é" * 40]
    passage = "".join(r.choice("abcdefgh é") for _ in range(70))
    for _ in range(30):
        t = "".join(r.choice("abcd") for _ in range(r.randint(0, 90)))
        at = r.randint(0, len(t))
        out.append(t[:at] + passage[r.randint(0, 20) :][: r.randint(10, 70)] + t[at:])
    return out + random_texts(seed, 20, words=4) + [out[-1], out[8]]


@pytest.mark.parametrize(("length", "gram", "most"), [(24, 8, 1 << 16), (24, 8, 1), (33, 4, 3)])
def test_removed_bytes_are_brute_force(spark, length, gram, most):
    texts = _texts(length + most)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digest(docs(spark, texts), length, gram, most).collect()}
    assert got == dict(enumerate(brute.removed(texts, length)))


def test_column_wise_sort_finds_repeats(spark):
    """repeated_starts alone, with one class of random pieces around a common anchor."""
    import numpy as np

    r = random.Random(3)
    length, gram = 12, 4
    pieces = []
    for _ in range(60):
        before = "".join(r.choice("ab") for _ in range(r.randint(0, length - gram)))
        after = "".join(r.choice("ab") for _ in range(length - len(before) - gram + r.randint(0, len(before))))
        pieces.append((before.encode() + b"XXXX" + after.encode(), len(before)))
    data = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in pieces])])
    found = suffixes.repeated_starts(np.zeros(len(pieces), np.int64), np.array([k for _, k in pieces]), data, offsets, length, gram)
    for i, (p, left) in enumerate(pieces):
        for start in range(len(p) - length + 1):
            column = start - left + length - gram
            if column > length - gram:
                continue
            want = any(q[left2 - left + start :][:length] == p[start : start + length] for j, (q, left2) in enumerate(pieces) if j != i and left2 - left + start >= 0)
            assert found[column, i] == want


def test_production_length(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    texts = [text(100) + " " + passage + " " + text(90), text(10) + " " + passage, text(200), passage[:399], "x" * 20_000, text(9000)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digest(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute.removed(texts, suffixes.LENGTH)))
    assert got[0][1] >= len(passage) and got[2][1] == 0


def test_rows_that_agree_and_clashing_columns(spark):
    t = "abcdefgh" * 10 + "some more of it here"
    df = clashing(docs(spark, [(1, t), (1, t), (None, t), (None, None), (2, "other")]))
    got = suffixes.digest(df, 24, 8).collect()
    assert len(got) == 5
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["n_bytes"] > 20)


def test_kept_text(spark):
    df = docs(spark, ["one two three four five six|first", "one two three four five six|second"])
    got = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(df, length=20).collect()}
    assert got == {0: "first", 1: "second"}


def test_empty_table(spark):
    df = docs(spark, ["x"]).filter(F.lit(False))
    assert suffixes.digest(df).collect() == []


def test_query_over_whole_table(spark, sf):
    from spanloom.llm.queries import op1_suffix_dedup

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute.removed([r["text"] for r in rows], 400), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op1_suffix_dedup(spark, sf).collect()}
    assert got == want
    assert hashlib.sha256(b"").hexdigest() in {x[3] for x in got.values()}
