from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from spanloom.llm import substrings

from .corpora import clashing, docs, random_texts


def brute(rows, window):
    """(n_words, removed word numbers, kept words) of each (doc_id, text), null ids last."""
    order = lambda i: (i is None, i or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first: dict[tuple, tuple] = {}
    for (i, _), ws in zip(rows, words, strict=True):
        for p in range(len(ws) - window + 1):
            w = tuple(ws[p : p + window])
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        gone = {p + k for p in range(len(ws) - window + 1) if first[tuple(ws[p : p + window])] < order(i) for k in range(window)}
        out.append((len(ws), gone, [w for p, w in enumerate(ws) if p not in gone]))
    return out


def check(spark, rows, window=substrings.WINDOW, gram=substrings.GRAM):
    d = docs(spark, rows)
    want = sorted((str(i), n, len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (i, _), (n, gone, kept) in zip(rows, brute(rows, window), strict=True))
    got = substrings.digest(d, window) if gram == substrings.GRAM else substrings._with_spans(d, "text", "doc_id", window).select("id", "text", "spans").mapInArrow(substrings._digest, "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == want
    return want


def test_rolling_hashes_agree_with_the_polynomial():
    x = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    base = substrings._BASES[1]
    want = [sum(int(x[i + k]) * base**k for k in range(7)) % 2**64 for i in range(294)]
    assert substrings.rabin_karp(x, 7, base).tolist() == substrings.mix(np.array(want, np.uint64)).tolist()


def test_least_of_each_range():
    x = np.random.default_rng(2).integers(0, 50, 200, dtype=np.uint64)
    for width in (1, 2, 3, 41):
        assert substrings._least(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_random_texts(spark):
    texts = random_texts(5, 60, words=3, most=140)
    want = check(spark, list(enumerate(texts)), window=12)
    assert any(r[2] for r in want)


def test_shared_passages_and_copies(spark):
    r = random.Random(3)
    fresh = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, short = fresh(70), fresh(49)
    rows = [(9, fresh(30) + " " + passage + "\n" + fresh(20)), (3, passage), (4, fresh(5) + "\t" + passage + " " + fresh(3) + " " + passage), (5, short), (6, short), (3, passage + " extra"), (None, passage), (None, fresh(60))]
    rows += [(7, fresh(4000) + " " + passage + " " + fresh(4000)), (8, "Case " + passage.upper())]
    # Within a document a passage stands twice, and part of it in an earlier one.
    twice = fresh(75)
    rows += [(20, fresh(9) + " " + " ".join(twice.split()[10:65]) + " " + fresh(9)), (21, f"{twice} {fresh(8)} {twice}"), (22, twice)]
    want = {(k, n): removed for k, n, removed, *_ in check(spark, rows)}
    assert want["4", 148] == 140 and want["9", 120] == 70 and want["None", 70] == 70 and want["3", 70] == 0 and want["6", 49] == 0 and want["8", 71] == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STEP", 16)
    batch = docs(spark, [(i, t) for i, t in enumerate(random_texts(8, 30, words=2, most=90))])
    rows = batch.selectExpr("doc_id id", "xxhash64(coalesce(text, '')) hash", "text").toArrow().to_batches()
    small = [x for b in substrings._anchors(12, 4)(iter(rows)) for x in b.to_pylist()]
    monkeypatch.setattr(substrings, "STEP", 1 << 18)
    whole = [x for b in substrings._anchors(12, 4)(iter(rows)) for x in b.to_pylist()]
    starts = lambda runs: {(x["id"], p, x["gram"]) for x in runs for p in range(x["first"], x["last"] + 1)}
    assert starts(small) == starts(whole) and len(small) > len(whole)


def test_nulls_empty_repeats_and_extra_columns(spark):
    long = " ".join(f"x{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (4, long), (5, long + " tail"), (None, None), (6, "one word \x00 nul")]
    check(spark, rows)
    d = clashing(docs(spark, rows))
    out = substrings.substring_dedup(d)
    assert out.columns == d.columns
    texts = sorted((str(r["doc_id"]), r["text"]) for r in out.collect())
    assert texts == sorted([("1", None), ("2", ""), ("3", " \n\t"), ("4", long), ("4", long), ("5", "tail"), ("None", None), ("6", "one word \x00 nul")])


def test_empty_table(spark):
    d = docs(spark, [(1, "a")]).filter("false")
    assert substrings.digest(d).count() == 0 and substrings.substring_dedup(d).count() == 0
