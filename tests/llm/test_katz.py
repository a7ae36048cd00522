from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.llm import katz

from . import brute
from .corpora import clashing, docs, random_texts

ODD = [None, "", "  ", "Word", "word", "é É", "x\x00y", "one " * 3000, "never seen before"]


def _check(rows, pairs):
    model = brute.Katz(pairs)
    left = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"], r["base_score"], r["score"]) for r in rows))
    right = []
    for key, t in pairs:
        n, known, base, score = model.score(t)
        right.append((key is None, key or 0, n, known, not brute.trained(key), model.n, base, score))
    right.sort()
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a[:6] == b[:6]
        assert a[6:] == pytest.approx(b[6:], rel=1e-9, abs=1e-9)
    return model


@pytest.mark.parametrize("entries", [katz.ENTRIES, 40])
def test_scores_are_brute_force(spark, entries, monkeypatch):
    monkeypatch.setattr(katz, "ENTRIES", entries)
    pairs = list(enumerate(ODD + random_texts(12, 60, words=8, most=40))) + [(None, "alpha beta"), (5, "alpha beta gamma"), (5, "alpha beta gamma")]
    _check(katz.score(clashing(docs(spark, pairs))).collect(), pairs)


def test_long_texts_are_cut(spark, monkeypatch):
    """Pieces of a text begin with the words before them, so cuts change nothing."""
    import pickle

    from pyspark import cloudpickle

    monkeypatch.setattr(katz, "SEGMENT", 50)
    monkeypatch.setattr(katz, "PIECE", 7)
    cloudpickle.register_pickle_by_value(katz)  # so that tasks see these bounds
    try:
        pairs = list(enumerate(random_texts(9, 30, words=8, most=60)))
        _check(katz.score(docs(spark, pairs)).collect(), pairs)
    finally:
        cloudpickle.unregister_pickle_by_value(katz)


def _corpus():
    import random

    r = random.Random(2)
    pool = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(r.choices(pool, weight, k=r.randint(0, 60)))) for i in range(150)]


def test_many_words(spark, monkeypatch):
    """Counts of every size, so that Good-Turing discounts hold."""
    monkeypatch.setattr(katz, "ENTRIES", 500)
    pairs = _corpus()
    model = _check(katz.score(docs(spark, pairs)).collect(), pairs)
    assert 0 < model.keeps[1](1) < 1
    words = [*model.c, "unknown"]
    for h in [("<s>", "<s>"), ("<s>", "w0"), ("w0", "w1"), ("w7", "w0"), ("w299", "w299"), ("unknown", "w0"), ("w0", "unknown")]:
        assert sum(model.p(h, w) for w in words) == pytest.approx(1)


def test_only_held_out_documents(spark):
    ids = [i for i in range(60) if not brute.trained(i)][:5]
    _check(katz.score(docs(spark, [(i, "some words") for i in ids])).collect(), [(i, "some words") for i in ids])


def test_empty_table(spark):
    assert katz.score(docs(spark, ["x"]).filter(F.lit(False))).collect() == []


def test_query_over_whole_table(spark, sf):
    from spanloom.llm.queries import op8_katz_scores

    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    _check(op8_katz_scores(spark, sf).collect(), pairs)
