from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate as D

from . import brute
from .corpora import clashing, docs, random_texts

ITEM = "item_id string, text string"


def _bench(spark, items):
    return spark.createDataFrame(items, ITEM)


def _corpus(seed):
    r = random.Random(seed)
    pool = ["alpha", "beta", "gamma", "delta", "ü"]
    some = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [("a", some(14)), ("b", "two words"), ("b", some(11)), ("c", None), (None, "single"), ("d", "?!"), ("z", some(10)), ("é", "Beta, GAMMA delta")]
    texts = [None, "", "two  words two words", "A single thing", f"{some(5)} {items[0][1].upper()} {some(5)}", f"{items[2][1]}!", "x " * 30_000 + items[6][1], *random_texts(seed, 40, words=4)]
    return texts, items


@pytest.mark.parametrize("block", [D.BLOCK, 60])
def test_digest_is_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    texts, items = _corpus(8)
    got = {r["doc_id"]: r for r in D.digest(D.search(D.build_index(docs(spark, texts)), _bench(spark, items))).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute.contamination(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [item, item.replace("five", "five extra"), item.replace("five six", "six five"), "ten nine eight seven six five four three two one"]
    rows = {r["doc_id"]: r for r in D.search(D.build_index(docs(spark, texts)), _bench(spark, [("i", item)])).collect()}
    assert [len(rows[i]["items"]) for i in range(4)] == [1, 0, 0, 0]
    assert [len(rows[i]["near_items"]) for i in range(4)][1:] == [1, 1, 0]


def test_matches_stay_in_their_document(spark):
    item = "one two three four five six seven eight nine ten"
    df = docs(spark, ["one two three four five", "six seven eight nine ten"]).coalesce(1)
    assert not any(r["contaminated"] for r in D.digest(D.search(D.build_index(df), _bench(spark, [("i", item)]))).collect())


def test_clean_rows_and_columns_stay(spark):
    item = "one two three four five six seven eight nine ten"
    df = clashing(docs(spark, [(1, f"so {item}"), (1, "clean"), (1, "clean"), (None, item), (None, None), (2, "")]))
    out = D.decontaminate(df, _bench(spark, [("i", item)]))
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, ""), (1, "clean"), (1, "clean"), (2, "")]


def test_empty_tables(spark):
    df, none = docs(spark, ["a b"]), _bench(spark, [])
    assert [r["contaminated"] for r in D.digest(D.search(D.build_index(df), none)).collect()] == [False]
    assert D.digest(D.search(D.build_index(df.filter(F.lit(False))), none)).collect() == []
    assert D.decontaminate(df, none).count() == 1
