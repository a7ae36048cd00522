from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing

from . import brute
from .corpora import clashing, docs


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1000, "b": 10, "c": 1, "d": 5000},
    {"Z": 7, "a": 9, "é": 100, "𝒳": 3, "￮": 8, None: 40},
    {"a": 0, "b": 50},
    {"one": 12},
    {None: 3},
    {"a": 0},
])
def test_targets_fill_by_weight(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = brute.targets(sizes) if sum(sizes.values()) else {k: 0.0 for k in sizes}
    assert got == pytest.approx(want)


def test_taken_words_come_near_targets(spark):
    r = random.Random(5)
    texts = [" ".join(["w"] * r.choice([0, 1, 5, 30, 200])) for _ in range(3000)]
    sources = [r.choice(["hot"] * 8 + ["b", "c", None]) for _ in texts]
    rows = mixing.digest(docs(spark, texts, sources)).collect()
    assert len(rows) == len(texts)
    size = {}
    for i, t in enumerate(texts):
        size[sources[i]] = size.get(sources[i], 0) + len(t.split())
    want = brute.targets(size)
    for s in size:
        own = [x for x in rows if sources[x["doc_id"]] == s]
        assert all(x["source_size"] == size[s] and x["target"] == pytest.approx(want[s]) for x in own)
        assert sum(x["taken"] for x in own) == pytest.approx(want[s], rel=0.1)
    assert all(x["taken"] in (0, x["size"], 2 * x["size"]) for x in rows)


def test_reruns_agree_whatever_the_partitions(spark):
    df = docs(spark, [f"{'w ' * (i % 17)}" for i in range(500)], ["a" if i % 3 else "b" for i in range(500)])
    once, again = (sorted(map(tuple, mixing.digest(df.repartition(n)).collect())) for n in (1, 7))
    assert once == again


def test_corpus_holds_each_row_as_often_as_taken(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b c"), (2, None), (None, "x y z"), (None, "x y z"), (3, "long " * 3000), *[(i, "some more words here") for i in range(10, 60)]]
    df = clashing(docs(spark, rows, ["s" if i % 2 else None for i in range(len(rows))]))
    counted = sum(r["copies"] for r in mixing.copies(df).collect())
    out = mixing.mix(df)
    assert [c for c in out.columns if c != "copy"] == [c for c in df.columns if c != "copy"]
    got = out.collect()
    assert len(got) == counted
    assert {r["copy"] for r in got} <= {1, 2}


def test_equal_rows_of_one_source_at_a_rate_below_one(spark):
    """At a rate under a half one of two equal rows is taken or none, so no key has two taken rows."""
    rows, sources = [(i // 2, f"{i // 2} some words") for i in range(40)], ["b"] * 40
    for source, n in {"a": 19, "c": 13, "d": 19, "e": 7, "f": 13}.items():
        rows += [(100 + len(rows) + i, "four words of text") for i in range(n)]
        sources += [source] * n
    df = docs(spark, rows, sources)
    want = {}
    for r in mixing.copies(df).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    assert {want[i] for i in range(20)} == {0, 1}
    got = {}
    for r in mixing.mix(df).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table_and_empty_texts(spark):
    df = docs(spark, ["", None])
    assert [r["taken"] for r in mixing.digest(df).collect()] == [0, 0]
    assert mixing.mix(df).collect() == []
    assert mixing.digest(df.filter(F.lit(False))).collect() == []
    assert mixing.mix(df.filter(F.lit(False))).collect() == []
