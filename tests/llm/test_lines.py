from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import lines

from . import brute
from .corpora import clashing, docs


def _texts(seed: int, n: int) -> list[str | None]:
    """Lines of zero to seven words from few, so short and long runs repeat."""
    r = random.Random(seed)
    pool = ["a", "b c", "d", "e f g", "one two three four five", "six seven eight nine ten eleven", "", "  ", "a b c d", "ü", "x\r"]
    out: list[str | None] = [None, "", "\n", "\n\n", " "]
    for _ in range(n):
        out.append(out[-1] if r.random() < 0.1 else "\n".join(r.choice(pool) for _ in range(r.randint(0, 14))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_later_copies_go(spark, seed):
    texts = _texts(seed, 25)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(None, "a\nb c\nd\ne f g"), (None, "new line of six plain words"), (3, "a\nb c"), (ids[-1], texts[-1])]
    df = docs(spark, rows)
    hashes = {tuple(r)[:2]: r[2] for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    want = brute.line_dedup(rows, lines.MIN_WORDS, [hashes[x] for x in rows])
    got = lines.line_dedup(df.withColumn("n", F.monotonically_increasing_id()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(zip([i for i, _ in rows], want, strict=True), key=key)


def test_long_passage_across_documents(spark):
    passage = "\n".join(f"line {i} of a passage that stands in two places" for i in range(8))
    df = docs(spark, [f"first text\n{passage}\nits own end", f"another start\n{passage}\nanother end here"])
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(df).collect()}
    assert got[0] == f"first text\n{passage}\nits own end"
    assert got[1] == "another start\nanother end here"


def test_short_lines_count_only_as_runs(spark):
    df = docs(spark, ["yes\nno\nmaybe so", "yes\nno\nother", "yes\nno\nmaybe so\nyes\nno\nmaybe so", "yes", "no no"])
    assert [r["text"] for r in lines.line_dedup(df, min_words=4).orderBy("doc_id").collect()] == ["yes\nno\nmaybe so", "yes\nno\nother", "", "yes", "no no"]


def test_columns_stay(spark):
    df = clashing(docs(spark, ["same words in every line here", "same words in every line here", None]))
    out = lines.line_dedup(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["same words in every line here", "", None]
    assert out.filter("hash <> 'x-hash' OR `__lines` <> 'x-__lines'").count() == 0


def test_empty_table_and_no_repeats(spark):
    df = docs(spark, ["one line of five words", "b"])
    assert lines.line_dedup(df.filter(F.lit(False))).collect() == []
    assert lines.digest(df.filter(F.lit(False))).collect() == []
    assert [r["n_removed"] for r in lines.digest(df).collect()] == [0, 0]
