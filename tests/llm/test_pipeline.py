from __future__ import annotations

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F

from spanloom.llm import lines, mixing, quality

from . import brute
from .corpora import docs


def _prose(i: int, n: int = 60) -> str:
    return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 9973}" for k in range(n))


def _tables(spark, tmp_path, rows):
    sf = f"file://{tmp_path}"
    docs(spark, [(r[0], r[1]) for r in rows], [r[2] for r in rows]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([("q1", _prose(900, 15)), ("q2", None)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages_against_brute_force(spark, tmp_path):
    passage = "\n".join(f"passage line {i} that stands in more than one text" for i in range(6))
    texts = {
        **{i: _prose(i) for i in range(10)},
        20: _prose(3), 21: _prose(4).upper(), 22: f"{_prose(5)} ",  # copies, the first by its lines, the others by their words
        30: f"{_prose(31)}\n{passage}\n{_prose(32)}", 31: f"{_prose(33)}\n{passage}\n{_prose(34)}",
        40: f"{_prose(41, 30)} {_prose(900, 15)} {_prose(42, 30)}",  # contaminated
        50: "spam " * 300, 51: "too short", 52: None, 53: "", 54: "### $$$ %%% " * 50,
    }
    rows = [(k, t, "a" if k % 2 else None) for k, t in texts.items()]
    sf = _tables(spark, tmp_path, rows)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    # The quality model's verdicts have their own test; what follows is worked out from what it kept.
    start = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in quality.quality_filter(start).collect()}
    assert set(range(10)) <= kept.keys() and not kept.keys() & {50, 51, 52, 53, 54}
    ids = sorted(kept)
    hashes = {r[0]: r[1] for r in start.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    left = dict(zip(ids, brute.line_dedup([(i, kept[i]) for i in ids], lines.MIN_WORDS, [hashes[i] for i in ids]), strict=True))
    roots = brute.linked([brute.fingerprint(left[i]) for i in ids])
    unique = {i: left[i] for k, i in enumerate(ids) if roots[k] == k}
    clean = {i: t for i, t in unique.items() if not brute.contamination(t, [("q1", _prose(900, 15))])[1]}
    taken = {r["doc_id"]: r["copies"] for r in mixing.copies(docs(spark, list(clean.items()), ["a" if i % 2 else None for i in clean])).collect()}
    want = sorted((i, t, c) for i, t in clean.items() for c in range(1, taken[i] + 1))

    out = corpus_pipeline.run(spark, sf)
    assert [c for c in out.columns if c != "copy"] == columns
    assert sorted((r["doc_id"], r["text"], r["copy"]) for r in out.collect()) == want
    assert 40 not in clean and not {21, 22} & unique.keys() and not clean.get(20)


def test_each_stage_returns_documents(spark, tmp_path):
    rows = [(i, _prose(i), "web") for i in range(6)] + [(None, None, None)]
    sf = _tables(spark, tmp_path, rows)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{sf}/out-{k}")
        now = spark.read.parquet(f"{sf}/out-{k}")
    assert now.count() >= 6


def test_empty_documents(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(1, None, None)])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_entry_names_every_operator(spark):
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
