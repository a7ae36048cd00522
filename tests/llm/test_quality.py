from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality

from . import brute
from .corpora import clashing, docs, random_texts

ODD = [None, "", " \t\n", "word", "a b c d e f g h " * 5, "One two.\n\nOne two.\nthree\r\nthree", "#*$%&|<> é! Ω ÀÉ\x1c\x85 x", "x" * 5000, "la " * 4000, "a\x0bb\x0cc\x00d"]


def test_features_are_brute_force(spark):
    texts = ODD + random_texts(1, 60, words=3, most=80) + random_texts(2, 40)
    got = quality.features(docs(spark, texts)).select("doc_id", *quality.FEATURES).collect()
    assert len(got) == len(texts)
    for row in got:
        want = brute.quality(texts[row["doc_id"]])
        assert {k: row[k] for k in quality.FEATURES} == want, texts[row["doc_id"]]


def _em(counts: dict[int, int]) -> dict[int, float]:
    k = len(quality.RULES)
    votes = {p: [p // 3 ** (k - 1 - j) % 3 - 1 for j in range(k)] for p in counts}
    alarm = [[a / (a + b)] * k for a, b in quality.PRIOR_VOTES]
    good = quality.PRIOR_GOOD

    def posterior(v):
        odds = math.log(good / (1 - good))
        for j, x in enumerate(v):
            if x:
                odds += math.log(alarm[0][j] / alarm[1][j]) if x < 0 else math.log((1 - alarm[0][j]) / (1 - alarm[1][j]))
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ROUNDS):
        p = {x: posterior(v) for x, v in votes.items()}
        mine = [{x: counts[x] * p[x] for x in p}, {x: counts[x] * (1 - p[x]) for x in p}]
        cast = lambda y, j, s: quality.PRIOR_VOTES[y][s > 0] + sum(w for x, w in mine[y].items() if votes[x][j] == s)  # noqa: B023, E731
        alarm = [[cast(y, j, -1) / (cast(y, j, -1) + cast(y, j, 1)) for j in range(k)] for y in (0, 1)]
        good = (quality.PRIOR_GOOD * quality.PRIOR_SIZE + sum(mine[0].values())) / (quality.PRIOR_SIZE + sum(counts.values()))
    return {x: posterior(v) for x, v in votes.items()}


def _pattern(f: dict) -> int:
    """The rules again, in plain arithmetic."""
    n, c, lines = f["n_words"], f["word_chars"], f["n_lines"]
    votes = [
        (f["n_symbols"] / 0.1 > n, f["n_symbols"] * 100 <= n), (f["n_symbols"] * 20 > c, f["n_symbols"] * 200 <= c), (f["n_marked"] * 10 > n, f["n_marked"] * 50 <= n), (f["n_letters"] * 10 < 8 * c, f["n_letters"] * 10 >= 9 * c),
        (c > 7 * n or c < 2 * n, 3 * n <= c <= 6.5 * n), (f["n_repeat_words"] * 100 > 15 * n, f["n_repeat_words"] * 100 <= 5 * n), (f["n_dup_lines"] * 100 > 20 * lines, f["n_dup_lines"] * 100 <= 5 * lines),
        (n >= 50 and f["n_distinct"] * 100 < 30 * n, f["n_distinct"] * 2 >= n), (f["n_upper"] * 5 > c, f["n_upper"] * 10 <= c), (f["n_exclaims"] * 10 > n, f["n_exclaims"] * 50 <= n),
    ]
    return sum((0 if bad else 2 if good else 1) * 3**i for i, (bad, good) in enumerate(reversed(votes)))


def test_label_model_is_expectation_maximisation(spark):
    k = len(quality.RULES)
    good, half, bad = 3**k - 1, (3**k - 1) // 2, 0
    counts = {good: 900, half: 50, bad: 40, good - 2: 25, 3 ** (k - 1): 30, 2 * 3 ** (k - 1): 3}
    table = spark.createDataFrame(list(counts.items()), "pattern int, n long")
    got = {r["pattern"]: r["posterior"] for r in quality.label_model(table).collect()}
    want = _em(counts)
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], rel=1e-9) for p in want)
    assert got[good] > 0.9 > 0.1 > got[bad]


def test_one_alarm_may_be_overruled(spark):
    """Symbol rules agree on a class; an alarm of another rule alone is outvoted."""
    k = len(quality.RULES)
    good = 3**k - 1
    junk = good - sum(2 * 3 ** (k - 1 - j) for j in range(4))
    lines = good - 2 * 3 ** (k - 1 - 6)
    table = spark.createDataFrame([(good, 9000), (junk, 700), (lines, 150)], "pattern int, n long")
    got = {r["pattern"]: r["posterior"] for r in quality.label_model(table).collect()}
    assert got[junk] < 0.5 < got[lines]


def test_recall_on_labels(spark):
    """Labels are not used; they tell how many bad documents go, and how many good ones stay."""
    import os

    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test tables here")
    judged = quality.assess(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "kept", "base_failed", "posterior").cache()
    both = judged.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").collect()
    bad, good = [r for r in both if r["quality"] == 0], [r for r in both if r["quality"] == 1]
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.9
    assert sum(r["kept"] for r in good if not r["base_failed"]) / sum(not r["base_failed"] for r in good) > 0.97


def test_verdicts(spark):
    prose = "the quick brown fox jumps over a lazy dog while seven wizards mix potions under old stone bridges near town"
    texts = [f"{prose} number {i} and nothing else of note" for i in range(30)] + ["short text", None, "", "spam " * 200, "### $$$ %%% &&& " * 30]
    got = {r["doc_id"]: r for r in quality.assess(docs(spark, texts), keep=["doc_id"]).collect()}
    assert all(got[i]["kept"] for i in range(30))
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (30, 31, 32, 33, 34))
    assert all(0 <= r["posterior"] <= 1 for r in got.values())


def test_filter_keeps_columns_rows_and_null_ids(spark):
    prose = " ".join(f"w{i}" for i in range(40))
    rows = [(1, prose), (1, prose), (None, prose + " x"), (2, None), (3, "few words")]
    df = clashing(docs(spark, rows))
    out = quality.quality_filter(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 1]
    assert out.filter("n_words <> 'x-n_words'").count() == 0


def test_empty_table(spark):
    df = docs(spark, ["x"]).filter(F.lit(False))
    assert quality.quality_filter(df).collect() == []
    assert quality.assess(df).collect() == []


def test_query_over_whole_table(spark, sf):
    from spanloom.llm.queries import op7_quality_rules

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.quality(texts[r["doc_id"]])
        assert {k: r[k] for k in quality.BASE} == {k: want[k] for k in quality.BASE}
        assert r["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
    features = {k: brute.quality(t) for k, t in texts.items()}
    failed = {r["doc_id"]: r["base_failed"] for r in rows}
    counts = dict.fromkeys((_pattern(f) for f in features.values()), 0)
    for k, f in features.items():
        counts[_pattern(f)] += not failed[k]
    posterior = _em(counts)
    for r in rows:
        p = posterior[_pattern(features[r["doc_id"]])]
        assert r["posterior"] == pytest.approx(p, rel=1e-6, abs=1e-12)
        assert r["kept"] == (not r["base_failed"] and p >= 0.5)
