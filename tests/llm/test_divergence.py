from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanloom.llm import divergence, ranking

from .corpora import clashing


def brute(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), g or "", s or "") for t, g, s in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for ws, lang, source in rows:
        docs[lang].update(set(ws))
        counts[lang, source].update(ws)
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        shares = {}
        own = {s: c for (x, s), c in counts.items() if x == lang}
        own[None] = sum(own.values(), Counter())
        for s, c in own.items():
            n = sum(c[t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in own:
            if s is None:
                continue
            found = {"pair": [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in own if o not in (None, s)]}
            found["term"] = sorted((-f(shares[s][t], shares[None][t]), t.encode(), t) for t in kept if own[s][t] and shares[s][t] > shares[None][t])[:top]
            out += [(lang, s, part, item, -v, rank) for part, xs in found.items() for rank, (v, _, item) in enumerate(sorted(xs), 1)]
    return sorted(out)


def corpus(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def check(spark, rows, min_docs=divergence.MIN_DOCS, top=divergence.TOP):
    out = divergence.audit(corpus(spark, rows), min_docs=min_docs, top=top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows, min_docs, top)
    return got


def test_random_corpora(spark):
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Émile", "ß", "Straße", "日本", "don't"]
    rows = [(" ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randrange(0, 40))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "Ω"])) for _ in range(150)]
    assert check(spark, rows, min_docs=3, top=4)


def test_nulls_groups_without_terms_and_ties(spark):
    rows = [(None, "en", "nothing"), ("", "en", "empty"), ("12 34", None, None), ("rare", "xx", "one"), ("word", "xx", "two")]
    rows += [(" ".join(f"{a}{b}" for a in "abcdef" for b in "abcdef"), "en", "tied")] * 2 + [("aa AA Aa", "en", "other")] * 2
    got = check(spark, rows, min_docs=2, top=5)
    assert [x[4] for x in got if x[0] == "xx"] == [0, 0]
    assert len({x[4] for x in got if x[1] == "tied" and x[2] == "term"}) < 5


def test_empty_table_and_extra_columns(spark):
    d = corpus(spark, [("a b", "en", "x")] * 12)
    assert divergence.audit(d.filter("false")).count() == 0
    assert sorted(map(tuple, divergence.audit(clashing(d)).collect())) == sorted(map(tuple, divergence.audit(d).collect()))


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1, 1), (10**13, 3 * 10**13 + 7, 10**6), (2**47, 2**47 + 5, 3), (0, 10**14, 10**9)]
    got = [r[0] for r in spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_radix_selection_with_crowded_ties(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 3)
    r = random.Random(6)
    rows = []
    for g in ["hot", None, "small", "prefix"]:
        n = {"hot": 900, None: 300, "small": 4, "prefix": 200}[g]
        items = {("same-long-prefix/" * 5 + f"{i:x}") if g == "prefix" else "".join(r.choices("aé日z", k=r.randrange(1, 7))) for i in range(n)}
        rows += [(g, r.choice([7, 7, 7, 5, 2**40, 0]), i) for i in items]
    rows += [("prefix", 7, "same-long-prefix/" * 5)]
    d = spark.createDataFrame(rows, "g string, v long, t string")
    for k, bits in ((10, 63), (60, 41)):
        want = []
        for g in {x[0] for x in rows}:
            best = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2].encode()))[:k]
            want += [(*x, i) for i, x in enumerate(best, 1)]
        got = [tuple(x) for x in ranking.top_k(d, ["g"], "v", "t", k, bits).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_words_are_counted_without_a_lambda_a_word(spark):
    rows = [("B a,a", "x", "s"), (" b ", "x", "s"), (None, None, None), ("É é", "x", "t"), ("", "x", "t"), (" 1 ", "x", "t")]
    tallies = divergence._tallies(divergence._named(corpus(spark, rows), "text", "lang", "source"))
    assert "lambda" not in tallies._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, tallies.collect())) == [("x", "s", "a", 2, 1), ("x", "s", "b", 2, 2), ("x", "t", "É", 1, 1), ("x", "t", "é", 1, 1)]
