from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.llm import licenses

from . import brute
from .corpora import clashing, docs

ODD = [None, "", "cc", "cc by", "CC-BY-NC", "cc by nc by nc cc by nc", "Under the MIT License. Apache License, Version 2.0", "under the mit license " * 3, "word " * 50_000 + "cc by nc", "ünder the mit license", "apache license version 20"]


def test_base_is_brute_force(spark):
    r = random.Random(2)
    pool = ["cc", "by", "nc", "under", "the", "mit", "license", "apache", "version", "2", "x"]
    texts = ODD + [" ".join(r.choice(pool) for _ in range(r.randint(0, 120))) for _ in range(60)]
    rows = licenses.scan(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for x in rows:
        want = brute.phrases(texts[x["doc_id"]])
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == want, texts[x["doc_id"]]
        assert set(filter(None, x["base_labels"].split(","))) <= set(filter(None, x["labels"].split(",")))
        assert 0 <= x["score"] <= 1


def test_notices_with_words_changed(spark):
    label, text = licenses.NOTICES[0]
    ws = text.split()
    changed = [*ws[:6], "really", *ws[6:12], *ws[13:]]
    far = [*ws[:8], *(f"filler{i}" for i in range(40)), *ws[8:]]
    rows = {r["doc_id"]: r for r in licenses.scan(docs(spark, [text, " ".join(changed), " ".join(ws[:8]), " ".join(far), "start " * 30 + text.upper() + " end"])).collect()}
    assert rows[0]["labels"] == label and rows[0]["score"] == 1
    assert rows[4]["labels"] == label
    assert rows[2]["labels"] == "" and 0 < rows[2]["score"] < licenses.COVERAGE
    assert rows[3]["labels"] == ""
    assert 0.6 < rows[1]["score"] < 1


def test_spans_say_where(spark):
    label, text = licenses.NOTICES[7]
    n = len(text.split())
    found = licenses.spans(docs(spark, [f"a b c {text} d"])).filter(F.col("coverage") == 1.0).collect()
    whole = [(r["label"], r["first"], r["last"]) for r in found if r["last"] - r["first"] > 5]
    assert whole == [(label, 3, 3 + n - 1)]


def test_short_statements_and_further_paragraphs(spark):
    said = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "GNU Lesser General Public License v2.1": "lgpl", "Creative Commons Attribution 3.0 Unported": "cc-by", "Creative Commons Attribution 3.0 International": "cc-by",
        "under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc", "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa", "subject to the Mozilla Public License": "mpl",
        licenses.NOTICES[9][1]: "mit", licenses.NOTICES[9][1].replace("express", "expressed"): "mit", "a general public, a license and a GNU": "", "creative commons": "", "the public license": "",
    }
    rows = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(spark, list(said))).collect()}
    assert [rows[i] for i in range(len(said))] == list(said.values())


def test_rows_that_agree_null_ids_and_clashing_columns(spark):
    df = clashing(docs(spark, [(1, "cc by nc"), (1, "cc by nc"), (None, None), (None, "cc by nc")]))
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in licenses.scan(df).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_empty_table(spark):
    assert licenses.scan(docs(spark, ["x"]).filter(F.lit(False))).collect() == []
