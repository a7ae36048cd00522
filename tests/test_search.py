from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.functions.expr import has_token
from spanloom.operators import search

WORDS = ["alpha", "Beta", "γάμμα", "d3", "o'clock", "and", "x"]


def corpus(seed, n, first=0):
    r = random.Random(seed)
    return [(first + i * r.choice([1, 1, 40_000]), r.choice([None, "", "?!"]) if r.random() < 0.1 else " ".join(r.choices(WORDS, k=r.randrange(1, 9)))) for i in range(n)]


def found(df):
    return sorted(r["id"] for r in df.collect())


def test_an_index_in_commits_finds_what_a_scan_finds(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = {}
    for n in range(3):
        part = {i: t for i, t in corpus(n, 60, n * 10_000_000)}
        rows |= part
        search.append_segment(spark.createDataFrame(list(part.items()), "doc_id long, text string"), path, n)
        search.append_segment(spark.createDataFrame(list(part.items()), "doc_id long, text string"), path, n)  # again
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for asked in ("alpha", "BETA and", "γάμμα d3 x", "clock o", "nothing", "?"):
        wanted = [t for t in asked.lower().split() if t not in "?"]
        scan = docs
        for t in wanted:
            scan = scan.filter(has_token(F.col("text"), t))
        want = sorted(r["doc_id"] for r in scan.collect()) if wanted else []
        assert found(search.search(spark, path, asked)) == want
        assert found(search.search(spark, path, asked, snapshot=0)) == [i for i in want if i < 10_000_000]
    search.compact(spark, path, f"{path}-one", 2)
    assert found(search.search(spark, f"{path}-one", "beta x")) == found(search.search(spark, path, "beta x"))
    assert search.read_index(spark, f"{path}-one").select("commit_id").distinct().count() == 1


def test_a_search_reads_its_tokens_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    search.append_segment(spark.createDataFrame(corpus(5, 80), "doc_id long, text string"), path, 0)
    plan = search.search(spark, path, "alpha")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "bucket#" in scan.split("PartitionFilters: ")[1].split("]")[0]
    assert "(token,alpha)" in scan or "(token, [alpha])" in scan
