from __future__ import annotations

import random

import pytest

from spanloom.operators import forest
from spanloom.sources.normalize import inherited

NODE = "part string, node string, parent string, named string, own string"


def one_batch(spark, rows):
    d = spark.createDataFrame(rows, NODE)
    return {(r["part"], r["node"]): r["value"] for r in inherited(d, "part").collect()}


def stored(spark, path):
    return {(r["part"], r["node"]): r["value"] for r in forest.read_forest(spark, path).collect()}


def random_forest(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parent = str(r.randrange(i)) if i and r.random() < 0.85 else r.choice([None, "nobody"])
        rows.append((r.choice("ab"), str(i), parent, r.choice([None, None, None, f"p{i}"]), r.choice([None, f"r{i}"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_lead_to_what_one_batch_says(spark, tmp_path, seed):
    rows, path = random_forest(seed), f"file://{tmp_path}/forest"
    for n, at in enumerate((0, 25, 40)):
        forest.extend_forest(spark.createDataFrame(rows[at : (25, 40, 60)[n]], NODE), path, n)
    assert stored(spark, path) == one_batch(spark, rows)
    forest.compact(spark, path, f"{path}-compact")
    assert stored(spark, f"{path}-compact") == stored(spark, path)


def test_a_child_inherits_from_an_earlier_batch_and_a_late_parent_corrects(spark, tmp_path):
    path = f"file://{tmp_path}/forest"
    node = lambda *rows: spark.createDataFrame(list(rows), NODE)
    forest.extend_forest(node(("s", "1", None, "turn-1", None)), path, 0)
    added = forest.extend_forest(node(("s", "2", "1", None, "request"), ("s", "9", "8", None, "own-9")), path, 1)
    assert {r["node"]: r["value"] for r in added.collect()} == {"2": "turn-1", "9": "own-9"}
    late = forest.extend_forest(node(("s", "8", "2", None, None)), path, 2)
    assert {r["node"]: r["value"] for r in late.collect()} == {"8": "turn-1", "9": "turn-1"}
    assert forest.extend_forest(node(("s", "8", "2", None, None), ("s", "2", "1", None, "request")), path, 3).count() == 0  # delivered again
    again = forest.extend_forest(node(("s", "8", "2", None, None)), path, 2)  # the batch runs again
    assert {r["node"]: r["value"] for r in again.collect()} == {"8": "turn-1", "9": "turn-1"}


def test_cycles_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "ROUNDS", 4)
    path = f"file://{tmp_path}/forest"
    rows = [("s", "1", "1", None, "x"), ("s", "2", "3", None, None), ("s", "3", "2", None, None), ("s", "4", "3", "p4", None)]
    forest.extend_forest(spark.createDataFrame(rows, NODE), path, 0)
    got = stored(spark, path)
    assert got["s", "1"] == "x" and got["s", "4"] == "p4" and got["s", "2"] is None
    forest.extend_forest(spark.createDataFrame([("s", "5", "2", None, "own")], NODE), path, 1)
    assert stored(spark, path)["s", "5"] == "own"
