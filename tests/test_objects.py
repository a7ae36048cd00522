from __future__ import annotations

import gzip
import hashlib
import os
import pickle

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.sources import objects as O

KEYS = {"workspace_id": "w1", "collector_key": "c:1", "source_kind": "thread", "source_stream_key": "s1", "generation_seq": 0, "generation_key": "g", "start_offset": 0, "end_offset": 0, "body": b""}


def batch(body, start=0, **more):
    return tuple((KEYS | {"start_offset": start, "end_offset": start + len(body), "body": body} | more).values())


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def test_objects_are_named_by_content_and_written_once(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [batch(b'{"a":1}\n'), batch(b"\xff\x00\n" * 50, 8), batch(b'{"a":1}\n', collector_key="c2")]
    O.write_objects(spark.createDataFrame(rows, O.BATCH).repartition(3), path)
    names = listed(tmp_path)
    sha = hashlib.sha256(rows[0][-1]).hexdigest()
    assert len(names) == 3 and f"workspaces/w1/collectors/c:1/thread/s1/generations/0-g/0-8-{sha}.jsonl.gz" in names
    times = {n: os.stat(tmp_path / n).st_mtime_ns for n in names}
    O.write_objects(spark.createDataFrame([*rows, rows[0]], O.BATCH).repartition(2), path)
    assert {n: os.stat(tmp_path / n).st_mtime_ns for n in listed(tmp_path)} == times
    got = O.read_objects(spark, path).collect()
    assert {bytes(r["body"]) for r in got} == {r[-1] for r in rows} and all(r["error"] is None for r in got)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = [batch(b"x\n" * n, n) for n in range(1, 9)]
    with pytest.raises(Exception, match="not those of its range"):
        O.write_objects(spark.createDataFrame([*rows, (*batch(b"y\n")[:-2], 5, b"y\n")], O.BATCH).repartition(3), f"file://{tmp_path}")
    with pytest.raises(Exception, match="no part of a name"):
        O.write_objects(spark.createDataFrame([batch(b"y\n", collector_key="../up")], O.BATCH), f"file://{tmp_path}")
    assert listed(tmp_path) == []


def test_other_bytes_under_a_name_are_a_conflict(spark, tmp_path):
    path, row = f"file://{tmp_path}", batch(b"one\n")
    O.write_objects(spark.createDataFrame([row], O.BATCH), path)
    at = tmp_path / listed(tmp_path)[0]
    at.write_bytes(gzip.compress(b"two\n", 6, mtime=0))
    with pytest.raises(Exception, match="other bytes"):
        O.write_objects(spark.createDataFrame([row], O.BATCH), path)
    assert listed(tmp_path / "_staged") == []
    assert [r["error"] for r in O.read_objects(spark, path).collect()] == ["source_mismatch"]


def test_record_hashes(spark, tmp_path):
    path, body = f"file://{tmp_path}", b"first\nsecond\n"
    O.write_objects(spark.createDataFrame([batch(body)], O.BATCH), path)
    found = O.read_objects(spark, path)
    at = found.first()["path"]
    h = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(at, 0, 0, 6, h(b"first\n")), (at, 1, 6, 13, h(b"second\n")), (at, 2, 6, 13, h(b"other")), (at, 3, 6, 20, h(b"second\n")), ("gone", 0, 0, 1, h(b"x"))]
    records = spark.createDataFrame(rows, "path string, record_index long, start long, end long, sha256 string")
    assert {(r["path"] == at, r["record_index"]): r["ok"] for r in O.prove_records(found, records).collect()} == {(True, 0): True, (True, 1): True, (True, 2): False, (True, 3): False, (False, 0): False}
    assert found.filter(F.col("error").isNotNull()).count() == 0


def test_the_driver_hears_of_tasks_only(spark, tmp_path):
    """What a task tells the driver doesn't grow with its objects, and listing them takes no index of files in the driver."""
    says = []
    for n in (1, 50):
        rows = [Row(**dict(zip(KEYS, batch(b"x\n" * i, i), strict=True))) for i in range(1, n + 1)]
        says.append(len(pickle.dumps(O._Writer(f"file://{tmp_path}", "job").write(iter(rows)))))
    assert says[0] == says[1]
    O.write_objects(spark.createDataFrame([batch(b"x\n" * i, i) for i in range(1, 6)], O.BATCH).repartition(2), f"file://{tmp_path}")
    got = O.read_objects(spark, f"file://{tmp_path}")
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(len(r["body"]) for r in got.collect()) == [2, 4, 6, 8, 10]
