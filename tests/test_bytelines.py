from __future__ import annotations

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom.sources import bytelines


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.unset(c)


def plain(data: bytes):
    at, out = 0, []
    for i, line in enumerate(data.split(b"\n")):
        whole = line + b"\n" if at + len(line) < len(data) else line
        if whole:
            out.append((i, at, at + len(whole), whole.endswith(b"\n"), line))
        at += len(whole)
    return out


def test_offsets_across_splits(spark, tmp_path, small_splits):
    r = random.Random(3)
    body = b"\n".join(bytes(r.choice([65, 0xFF, 0xC3, 0x28, 13, 0xE2]) for _ in range(r.choice([0, 1, 7, 40, 900]))) for _ in range(90))
    files = {"tail": body + b"\nend", "ended": body + b"\n", "mark": b"\xef\xbb\xbf" + body + b"\n", "mark-tail": b"\xef\xbb\xbffirst\nlast", "empty": b"", "one": b"\n", "lines": b"\n" * 700, "long": b"x" * 5000}
    for name, data in files.items():
        (tmp_path / f"{name}.log").write_bytes(data)
    got = bytelines.read_records(spark, f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() > 1
    found: dict[str, list] = {n: [] for n in files}
    for x in got.collect():
        found[os.path.basename(x["path"])[:-4]].append((x["record_index"], x["start"], x["end"], x["terminated"], bytes(x["record"])))
    for name, data in files.items():
        assert sorted(found[name]) == plain(data), name
    hashes = bytelines.locate(got).filter(F.col("path").endswith("/mark.log")).collect()
    want = {hashlib.sha256(line + b"\n").hexdigest() for *_, line in plain(files["mark"])}
    assert {x["record_sha256"] for x in hashes} == want


CASES = [
    (b'{"type":"a","payload":{"type":"b"},"timestamp":"2026-08-15T00:00:00.5Z"}', ("ok", "a", "b", "2026-08-15T00:00:00.5Z")),
    (b'{"type":"a","timestamp":5,"time":"2026-08-15T00:00:00+02:00"}', ("ok", "a", None, "2026-08-15T00:00:00+02:00")),
    (b'{"type":"a","timestamp":"2026-02-30T00:00:00Z","time":"2026-08-15T00:00:00Z"}', ("ok", "a", None, None)),
    (b'{"type":" ","payload":{"type":7}}', ("unknown", None, None, None)),
    (json.dumps({"type": "x" * 257, "payload": {"type": "é" * 128}}).encode(), ("unknown", None, "é" * 128, None)),
    (b"[1]", ("unknown", None, None, None)),
    (b"7\r", ("unknown", None, None, None)),
    (b'{"type":"a"', ("malformed", None, None, None)),
    (b'{"type":"\xff"}', ("malformed", None, None, None)),
    (b"", ("malformed", None, None, None)),
]


def test_locators(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\n".join(c for c, _ in CASES) + b"\n")
    rows = bytelines.locate(bytelines.read_records(spark, f"file://{tmp_path}")).orderBy("record_index").collect()
    assert [(x["parse_status"], x["native_type"], x["native_payload_type"], x["occurred_at"]) for x in rows] == [want for _, want in CASES]
