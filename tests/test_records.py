from __future__ import annotations

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from spanloom.functions import expr as X
from spanloom.sources import records as R


def test_locators_chunks_and_batches(spark):
    text = '{"a":1}\n\nnot json\n{"b":"é"}\nno end'
    rows = R.locators(spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "k string, t string"), "k", "t").orderBy("record_index").collect()
    raw = text.encode()
    assert [(r["start"], r["end"]) for r in rows][-1][1] == len(raw)
    for r in rows:
        assert hashlib.sha256(raw[r["start"] : r["end"]]).hexdigest() == r["sha256"]
    assert [r["parse_status"] for r in rows] == ["ok", "malformed", "malformed", "ok", "malformed"]
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "record_index long, start long")
    assert [r["batch_seq"] for r in R.batches(df, "k", 4).orderBy("record_index").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    # Chunks are packed from where the last one ended, so two records of ten bytes fit into 25 whatever their offsets.
    sized = df.select(F.lit("f").alias("k"), "record_index", "start", (F.col("start") + 10).alias("end"))
    assert [r["chunk"] for r in R.chunks(sized, "k", 25).orderBy("record_index").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    long = spark.createDataFrame([("f", 0, 10), ("f", 10, 90), ("f", 90, 95), ("g", 0, 99), (None, 0, 5)], "k string, start long, end long")
    assert sorted((r["k"] or "", r["start"], r["chunk"]) for r in R.chunks(long, "k", 25).collect()) == [("", 0, 0), ("f", 0, 0), ("f", 10, 1), ("f", 90, 2), ("g", 0, 0)]


def test_fragments_round_trip(spark):
    body = random.Random(1).randbytes(1000)
    df = spark.createDataFrame([("r", bytearray(body), len(body)), ("s", bytearray(b"short"), 5)], "k string, body binary, n long")
    plan = R.fragment_plan(df, ["k"], "n", 300)
    pieces = plan.join(df, "k").select("k", "fragment_index", "fragment_count", F.expr("substring(body, int(start) + 1, int(end - start))").alias("body"), F.sha2("body", 256).alias("record_sha256"))
    whole = R.reassemble(pieces, ["k"]).collect()
    assert [(r["k"], bytes(r["body"]), r["complete"]) for r in whole] == [("r", body, True)]
    assert not R.reassemble(pieces.filter("fragment_index <> 2"), ["k"]).first()["complete"]


def test_unpack_objects(spark):
    good, other = b"some records\n" * 50, b"x" * 4000
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = []
    for name, body, stored, source in (("ok", gzip.compress(good), None, good), ("stored", gzip.compress(good), b"else", good), ("source", gzip.compress(good), None, b"else"), ("corrupt", b"no gzip", None, good), ("large", gzip.compress(other), None, other), ("cut", gzip.compress(good)[:-9], None, good)):
        at = stored or body
        rows.append((name, bytearray(body), len(at), sha(at), len(source), sha(source)))
    df = spark.createDataFrame(rows, "path string, body binary, stored_size long, stored_sha256 string, source_size long, source_sha256 string")
    got = {r["path"]: (r["body"] and bytes(r["body"]), r["error"]) for r in R.unpack(df, 2000).collect()}
    assert got == {"ok": (good, None), "stored": (None, "stored_mismatch"), "source": (None, "source_mismatch"), "corrupt": (None, "corrupt"), "large": (None, "too_large"), "cut": (None, "corrupt")}


def test_generations(spark):
    rows = [("s", 1, "i", 10), ("s", 2, "i", 20), ("s", 3, "i", 5), ("s", 4, "j", 9), ("s", 5, None, 9), ("s", 6, None, 9)]
    got = R.generations(spark.createDataFrame(rows, "k string, at long, inode string, size long"), "k", "at", ["inode"], "size")
    assert [r["generation"] for r in got.orderBy("at").collect()] == [0, 0, 1, 2, 3, 3]


def test_overlapping_ranges_are_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, s := r.randint(-50, 300), s + r.randint(0, 90)) for i in range(60)]
    want = sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    df = spark.createDataFrame(rows, "stream string, id long, start long, end long")
    assert sorted((x["left_id"], x["right_id"]) for x in R.overlapping(df, "stream", width=40).collect()) == want


def test_column_functions(spark):
    df = spark.createDataFrame([("msg_0190a1b2-c3d4-7000-8000-000000000001",), ("msg_0190A1B2-c3d4-7000-8000-000000000001",), ("msg_0190a1b2-c3d4-4000-8000-000000000001",), ("0190a1b2-c3d4-7000-8000-000000000001",), ("a_b_0190a1b2-c3d4-7000-8000-000000000001",)], "u string")
    assert [r[0] for r in df.select(X.uuid7_micros(F.col("u"))).collect()] == [0x0190A1B2C3D4 * 1000, None, None, None, None]
    times = ["2024-02-29T10:00:00.000001Z", "2024-02-30T10:00:00Z", "2024-02-01T10:00:00.1234567Z", "2024-02-01 10:00:00Z", "1970-01-01T00:00:01+00:00"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(X.rfc3339_micros(F.col("t"))).collect()]
    assert got == [1_709_200_800_000_001, None, None, None, 1_000_000]
    assert spark.range(1).select(X.rfc3339_text(F.lit(1_709_200_800_000_001))).first()[0] == times[0]
    texts = ["abc", "é" * 4, "a€€€", "😀😀", "", None]
    for most in range(1, 10):
        cut = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.excerpt(F.col("t"), most)).collect()]
        want = []
        for t in texts:
            end = min(most, len((t or "").encode()))
            # U+FFFD stands for a cut character only where it takes no more than what is left of it.
            while t and len(t.encode()[:end].decode("utf-8", "replace").encode()) > most:
                end -= 1
            want.append(t and t.encode()[:end].decode("utf-8", "replace"))
        assert cut == want
    assert spark.range(1).select(X.encode_uri_component(F.lit("a b!'()~*é/+"))).first()[0] == "a%20b!'()~*%C3%A9%2F%2B"
    usage = spark.createDataFrame([(100, 20, 30, 10, 130), (100, 120, 30, 10, 130), (100, 20, 30, 10, 131)], "i long, c long, o long, r long, t long").select(X.cumulative_usage(*[F.col(x) for x in "icort"]).alias("u"))
    assert [r["u"] and tuple(r["u"]) for r in usage.collect()] == [(80, 20, 20, 10, 130), None, None]
    docs = ['{"k": 5}', '{"k": "5"}', '{"k": true}', '{"k": 5.0}', '{"k": 5.5}', "{}", "no"]
    assert [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(X.json_integer(F.col("d"), "$.k")).collect()][3:] == [5, None, None, None]


def test_identities_and_lanes(spark):
    rows = ["a@b.c", "a@b", "a@@b", "@b", "a@", "a b@c", "a@.b", "a@b.", "a@b\n", "a", None]
    df = spark.createDataFrame([(e,) for e in rows], "e string")
    assert [r[0] for r in df.select(X.valid_email(F.col("e"))).collect()] == [True, True, *[False] * 8, None]
    assert [r[0] for r in df.limit(2).select(X.workspace_of(F.col("e"), {"b.c": "w1"})).collect()] == ["w1", None]
    work = spark.createDataFrame([(0, 0), (3, 0), (3, 3), (2, 9)], "l int, b int")
    assert [r[0] for r in work.select(X.lane(F.col("l"), F.col("b"), 6, 3)).collect()] == ["live", "backfill", "live", "live"]
