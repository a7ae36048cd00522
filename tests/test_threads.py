from __future__ import annotations

import os
import sqlite3

from spanloom.sources import threads as T


def database(path, columns, rows):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE threads ({', '.join(columns)})")
        db.executemany(f"INSERT INTO threads VALUES ({', '.join('?' * len(columns))})", rows)
    db.close()


def scan(spark, path, **more):
    rows = T.scan_threads(spark, f"file://{path}", **({"cutoff_ms": 10_000, "limit": 3} | more)).collect()
    out = {}
    for r in rows:
        out.setdefault(os.path.basename(r["database"]), []).append((r["id"], r["updated_at_ms"]) if r["error"] is None else r["error"])
    return out


def test_recent_threads_of_all_shapes_of_databases(spark, tmp_path):
    full = ["id", "rollout_path", "updated_at", "updated_at_ms", "archived", "thread_source"]
    database(tmp_path / "full.sqlite", full, [
        ("a", "/a", 20, 20_500, 0, "user"), ("b", "/b", 30, None, None, None), ("c", "/c", None, 40_001, 0, ""), ("d", "/d", 99, 99_000, 1, "user"), ("e", "/e", 98, 98_000, 0, "robot"), ("f", "/f", 9, 9_999, 0, "user"), ("g", "/g", 20, 20_500, 0, "subagent"),
    ])
    database(tmp_path / "seconds.sqlite", ["id", "rollout_path", "updated_at"], [("x", "/x", 10), ("y", "/y", 9), ("z", "/z", 10)])
    database(tmp_path / "millis.sqlite", ["updated_at_ms", "id", "rollout_path"], [(10_000 + i, f"m{i}", "/m") for i in range(9)])
    database(tmp_path / "bare.sqlite", ["id", "rollout_path"], [])
    (tmp_path / "broken.sqlite").write_bytes(b"not a database at all" * 300)
    got = scan(spark, tmp_path)
    assert got["full.sqlite"] == [("c", 40_001), ("b", 30_000), ("g", 20_500)]
    assert got["seconds.sqlite"] == [("z", 10_000), ("x", 10_000)]
    assert got["millis.sqlite"] == [("m8", 10_008), ("m7", 10_007), ("m6", 10_006)]
    assert "lacks" in got["bare.sqlite"][0] and isinstance(got["broken.sqlite"][0], str)
    assert scan(spark, tmp_path, limit=0)["millis.sqlite"] == [("m8", 10_008)]


def test_the_newest_of_several_databases(spark, tmp_path):
    for name, at in (("one", 50), ("two", 60)):
        database(tmp_path / f"{name}.sqlite", ["id", "rollout_path", "updated_at"], [("a", f"/{name}", at), (name, "/own", 20)])
    rows = T.newest(T.scan_threads(spark, f"file://{tmp_path}", 0, 10)).collect()
    assert sorted((r["id"], r["rollout_path"], r["updated_at_ms"]) for r in rows) == [("a", "/two", 60_000), ("one", "/own", 20_000), ("two", "/own", 20_000)]


def test_a_database_too_large_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MOST_BYTES", 100)
    database(tmp_path / "big.sqlite", ["id", "rollout_path", "updated_at"], [])
    assert scan(spark, tmp_path) == {"big.sqlite": ["too large"]}
