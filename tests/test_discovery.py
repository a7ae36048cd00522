from __future__ import annotations

import json
import os

from spanloom.sources import discovery as D


def look(spark, path, before=None):
    before = before if before is not None else spark.createDataFrame([], D.SNAPSHOT)
    rows = D.snapshot(D.listing(spark, f"file://{path}", "*.log"), before).collect()
    return {os.path.basename(r["path"]): r["status"] for r in rows}, spark.createDataFrame([tuple(r)[:5] for r in rows if r["status"] != "gone"], D.SNAPSHOT)


def test_what_has_become_of_files(spark, tmp_path):
    names = ["same", "short", "long", "cut", "replaced", "replaced-longer", "rewritten", "goes", "tiny-grows"]
    for i, n in enumerate(names):
        (tmp_path / f"{n}.log").write_bytes(bytes([65 + i]) * (10 if n in ("short", "tiny-grows") else 9000))
        os.utime(tmp_path / f"{n}.log", (1_700_000_000, 1_700_000_000))
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    first, snap = look(spark, tmp_path)
    assert first == {f"{n}.log": "new" for n in names}
    (tmp_path / "long.log").write_bytes(b"C" * 9000 + b"more")
    (tmp_path / "cut.log").write_bytes(b"D" * 5000)
    (tmp_path / "replaced.log").write_bytes(b"?" + b"E" * 8999)
    (tmp_path / "replaced-longer.log").write_bytes(b"?" + b"F" * 20_000)
    (tmp_path / "rewritten.log").write_bytes(b"G" * 8999 + b"!")
    (tmp_path / "tiny-grows.log").write_bytes(b"I" * 10 + b"more" * 3000)
    (tmp_path / "empty.log").write_bytes(b"now some")
    (tmp_path / "goes.log").unlink()
    (tmp_path / "comes.log").write_bytes(b"new")
    second, snap = look(spark, tmp_path, snap)
    assert second == {
        "same.log": "unchanged", "short.log": "unchanged", "long.log": "appended", "cut.log": "truncated", "replaced.log": "rotated", "replaced-longer.log": "rotated", "rewritten.log": "changed", "goes.log": "gone",
        "tiny-grows.log": "appended", "empty.log": "new", "comes.log": "new",
    }
    third, _ = look(spark, tmp_path, snap)
    assert set(third.values()) == {"unchanged"} and "goes.log" not in third


def test_only_heads_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "big.log").write_bytes(b"\n" * (3 << 20))
    head = D.heads(D.listing(spark, f"file://{tmp_path}"), 1000).first()["head"]
    assert len(head) == 1000


def test_identities(spark, tmp_path):
    line = lambda **x: json.dumps(x).encode() + b"\n"
    files = {
        "one": line(sessionId="s1") + b"not json\n" + line(session_id="s1", agentId=" "),
        "two": line(sessionId="s1") + line(sessionId="s2"),
        "late": line(sessionId="s1") + b"{}\n" * 100 + line(sessionId="s2"),
        "tail": line(sessionId="s1") + b'{"sessionId":"s2"}',
        "agent": line(sessionId="s1", agentId="a1") + line(agentId="a1"),
        "bytes": b"\xff\n" + line(sessionId=7) + line(sessionId="s9"),
    }
    for n, data in files.items():
        (tmp_path / f"{n}.log").write_bytes(data)
    got = D.identities(D.listing(spark, f"file://{tmp_path}"), {"session": ["$.sessionId", "$.session_id"], "agent": ["$.agentId", "$.agent_id"]})
    found = {os.path.basename(r["path"])[:-4]: (r["session"], r["agent"], r["conflict"]) for r in got.collect()}
    assert found == {"one": ("s1", None, False), "two": (None, None, True), "late": ("s1", None, False), "tail": ("s1", None, False), "agent": ("s1", "a1", False), "bytes": ("s9", None, False)}
