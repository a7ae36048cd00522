from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spanloom.functions.expr import BUCKET, DAY
from spanloom.sources import tokens as T

NOW = 20_000 * DAY + 5


@given(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, (1 << 63) - 1))
def test_cursor_round_trip(at, id_):
    assert T.decode_cursor(T.encode_cursor(at, id_)) == (at, id_)


def test_snapshot_round_trip():
    for s in (T.Snapshot(NOW, 3, 9, (4, 7)), T.Snapshot(NOW, 3, 3, (), "f2")):
        assert T.Snapshot.of(s.token(), NOW + 5) == s


@pytest.mark.parametrize("token", ["", "v1.", "v1.!!", "v3.W10", "v1.W10", "v1." + "A" * 9000, T.encode("v1", [1, 2]), T.encode("v1", [NOW, 9, 3, []]), T.encode("v1", [NOW, 3, 9, [12]]), T.encode("v1", [NOW, 3, 9, [7, 4]]), T.encode("v1", [True, 3, 9, []]), None])
def test_bad_snapshots(token):
    with pytest.raises(T.RequestError) as e:
        T.Snapshot.of(token, NOW)
    assert e.value.status == 400


def test_other_spellings_of_a_token_are_refused():
    good = T.encode_cursor(5, 6)
    with pytest.raises(T.RequestError):
        T.decode_cursor(good + "=")
    with pytest.raises(T.RequestError):
        T.decode_cursor(T.encode("v1", ["05", "6"]))


def test_old_snapshots_and_foreign_buckets():
    s = T.Snapshot(NOW, 1, 2)
    with pytest.raises(T.RequestError) as e:
        T.Snapshot.of(s.token(), NOW + T.OLDEST + 1)
    assert e.value.status == 410
    end = NOW - NOW % BUCKET
    assert T.bucket_of(end - DAY, s) == (end - DAY, end - DAY + BUCKET)
    for start in (end, end - DAY - BUCKET, end - DAY + 1):
        with pytest.raises(T.RequestError):
            T.bucket_of(start, s)


def test_identifiers():
    assert T.identifier("0190a1b2-0000-7000-8000-000000000001")
    with pytest.raises(T.RequestError):
        T.identifier("0190A1B2-0000-7000-8000-000000000001")


UUID = "0190a1b2-0000-7000-8000-00000000000a"


def test_people_cursors():
    token = T.encode_people_cursor(UUID)
    assert T.decode_people_cursor(token) == UUID and T.decode_people_cursor("") is None and T.decode_people_cursor(None) is None
    for bad in (token + "=", token + ".x", token.replace("u1", "v1"), "u1.", "u1.!!", "u1._w", "u1." + "A" * 200, T.encode("u1", UUID), 7):
        with pytest.raises(T.RequestError):
            T.decode_people_cursor(bad)
    with pytest.raises(T.RequestError):
        T.encode_people_cursor("me")


def test_a_snapshot_is_answered_by_what_it_was_read_from():
    raw, projections = object(), {"f2": object()}
    assert T.pinned(T.Snapshot(NOW, 1, 2), raw, projections) is raw
    assert T.pinned(T.Snapshot(NOW, 1, 2, (), "f2"), raw, projections) is projections["f2"]
    with pytest.raises(T.RequestError) as e:
        T.pinned(T.Snapshot(NOW, 1, 2, (), "f1"), raw, projections)
    assert e.value.status == 503
