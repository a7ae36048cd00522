"""Opaque tokens for snapshots and pages, and what a request may ask. Small values on the driver; no data passes here."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from typing import Any

from ..functions.expr import BUCKET, DAY

LONGEST = 8192
OLDEST = 25 * 60 * 60 * 1_000_000
_INT64 = 1 << 63
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


class RequestError(ValueError):
    """What is wrong with a request: code is expired, not_found, too_large or invalid."""

    #: The HTTP status of each code.
    STATUS = {"expired": 410, "not_found": 404, "too_large": 413, "invalid": 400, "unavailable": 503}

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.status = code, self.STATUS[code]


def encode(version: str, value: Any) -> str:
    raw = json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()
    return f"{version}.{base64.urlsafe_b64encode(raw).decode().rstrip('=')}"


def decode(version: str, token: str) -> Any:
    """The value of a token in its one canonical form."""
    if not isinstance(token, str) or len(token) > LONGEST or not token.startswith(f"{version}."):
        raise RequestError("invalid", "not a token of this kind")
    body = token[len(version) + 1 :]
    try:
        value = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    except ValueError as e:
        raise RequestError("invalid", "a token that can't be read") from e
    if encode(version, value) != token:
        raise RequestError("invalid", "a token in another than its canonical form")
    return value


@dataclass(frozen=True)
class Snapshot:
    """What a reader has seen: commits below xmax but for those still running; projected ones name their version."""

    read_at: int
    xmin: int
    xmax: int
    running: tuple[int, ...] = ()
    projection: str | None = None

    def token(self) -> str:
        value = [self.read_at, self.xmin, self.xmax, list(self.running)]
        return encode("v1", value) if self.projection is None else encode("v2", [*value, self.projection])

    @classmethod
    def of(cls, token: str, now: int) -> Snapshot:
        version = "v2" if str(token).startswith("v2.") else "v1"
        value = decode(version, token)
        if not isinstance(value, list) or len(value) != 4 + (version == "v2") or not all(isinstance(x, int) and not isinstance(x, bool) for x in value[:3]) or not isinstance(value[3], list):
            raise RequestError("invalid", "not a snapshot")
        out = cls(value[0], value[1], value[2], tuple(value[3]), value[4] if version == "v2" else None)
        if not 0 < out.xmin <= out.xmax or list(out.running) != sorted({*out.running}) or any(not out.xmin <= x < out.xmax for x in out.running):
            raise RequestError("invalid", "a snapshot whose commits are out of order")
        if now - out.read_at > OLDEST:
            raise RequestError("expired", "the snapshot is too old")
        return out


def encode_cursor(at: int, id_: int) -> str:
    return encode("v1", [str(at), str(id_)])


def decode_cursor(token: str) -> tuple[int, int]:
    value = decode("v1", token)
    if not isinstance(value, list) or len(value) != 2 or not all(isinstance(x, str) and re.fullmatch(r"0|-?[1-9]\d*", x) for x in value):
        raise RequestError("invalid", "not a cursor")
    at, id_ = map(int, value)
    if not (-_INT64 <= at < _INT64 and 0 <= id_ < _INT64):
        raise RequestError("invalid", "a cursor out of bounds")
    return at, id_


#: People on a page, and the longest cursor of one.
PEOPLE_PAGE, LONGEST_PEOPLE = 20, 128


def encode_people_cursor(person_id: str) -> str:
    return "u1." + base64.urlsafe_b64encode(identifier(person_id).encode()).decode().rstrip("=")


def decode_people_cursor(token: str | None) -> str | None:
    """The person after whom a page begins; None for the first page."""
    if not token:
        return None
    version, _, body = token.partition(".") if isinstance(token, str) and len(token) <= LONGEST_PEOPLE else ("", "", "")
    if version != "u1" or not re.fullmatch(r"[A-Za-z0-9_-]+", body):
        raise RequestError("invalid", "not a cursor of people")
    try:
        found = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode()
    except ValueError as e:
        raise RequestError("invalid", "a cursor that can't be read") from e
    if encode_people_cursor(found) != token:
        raise RequestError("invalid", "a cursor in another than its canonical form")
    return found


def pinned(snapshot: Snapshot, raw: Any, projected: dict[str, Any]) -> Any:
    """What answers questions about a snapshot: of one that names a projection that projection only, of another the raw events.
    Where it isn't there, nothing else steps in."""
    found = raw if snapshot.projection is None else projected.get(snapshot.projection)
    if found is None:
        raise RequestError("unavailable", "what the snapshot was read from is not there")
    return found


def bucket_of(start: int, snapshot: Snapshot) -> tuple[int, int]:
    """The bucket that a request names; it must be one of the snapshot's day."""
    end = snapshot.read_at - snapshot.read_at % BUCKET
    if start % BUCKET or not end - DAY <= start < end:
        raise RequestError("invalid", "not a bucket of this day")
    return start, start + BUCKET


def identifier(text: str) -> str:
    if not _UUID.fullmatch(text):
        raise RequestError("invalid", "not an identifier")
    return text
