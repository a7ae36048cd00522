"""Sessions kept in keyed state: a batch reads and writes the state of what it touches, and no history.

`span_revisions` keeps, for each session, the canonical event of each logical key, the events of each span, and the last
revision of each span. An event that arrives changes at most the span it belongs to and that of the event it displaces; only
these are worked out again, and only a span that differs from its last revision is appended, or its tombstone. So a late
event appends the correction that a recomputation would find, and an event delivered twice appends nothing. With `settle_ms`
a touched span waits that long for further events (a processing-time timer) before it is revised; such a query needs a trigger
that goes on, as it never has nothing left to wait for.

`folded_sessions` keeps each session's row as its parts come in any order.

State lies in RocksDB stores beside the checkpoint, partitioned by session, and outlives the query. A session's state grows
with its own events; ttl_ms lets sessions that nobody touches any more go. A call of the state costs far more than the work on an
event, so a session is read and written in one, as JSON, until it is large (SMALL); from then on its entries are read one by one,
so that an event's work stays that of its span.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import SECOND
from ..operators.spans import TASK_SUBTYPES, TURN_KINDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a span needs of an event. at is when it happened, by the source's clock if it has one.
EVENT = "session_id long, id long, at long, occurred_at long, source_priority int, event_kind string, event_subtype string, message_origin string, phase string, tool_status string, turn_id string, tool_call_id string, scope_key string, normalizer_version string, logical_event_key string, is_replay boolean"
_EVENT = [x.split(" ")[0] for x in EVENT.split(", ")]
_SLIM = ["id", "at", "event_kind", "event_subtype", "message_origin", "phase", "tool_status"]
_CHOSEN = ["id", "occurred_at", "source_priority", "event_kind", "event_subtype", "turn_id", "tool_call_id"]  # what tells an event's rank and its spans
_BLANK = dict.fromkeys(x for x in _EVENT if x != "session_id")  # JSON leaves nulls out
_SPAN = ["span_kind", "start_at", "end_at", "start_id", "end_id", "state", "basis"]
_SPAN_TYPE = "span_kind string, start_at long, end_at long, start_id long, end_id long, state string, basis string"
_CUT = "\x1f"
PARTS = 2048  # sessions share so many keys of state, as each key costs a batch of output; a checkpoint's number never changes
CHUNK = 65536  # rows of a part that are held at once
SMALL = 1 << 16  # a session whose state is no longer than this is read and written whole
_dumps = functools.partial(json.dumps, separators=(",", ":"))
REVISION = f"session_id long, span_key string, revision long, {_SPAN_TYPE}, is_tombstone boolean"


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streaming queries that start meanwhile keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _groups(e) -> list[str]:
    """The spans, or the one list of tasks, that an event belongs to."""
    out = []
    if e["turn_id"] is not None and e["event_kind"] in TURN_KINDS:
        out.append(f"turn:{e['turn_id']}")
    if e["event_kind"] in ("tool_call", "tool_result"):
        out.append(f"tool:call:{e['tool_call_id']}" if e["tool_call_id"] is not None else f"tool:event:{e['id']}")
    if e["turn_id"] is None and e["event_kind"] == "lifecycle" and e["event_subtype"] in TASK_SUBTYPES:
        out.append("tasks")
    return out


def _span(kind: str, start: dict, end: dict | None, basis: str) -> tuple:
    whole = end is not None and end["at"] > start["at"]
    state = "interval" if whole else "open" if end is None else "point"
    return (kind, start["at"], end["at"] if whole else start["at"] + SECOND, start["id"], end["id"] if end else None, state, basis if whole else "estimated")


def _turn(events: list[dict]) -> tuple:
    """events are in order of time and id, as in the two functions below."""
    life = lambda e, *names: e["event_kind"] == "lifecycle" and e["event_subtype"] in names
    begun = next((e for e in events if life(e, "turn_started", "task_started")), None)
    start = begun or next((e for e in events if e["message_origin"] == "human"), events[0])
    end = next((e for e in reversed(events) if life(e, "turn_complete", "task_complete") or (e["message_origin"] != "human" and e["phase"] == "final_answer")), None)
    return _span("turn", start, end, "lifecycle" if begun and end and life(end, "turn_complete", "task_complete") else "estimated")


def _tool(events: list[dict]) -> tuple:
    call = next((e for e in events if e["event_kind"] == "tool_call"), None)
    results = [e for e in events if e["event_kind"] == "tool_result"]
    if call is None:
        return _span("tool", results[0], results[0], "estimated")[:4] + (None, "point", "estimated")
    result = next((r for r in results if r["at"] > call["at"]), results[0] if results else None)
    out = _span("tool", call, result, "paired_events")
    return out[:5] + ("point", "estimated") if result is None and call["tool_status"] == "completed" else out


def _tasks(events: list[dict]) -> dict[str, tuple]:
    """Starts wait in a queue; a completion takes the first."""
    out, waiting = {}, []
    for e in events:
        if e["event_subtype"] == "task_started":
            waiting.append(e)
        elif waiting:
            start = waiting.pop(0)
            out[f"task:{start['id']}"] = _span("task", start, e, "lifecycle")
        else:
            out[f"task-complete:{e['id']}"] = ("task", e["at"], e["at"] + SECOND, e["id"], None, "point", "estimated")
    return out | {f"task:{s['id']}": _span("task", s, None, "lifecycle") for s in waiting}


def _spans(group: str, events: list[dict]) -> dict[str, tuple]:
    events = sorted(events, key=lambda e: (e["at"], e["id"]))
    if group == "tasks":
        return _tasks(events)
    if not events:
        return {}
    return {group: _turn(events) if group.startswith("turn:") else _tool(events)}


def _preference(e) -> tuple:
    return (-e["source_priority"], e["occurred_at"] is None, e["occurred_at"] or 0, e["id"])


class _Session:
    """A session's state: canonical (by logical key, the preferred event), members (by group, its canonical events), shown (by
    span, its last revision), group_keys (by group, the spans last shown for it), and n, how many revisions were appended.

    A small one was read whole (body). Of a large one single entries are read from map states as they are asked for."""

    def __init__(self, id_: int, maps: dict, body: str | None, large: bool):
        self.id, self.maps, self.large = id_, maps, large
        known = json.loads(body) if body else {}
        self.n = known.pop("n", 0)
        self.entries = {name: known.get(name, {}) for name in maps}
        self.dirty: dict[str, set[str]] = {name: set() for name in maps}

    def _key(self, key: str) -> tuple[str]:
        return (f"{self.id}{_CUT}{key}",)

    def get(self, name: str, key: str):
        entries = self.entries[name]
        if key not in entries and self.large:
            found = self.maps[name].getValue(self._key(key)) if self.maps[name].containsKey(self._key(key)) else None
            entries[key] = json.loads(found[0]) if found else None
        return entries.get(key)

    def put(self, name: str, key: str, value) -> None:
        self.entries[name][key] = value
        self.dirty[name].add(key)

    def changed(self) -> bool:
        """Whether there is anything to keep: a key's preferred event may belong to no span, and is known all the same."""
        return any(self.dirty.values())

    def kept(self, most: int) -> str:
        """What is kept of it as a whole; entries of one that is or gets large go to their maps."""
        if not self.large:
            body = _dumps({"n": self.n, **self.entries})
            if len(body) <= most:
                return body
            self.large, self.dirty = True, {name: set(e) for name, e in self.entries.items()}
        for name, keys in self.dirty.items():
            for key in keys:
                self.maps[name].updateValue(self._key(key), (_dumps(self.entries[name][key]),))
        return _dumps({"n": self.n})


def _by_session(rows: Iterator[Row]) -> Iterator[dict[int, list[dict]]]:
    """Rows of the parts of a key, by session, CHUNK at once; rows are JSON."""
    for chunk in itertools.batched(rows, CHUNK):
        found: dict[int, list[dict]] = {}
        for row in chunk:
            found.setdefault(row["session_id"], []).append(json.loads(row["row"]))
        yield found


def _dealt(rows: DataFrame, names: list[str]) -> GroupedData:
    """session_id and the rest as JSON, grouped into PARTS keys of state."""
    part = F.pmod(F.xxhash64("session_id"), F.lit(PARTS)).cast("int").alias("part")
    return rows.select(part, "session_id", F.to_json(F.struct(*[c for c in names if c != "session_id"])).alias("row")).groupBy("part")


class SpanRevisions(StatefulProcessor):
    """State of a part: sessions (by session, its state, whole if it is small), the entries of large sessions in a map of each kind,
    and waiting (sessions and groups touched since the last timer)."""

    def __init__(self, settle_ms: int = 0, ttl_ms: int | None = None, small: int = SMALL):
        self.settle_ms, self.ttl_ms, self.small = settle_ms, ttl_ms, small

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session_id long", "body string, large boolean", self.ttl_ms)
        self.maps = {name: handle.getMapState(name, "key string", "value string", self.ttl_ms) for name in ("canonical", "members", "shown", "group_keys")}
        self.waiting = handle.getMapState("waiting", "session_id long, name string", "since long", self.ttl_ms)

    def _read(self, id_: int) -> _Session:
        found = self.sessions.getValue((id_,)) if self.sessions.containsKey((id_,)) else None
        return _Session(id_, self.maps, *(found or (None, False)))

    def _keep(self, session: _Session) -> None:
        self.sessions.updateValue((session.id,), (session.kept(self.small), session.large))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for found in _by_session(rows):
            timed = False
            for id_, events in found.items():
                session = self._read(id_)
                touched = self._add(session, events)
                if self.settle_ms:
                    timed = timed or bool(touched)
                    for name in touched:
                        self.waiting.updateValue((id_, name), (timerValues.getCurrentProcessingTimeInMs(),))
                else:
                    yield from self._revise(session, touched)
                if session.changed():
                    self._keep(session)
            if timed:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.settle_ms)

    @staticmethod
    def _add(session: _Session, events: list[dict]) -> dict[str, list[dict]]:
        """Groups that these events change, with the events that they have now."""
        groups: dict[str, dict[int, dict]] = {}
        before: dict[str, set[int]] = {}

        def members(name: str) -> dict[int, dict]:
            if name not in groups:
                groups[name] = {e[0]: dict(zip(_SLIM, e, strict=True)) for e in session.get("members", name) or ()}
                before[name] = set(groups[name])
            return groups[name]

        def add(e) -> None:
            for name in _groups(e):
                members(name)[e["id"]] = {c: e[c] for c in _SLIM}

        for row in events:
            e = _BLANK | row
            if e["is_replay"]:
                continue
            if e["scope_key"] is None or e["logical_event_key"] is None:
                add(e)
                continue
            name = _CUT.join((e["scope_key"], e["normalizer_version"], e["logical_event_key"], e["event_kind"]))
            known = session.get("canonical", name)
            now = dict(zip(_CHOSEN, known, strict=True)) if known else None
            if now is not None and _preference(now) <= _preference(e):
                continue
            if now is not None:
                for group in _groups(now):
                    members(group).pop(now["id"], None)
            session.put("canonical", name, [e[c] for c in _CHOSEN])
            add(e)
        touched = {name: list(found.values()) for name, found in groups.items() if set(found) != before[name]}
        for name, found in touched.items():
            session.put("members", name, [[e[c] for c in _SLIM] for e in found])
        return touched

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.settle_ms
        names: dict[int, list[str]] = {}
        for k, since in list(self.waiting.iterator()):
            if since[0] <= due:
                names.setdefault(k[0], []).append(k[1])
        for id_, groups in names.items():
            session = self._read(id_)
            for name in groups:
                self.waiting.removeKey((id_, name))
            yield from self._revise(session, {name: [dict(zip(_SLIM, e, strict=True)) for e in session.get("members", name) or ()] for name in groups})
            self._keep(session)

    @staticmethod
    def _revise(session: _Session, groups: dict[str, list[dict]]) -> Iterator[Row]:
        for name, events in sorted(groups.items()):
            now = _spans(name, events)
            known = session.get("group_keys", name) or []
            for span_key in sorted({*now, *known}):
                last = session.get("shown", span_key)
                want = [*now[span_key], False] if span_key in now else [*[None] * len(_SPAN), True]
                if want != last and not (last is None and want[-1]):
                    session.n += 1
                    session.put("shown", span_key, want)
                    yield Row(session_id=session.id, span_key=span_key, revision=session.n, **dict(zip([*_SPAN, "is_tombstone"], want, strict=True)))
            if {*now} - {*known}:
                session.put("group_keys", name, sorted({*now, *known}))


def span_revisions(events: DataFrame, settle_ms: int = 0, ttl_ms: int | None = None, small: int = SMALL) -> DataFrame:
    """A stream of REVISION rows from a stream of EVENT rows; start it within rocks(). A session whose state takes more than `small`
    characters is kept by entries."""
    timed = "ProcessingTime" if settle_ms or ttl_ms else "None"
    return _dealt(events, _EVENT).transformWithState(SpanRevisions(settle_ms, ttl_ms, small), REVISION, "Append", timed)


class SessionFold(StatefulProcessor):
    """State of a part: sessions (by session, for each attribute the part it was last known in and its value, the least start, and the
    least and the greatest person who claims it)."""

    def __init__(self, attributes: list[str]):
        self.attributes = attributes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session_id long", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for found in _by_session(rows):
            for id_, parts in found.items():
                before = self.sessions.getValue((id_,))[0] if self.sessions.containsKey((id_,)) else None
                known, started, least, most = json.loads(before) if before else ({}, None, None, None)
                for p in parts:
                    for a in [*self.attributes, "actor_role"]:
                        value = p.get(a)
                        if value is None or (a == "actor_role" and value == "unknown"):
                            continue
                        if a not in known or [p["batch_seq"], value] > known[a]:
                            known[a] = [p["batch_seq"], value]
                    started, least = (min((x for x in pair if x is not None), default=None) for pair in ((started, p.get("started_at")), (least, p.get("person_id"))))
                    most = max((x for x in (most, p.get("person_id")) if x is not None), default=None)
                after = _dumps([known, started, least, most])
                if before is not None and json.loads(before) == json.loads(after):
                    continue
                self.sessions.updateValue((id_,), (after,))
                yield Row(session_id=id_, **{a: known.get(a, (0, None))[1] for a in self.attributes}, actor_role=known.get("actor_role", (0, "unknown"))[1], started_at=started, person_id=least, person_changed=None if least is None else least != most)


def folded_sessions(parts: DataFrame, attributes: list[str]) -> DataFrame:
    """A stream of sessions' rows as they change, as operators.sessions.session_fold folds them, from parts with session_id,
    batch_seq, person_id, actor_role, started_at and attributes (strings). The last row of a session is the one that holds."""
    names = ["session_id", "batch_seq", "person_id", "actor_role", "started_at", *attributes]
    schema = f"session_id long, {', '.join(f'{a} string' for a in attributes)}, actor_role string, started_at long, person_id long, person_changed boolean"
    return _dealt(parts, names).transformWithState(SessionFold(attributes), schema, "Update", "None")
