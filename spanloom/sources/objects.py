"""Immutable objects of batches: named by what is in them, written whole or not at all, never overwritten.

A Python data source stages; a second job publishes. Tasks compress their rows into staged files of the job and list them in a
file beside them, so that the driver hears of tasks and not of objects. Once all have been staged, tasks move each to its name,
unless an object is there, which must be the same bytes. A job that fails while it stages, or a task that is run again
elsewhere, leaves no object: what it staged goes with the job's folder. Writing the same batches again changes nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .records import MAX_SOURCE, unpack

BATCH = "workspace_id string, collector_key string, source_kind string, source_stream_key string, generation_seq long, generation_key string, start_offset long, end_offset long, body binary"
#: Fixed value: an object's name.
NAME = "workspaces/{workspace_id}/collectors/{collector_key}/{source_kind}/{source_stream_key}/generations/{generation_seq}-{generation_key}/{start_offset}-{end_offset}-{sha256}.jsonl.gz"
_SEGMENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]*")
_STAGED = "_staged"
_LISTS = "lists"
_PIECE = 1 << 23  # bytes of objects that are handed on at once


class ObjectConflict(ValueError):
    """Another object stands under a name."""


@dataclass
class Staged(WriterCommitMessage):
    """The file that lists what a task has staged; none if it had no rows."""

    listed: str | None = None


def object_name(row: Row) -> str:
    parts = row.asDict()
    for c in ("workspace_id", "collector_key", "source_kind", "source_stream_key", "generation_key"):
        if not parts[c] or not _SEGMENT.fullmatch(parts[c]):
            raise ValueError(f"{c} is no part of a name: {parts[c]!r}")
    body = parts.pop("body")
    if not 0 < len(body) <= MAX_SOURCE or parts["end_offset"] - parts["start_offset"] != len(body):
        raise ValueError("a batch's bytes are not those of its range, or too many")
    return NAME.format(**parts, sha256=hashlib.sha256(body).hexdigest())


class _Writer(DataSourceWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def _at(self) -> tuple[pafs.FileSystem, str]:
        system, root = pafs.FileSystem.from_uri(self.path)
        return system, f"{root}/{_STAGED}/{self.job}"

    def write(self, rows: Iterator[Row]) -> Staged:
        system, staging = self._at()
        done: list[tuple[str, str]] = []
        try:
            for row in rows:
                name, at = object_name(row), f"{staging}/{uuid.uuid4().hex}"
                if not done:
                    system.create_dir(staging, recursive=True)
                done.append((at, name))
                with system.open_output_stream(at, compression=None) as out:
                    out.write(gzip.compress(bytes(row["body"]), 6, mtime=0))
            if not done:
                return Staged()
            listed = f"{staging}/{uuid.uuid4().hex}.list"
            with system.open_output_stream(listed, compression=None) as out:
                for each in done:
                    out.write(f"{json.dumps(each)}\n".encode())
        except Exception:
            for at, _name in done:
                if system.get_file_info(at).type == pafs.FileType.File:
                    system.delete_file(at)
            raise
        return Staged(listed)

    def commit(self, messages: list[Staged | None]) -> None:
        """Names the lists of the tasks that count, for the job that publishes."""
        system, staging = self._at()
        lists = [m.listed for m in messages if m and m.listed]
        if lists:
            with system.open_output_stream(f"{staging}/{_LISTS}", compression=None) as out:
                out.write("\n".join(lists).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        _clean(*self._at())


def _clean(system: pafs.FileSystem, staging: str) -> None:
    if system.get_file_info(staging).type == pafs.FileType.Directory:
        system.delete_dir(staging)


def _hash(system: pafs.FileSystem, at: str) -> str:
    with system.open_input_stream(at, compression=None) as f:
        return hashlib.sha256(f.read()).hexdigest()


def _read_lists(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(path)
        for at in (x for b in batches for x in b.column("listed").to_pylist()):
            with system.open_input_stream(at, compression=None) as f:
                staged = [json.loads(x) for x in f.read().splitlines()]
            yield pa.RecordBatch.from_pydict({"at": [x[0] for x in staged], "name": [x[1] for x in staged]})

    return run


def _publish(path: str):
    """Moves staged objects to their names. All of a name are in one task; a task that is run again finds them moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(path)
        there = lambda x: system.get_file_info(x).type == pafs.FileType.File
        for b in batches:
            for at, name in zip(b.column("at").to_pylist(), b.column("name").to_pylist(), strict=True):
                to = f"{root}/{name}"
                if not there(to):
                    system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    system.move(at, to)
                elif there(at) and _hash(system, at) != _hash(system, to):
                    raise ObjectConflict(f"{name} is there with other bytes")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return run


class BatchObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_objects"

    def schema(self) -> str:
        return BATCH

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are never overwritten; use mode append")
        return _Writer(self.options["path"], self.options["job"])


def write_objects(batches: DataFrame, path: str) -> None:
    """BATCH rows as objects below path. The driver handles names of tasks' lists only."""
    spark, job = batches.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(BatchObjects)
    system, root = pafs.FileSystem.from_uri(path)
    staging = f"{root}/{_STAGED}/{job}"
    try:
        batches.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in BATCH.split(", ")]).write.format("batch_objects").option("path", path).option("job", job).mode("append").save()
        if system.get_file_info(f"{staging}/{_LISTS}").type == pafs.FileType.File:
            with system.open_input_stream(f"{staging}/{_LISTS}", compression=None) as f:
                lists = [(x,) for x in f.read().decode().split("\n")]
            staged = spark.createDataFrame(lists, "listed string").repartition("listed").mapInArrow(_read_lists(path), "at string, name string")
            staged.repartition("name").mapInArrow(_publish(path), "n long").agg(F.sum("n")).collect()  # one row
    finally:
        _clean(system, staging)


def _below(path: str, levels: int | None):
    """Paths below folders, so many levels down, or all; files on the way stay. Hidden ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(path)

        def walk(at: str, left: int | None) -> Iterator[tuple[str, bool]]:
            for x in system.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                folder = x.type == pafs.FileType.Directory
                if x.base_name.startswith(("_", ".")):
                    continue
                if folder and left != 1:
                    yield from walk(x.path, None if left is None else left - 1)
                elif folder or x.base_name.endswith(".jsonl.gz"):
                    yield x.path, folder

        for b in batches:
            for at, folder in zip(b.column("at").to_pylist(), b.column("folder").to_pylist(), strict=True):
                found = list(walk(root if at == "" else at, levels)) if folder else [(at, False)]
                yield pa.RecordBatch.from_pydict({"at": pa.array([x[0] for x in found], pa.string()), "folder": pa.array([x[1] for x in found], pa.bool_())})

    return run


def _contents(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(path)
        base = path.rstrip("/")

        def piece(names: list[str], bodies: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": names, "content": pa.array(bodies, pa.binary())})

        names, bodies, size = [], [], 0
        for at in (x for b in batches for x in b.column("at").to_pylist()):
            with system.open_input_stream(at, compression=None) as f:
                bodies.append(f.read())
            names.append(f"{base}{at[len(root.rstrip('/')) :]}")
            size += len(bodies[-1])
            if size >= _PIECE or len(names) >= 4096:
                yield piece(names, bodies)
                names, bodies, size = [], [], 0
        if names:
            yield piece(names, bodies)

    return run


def read_objects(spark, path: str) -> DataFrame:
    """path, body and error of the objects below path: each is held against the size and hash that its name says. Tasks list
    folders, collectors' first, then streams', as the driver can't hold a list of all objects."""
    at = spark.createDataFrame([("", True)], "at string, folder boolean")
    for levels in (4, 2, None):
        at = at.mapInArrow(_below(path, levels), "at string, folder boolean").repartition("at")
    files = at.mapInArrow(_contents(path), "path string, content binary").withColumn("length", F.octet_length("content").cast("long"))
    part = lambda i: F.regexp_extract("path", r"/(\d+)-(\d+)-([0-9a-f]{64})\.jsonl\.gz$", i)
    named = files.select("path", F.col("content").alias("body"), F.col("length").alias("stored_size"), F.sha2("content", 256).alias("stored_sha256"), (part(2).cast("long") - part(1).cast("long")).alias("source_size"), part(3).alias("source_sha256"))
    return unpack(named)


def prove_records(objects: DataFrame, records: DataFrame) -> DataFrame:
    """path, record_index and ok of each record (path, record_index, start, end within the object's source, sha256): whether the bytes
    there have its hash. An object that is missing or broken proves none."""
    found = records.join(objects.select("path", "body"), "path", "left")
    bytes_ = F.substring(F.col("body"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    whole = (F.octet_length(bytes_) == F.col("end") - F.col("start")) & (F.sha2(bytes_, 256) == F.col("sha256"))
    return found.select("path", "record_index", F.coalesce(whole, F.lit(False)).alias("ok"))
