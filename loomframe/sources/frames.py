"""A Python data source for files of concatenated frames.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").load(folder)              # path, pos, len, frame
    df.select("frame").write.format("frames").save(folder)
    spark.readStream.format("frames").load(folder)        # conn_id, seq, frame

A file is one task unless ``indexed`` is set: frames form a chain of lengths, so
only an index of frame starts makes a file splittable. The writer leaves one beside
each file, in a hidden file; the driver walks the lengths of other files. Paths are
local ones or URIs of any store that ``pyarrow.fs`` opens (``hdfs://``, ``s3://``,
``gs://``, ...), the same for driver and executors; frames in a store that only Spark
reads come in by ``spark.read.format("binaryFile")`` and ``operators.frames.split_frames``.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..kernel.wire import FrameError

SCHEMA = "path string, pos bigint, len bigint, frame binary"
STREAM_SCHEMA = "conn_id string, seq bigint, frame binary"
SUFFIX = ".frames"


#: Bytes after which the index of a file has the start of another frame.
INDEX_STEP = 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what the paths in it begin with for the reader."""
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path), ""
    store, inner = pafs.FileSystem.from_uri(path)
    return store, inner, "" if isinstance(store, pafs.LocalFileSystem) else path[: len(path) - len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"


def _files(path: str) -> dict[str, int]:
    """Files at a path, or under it, and their sizes; hidden ones are left out."""
    store, inner, head = _store(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return {head + inner: info.size}
    found = store.get_file_info(pafs.FileSelector(inner, allow_not_found=True, recursive=True))
    return {head + x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_"))}


def _open(path: str):
    store, inner, _ = _store(path)
    return store.open_input_file(inner)


def _index_of(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.index"


def _index(path: str, size: int) -> dict | None:
    """What the writer has noted about a file: ``size``, number of ``frames``, ``starts`` of some of them; None if there is nothing, or the file has changed."""
    store, inner, _ = _store(_index_of(path))
    if store.get_file_info(inner).type != pafs.FileType.File:
        return None
    with store.open_input_file(inner) as f:
        found = json.loads(f.read())
    return found if found["size"] == size else None


def lengths(f, start: int, end: int | None, max_segments: int) -> Iterator[tuple[int, int]]:
    """(position, bytes) of the frames from ``start`` on, reading only their tables."""
    at = start
    size = f.size()
    while at + 8 <= size and (end is None or at < end):
        f.seek(at)
        n = int.from_bytes(f.read(4), "little") + 1
        if n > max_segments:
            raise FrameError("FRAMING", f"{n} segments at {at}")
        table = f.read(4 * n)
        if len(table) < 4 * n:
            return
        total = ((4 + 4 * n + 7) & ~7) + 8 * sum(struct.unpack(f"<{n}I", table))
        if at + total > size:
            return
        yield at, total
        at += total


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class _Every:
    """The set of all paths."""

    def __contains__(self, path: str) -> bool:
        return True

    def __and__(self, other: set[str]) -> set[str]:
        return other


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.max_segments = int(options.get("maxSegments", 512))
        self.only: set[str] | _Every = _Every()
        self.split = int(options.get("splitBytes", 0)) if options.get("indexed", "false") == "true" else 0

    def partitions(self) -> list[_Part]:
        out = []
        for path, size in _files(self.path).items():
            if path not in self.only:
                continue
            if not self.split or size <= self.split:
                out.append(_Part(path, 0, None))
                continue
            start = 0
            for at in self._ends(path, size):
                if at - start >= self.split:
                    out.append(_Part(path, start, at))
                    start = at
            if start < size:
                out.append(_Part(path, start, None))
        return out or [_Part("", 0, None)]

    def _ends(self, path: str, size: int) -> Iterator[int]:
        """Places where a frame ends and the next one may begin."""
        if self.split >= INDEX_STEP and (known := _index(path, size)) is not None:
            yield from known["starts"]
            return
        with _open(path) as f:
            for at, total in lengths(f, 0, None, self.max_segments):
                yield at + total

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.path:
            return
        with _open(part.path) as f:
            for at, total in lengths(f, part.start, part.end, self.max_segments):
                f.seek(at)
                yield part.path, at, total, f.read(total)


class FilteringFrameReader(FrameReader):
    """With option ``pushFilters``; it needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on ``path`` picks the files ; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only &= {f.value}
            elif isinstance(f, In) and f.attribute == ("path",):
                self.only &= set(f.value)
            else:
                yield f


class _Done(WriterCommitMessage):
    def __init__(self, path: str, size: int, frames: int, starts: list[int]):
        self.path, self.index = path, {"size": size, "frames": frames, "starts": starts}


class FrameWriter(DataSourceWriter):
    """Writes to hidden files; a commit gives them their names, so a lost task leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows) -> _Done:
        store, folder, _ = _store(self.path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/._{uuid.uuid4().hex}"
        size = frames = noted = 0
        starts = []
        with store.open_output_stream(name) as f:
            for row in rows:
                if row["frame"] is not None:
                    if size - noted >= INDEX_STEP:
                        starts.append(size)
                        noted = size
                    f.write(row["frame"])
                    size, frames = size + len(row["frame"]), frames + 1
        return _Done(name, size, frames, starts)

    def name(self, m: _Done, name: str) -> None:
        """Give a file its name, after its index."""
        store, folder, _ = _store(self.path)
        with store.open_output_stream(_index_of(f"{folder}/{name}")) as f:
            f.write(json.dumps(m.index).encode())
        store.move(m.path, f"{folder}/{name}")

    def commit(self, messages: list[_Done | None]) -> None:
        if self.overwrite:
            for old in _files(self.path):
                store, inner, _ = _store(old)
                store.delete_file(inner)
        for k, m in enumerate(m for m in messages if m):
            self.name(m, f"part-{k:05d}-{m.path.rpartition('/._')[2]}{SUFFIX}")

    def abort(self, messages: list[_Done | None]) -> None:
        store, _, _ = _store(self.path)
        for m in messages:
            if m and store.get_file_info(m.path).type == pafs.FileType.File:
                store.delete_file(m.path)


class FrameStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.inner = FrameWriter(options, False)

    def write(self, rows) -> _Done:
        return self.inner.write(rows)

    def commit(self, messages: list[_Done | None], batch: int) -> None:
        for k, m in enumerate(m for m in messages if m):
            self.inner.name(m, f"batch-{batch:08d}-{k:05d}{SUFFIX}")

    def abort(self, messages: list[_Done | None], batch: int) -> None:
        self.inner.abort(messages)


class _StreamPart(InputPartition):
    def __init__(self, path: str, start: int, end: int, seq: int):
        self.path, self.start, self.end, self.seq = path, start, end, seq


class FrameStreamReader(DataSourceStreamReader):
    """Each file is a connection; a batch takes what whole frames have been appended since the last one.

    Where files have no index, the driver walks their segment tables to find where
    frames end; executors read the frames, one task for each file of a batch.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.max_segments = int(options.get("maxSegments", 64))
        self.known: dict[str, list[int]] = {}  # file -> end of its last whole frame, frames before it

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in _files(self.path).items():
            at, seq = self.known.get(path, (0, 0))
            if at >= size:
                continue
            if (noted := _index(path, size)) is not None:
                self.known[path] = [size, noted["frames"]]
                continue
            with _open(path) as f:
                for pos, total in lengths(f, at, None, self.max_segments):
                    at, seq = pos + total, seq + 1
            self.known[path] = [at, seq]
        return {k: list(v) for k, v in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[_StreamPart]:
        out = []
        for path, (stop, _) in sorted(end.items()):
            at, seq = start.get(path, (0, 0))
            if at < stop:
                out.append(_StreamPart(path, at, stop, seq))
        return out

    def read(self, part: _StreamPart) -> Iterator[tuple]:
        with _open(part.path) as f:
            for n, (at, total) in enumerate(lengths(f, part.start, part.end, self.max_segments)):
                f.seek(at)
                yield part.path, part.seq + n, f.read(total)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return STREAM_SCHEMA if self.options.get("stream", "false") == "true" else SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return (FilteringFrameReader if self.options.get("pushFilters", "false") == "true" else FrameReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> FrameStreamWriter:
        return FrameStreamWriter(self.options)

    def streamReader(self, schema: StructType) -> FrameStreamReader:
        return FrameStreamReader(self.options)
