"""Frames as DataFrame operators.

Everything that touches bytes runs over Arrow batches; the columns that are not
involved stay next to the result in the same batch. What comes after decoding is
ordinary Spark SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native
from ..kernel import columnar, packing, transform, wire
from ..kernel.reader import Frame, walk
from ..kernel.wire import FrameError, Limits
from ..layout import Struct, layout_of

MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")
ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])
_ERROR_SPARK = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])


def _map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(each, schema)


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "binary": T.BinaryType()}


def _shape(source: DataFrame, keep: list[str], **more: str) -> T.StructType:
    return T.StructType([source.schema[c] for c in keep] + [T.StructField(k, _TYPES[v]) for k, v in more.items()])


def decode(
    df: DataFrame, layout: Struct, frame_col: str = "frame", columns: list[str] | None = None, keep: list[str] | None = None, mode: str = "FAILFAST",
    limits: Limits = Limits(), into: str | None = None, packed: bool = False, raw: bool = False, fill_null: bool = False,
) -> DataFrame:
    """Frames to typed columns.

    ``columns`` limits what is followed: an error in another branch does not show.
    ``keep`` names columns of ``df`` that go along (none unless given). With
    ``into`` the root becomes one struct column, else its fields become columns.
    ``packed`` frames are unpacked first, ``raw`` ones are single segments without
    a table. PERMISSIVE adds ``_error`` and leaves the fields of a bad frame null;
    DROPMALFORMED drops bad frames. A null frame gives null fields and no error.
    A null root gives null fields, or with ``fill_null`` the defaults.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode}")
    s = layout.only(*columns) if columns is not None else layout
    keep = [c for c in keep or [] if c != frame_col]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{frame_col}`"))
    shape = s.spark()
    out = [source.schema[c] for c in keep] + ([T.StructField(into, shape)] if into else list(shape.fields))
    if mode == "PERMISSIVE":
        out.append(T.StructField("_error", _ERROR_SPARK))
    names = [f.name for f in out]
    empty = columnar.encode(pa.array([{}], pa.struct([])), Struct("nothing", 0, 0, ()))[0].as_py()

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        frames = batch.column(len(keep))
        early: dict[int, FrameError] = {}
        if packed and mode == "FAILFAST":
            frames = packing.unpack(frames, limits.words)
        elif packed or raw:
            frames, early = _each(frames, (lambda x: transform.unpack(x, limits.words)) if packed else lambda x: wire.frame_of([x]), mode)
        value, errors = columnar.decode(frames, s, limits, mode)
        if fill_null:
            gone = [v and frames[i].is_valid and errors[i] is None for i, v in enumerate(value.is_null().to_pylist())]
            if any(gone):
                blank, _ = columnar.decode(pa.array([empty]), s, limits)
                index = pa.array([len(value) if g else i for i, g in enumerate(gone)])
                value = pa.concat_arrays([value, blank]).take(index)
        for i, e in early.items():
            errors[i] = e
        parts = [batch.column(i) for i in range(len(keep))] + ([value] if into else value.flatten())
        if mode == "PERMISSIVE":
            parts.append(pa.array([None if e is None else {"code": e.code, "message": e.message} for e in errors], ERROR))
        done = pa.RecordBatch.from_arrays(parts, names)
        if mode == "DROPMALFORMED" and any(errors):
            done = done.filter(pa.array([e is None for e in errors]))
        return done

    return _map(source, f, T.StructType(out))


def encode(df: DataFrame, layout: Struct | None = None, frame_col: str = "frame", keep: list[str] | None = None, on_null: str = "presence", pack: bool = False) -> DataFrame:
    """Rows to frames: one column ``frame_col``, after the ``keep`` columns.

    Without a layout one is made from the schema (``layout_for``). ``on_null``:
    ``presence`` stores a bit for each scalar, ``default`` writes nulls as the
    default, ``error`` refuses them.
    """
    s = layout or layout_for(df, on_null)
    keep = keep or []
    wanted = {f.name for f in s.columns} | ({"which"} if s.union_at is not None else set())
    used = [c for c in df.columns if c in wanted]
    names = [*keep, *(c for c in used if c not in keep)]
    source = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(frame_col, T.BinaryType())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(names.index(c)) for c in used]
        if on_null == "error" and any(c.null_count for c in cols):
            raise FrameError("ARG", "null in " + ", ".join(u for u, c in zip(used, cols) if c.null_count))
        value = pa.StructArray.from_arrays(cols, used) if cols else pa.array([{}] * batch.num_rows, pa.struct([]))
        frames = columnar.encode(value, s)
        if pack:
            frames = packing.pack(frames)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), frames], [*keep, frame_col])

    return _map(source, f, schema)


def layout_for(df: DataFrame, on_null: str = "presence", defaults: dict | None = None) -> Struct:
    if on_null not in ("presence", "default", "error"):
        raise ValueError(f"on_null {on_null}")
    return layout_of(df.schema, presence=on_null == "presence", defaults=defaults)


def decode_segments(df: DataFrame, layout: Struct, segments_col: str = "segments", **options) -> DataFrame:
    """Like ``decode`` for messages that come as arrays of word-aligned segments."""
    keep = options.get("keep") or []
    return decode(df.select(*[F.col(f"`{c}`") for c in keep], native.frame_segments(segments_col).alias("_frame")), layout, "_frame", **options)


def float_bits(c: Column | str) -> Column:
    """The bits of a double as a long."""

    @F.arrow_udf(T.LongType())
    def run(x: pa.Array) -> pa.Array:
        return pa.Array.from_buffers(pa.int64(), len(x), x.buffers(), x.null_count, x.offset)

    return run(c)


def bits_float(c: Column | str) -> Column:
    """The double with the given bits."""

    @F.arrow_udf(T.DoubleType())
    def run(x: pa.Array) -> pa.Array:
        return pa.Array.from_buffers(pa.float64(), len(x), x.buffers(), x.null_count, x.offset)

    return run(c)


# Binary to binary, as columns.


def _each(column: pa.Array, f: Callable, mode: str = "FAILFAST") -> tuple[pa.Array, dict[int, FrameError]]:
    out, errors = [], {}
    for i, x in enumerate(column.to_pylist()):
        try:
            out.append(None if x is None else f(x))
        except FrameError as e:
            if mode == "FAILFAST":
                raise
            out.append(None)
            errors[i] = e
    return pa.array(out, pa.binary()), errors


def _bytes_udf(f: Callable, mode: str) -> Callable[..., Column]:
    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        return _each(x, f, mode)[0]

    return run


def pack(c: Column | str) -> Column:
    """The packed form of a binary column; its length must be a multiple of 8."""

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        return packing.pack(x)

    return run(c)


def unpack(c: Column | str, max_words: int = transform.UNPACK_WORDS, mode: str = "FAILFAST") -> Column:
    """The inverse of ``pack``; with another mode than FAILFAST what is refused becomes null."""

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        return packing.unpack(x, max_words, mode)

    return run(c)


def canonicalize(c: Column | str, limits: Limits = Limits(), mode: str = "FAILFAST", mask_padding: bool = False) -> Column:
    """The canonical segment of a frame: equal messages have equal bytes, however they were laid out."""
    return _bytes_udf(lambda x: transform.canonicalize(Frame.parse(x, limits), mask_padding), mode)(c)


def resegment(c: Column | str, first_words: int = 1024, max_words: int = wire.MAX_SEGMENT_WORDS, mode: str = "FAILFAST") -> Column:
    return _bytes_udf(lambda x: transform.resegment(Frame.parse(x), first_words, max_words), mode)(c)


def extract(c: Column | str, path: str, mode: str = "FAILFAST") -> Column:
    """The object at ``path`` (``.1[3].0``: slots and elements) as a frame of its own."""
    return _bytes_udf(lambda x: transform.extract(Frame.parse(x), path), mode)(c)


def move(c: Column | str, source: str, target: str) -> Column:
    """The object at ``source`` moved to ``target``; nothing is copied but the pointers."""
    return _bytes_udf(lambda x: transform.move(Frame.parse(x), source, target), "FAILFAST")(c)


def graft(into: Column | str, path: str, source: Column | str) -> Column:
    """``into`` with a deep copy of ``source``'s root at ``path``."""

    @F.arrow_udf(T.BinaryType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else transform.graft(Frame.parse(x), path, Frame.parse(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.binary())

    return run(into, source)


_INSPECT = pa.struct([("bytes", pa.int64()), ("segments", pa.int32()), ("words", pa.int64()), ("root", pa.string()), ("dwords", pa.int32()), ("pwords", pa.int32()), ("count", pa.int64()), ("text", pa.string()), ("error", pa.string())])


def inspect(c: Column | str, limits: Limits = Limits()) -> Column:
    """Segment statistics and shape of the root; never fails, an error's code is in ``error``."""

    @F.arrow_udf("bytes bigint, segments int, words bigint, root string, dwords int, pwords int, count bigint, text string, error string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([transform.inspect(v, limits) for v in x.to_pylist()], _INSPECT)

    return run(c)


def objects(df: DataFrame, frame_col: str = "frame", keep: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row for each object that a frame's root reaches: path, kind, place and dimensions."""
    keep = keep or []
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{frame_col}`"))
    shape = _shape(source, keep, path="string", kind="string", segment="int", word="bigint", dwords="int", pwords="int", esize="int", count="bigint", depth="int")
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, found = [], []
        for i, x in enumerate(batch.column(len(keep)).to_pylist()):
            if x is None:
                continue
            for path, r in walk(Frame.parse(x, limits).root()):
                index.append(i)
                found.append((path, ("struct", "list", "far", "capability")[r.kind], r.segment, r.at // 8, r.dwords, r.pwords, r.esize, r.count, r.depth))
        at = pa.array(index, pa.int32())
        columns = [batch.column(i).take(at) for i in range(len(keep))]
        columns += [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, [x.name for x in shape])

    return _map(source, f, shape)


def split_frames(df: DataFrame, bytes_col: str = "content", keep: list[str] | None = None, max_segments: int = 64) -> DataFrame:
    """Whole frames of concatenated bytes: ``pos``, ``len``, ``frame`` for each; an incomplete rest is left out."""
    keep = keep or []
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{bytes_col}`"))
    shape = _shape(source, keep, pos="bigint", len="bigint", frame="binary")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(len(keep))[i].as_buffer() if batch.column(len(keep))[i].is_valid else b""
                view, at, found = memoryview(data), 0, []

                def flush(found=found, i=i, batch=batch) -> pa.RecordBatch:
                    n = pa.array([i] * len(found), pa.int32())
                    cols = [batch.column(k).take(n) for k in range(len(keep))]
                    cols += [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
                    return pa.RecordBatch.from_arrays(cols, [x.name for x in shape])

                while size := wire.frame_length(view[at:], max_segments):
                    found.append((at, size, bytes(view[at : at + size])))
                    at += size
                    if len(found) == 4096:
                        yield flush()
                        found.clear()
                if found:
                    yield flush()

    return source.mapInArrow(f, shape)


def canonical_distinct(df: DataFrame, frame_col: str = "frame") -> DataFrame:
    """One frame of each class of equal messages, whatever their padding, order of objects or segments."""
    keyed = df.withColumn("_canonical", F.sha2(canonicalize(F.col(frame_col)), 256))
    return keyed.dropDuplicates(["_canonical"]).drop("_canonical")
