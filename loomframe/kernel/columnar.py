"""Whole batches of frames at once: Arrow arrays from frames and frames from Arrow arrays.

Decoding follows all frames of a batch field by field with numpy: an array of
body positions stands for one struct of every frame (or every element of every
list). Frames that are not plain (several segments, far pointers, other list
widths than the layout's, anything out of bounds or over a limit) are marked and
read one by one with ``loomframe.kernel.rows``, which gives the exact error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..layout import ESIZE, Field, Struct, Type
from . import rows
from .wire import Limits, bits as bits_of

_NP = {"int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float32": "<f4", "float64": "<f8"}


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a binary or string column (nulls have length 0)."""
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off[:-1], np.diff(off)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


def _offsets(length: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(length)))


def _bitmap(valid: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())


def _strings(raw: np.ndarray, start: np.ndarray, length: np.ndarray, kind: pa.DataType, valid: np.ndarray) -> pa.Array:
    length = np.where(valid, length, 0)
    off = _offsets(length).astype(np.int32)
    body = raw[_ranges(start, length)]
    return pa.Array.from_buffers(kind, len(start), [_bitmap(valid), pa.py_buffer(off.tobytes()), pa.py_buffer(body.tobytes())])


class _Reader:
    def __init__(self, column: pa.Array, limits: Limits):
        raw, start, length = binary_parts(column)
        n = len(column)
        self.limits = limits
        self.bad = np.asarray(column.is_null().to_numpy(zero_copy_only=False)) | (length < 16)
        # Aligned copies of the frames, each rounded up to whole words.
        size = np.where(self.bad, 0, length)
        words = (size + 7) // 8
        self.base = _offsets(words)[:-1]  # first word of each frame
        buf = np.zeros(8 * int(words.sum()) + 64, np.uint8)
        if n and (size % 8 == 0).all() and not self.bad.any() and (start[1:] == start[:-1] + length[:-1]).all():
            buf[: int(size.sum())] = raw[start[0] : start[0] + int(size.sum())]
        else:
            buf[_ranges(8 * self.base, size)] = raw[_ranges(start, size)]
        self.buf, self.words = buf, buf.view("<u8")
        head = self.words[np.where(self.bad, 0, self.base)]
        self.bad |= (head & 0xFFFFFFFF) != 0
        self.size = np.where(self.bad, 0, (head >> np.uint64(32)).astype(np.int64))  # words of the segment
        self.bad |= (8 + 8 * self.size > length) | (self.size < 1)
        self.first = self.base + 1
        self.end = np.where(self.bad, 0, self.first + self.size)
        self.spent = np.zeros(n, np.int64)

    def mark(self, own: np.ndarray) -> None:
        self.bad[own] = True

    def charge(self, own: np.ndarray, words) -> None:
        np.add.at(self.spent, own, words)

    def pointers(self, own: np.ndarray, at: np.ndarray, have: np.ndarray):
        """Pointer words at ``at`` (where there is one), their kinds and the places they name."""
        ok = have & ~self.bad[own]
        w = np.where(ok, self.words[np.where(ok, at, 0)], np.uint64(0))
        self.charge(own, ok.astype(np.int64))
        off = ((w & np.uint64(0xFFFFFFFF)) >> np.uint64(2)).astype(np.int64)
        off = np.where(off >> 29, off - (1 << 30), off)
        return w, (w & np.uint64(3)).astype(np.int64), at + 1 + off

    def inside(self, own: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (at >= self.first[own]) & (at + words <= self.end[own])

    def structs(self, own: np.ndarray, at: np.ndarray, have: np.ndarray, depth: int):
        """(valid, body, dwords, pwords) of struct pointers; what is no plain struct is marked."""
        w, kind, body = self.pointers(own, at, have)
        some = w != 0
        d = ((w >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
        p = (w >> np.uint64(48)).astype(np.int64)
        ok = some & (kind == 0) & self.inside(own, body, d + p) & (depth <= self.limits.depth)
        self.mark(own[some & ~ok])
        ok &= ~self.bad[own]
        self.charge(own, np.where(ok, d + p, 0))
        return ok, np.where(ok, body, 0), np.where(ok, d, 0), np.where(ok, p, 0)

    def lists(self, own: np.ndarray, at: np.ndarray, have: np.ndarray, esize: int, depth: int):
        """(valid, body, count) of list pointers of one element size."""
        w, kind, body = self.pointers(own, at, have)
        some = w != 0
        code = ((w >> np.uint64(32)) & np.uint64(7)).astype(np.int64)
        count = (w >> np.uint64(35)).astype(np.int64)
        step = (0, 1, 8, 16, 32, 64, 64, 64)[esize]
        size = (count * step + 63) // 64 + (esize == 7)
        ok = some & (kind == 1) & (code == esize) & self.inside(own, body, size) & (depth <= self.limits.depth)
        self.mark(own[some & ~ok])
        ok &= ~self.bad[own]
        self.charge(own, np.where(ok, size, 0))
        return ok, np.where(ok, body, 0), np.where(ok, count, 0)

    def many(self, own: np.ndarray, count: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Counts of list elements; too many elements without any width, which no word budget bounds, are marked and count nothing."""
        over = (count > self.limits.elements) & (width == 0)
        if over.any():
            self.mark(own[over])
            count = np.where(over, 0, count)
        return count

    # Fields.

    def struct(self, s: Struct, own, body, d, p, depth: int, valid=None) -> pa.Array:
        columns, names = [], []
        tag = None
        if s.union_at is not None:
            tag = self.scalar("uint16", s.union_at, own, body, d).astype(np.int64)
            known = np.array([f.name for f in s.arms.values()], object)
            index = np.full(65536, -1, np.int32)
            index[list(s.arms)] = np.arange(len(known))
            k = index[tag]
            which = np.where(k >= 0, known[np.maximum(k, 0)], None) if len(known) else np.full(len(tag), None)
            for i in np.flatnonzero(k < 0):
                which[i] = f"#{tag[i]}"
            columns.append(pa.array(which, pa.string()))
            names.append("which")
        for f in s.columns:
            live = np.ones(len(own), bool) if f.tag is None or tag is None else tag == f.tag
            if f.present is not None:
                live &= self.flag(f.present, own, body, d)
            columns.append(self.field(f, own, body, d, p, depth, live))
            names.append(f.name)
        mask = None if valid is None or valid.all() else pa.array(~valid)
        if not columns:
            return pa.array([{}] * len(own), pa.struct([]))
        return pa.StructArray.from_arrays(columns, fields=list(s.arrow()), mask=mask)

    def scalar(self, kind: str, at: int, own, body, d) -> np.ndarray:
        view = self.buf.view(_NP[kind])
        size = view.itemsize
        have = (at + size <= 8 * d) & ~self.bad[own]
        return np.where(have, view[np.where(have, (8 * body + at) // size, 0)], view.dtype.type(0))

    def flag(self, bit: int, own, body, d) -> np.ndarray:
        have = (bit < 64 * d) & ~self.bad[own]
        return np.where(have, self.buf[np.where(have, 8 * body + bit // 8, 0)] >> (bit % 8) & 1, 0).astype(bool)

    def field(self, f: Field, own, body, d, p, depth: int, live) -> pa.Array:
        t = f.type
        if t.kind == "bool":
            v = self.flag(f.at, own, body, d) ^ bool(f.default)
            return pa.array(v, mask=None if live.all() else ~live)
        if t.kind == "group":
            return self.struct(t.struct, own, body, d, p, depth, live)
        if not t.is_pointer:
            v = self.scalar(t.stored, f.at, own, body, d)
            if f.default:
                raw = bits_of(t.stored, _wire_default(t, f.default))
                v = (v.view(f"<u{v.itemsize}") ^ np.array(raw, f"<u{v.itemsize}")).view(v.dtype)
            return scalars(t, v, live)
        slot = body + d + f.at
        have = (f.at < p) & live
        return self.pointer(t, own, slot, have, live, depth + 1, f.default)

    def pointer(self, t: Type, own, slot, have, live, depth: int, default=None) -> pa.Array:
        if t.kind in ("text", "data"):
            ok, at, count = self.lists(own, slot, have, 2, depth)
            start = 8 * at
            if t.kind == "text":
                last = np.where(ok & (count > 0), self.buf[np.maximum(start + count - 1, 0)], 1)
                count = count - (last == 0)
                bom = ok & (count >= 3) & (self.buf[start] == 0xEF) & (self.buf[start + 1] == 0xBB) & (self.buf[start + 2] == 0xBF)
                self.mark(own[bom])
                head = np.where(ok & (count > 0), self.buf[start], 0)
                self.mark(own[(head & 0xC0) == 0x80])
            valid = ok if default is None else live
            if t.kind == "data":
                out = _strings(self.buf, start, np.where(ok, count, 0), pa.binary(), valid)
            else:
                out = self._text(own, start, np.where(ok, count, 0), valid)
            if default and not ok.all():
                fill = pa.scalar(default, out.type)
                out = pa.array(np.where(ok | ~live, out.to_numpy(zero_copy_only=False), fill.as_py()), out.type)
            return out
        if t.kind == "struct":
            ok, at, d, p = self.structs(own, slot, have, depth)
            k = np.flatnonzero(ok)
            inner = self.struct(t.struct, own[k], at[k], d[k], p[k], depth)
            return _scattered(inner, ok)
        if t.kind == "list":
            return self.list(t.element, own, slot, have, live, depth, default)
        if t.kind == "cap":
            w, kind, _ = self.pointers(own, slot, have)
            some = w != 0
            ok = some & (w & np.uint64(0xFFFFFFFF) == 3)
            self.mark(own[some & ~ok])
            index = (w >> np.uint64(32)).astype(np.int64)
            return pa.StructArray.from_arrays([pa.array(index)], fields=list(t.arrow()), mask=pa.array(~ok))
        # Any pointer: read one by one.
        w, _, _ = self.pointers(own, slot, have)
        self.mark(own[w != 0])
        return pa.nulls(len(own), t.arrow())

    def _text(self, own, start, count, valid) -> pa.Array:
        out = _strings(self.buf, start, count, pa.binary(), valid)
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            for i, x in enumerate(out.to_pylist()):
                if x is not None:
                    try:
                        x.decode()
                    except UnicodeDecodeError:
                        self.mark(own[i : i + 1])
                        count[i] = 0
            return _strings(self.buf, start, count, pa.binary(), valid).cast(pa.string())

    def list(self, e: Type, own, slot, have, live, depth: int, default) -> pa.Array:
        shown = lambda ok: ok if default is None else live
        if e.kind == "struct":
            ok, at, words = self.lists(own, slot, have, 7, depth)
            tag = np.where(ok, self.words[at], np.uint64(0))
            count = ((tag & np.uint64(0xFFFFFFFF)) >> np.uint64(2)).astype(np.int64)
            d = ((tag >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
            p = (tag >> np.uint64(48)).astype(np.int64)
            fits = ((tag & np.uint64(3)) == 0) & (count * (d + p) <= words)
            self.mark(own[ok & ~fits])
            count = self.many(own, np.where(ok & fits, count, 0), d + p)
            at, inner_own = np.repeat(at + 1, count) + _within(count) * np.repeat(d + p, count), np.repeat(own, count)
            inner = self.struct(e.struct, inner_own, at, np.repeat(d, count), np.repeat(p, count), depth)
            return _listed(inner, count, shown(ok), e)
        if e.is_pointer:
            ok, at, count = self.lists(own, slot, have, 6, depth)
            at, inner_own = np.repeat(at, count) + _within(count), np.repeat(own, count)
            every = np.ones(len(at), bool)
            inner = self.pointer(e, inner_own, at, every, every, depth + 1, "" if e.kind == "text" else b"" if e.kind == "data" else () if e.kind == "list" else None)
            return _listed(inner, count, shown(ok), e)
        if e.kind == "bool":
            ok, at, count = self.lists(own, slot, have, 1, depth)
            bit = _within(count)
            v = (self.buf[8 * np.repeat(at, count) + bit // 8] >> (bit % 8).astype(np.uint8) & 1).astype(bool)
            return _listed(pa.array(v), count, shown(ok), e)
        if e.kind == "void":
            ok, at, count = self.lists(own, slot, have, 0, depth)
            self.mark(own[ok])
            return pa.nulls(len(own), pa.list_(pa.null()))
        size = e.size
        ok, at, count = self.lists(own, slot, have, ESIZE[size], depth)
        v = self.buf.view(_NP[e.stored])[np.repeat(8 * at // size, count) + _within(count)]
        return _listed(scalars(e, v, np.ones(len(v), bool)), count, shown(ok), e)


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _scattered(inner: pa.Array, ok: np.ndarray) -> pa.Array:
    """Values of ``inner`` at the true places, nulls elsewhere."""
    if ok.all():
        return inner
    index = np.cumsum(ok) - 1
    return inner.take(pa.array(index, mask=~ok))


def _listed(inner: pa.Array, count: np.ndarray, valid: np.ndarray, e: Type) -> pa.Array:
    off = _offsets(count).astype(np.int32)
    kind = pa.list_(e.arrow())
    return pa.Array.from_buffers(kind, len(count), [_bitmap(valid), pa.py_buffer(off.tobytes())], children=[inner if inner.type == kind.value_type else inner.cast(kind.value_type)])


def _wire_default(t: Type, default):
    return t.names.index(default) if t.kind == "enum" and isinstance(default, str) else default


def scalars(t: Type, v: np.ndarray, live: np.ndarray) -> pa.Array:
    """An Arrow array of a scalar type from the numbers on the wire."""
    mask = None if live.all() else ~live
    if t.kind == "enum":
        names = np.array([*t.names, None], object)
        out = names[np.minimum(v.astype(np.int64), len(t.names))]
        for i in np.flatnonzero(v >= len(t.names)):
            out[i] = f"#{v[i]}"
        return pa.array(out, pa.string(), mask=mask)
    if t.kind == "uint64" and not t.bits:
        pairs = np.zeros((len(v), 2), "<u8")
        pairs[:, 0] = v
        return pa.Array.from_buffers(pa.decimal128(20, 0), len(v), [_bitmap(live), pa.py_buffer(pairs.tobytes())])
    if t.kind == "decimal":
        pairs = np.zeros((len(v), 2), "<i8")
        pairs[:, 0] = v
        pairs[:, 1] = np.where(v < 0, -1, 0)
        return pa.Array.from_buffers(t.arrow(), len(v), [_bitmap(live), pa.py_buffer(pairs.tobytes())])
    if t.bits:
        v = v.view("<i8")
    if t.kind == "date":
        return pa.array(v, pa.int32(), mask=mask).cast(pa.date32())
    if t.kind in ("timestamp", "timestamp_ntz"):
        return pa.array(v, pa.int64(), mask=mask).cast(t.arrow())
    return pa.array(v, mask=mask).cast(t.arrow())


def decode(column: pa.Array, s: Struct, limits: Limits = Limits(), mode: str = "FAILFAST") -> tuple[pa.Array, list]:
    """A struct array with the root of each frame, and an error (or None) for each.

    FAILFAST raises the first error; otherwise a bad frame gives a null struct.
    """
    r = _Reader(column, limits)
    n = len(column)
    own = np.arange(n)
    ok, at, d, p = r.structs(own, r.first, ~r.bad, 0)
    out = r.struct(s, own, at, d, p, 0, ok)
    r.bad |= r.spent > limits.words
    errors: list = [None] * n
    again = np.flatnonzero(r.bad)
    if not len(again):
        return out, errors
    values = []
    for i in again.tolist():
        frame = column[i].as_py()
        value, errors[i] = (None, None) if frame is None else rows.decode_row(frame, s, limits)
        if errors[i] is not None and mode == "FAILFAST":
            raise errors[i]
        values.append(value)
    index = own.copy()
    index[again] = n + np.arange(len(again))
    return pa.concat_arrays([out, pa.array(values, s.arrow())]).take(pa.array(index)), errors


# Encoding.


class _Plan:
    """Sizes of a column's objects in words, and how to write them once they have a place."""

    def __init__(self, words: np.ndarray, write):
        self.words, self.write = words, write


class _Writer:
    """The batch's frames in one array of words."""

    def __init__(self, words: int):
        self.buf = np.zeros(8 * words + 64, np.uint8)
        self.words = self.buf.view("<u8")

    def list_pointer(self, slot, at, esize: int, count) -> None:
        off = ((at - slot - 1) & 0x3FFFFFFF).astype(np.uint64)
        self.words[slot] = np.uint64(1 | esize << 32) | off << np.uint64(2) | count.astype(np.uint64) << np.uint64(35)

    def struct_pointer(self, slot, at, d: int, p: int) -> None:
        if not d and not p:
            self.words[slot] = np.uint64(0xFFFFFFFC)
            return
        off = ((at - slot - 1) & 0x3FFFFFFF).astype(np.uint64)
        self.words[slot] = off << np.uint64(2) | np.uint64(d << 32 | p << 48)


def _valid(a: pa.Array) -> np.ndarray:
    return np.ones(len(a), bool) if not a.null_count else a.is_valid().to_numpy(zero_copy_only=False)


def numbers(t: Type, a: pa.Array) -> np.ndarray:
    """The numbers on the wire of a scalar array; nulls are 0."""
    if t.kind == "enum":
        index = {n: i for i, n in enumerate(t.names)}
        return np.array([0 if x is None else index[x] if x in index else int(x[1:]) for x in a.to_pylist()], "<u2")
    if t.kind in ("date", "timestamp", "timestamp_ntz"):
        a = a.cast(pa.int32() if t.kind == "date" else pa.int64())
    elif t.kind == "decimal" or t.kind == "uint64" and pa.types.is_decimal(a.type):
        low = np.frombuffer(a.buffers()[1], "<u8")[2 * a.offset : 2 * (a.offset + len(a)) : 2]
        return np.where(_valid(a), low, np.uint64(0)).view(_NP[t.stored])
    if a.null_count:
        a = a.fill_null(False if pa.types.is_boolean(a.type) else 0)
    v = a.to_numpy(zero_copy_only=False)
    return v.view("<u8") if t.bits else v.astype(_NP[t.stored], copy=False)


def _plan(t: Type, a: pa.Array) -> _Plan:
    """Plan for a pointer column; null objects take no words and leave a null pointer."""
    live = _valid(a)
    if t.kind in ("text", "data"):
        raw, start, length = binary_parts(a)
        extra = int(t.kind == "text")
        words = np.where(live, (length + extra + 7) // 8, 0)

        def write(w: _Writer, slot, at, k) -> None:
            k = k[live[k]]
            w.list_pointer(slot[k], at[k], 2, length[k] + extra)
            w.buf[_ranges(8 * at[k], length[k])] = raw[_ranges(start[k], length[k])]

        return _Plan(words, write)
    if t.kind == "struct":
        return _struct_plan(t.struct, a, live)
    if t.kind == "list":
        return _list_plan(t.element, a, live)
    if t.kind == "cap":
        index = a.field(0).fill_null(0).to_numpy(zero_copy_only=False) if len(a) else np.zeros(0, np.int64)

        def write_cap(w: _Writer, slot, at, k) -> None:
            k = k[live[k]]
            w.words[slot[k]] = np.uint64(3) | index[k].astype(np.uint64) << np.uint64(32)

        return _Plan(np.zeros(len(a), np.int64), write_cap)
    # Any pointer: the value is a frame of its own, copied in as one object after a pointer to it.
    bodies = [None if x is None else rows.single_segment(x) for x in a.to_pylist()]
    words = np.array([0 if b is None else len(b) // 8 - 1 for b in bodies], np.int64)

    def write_any(w: _Writer, slot, at, k) -> None:
        for i in k:
            if bodies[i] is not None:
                # The root pointer moves from the word before the body to the slot.
                root = int.from_bytes(bodies[i][:8], "little")
                if root and root & 3 in (0, 1) and root != 0xFFFFFFFC:
                    low = (root & 0xFFFFFFFF) >> 2
                    off = (low - (1 << 30) if low >> 29 else low) + int(at[i]) - 1 - int(slot[i])
                    root = root & ~0xFFFFFFFC | (off & 0x3FFFFFFF) << 2
                w.words[slot[i]] = np.uint64(root)
                body = bodies[i][8:]
                w.buf[8 * at[i] : 8 * at[i] + len(body)] = np.frombuffer(body, np.uint8)

    return _Plan(words, write_any)


def _members(s: Struct, a: pa.StructArray) -> dict[str, pa.Array]:
    # Children of a null struct count as null.
    return {a.type.field(i).name: c for i, c in enumerate(a.flatten())}


def _body(s: Struct, a: pa.StructArray):
    """(words of all children, write) for the content of structs; ``write`` gets body and first child places."""
    have = _members(s, a)
    n = len(a)
    parts: list = []  # (field, content of a group | plan of a pointer | scalars, live arm)
    tag = None
    if s.union_at is not None:
        number = {f.name: t for t, f in s.arms.items()}
        said = have["which"].to_pylist()
        if any(x is not None and x not in number and not x.startswith("#") for x in said):
            raise rows.FrameError("ARG", f"{s.name} has no such arm")
        tag = np.array([0 if x is None else number[x] if x in number else int(x[1:]) for x in said], np.int64)
    for f in s.columns:
        if f.name not in have:
            continue
        column = have[f.name]
        arm = None if f.tag is None or tag is None else tag == f.tag
        if f.type.kind == "group":
            parts.append((f, _body(f.type.struct, column), arm))
        elif f.type.is_pointer:
            if arm is not None and not arm.all():
                column = column.take(pa.array(np.arange(n), mask=~arm))
            parts.append((f, _plan(f.type, column), None))
        else:
            parts.append((f, column, arm))
    words = np.zeros(n, np.int64)
    for _, x, _ in parts:
        if isinstance(x, _Plan):
            words += x.words
        elif isinstance(x, tuple):
            words += x[0]

    def write(w: _Writer, body, child, k, dwords: int = s.dwords) -> None:
        if tag is not None:
            w.buf.view("<u2")[(8 * body[k] + s.union_at) // 2] = tag[k].astype("<u2")
        at = child.copy()
        for f, x, arm in parts:
            if isinstance(x, _Plan):
                x.write(w, body + dwords + f.at, at, k)
                at += x.words
                continue
            j = k if arm is None else k[arm[k]]
            if isinstance(x, tuple):
                x[1](w, body, at, j, dwords)
                at += x[0]
                continue
            live = _valid(x)
            if f.present is not None:
                on = j[live[j]]
                w.buf[8 * body[on] + f.present // 8] |= np.uint8(1 << f.present % 8)
            j = j[live[j]]
            if f.type.kind == "bool":
                v = x.fill_null(False).to_numpy(zero_copy_only=False) ^ bool(f.default)
                w.buf[8 * body[j] + f.at // 8] |= (v[j].astype(np.uint8) << np.uint8(f.at % 8)).astype(np.uint8)
                continue
            v = numbers(f.type, x)
            if f.default:
                raw = bits_of(f.type.stored, _wire_default(f.type, f.default))
                v = v.view(f"<u{v.itemsize}") ^ np.array(raw, f"<u{v.itemsize}")
            w.buf.view(v.dtype)[(8 * body[j] + f.at) // v.itemsize] = v[j]

    return words, write


def _struct_plan(s: Struct, a: pa.StructArray, live: np.ndarray) -> _Plan:
    inner, write_body = _body(s, a)
    size = s.dwords + s.pwords

    def write(w: _Writer, slot, at, k) -> None:
        k = k[live[k]]
        w.struct_pointer(slot[k], at[k], s.dwords, s.pwords)
        write_body(w, at, at + size, k)

    return _Plan(np.where(live, size + inner, 0), write)


def _list_plan(e: Type, a: pa.Array, live: np.ndarray) -> _Plan:
    off = a.offsets.to_numpy().astype(np.int64)
    count = np.where(live, np.diff(off), 0)
    values = a.values.slice(off[0], off[-1] - off[0]) if len(off) else a.values
    if not live.all() and (np.diff(off)[~live] != 0).any():
        values = values.take(pa.array(_ranges(off[:-1] - off[0], count)))
    first = np.cumsum(count) - count  # of each list, among the values
    if e.kind == "struct":
        inner, write_body = _body(e.struct, values)
        size = e.struct.dwords + e.struct.pwords
        before = _offsets(inner)
        words = np.where(live, 1 + count * size + before[first + count] - before[first], 0)

        def write(w: _Writer, slot, at, k) -> None:
            k = k[live[k]]
            w.list_pointer(slot[k], at[k], 7, count[k] * size)
            w.words[at[k]] = count[k].astype(np.uint64) << np.uint64(2) | np.uint64(e.struct.dwords << 32 | e.struct.pwords << 48)
            m, body, child = _ranges(first[k], count[k]), np.zeros(len(inner), np.int64), np.zeros(len(inner), np.int64)
            body[m] = np.repeat(at[k] + 1, count[k]) + _within(count[k]) * size
            child[m] = np.repeat(at[k] + 1 + count[k] * size - before[first[k]], count[k]) + before[m]
            write_body(w, body, child, m)

        return _Plan(words, write)
    if e.is_pointer:
        p = _plan(e, values)
        before = _offsets(p.words)
        words = np.where(live, count + before[first + count] - before[first], 0)

        def write_pointers(w: _Writer, slot, at, k) -> None:
            k = k[live[k]]
            w.list_pointer(slot[k], at[k], 6, count[k])
            m, own, child = _ranges(first[k], count[k]), np.zeros(len(p.words), np.int64), np.zeros(len(p.words), np.int64)
            own[m] = np.repeat(at[k], count[k]) + _within(count[k])
            child[m] = np.repeat(at[k] + count[k] - before[first[k]], count[k]) + before[m]
            p.write(w, own, child, m)

        return _Plan(words, write_pointers)
    if e.kind == "bool":
        v = values.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)

        def write_bits(w: _Writer, slot, at, k) -> None:
            k = k[live[k]]
            w.list_pointer(slot[k], at[k], 1, count[k])
            bit = _within(count[k])
            np.bitwise_or.at(w.buf, 8 * np.repeat(at[k], count[k]) + bit // 8, v[_ranges(first[k], count[k])] << (bit % 8).astype(np.uint8))

        return _Plan(np.where(live, (count + 63) // 64, 0), write_bits)
    if e.kind == "void":
        return _Plan(np.zeros(len(a), np.int64), lambda w, slot, at, k: w.list_pointer(slot[k[live[k]]], at[k[live[k]]], 0, count[k[live[k]]]))
    v = numbers(e, values)

    def write_numbers(w: _Writer, slot, at, k) -> None:
        k = k[live[k]]
        w.list_pointer(slot[k], at[k], ESIZE[e.size], count[k])
        w.buf.view(v.dtype)[np.repeat(8 * at[k] // e.size, count[k]) + _within(count[k])] = v[_ranges(first[k], count[k])]

    return _Plan(np.where(live, (count * e.size + 7) // 8, 0), write_numbers)


def encode(a: pa.StructArray, s: Struct) -> pa.Array:
    """One single-segment frame for each struct: objects in preorder, fields in order. A null struct gives a null root pointer."""
    n = len(a)
    live = _valid(a)
    plan = _struct_plan(s, a, live)
    size = 2 + plan.words  # table, root pointer, body
    base = _offsets(size)
    w = _Writer(int(base[-1]))
    w.words[base[:-1]] = (size - 1).astype(np.uint64) << np.uint64(32)
    plan.write(w, base[:-1] + 1, base[:-1] + 2, np.arange(n))
    if 8 * int(base[-1]) >= 1 << 31:
        raise rows.FrameError("ALLOC", "a batch of 2 GB; use fewer rows a batch")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((8 * base).astype(np.int32).tobytes()), pa.py_buffer(w.buf[: 8 * int(base[-1])].tobytes())])
