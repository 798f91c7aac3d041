"""Packing and unpacking whole columns of frames with numpy.

Packing looks at all words of a batch at once. Unpacking goes tag by tag, the k-th
tag of every frame in one step; long packed frames, and whatever is refused, go
through the frame-by-frame functions of ``transform``, which give the exact error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import transform
from .columnar import _bitmap, _offsets, _ranges, binary_parts
from .wire import FrameError

#: Packed bytes from which a frame is unpacked alone.
LONG = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
_COUNT = _BITS.sum(axis=1)


def _column(valid: np.ndarray, size: np.ndarray, body: np.ndarray) -> pa.Array:
    off = _offsets(size)
    if off[-1] >= 1 << 31:
        raise FrameError("ALLOC", "a batch of 2 GB; use fewer rows a batch")
    return pa.Array.from_buffers(pa.binary(), len(size), [_bitmap(valid), pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def pack(column: pa.Array) -> pa.Array:
    """The packed form of each frame; ARG if a length is no multiple of 8. Nulls stay null."""
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    raw, start, length = binary_parts(column)
    length = np.where(valid, length, 0)
    if (length % 8).any():
        raise FrameError("ARG", "length is not a multiple of 8")
    per = length // 8
    n = int(per.sum())
    if not n:
        return _column(valid, per, np.zeros(0, np.uint8))
    w = raw[_ranges(start, length)].reshape(-1, 8)
    some = w != 0
    count = some.sum(axis=1)
    tag = np.packbits(some, axis=1, bitorder="little").ravel()
    head = np.zeros(n + 1, bool)  # first words of frames, and the end
    head[_offsets(per)] = True
    size = 1 + count  # bytes that each word becomes; a tag and what is not zero
    extra = np.zeros(n, np.int64)  # length of the run that a word begins

    zero = count == 0
    first, run = _stretches(zero, head)
    at = np.arange(n)
    inside = np.zeros(n, np.int64)  # place within the stretch
    k = np.flatnonzero(zero)
    inside[k] = k - np.repeat(first, run)
    left = np.zeros(n, np.int64)
    left[k] = np.repeat(first + run, run) - k
    lead = zero & (inside % 256 == 0)
    size[zero] = np.where(lead[zero], 2, 0)
    extra[lead] = np.minimum(left[lead], 256) - 1

    dense, full = count >= 7, count == 8
    first, run = _stretches(dense, head)
    end = first + run
    upcoming = np.where(full, at, n)
    upcoming = np.append(np.minimum.accumulate(upcoming[::-1])[::-1], n)
    opens = np.zeros(n, bool)
    plain = np.zeros(n, bool)  # verbatim words of a run
    while len(first):
        s = upcoming[first]
        go = s < end
        s, end = s[go], end[go]
        body = np.minimum(end - s - 1, 255)
        opens[s] = True
        extra[s] = body
        plain[_ranges(s + 1, body)] = True
        first = s + 1 + body
        more = first < end
        first, end = first[more], end[more]
    size[opens] = 10
    size[plain] = 8

    off = _offsets(size)
    out = np.zeros(int(off[-1]), np.uint8)
    tagged = ~plain & (~zero | lead)
    out[off[:-1][tagged]] = tag[tagged]
    out[off[:-1][lead] + 1] = extra[lead]
    out[off[:-1][opens] + 9] = extra[opens]
    keep = some | plain[:, None]
    place = np.cumsum(keep, axis=1) - 1 + (off[:-1] + ~plain)[:, None]
    out[place[keep]] = w[keep]
    ends = _offsets(per)
    return _column(valid, off[ends[1:]] - off[ends[:-1]], out)


def _stretches(flag: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of true values that do not cross the start of a frame."""
    begin = flag & (np.concatenate(([True], ~flag[:-1])) | head[:-1])
    stop = flag & (np.concatenate((~flag[1:], [True])) | head[1:])
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(stop) + 1 - first


def unpack(column: pa.Array, max_words: int = transform.UNPACK_WORDS, mode: str = "FAILFAST") -> pa.Array:
    """The inverse; refused frames raise PACKED, or become null with another mode. Nulls stay null."""
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    raw, start, length = binary_parts(column)
    alone = valid & (length > LONG)
    live = np.flatnonzero(valid & ~alone & (length > 0))
    words = np.zeros(len(column), np.int64)
    src, end = start[live], (start + length)[live]
    data = np.append(raw, np.zeros(16, np.uint8))
    steps: list[tuple[np.ndarray, ...]] = []  # frame, first word, tag, source, verbatim words
    bad = np.zeros(len(column), bool)
    while len(live):
        tag = data[src]
        n = _COUNT[tag]
        body = src + 1 + n
        runs = (tag == 0) | (tag == 255)
        more = np.where(runs, data[np.minimum(body, len(raw))].astype(np.int64), 0)
        stop = body + runs + np.where(tag == 255, 8 * more, 0)
        made = 1 + more
        wrong = (stop > end) | (words[live] + made > max_words)
        bad[live[wrong]] = True
        ok = ~wrong
        live, src, end, tag, body, more, stop, made = (x[ok] for x in (live, src, end, tag, body, more, stop, made))
        steps.append((live, words[live], tag, src + 1, np.where(tag == 255, more, 0), body + 1))
        words[live] += made
        on = stop < end
        live, src, end = live[on], stop[on], end[on]
    lone: dict[int, bytes] = {}
    for i in np.flatnonzero(alone | bad).tolist():
        try:
            lone[i] = transform.unpack(column[i].as_py(), max_words)
            words[i] = len(lone[i]) // 8
        except FrameError:
            if mode == "FAILFAST":
                raise
            valid[i], words[i] = False, 0
    base = _offsets(words)
    out = np.zeros(8 * int(base[-1]), np.uint8)
    for frame, word, tag, at, verbatim, text in steps:
        fine = ~bad[frame]
        frame, word, tag, at, verbatim, text = (x[fine] for x in (frame, word, tag, at, verbatim, text))
        to = 8 * (base[frame] + word)
        bits = _BITS[tag]
        rank = np.cumsum(bits, axis=1) - 1
        out[(to[:, None] + np.arange(8))[bits]] = data[(at[:, None] + rank)[bits]]
        v = verbatim > 0
        if v.any():
            out[_ranges(to[v] + 8, 8 * verbatim[v])] = data[_ranges(text[v], 8 * verbatim[v])]
    for i, x in lone.items():
        out[8 * base[i] : 8 * base[i + 1]] = np.frombuffer(x, np.uint8)
    return _column(valid, 8 * words, out)
