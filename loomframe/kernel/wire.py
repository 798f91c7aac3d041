"""Words and pointers of the frame format: 8-byte little-endian words, pointer bit fields, errors and limits."""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Fixed values of the format.
STRUCT, LIST, FAR, CAP = 0, 1, 2, 3
VOID, BIT, BYTE, TWO, FOUR, EIGHT, POINTER, COMPOSITE = range(8)
#: Bits from one list element to the next, by element size; composite lists have their own step.
STEP_BITS = (0, 1, 8, 16, 32, 64, 64, 0)
ERROR_CODES = ("ARG", "ALLOC", "FRAMING", "BOUNDS", "SEGMENT", "KIND", "DEPTH", "TRAVERSAL", "PACKED", "CANONICAL", "UNSUPPORTED")
EMPTY_STRUCT = 0xFFFFFFFC
MAX_SEGMENT_WORDS = 1 << 29

M64 = (1 << 64) - 1


class FrameError(Exception):
    """A refused frame or request; ``code`` is one of ERROR_CODES."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
        self.message = message

    def __reduce__(self):
        return FrameError, (self.code, self.message)


def need(ok: object, code: str, message: str = "") -> None:
    if not ok:
        raise FrameError(code, message)


@dataclass(frozen=True)
class Limits:
    """Defences against hostile frames; the reader charges words against ``words`` once per visit.

    ``elements`` bounds lists whose elements have no width; all others are bounded by their words.
    """

    words: int = 8 << 20
    depth: int = 64
    segments: int = 512
    elements: int = 1 << 20


@dataclass(frozen=True)
class Pointer:
    """Bit fields of a pointer word."""

    kind: int
    offset: int = 0  # signed words from the end of the pointer
    dwords: int = 0
    pwords: int = 0
    esize: int = 0
    count: int = 0
    two: bool = False
    segment: int = 0
    cap: int = 0

    @staticmethod
    def of(word: int) -> Pointer:
        kind, top = word & 3, word >> 32
        low = (word & 0xFFFFFFFF) >> 2
        signed = low - (1 << 30) if low >> 29 else low
        if kind == STRUCT:
            return Pointer(kind, signed, top & 0xFFFF, top >> 16)
        if kind == LIST:
            return Pointer(kind, signed, esize=top & 7, count=top >> 3)
        if kind == FAR:
            return Pointer(kind, low >> 1, two=bool(low & 1), segment=top)
        return Pointer(kind, low, cap=top)


def struct_word(offset: int, dwords: int, pwords: int) -> int:
    return (offset & 0x3FFFFFFF) << 2 | (dwords & 0xFFFF) << 32 | (pwords & 0xFFFF) << 48


def list_word(offset: int, esize: int, count: int) -> int:
    return LIST | (offset & 0x3FFFFFFF) << 2 | (esize & 7) << 32 | (count & 0x1FFFFFFF) << 35


def far_word(two: bool, offset: int, segment: int) -> int:
    return FAR | int(two) << 2 | (offset & 0x1FFFFFFF) << 3 | (segment & 0xFFFFFFFF) << 32


def cap_word(index: int) -> int:
    return CAP | (index & 0xFFFFFFFF) << 32


def list_words(esize: int, count: int) -> int:
    """Words of a list's body (without a composite list's tag)."""
    return (count * STEP_BITS[esize] + 63) // 64


def word_at(data, index: int) -> int:
    return int.from_bytes(data[8 * index : 8 * index + 8], "little")


_CODES = {"int8": "<b", "int16": "<h", "int32": "<i", "int64": "<q", "uint8": "<B", "uint16": "<H", "uint32": "<I", "uint64": "<Q", "float32": "<f", "float64": "<d"}


def load(data, at: int, kind: str):
    return struct.unpack_from(_CODES[kind], data, at)[0]


def store(data, at: int, kind: str, value) -> None:
    struct.pack_into(_CODES[kind], data, at, value)


def bits(kind: str, value) -> int:
    """The bits of a scalar as an unsigned number."""
    return int.from_bytes(struct.pack(_CODES[kind], value), "little")


def scalar(kind: str, raw: int):
    """The scalar whose bits are ``raw``."""
    return struct.unpack(_CODES[kind], raw.to_bytes(struct.calcsize(_CODES[kind]), "little"))[0]


def size_of(kind: str) -> int:
    return struct.calcsize(_CODES[kind])


def frame_of(segments: list) -> bytes:
    """Segment table and bodies; each segment is word-aligned bytes."""
    n = len(segments)
    need(1 <= n <= 512, "FRAMING", f"{n} segments")
    need(all(len(s) % 8 == 0 for s in segments), "FRAMING", "a segment is not word-aligned")
    head = struct.pack(f"<{n + 1}I", n - 1, *(len(s) // 8 for s in segments))
    return head + b"\0" * (-len(head) % 8) + b"".join(bytes(s) for s in segments)


def frame_length(data, most: int = 64) -> int:
    """Bytes of the frame at the start of ``data``; 0 if its table or body is not complete."""
    if len(data) < 4:
        return 0
    n = int.from_bytes(data[:4], "little") + 1
    need(n <= most, "FRAMING", f"{n} segments")
    head = (4 + 4 * n + 7) & ~7
    if len(data) < head:
        return 0
    total = head + 8 * sum(struct.unpack_from(f"<{n}I", data, 4))
    return total if len(data) >= total else 0
