"""Expressions that stay in the JVM: words, pointers, frame headers, framing, list views.

They cover what has a fixed place: the segment table, and fields of the root of a
single-segment frame whose root pointer is near. ``fixed_field`` guards for this
and gives null elsewhere, where ``operators.frames.decode`` reads any frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _hex(c: Column, at: Column, size: int) -> Column:
    """Hex digits of ``size`` bytes at ``at`` (from 0), most significant byte first."""
    return F.concat(*[F.hex(F.substring(c, at + k, 1)) for k in range(size, 0, -1)])


def le_uint(c: Column | str, at: Column | int, size: int) -> Column:
    """A little-endian unsigned number of 1, 2 or 4 bytes at byte ``at``; null beyond the end."""
    c, at = _c(c), F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(c) >= at + size, F.conv(_hex(c, at, size), 16, 10).cast("long"))


def le_int(c: Column | str, at: Column | int, size: int) -> Column:
    """A little-endian signed number of 1, 2, 4 or 8 bytes."""
    c, at = _c(c), F.lit(at) if isinstance(at, int) else at
    if size < 8:
        v = le_uint(c, at, size)
        return F.when(v >= 1 << (8 * size - 1), v - (1 << 8 * size)).otherwise(v)
    low, high = le_uint(c, at, 4), le_uint(c, at + 4, 4)
    signed = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
    return F.shiftleft(signed, 32).bitwiseOR(low)


def le_bytes(c: Column | str, size: int) -> Column:
    """The number's ``size`` low bytes, least significant first, as binary."""
    c = _c(c).cast("long")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)]))


def segment_count(c: Column | str) -> Column:
    return le_uint(c, 0, 4) + 1


def segment_words(c: Column | str) -> Column:
    """Sizes of a frame's segments in words, as an array."""
    c = _c(c)
    return F.transform(F.sequence(F.lit(1), segment_count(c).cast("int")), lambda i: le_uint(c, 4 * i, 4))


def header_bytes(c: Column | str) -> Column:
    """Bytes of the segment table."""
    return F.shiftleft(F.shiftright(4 + 4 * segment_count(c) + 7, 3), 3)


def frame_bytes(c: Column | str) -> Column:
    """Bytes of the frame that its segment table promises."""
    return header_bytes(c) + 8 * F.aggregate(segment_words(c), F.lit(0).cast("long"), lambda a, x: a + x)


def frame_segments(segments: Column | str) -> Column:
    """A frame from an array of word-aligned segments."""
    s = _c(segments)
    sizes = F.aggregate(F.transform(s, lambda x: le_bytes(F.octet_length(x) / 8, 4)), F.lit(b""), lambda a, x: F.concat(a, x))
    pad = F.when(F.size(s) % 2 == 0, F.lit(b"\0\0\0\0")).otherwise(F.lit(b""))
    body = F.aggregate(s, F.lit(b""), lambda a, x: F.concat(a, x))
    framed = F.concat(le_bytes(F.size(s) - 1, 4), sizes, pad, body)
    fine = (F.size(s) >= 1) & (F.size(s) <= 512) & F.forall(s, lambda x: F.octet_length(x) % 8 == 0)
    return F.when(s.isNull(), F.lit(None)).when(fine, framed).otherwise(F.raise_error(F.lit("FRAMING: segments")).cast("binary"))


def split_segments(c: Column | str) -> Column:
    """The segments of a frame, as an array of binary."""
    c = _c(c)
    words = segment_words(c)
    ends = F.aggregate(words, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x)))
    return F.zip_with(words, ends, lambda w, e: F.substring(c, (header_bytes(c) + 8 * (e - w) + 1).cast("int"), (8 * w).cast("int")))


# Pointer words as longs.


def pointer_kind(w: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, ("struct", "list", "far", "capability"))), _c(w).bitwiseAND(F.lit(3)).cast("int") + 1)


def pointer_offset(w: Column | str) -> Column:
    """Signed offset in words of a struct or list pointer."""
    return F.shiftright(F.shiftleft(_c(w).bitwiseAND(F.lit(0xFFFFFFFF)), 32), 34)


def pointer_dwords(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w), 32).bitwiseAND(F.lit(0xFFFF))


def pointer_pwords(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w), 48)


def list_esize(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w), 32).bitwiseAND(F.lit(7))


def list_count(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w), 35)


def far_two(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w), 2).bitwiseAND(F.lit(1)) == 1


def far_offset(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w).bitwiseAND(F.lit(0xFFFFFFFF)), 3)


def far_segment(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w), 32)


def cap_index(w: Column | str) -> Column:
    return F.shiftrightunsigned(_c(w), 32)


def make_struct(offset: Column, dwords: Column, pwords: Column) -> Column:
    """A struct pointer; offsets keep 30 bits and dimensions 16."""
    low = F.shiftleft(offset.cast("long").bitwiseAND(F.lit(0x3FFFFFFF)), 2)
    return low.bitwiseOR(F.shiftleft(dwords.cast("long").bitwiseAND(F.lit(0xFFFF)), 32)).bitwiseOR(F.shiftleft(pwords.cast("long").bitwiseAND(F.lit(0xFFFF)), 48))


def make_list(offset: Column, esize: Column, count: Column) -> Column:
    low = F.shiftleft(offset.cast("long").bitwiseAND(F.lit(0x3FFFFFFF)), 2).bitwiseOR(F.lit(1))
    return low.bitwiseOR(F.shiftleft(esize.cast("long").bitwiseAND(F.lit(7)), 32)).bitwiseOR(F.shiftleft(count.cast("long").bitwiseAND(F.lit(0x1FFFFFFF)), 35))


def make_far(two: Column, offset: Column, segment: Column) -> Column:
    low = F.shiftleft(offset.cast("long").bitwiseAND(F.lit(0x1FFFFFFF)), 3).bitwiseOR(F.shiftleft(two.cast("int").cast("long"), 2)).bitwiseOR(F.lit(2))
    return low.bitwiseOR(F.shiftleft(segment.cast("long"), 32))


def make_cap(index: Column) -> Column:
    return F.lit(3).cast("long").bitwiseOR(F.shiftleft(index.cast("long"), 32))


def step_bits(esize: Column | str) -> Column:
    """Bits from one list element to the next, by element size code."""
    return F.get(F.array(*map(F.lit, (0, 1, 8, 16, 32, 64, 64, 0))), _c(esize).cast("int"))


def list_words(esize: Column | str, count: Column | str) -> Column:
    return F.floor((_c(count) * step_bits(esize) + 63) / 64)


# Fields of the root at fixed places.


def fixed_field(frame: Column | str, at: int, kind: str, default: int = 0) -> Column:
    """A scalar (int8..int64, uint8..uint32, bool) of the root struct; null unless the root is near and in one segment."""
    c = _c(frame)
    root = le_int(c, 8, 8)
    plain = (segment_count(c) == 1) & (root.bitwiseAND(F.lit(3)) == 0) & (root != 0)
    body = 16 + 8 * pointer_offset(root)
    if kind == "bool":
        bit = F.shiftright(le_uint(c, body + at // 8, 1), at % 8).bitwiseAND(F.lit(1))
        inside = F.when(64 * pointer_dwords(root) > at, bit == (0 if default else 1)).otherwise(bool(default))
        return F.when(plain, inside)
    size = int(kind.lstrip("uint")) // 8
    raw = (le_uint if kind.startswith("u") and size < 8 else le_int)(c, body + at, size)
    value = raw.bitwiseXOR(F.lit(default).cast("long")) if default else raw
    return F.when(plain, F.when(8 * pointer_dwords(root) >= at + size, value).otherwise(F.lit(default).cast("long")))


# Lists after decoding: evolution between lists of scalars, pointers and structs.


def list_length(c: Column | str) -> Column:
    """Elements of a list; a null list has none."""
    return F.coalesce(F.size(F.when(_c(c).isNotNull(), _c(c))), F.lit(0))


def list_at(c: Column | str, i: Column | int, default: Column | None = None) -> Column:
    """An element, or the default beyond the end; a negative index is an error."""
    i = F.lit(i) if isinstance(i, int) else i
    value = F.get(_c(c), i)
    value = value if default is None else F.coalesce(value, default)
    return F.when(i < 0, F.raise_error(F.lit("BOUNDS: negative index"))).otherwise(value)


def lift_scalars(c: Column | str, name: str = "f0", **defaults: Column) -> Column:
    """A list of scalars or pointers seen as structs: the element is the first field, the others have their defaults."""
    return F.transform(_c(c), lambda x: F.struct(x.alias(name), *[v.alias(k) for k, v in defaults.items()]))


def lift_void(count: Column, **defaults: Column) -> Column:
    """A list of voids seen as structs with default fields."""
    return F.array_repeat(F.struct(*[v.alias(k) for k, v in defaults.items()]), count.cast("int"))


def lift_bits(c: Column | str) -> Column:
    """A list of bits cannot be seen as structs."""
    return F.raise_error(F.lit("KIND: a list of bits is no list of structs"))


def lower_structs(c: Column | str, name: str) -> Column:
    """A list of structs seen as a list of their first field."""
    return F.transform(_c(c), lambda x: x.getField(name))
