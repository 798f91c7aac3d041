"""Frames one by one: the exact reading that the columnar decoder falls back to."""

from __future__ import annotations

from decimal import Decimal

from ..layout import Field, Struct, Type
from .reader import Frame, Ref
from .transform import reframe, resegment
from .wire import BIT, COMPOSITE, LIST, STRUCT, VOID, FrameError, Limits, need

_UNSIGNED = {"uint64"}


def decode_row(data, s: Struct, limits: Limits) -> tuple[dict | None, FrameError | None]:
    """The root of a frame as a dict, or the error that reading it gives."""
    try:
        frame = Frame.parse(data, limits)
        root = frame.root()
        return (None if root.null else struct_value(root, s)), None
    except FrameError as e:
        return None, e
    except (ValueError, OverflowError) as e:
        return None, FrameError("ARG", str(e))


def struct_value(ref: Ref, s: Struct) -> dict:
    need(ref.kind == STRUCT, "KIND", f"{s.name} is no struct here")
    out, tag = {}, None
    if s.union_at is not None:
        tag = ref.number(s.union_at, "uint16")
        out["which"] = s.arms[tag].name if tag in s.arms else f"#{tag}"
    for f in s.columns:
        live = f.tag is None or tag is None or f.tag == tag
        out[f.name] = field_value(ref, f) if live and (f.present is None or ref.flag(f.present)) else None
    return out


def field_value(ref: Ref, f: Field):
    t = f.type
    if t.kind == "group":
        return struct_value(ref, t.struct)
    if t.kind == "bool":
        return ref.flag(f.at, bool(f.default))
    if not t.is_pointer:
        default = t.names.index(f.default) if t.kind == "enum" and isinstance(f.default, str) else f.default or 0
        return scalar_value(t, ref.number(f.at, t.stored, default))
    return pointer_value(t, ref.pointer(f.at), f.default)


def scalar_value(t: Type, v):
    if t.kind == "enum":
        return t.names[v] if v < len(t.names) else f"#{v}"
    if t.kind == "uint64":
        return v - (1 << 64) * (v >> 63) if t.bits else Decimal(v)
    if t.kind == "decimal":
        return Decimal(v).scaleb(-t.scale)
    return v


def pointer_value(t: Type, ref: Ref, default=None):
    if t.kind == "text":
        return None if ref.null and default is None else ref.as_text(default or "")
    if t.kind == "data":
        return None if ref.null and default is None else ref.as_data(default or b"")
    if ref.null:
        return [] if t.kind == "list" and default is not None else None
    if t.kind == "any":
        return reframe(ref)
    if t.kind == "cap":
        need(ref.kind == 3, "KIND", "no capability")
        return {"cap_index": ref.count}
    if t.kind == "struct":
        return struct_value(ref, t.struct)
    need(ref.kind == LIST, "KIND", "no list")
    free = ref.esize == VOID or ref.esize == COMPOSITE and not ref.dwords + ref.pwords
    need(not free or len(ref) <= ref.frame.limits.elements, "TRAVERSAL", f"{len(ref)} list elements without width")
    return [element_value(t.element, ref, i) for i in range(len(ref))]


def element_value(e: Type, ref: Ref, i: int):
    """An element as the reader's schema has it, whatever width the writer used."""
    if e.kind == "struct":
        return struct_value(ref.element_struct(i), e.struct)
    if e.kind == "bool":
        need(ref.esize == BIT, "KIND", "no list of bits")
        return ref.element_flag(i)
    if e.kind == "void":
        return None
    if e.kind == "text":
        return ref.element_text(i)
    if e.is_pointer:
        return pointer_value(e, ref.element_pointer(i), () if e.kind == "list" else b"" if e.kind == "data" else None)
    return scalar_value(e, ref.element_number(i, e.stored))


def single_segment(data) -> bytes:
    """The only segment of a frame, rebuilt into one if it has several."""
    if int.from_bytes(data[:4], "little"):
        data = resegment(Frame.parse(data), 1 << 20, 1 << 29)
    return bytes(data[8:])
