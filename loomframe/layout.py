"""Layouts: where the fields of a struct lie in a frame, and what Spark type they become.

A layout is plain data, so it travels with a task. It comes from a literal
(``Struct``/``Field``), from a compiled schema (``loomframe.plans.schema``), or is
laid out automatically from a Spark schema (``layout_of``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import types as T

#: Bytes of scalar types.
SIZES = {"int8": 1, "int16": 2, "int32": 4, "int64": 8, "uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "float32": 4, "float64": 8, "enum": 2}
#: List element size code of scalar widths.
ESIZE = {1: 2, 2: 3, 4: 4, 8: 5}

_SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "text": T.StringType(), "data": T.BinaryType(), "enum": T.StringType(), "any": T.BinaryType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}
_ARROW = {
    "bool": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(),
    "uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0),
    "float32": pa.float32(), "float64": pa.float64(), "text": pa.string(), "data": pa.binary(), "enum": pa.string(), "any": pa.binary(),
    "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"),
}


@dataclass(frozen=True)
class Type:
    """A field's type. ``kind`` is a scalar's name, or void, text, data, any, cap, list, struct or group.

    ``stored`` is the scalar on the wire where the Spark type has none of its own:
    dates are int32 days, timestamps int64 microseconds, decimals int64 unscaled.
    """

    kind: str
    element: Type | None = None
    struct: Struct | None = None
    names: tuple[str, ...] = ()
    precision: int = 0
    scale: int = 0
    bits: bool = False  # a uint64 as the signed long of its bits

    @property
    def stored(self) -> str:
        return {"date": "int32", "timestamp": "int64", "timestamp_ntz": "int64", "decimal": "int64", "enum": "uint16"}.get(self.kind, self.kind)

    @property
    def is_pointer(self) -> bool:
        return self.kind in ("text", "data", "any", "cap", "list", "struct")

    @property
    def size(self) -> int:
        return SIZES[self.stored]

    def spark(self) -> T.DataType:
        if self.kind == "list":
            return T.ArrayType(self.element.spark(), False)
        if self.kind in ("struct", "group"):
            return self.struct.spark()
        if self.kind == "cap":
            return T.StructType([T.StructField("cap_index", T.LongType(), False)])
        if self.kind == "decimal":
            return T.DecimalType(self.precision, self.scale)
        return T.LongType() if self.bits else _SPARK[self.kind]

    def arrow(self) -> pa.DataType:
        if self.kind == "list":
            return pa.list_(self.element.arrow())
        if self.kind in ("struct", "group"):
            return self.struct.arrow()
        if self.kind == "cap":
            return pa.struct([("cap_index", pa.int64())])
        if self.kind == "decimal":
            return pa.decimal128(self.precision, self.scale)
        return pa.int64() if self.bits else _ARROW[self.kind]


@dataclass(frozen=True)
class Field:
    """``at``: bit of a bool, byte of another scalar, slot of a pointer. ``tag``: discriminant of a union's arm.

    ``present``: bit that says whether the value is not null.
    """

    name: str
    type: Type
    at: int = 0
    default: object = 0
    tag: int | None = None
    present: int | None = None


@dataclass(frozen=True)
class Struct:
    """Dimensions and fields; ``union_at`` is the byte of the union's discriminant, if there is one."""

    name: str
    dwords: int
    pwords: int
    fields: tuple[Field, ...]
    union_at: int | None = None

    @cached_property
    def arms(self) -> dict[int, Field]:
        return {f.tag: f for f in self.fields if f.tag is not None}

    @property
    def columns(self) -> tuple[Field, ...]:
        """Fields that become columns; a void has no value."""
        return tuple(f for f in self.fields if f.type.kind != "void")

    def spark(self) -> T.StructType:
        which = [T.StructField("which", T.StringType())] if self.union_at is not None else []
        return T.StructType(which + [T.StructField(f.name, f.type.spark()) for f in self.columns])

    def arrow(self) -> pa.StructType:
        which = [("which", pa.string())] if self.union_at is not None else []
        return pa.struct(which + [(f.name, f.type.arrow()) for f in self.columns])

    def only(self, *names: str) -> Struct:
        """The layout with some of its fields; what is not asked for is not followed when reading."""
        missing = set(names) - {f.name for f in self.fields}
        if missing:
            raise KeyError(f"{self.name} has no {', '.join(sorted(missing))}")
        return replace(self, fields=tuple(f for f in self.fields if f.name in names), union_at=self.union_at if any(f.tag is not None and f.name in names for f in self.fields) else None)


VOID, BOOL, TEXT, DATA, ANY, CAP = (Type(k) for k in ("void", "bool", "text", "data", "any", "cap"))
INT8, INT16, INT32, INT64, UINT8, UINT16, UINT32, UINT64, FLOAT32, FLOAT64 = (
    Type(k) for k in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64")
)


def enum(*names: str) -> Type:
    return Type("enum", names=names)


def list_of(element: Type | Struct) -> Type:
    return Type("list", element=Type("struct", struct=element) if isinstance(element, Struct) else element)


def struct_of(s: Struct) -> Type:
    return Type("struct", struct=s)


def group_of(s: Struct) -> Type:
    return Type("group", struct=s)


class _Packer:
    """Places fields in declared order, each in the first hole that it fits."""

    def __init__(self) -> None:
        self.bits = 0
        self.holes: list[tuple[int, int]] = []  # (bit, size)
        self.slots = 0

    def take(self, size: int) -> int:
        for k, (at, room) in enumerate(self.holes):
            start = -(-at // size) * size
            if start + size <= at + room:
                rest = [(at, start - at), (start + size, at + room - start - size)]
                self.holes[k : k + 1] = [h for h in rest if h[1]]
                return start
        start = -(-self.bits // size) * size
        end = -(-(start + size) // 64) * 64
        if start > self.bits:
            self.holes.append((self.bits, start - self.bits))
        if end > start + size:
            self.holes.append((start + size, end - start - size))
        self.bits = max(self.bits, end)
        return start


def pack_struct(name: str, members: list[tuple[str, Type]], presence: bool = False, defaults: dict | None = None) -> Struct:
    """A layout for the members; with ``presence`` each gets a bit that tells null from the default."""
    p, fields, defaults = _Packer(), [], defaults or {}
    for n, t in members:
        if t.is_pointer:
            at, p.slots = p.slots, p.slots + 1
        elif t.kind == "bool":
            at = p.take(1)
        else:
            at = p.take(8 * t.size) // 8
        # A pointer can be null itself, so only its content's null needs no bit.
        bit = p.take(1) if presence and not t.is_pointer else None
        fields.append(Field(n, t, at, defaults.get(n, "" if t.kind == "text" else b"" if t.kind == "data" else 0), present=bit))
    if presence:
        fields = [replace(f, default=None) if f.type.is_pointer else f for f in fields]
    return Struct(name, p.bits // 64, p.slots, tuple(fields))


def type_of(t: T.DataType, name: str = "", presence: bool = False) -> Type:
    """The wire type for a Spark type; maps are lists of key and value."""
    simple = {
        T.BooleanType: BOOL, T.ByteType: INT8, T.ShortType: INT16, T.IntegerType: INT32, T.LongType: INT64, T.FloatType: FLOAT32, T.DoubleType: FLOAT64,
        T.StringType: TEXT, T.BinaryType: DATA, T.DateType: Type("date"), T.TimestampType: Type("timestamp"), T.TimestampNTZType: Type("timestamp_ntz"),
    }
    if type(t) in simple:
        return simple[type(t)]
    if isinstance(t, T.DecimalType) and t.precision <= 18:
        return Type("decimal", precision=t.precision, scale=t.scale)
    if isinstance(t, T.ArrayType):
        return list_of(type_of(t.elementType, name, presence))
    if isinstance(t, T.StructType):
        return struct_of(layout_of(t, name, presence))
    raise TypeError(f"{name}: no wire type for {t.simpleString()}")


def layout_of(schema: T.StructType, name: str = "row", presence: bool = True, defaults: dict | None = None) -> Struct:
    """A layout for rows of a Spark schema. Without ``presence`` a null reads back as the default."""
    return pack_struct(name, [(f.name, type_of(f.dataType, f.name, presence)) for f in schema.fields], presence, defaults)
