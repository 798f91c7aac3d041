"""Calculator expressions in frames, evaluated: a left fold of the operator over the parameters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..kernel.reader import Frame, Ref
from ..kernel.wire import STRUCT, FrameError, need

_FOLD = (lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b, lambda a, b: a / b)


def evaluate(ref: Ref) -> float:
    """The value of an expression; free parameters, calls without parameters, unknown tags and division by zero are errors."""
    need(ref.kind == STRUCT, "KIND", "no expression")
    tag = ref.number(8, "uint16")
    if tag == 0:
        return ref.number(0, "float64")
    need(tag == 2, "UNSUPPORTED", "a free parameter" if tag == 1 else f"tag {tag}")
    op, params = ref.number(0, "uint16"), ref.pointer(0)
    need(op < len(_FOLD), "UNSUPPORTED", f"operator {op}")
    need(len(params), "ARG", "a call without parameters")
    out = evaluate(params.element_struct(0))
    for i in range(1, len(params)):
        x = evaluate(params.element_struct(i))
        need(op != 3 or x != 0, "ARG", "division by zero")
        out = _FOLD[op](out, x)
    return out


def eval_expression(c: Column | str, mode: str = "FAILFAST") -> Column:
    """The value of the expression that a frame's root (an evaluate request) holds."""

    @F.arrow_udf(T.DoubleType())
    def run(x: pa.Array) -> pa.Array:
        out = []
        for v in x.to_pylist():
            try:
                out.append(None if v is None else evaluate(Frame.parse(v).root().pointer(0)))
            except FrameError:
                if mode == "FAILFAST":
                    raise
                out.append(None)
        return pa.array(out, pa.float64())

    return run(c)


def eval_decoded(e: Column, depth: int) -> Column:
    """The value of an expression that has been decoded with ``schemas.expression(depth)``, in the JVM.

    Null where the row-wise evaluation has an error, and for expressions with
    more levels of calls than ``depth``.
    """
    out = F.when(e["which"] == "literal", e["literal"])
    if not depth:
        return out
    op = e["call"]["op"]
    values = F.transform(e["call"]["params"], lambda p: eval_decoded(p, depth - 1))
    step = lambda a, x: (
        F.when(op == "add", a + x).when(op == "subtract", a - x).when(op == "multiply", a * x).when((op == "divide") & (x != 0), F.try_divide(a, x))
    )
    # A lambda's variable holds the parameters' values, so that they are worked out once.
    fold = lambda v: F.when(F.size(v) > 0, F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.get(v, F.lit(0)), step))
    value = F.get(F.transform(F.array(values), fold), F.lit(0))
    return F.when(e["which"] == "call", F.when(op.isin(*schemas.OPERATIONS), value)).otherwise(out)


def expression_of(op: str, *params: Column) -> Column:
    """A call as a column for ``schemas.expression``: numbers become literals, structs are calls."""
    return F.struct(F.lit("call").alias("which"), F.struct(F.lit(op).alias("op"), F.array(*params).alias("params")).alias("call"))


def literal(c: Column) -> Column:
    return F.struct(F.lit("literal").alias("which"), c.cast("double").alias("literal"))


OPERATIONS = schemas.OPERATIONS
