"""Element-wise 32-bit addition and subtraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions.ints import wrapped
from vectide.plans.vectors import Vector, aligned, fresh, named

#: Longer expressions become columns, so a chain of sums grows by projections and not by copies of text.
LONGEST = 500


def combine(op: str, a: Vector, b: Vector) -> Vector:
    """a + b or a - b place by place, modulo 2**32."""
    frame, (x, y) = aligned(a, b)
    sql = wrapped(op, x.sql, y.sql)
    if len(sql) <= LONGEST:
        return Vector(frame, sql)
    inst = fresh("v")
    return Vector(frame.extended(lambda df: df.withColumn(f"{inst}|x", F.expr(sql))), named(inst, "x"))
