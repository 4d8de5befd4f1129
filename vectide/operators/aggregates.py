"""Aggregates of a vector. Scalars are lazy; those of one frame are computed together."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.plans.vectors import Frame, Scalar, Vector, aligned, fresh, named, ordinals

_SQL = {
    "sum": "coalesce(sum(CAST({} AS BIGINT)), 0)",
    "avg": "coalesce(avg(CAST({} AS DOUBLE)), CAST(0 AS DOUBLE))",
    "min": "CAST(min({}) AS BIGINT)",
    "max": "CAST(max({}) AS BIGINT)",
}


def aggregate(kind: str, values: Vector) -> Scalar:
    """sum and avg of nothing are 0; min and max of nothing are null."""
    return Scalar(values.frame, _SQL[kind].format(values.sql), kind == "avg")


def of_column(kind: str, table, name: str, scan: Vector) -> Scalar:
    """As ``aggregate``, from the statistics kept with a managed table where these tell it."""
    table.flush()
    known = table.version.stats.get(name) if table.attached is None else None
    out = aggregate(kind, scan)
    if known and known[0] is not None and kind != "avg":
        out.value = known[("min", "max", "sum").index(kind)]
    return out


def extremum(kind: str, positions: Vector | None, values: Vector) -> tuple[Vector, Scalar]:
    """All positions that hold the smallest or largest value, and the value. Without positions:
    the places within the vector."""
    if positions is None:
        inst = fresh("z")
        df = ordinals(values.frame, [values.sql], [f"{inst}|v"], f"{inst}|p")
        frame = Frame(df, lambda: [named(inst, "p")])
        positions, values = Vector(frame, named(inst, "p"), None, inst), Vector(frame, named(inst, "v"))
    frame, (p, v) = aligned(positions, values)
    best = frame.df.agg(F.expr(f"{kind}({v.sql})").alias("best"))
    held = Frame(frame.df.where(F.expr(v.sql) == best.scalar()), frame.order)
    return Vector(held, p.sql, p.table, p.instance), Scalar(frame, _SQL[kind].format(v.sql))
