"""Rows of aligned vectors and scalars as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.plans.vectors import Scalar, Vector, aligned, widest


def scalar_values(scalars: list[Scalar]) -> list[int | float | None]:
    """The values of scalars, one aggregation for each frame that they come from."""
    out: dict[int, int | float | None] = {k: s.value for k, s in enumerate(scalars) if s.value is not None}
    for f in widest(s.frame for k, s in enumerate(scalars) if k not in out):
        own = [k for k, s in enumerate(scalars) if k not in out and s.frame.id == f.id]
        row = f.df.agg(*[F.expr(scalars[k].sql).alias(f"s{k}") for k in own]).collect()[0]
        out |= {k: row[f"s{k}"] for k in own}
    return [out[k] for k in range(len(scalars))]


def table_of(vectors: list[Vector], names: list[str]) -> DataFrame:
    """The vectors side by side, rows in no order: what a query returns."""
    frame, found = aligned(*vectors)
    return frame.df.select(*[F.expr(v.sql).alias(n) for v, n in zip(found, names, strict=True)])


def shown(value, floating: bool) -> str:
    return "" if value is None else "%.2f" % value if floating else str(int(value))


def lines(items: list[Vector | Scalar]) -> Iterator[str]:
    """CSV rows in the order of the vectors; scalars repeat on each, and alone make one row."""
    scalars = [x for x in items if isinstance(x, Scalar)]
    values = iter(scalar_values(scalars))
    fixed = [shown(next(values), x.floating) if isinstance(x, Scalar) else None for x in items]
    vectors = [x for x in items if isinstance(x, Vector)]
    if not vectors:
        yield ",".join(fixed)
        return
    frame, found = aligned(*vectors)
    rows = frame.sorted().select(*[F.expr(v.sql).alias(f"c{k}") for k, v in enumerate(found)])
    for row in rows.toLocalIterator():
        cells = iter(row)
        yield ",".join(x if x is not None else shown(next(cells), False) for x in fixed)
