"""Inner equi-join of two vectors of values, giving aligned positions of both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.plans.vectors import Frame, Vector, aligned, fresh, renamed

#: The hint for each kind; a plain hash join is left to the optimiser, which may broadcast a small side.
HINTS = {"hash": None, "nested-loop": None, "sort-merge": "merge"}


def join(values1: Vector, positions1: Vector, values2: Vector, positions2: Vector, kind: str = "hash") -> tuple[Vector, Vector]:
    """Pairs of positions with equal values. Order: hash and sort-merge by the right side, then the
    left; nested-loop by the larger side (the left one in a tie), then the other."""
    left, (v1, p1) = aligned(values1, positions1)
    right, (v2, p2) = aligned(values2, positions2)
    mark = fresh("r")
    right_frame, change = renamed(right, mark)
    rdf = right_frame.df.hint(HINTS[kind]) if HINTS[kind] else right_frame.df
    df = left.df.join(rdf, F.expr(f"{v1.sql} = {change(v2.sql)}"))

    def order() -> list[str]:
        if kind == "nested-loop" and left.df.count() >= right.df.count():
            return [*left.order(), *right_frame.order()]
        return [*right_frame.order(), *left.order()]

    frame = Frame(df, order)
    return (
        Vector(frame, p1.sql, p1.table, p1.instance),
        Vector(frame, change(p2.sql), p2.table, p2.instance and p2.instance + mark),
    )
