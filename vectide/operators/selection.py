"""Range selection, refinement and fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.ints import in_range
from vectide.plans.vectors import POS, Frame, Vector, aligned, fresh, named, ordinals
from vectide.sources.catalog import Table


def instance(df: DataFrame) -> tuple[str, DataFrame]:
    inst = fresh("i")
    return inst, df.toDF(*[f"{inst}|{c}" for c in df.columns])


def whole(table: Table) -> tuple[str, Frame]:
    """The table as a frame in the order of its rows."""
    inst, df = instance(table.snapshot().scan())
    return inst, Frame(df, lambda: [named(inst, POS)])


def column(table: Table, name: str) -> Vector:
    inst, frame = whole(table)
    return Vector(frame, named(inst, name))


def select(table: Table, name: str, low: int | None, high: int | None) -> Vector:
    """Positions of the rows with low <= value < high. With an index, from its sorted copy and
    in the order of values; the filter is left to the scan."""
    bound = table.snapshot()
    copy = table.layout(name)
    inst, df = instance(copy if copy is not None else bound.scan())
    keys = [named(inst, name)] if name in table.indexes else []
    frame = Frame(df, lambda: [*keys, named(inst, POS)]).filtered(in_range(named(inst, name), low, high))
    return Vector(frame, named(inst, POS), bound, inst)


def select_values(values: Vector, low: int | None, high: int | None) -> Vector:
    """Places within a vector of values whose value is in range."""
    inst = fresh("z")
    df = ordinals(values.frame, [values.sql], [f"{inst}|v"], f"{inst}|{POS}")
    frame = Frame(df, lambda: [named(inst, POS)]).filtered(in_range(named(inst, "v"), low, high))
    return Vector(frame, named(inst, POS), None, inst)


def refine(positions: Vector, values: Vector, low: int | None, high: int | None) -> Vector:
    """The positions whose value at the same place is in range."""
    frame, (p, v) = aligned(positions, values)
    return Vector(frame.filtered(in_range(v.sql, low, high)), p.sql, p.table, p.instance)


def fetch(table: Table, name: str, positions: Vector) -> Vector:
    """The column's values at the positions, their order and repeats kept: a projection where the
    frame carries the table already, else a join on positions. Positions of this table see the version that they were bound to."""
    frame = positions.frame
    own = positions.table is not None and positions.table.table is table
    if own and positions.instance and f"{positions.instance}|{name}" in frame.df.columns:
        return Vector(frame, named(positions.instance, name))
    bound = positions.table if own else table.snapshot()
    # The join brings all columns, of which the optimiser keeps those in use: one join serves all fetches of a table.
    joined = positions.__dict__.setdefault("joined", {})
    key = (table.full_name, id(bound.version))
    if key not in joined:
        inst, df = instance(bound.scan())
        there = F.expr(f"{positions.sql} = {named(inst, POS)}")
        if own:
            # Every position is there, once: the same rows.
            joined[key] = inst, bound, frame.extended(lambda rows: rows.join(df, there))
        else:
            joined[key] = inst, bound, Frame(frame.df.join(df, there), frame.order)
    inst, _, wide = joined[key]
    return Vector(wide, named(inst, name))
