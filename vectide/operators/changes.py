"""Delete and update of rows at positions, as new versions of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.plans.vectors import POS, Vector
from vectide.sources.catalog import Table, renumbered


def _distinct(positions: Vector):
    return positions.frame.df.select(F.expr(positions.sql).alias(POS)).distinct()


def remaining(table: Table, positions: Vector):
    """The rows of the table without those at the positions, under their old positions."""
    return table.scan().join(_distinct(positions), POS, "left_anti")


def delete(table: Table, positions: Vector):
    """Positions close up behind the rows that go."""
    table.flush()
    table.replace(renumbered(remaining(table, positions), table.version.rows))


def updated(table: Table, column: str, positions: Vector, value: int):
    """The rows of the table with ``value`` in ``column`` at the positions."""
    hit = _distinct(positions).withColumn("_hit", F.lit(True))
    rows = table.scan().join(hit, POS, "left")
    return rows.withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_hit")


def update(table: Table, column: str, positions: Vector, value: int):
    table.replace(updated(table, column, positions, value))
