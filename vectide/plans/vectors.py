"""Frames, vectors and scalars: what the names of a script stand for.

A frame is a DataFrame of aligned rows and the keys of their observable order. A vector
is an SQL expression over a frame; vectors of one frame are aligned by construction.
Columns are named ``instance|column``, one instance for each scan, so both sides of a
join stay apart and a fetch through a join is a projection.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.errors import LengthMismatch
from vectide.sources.storage import scratch_table

POS = "__pos"
_ids = itertools.count(1)


def fresh(prefix: str) -> str:
    return f"{prefix}{next(_ids)}"


def named(instance: str, column: str) -> str:
    return f"`{instance}|{column}`"


@dataclass(eq=False)
class Frame:
    """Aligned rows. order: SQL sort keys, found only when the order is asked for. Frames with one id are the same rows,
    each with more columns than the one before it in ``chain``."""

    df: DataFrame
    order: Callable[[], list[str]]
    id: int = field(default_factory=lambda: next(_ids))
    chain: list[Frame] = field(default_factory=list)

    def __post_init__(self):
        self.depth = len(self.chain)
        self.chain.append(self)

    def extended(self, change: Callable[[DataFrame], DataFrame]) -> Frame:
        """The rows with more columns; ``change`` keeps the rows and columns, so all vectors stay aligned."""
        return Frame(change(self.chain[-1].df), self.order, self.id, self.chain)

    def filtered(self, condition: str) -> Frame:
        return Frame(self.df.where(condition), self.order)

    def sorted(self, df: DataFrame | None = None) -> DataFrame:
        keys = self.order()
        return (df if df is not None else self.df).orderBy(*[F.expr(k) for k in keys]) if keys else self.df


@dataclass(eq=False)
class Vector:
    """sql: the value of each row. For positions, ``table`` (a snapshot) and ``instance`` say where they point."""

    frame: Frame
    sql: str
    table: object = None
    instance: str | None = None


@dataclass(eq=False)
class Scalar:
    """An aggregate over a frame; floating ones print with two places. value: known without a scan."""

    frame: Frame | None
    sql: str
    floating: bool = False
    value: int | None = None


def renamed(frame: Frame, mark: str) -> tuple[Frame, Callable[[str], str]]:
    """The frame with every instance renamed, and the same for SQL over it."""
    change = lambda sql: re.sub(r"`(\w+)\|", rf"`\1{mark}|", sql)
    df = frame.df.toDF(*[re.sub(r"^(\w+)\|", rf"\1{mark}|", c) for c in frame.df.columns])
    return Frame(df, lambda: [change(k) for k in frame.order()]), change


def with_ordinals(df: DataFrame, name: str) -> DataFrame:
    """``df``, in its present order of rows, with a gapless number from 0. Written once, so
    that counts and numbers are of the same rows; partitions are numbered from their counts."""
    spark = df.sparkSession
    kept = scratch_table(df.withColumn("_m", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("_m", 33)
    base, starts = 0, []
    for r in sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((r.part, base))
        base += r.n
    first = spark.createDataFrame(starts or [(0, 0)], "_part long, _base long")
    joined = kept.withColumn("_part", part).join(F.broadcast(first), "_part")
    return joined.withColumn(name, F.col("_base") + (F.col("_m") % (1 << 33))).drop("_m", "_part", "_base")


def ordinals(frame: Frame, sqls: list[str], names: list[str], ordinal: str) -> DataFrame:
    """The expressions in the frame's order, numbered."""
    return with_ordinals(frame.sorted().select(*[F.expr(s).alias(n) for s, n in zip(sqls, names, strict=True)]), ordinal)


def zipped(groups: list[tuple[Frame, list[str]]]) -> tuple[Frame, list[list[str]]]:
    """One frame for expressions of several frames, aligned by place. LengthMismatch if they differ."""
    out, found, count = None, [], None
    for k, (frame, sqls) in enumerate(groups):
        inst = fresh("z")
        names = [f"{inst}|c{i}" for i in range(len(sqls))]
        one = ordinals(frame, sqls, names, "_ord" if k == 0 else f"_ord{k}")
        n = one.count()
        if count is not None and n != count:
            raise LengthMismatch(f"{count} and {n} rows")
        count = n
        out = one if out is None else out.join(one, F.col("_ord") == F.col(f"_ord{k}")).drop(f"_ord{k}")
        found.append([f"`{x}`" for x in names])
    inst = fresh("z")
    frame = Frame(out.withColumnRenamed("_ord", f"{inst}|ord"), lambda: [named(inst, "ord")])
    return frame, found


def widest(frames: Iterable[Frame]) -> list[Frame]:
    """Of frames of the same rows the one with all their columns."""
    out: dict[int, Frame] = {}
    for f in frames:
        if f.id not in out or out[f.id].depth < f.depth:
            out[f.id] = f
    return list(out.values())


def aligned(*vectors: Vector) -> tuple[Frame, list[Vector]]:
    """The vectors on one frame: as they are, or zipped by place."""
    frames = widest(v.frame for v in vectors)
    if len(frames) == 1:
        return frames[0], list(vectors)
    groups = [(f, [v.sql for v in vectors if v.frame.id == f.id]) for f in frames]
    frame, sqls = zipped(groups)
    pools = {f.id: iter(s) for f, s in zip(frames, sqls, strict=True)}
    # A zipped frame carries no table columns: positions keep their table, and a fetch joins.
    return frame, [Vector(frame, next(pools[v.frame.id]), v.table, None) for v in vectors]
