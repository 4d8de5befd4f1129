"""Batches: all selections over one table answered by one scan of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.ints import in_range
from vectide.operators.selection import instance
from vectide.plans.vectors import POS, Frame, Vector, named
from vectide.sources.catalog import Snapshot, Table

#: So many selections share a scan; more of them take another.
MOST = 256
Range = tuple[str, int | None, int | None]


def matching(table: Snapshot, ranges: list[Range], carry: list[str]) -> tuple[str, DataFrame]:
    """The rows that any of the ranges holds, each once, with the columns that are asked for."""
    columns = list(dict.fromkeys([POS, *(c for c, _, _ in ranges), *carry]))
    inst, df = instance(table.scan().select(*columns))
    return inst, df.where(" OR ".join(f"({in_range(named(inst, c), lo, hi)})" for c, lo, hi in dict.fromkeys(ranges)))


def tagged(table: Table, ranges: list[Range]) -> DataFrame:
    """(qid, __pos): the rows of one scan once for each range that holds them, with its number."""
    inst, df = matching(table.snapshot(), ranges, [])
    tests = [F.when(F.expr(in_range(named(inst, c), lo, hi)), F.lit(i)) for i, (c, lo, hi) in enumerate(ranges)]
    return df.select(F.explode(F.array_compact(F.array(*tests))).alias("qid"), F.col(named(inst, POS)).alias(POS))


def select_all(table: Table, ranges: list[Range], carry: list[str] = ()) -> tuple[list[Vector], list[DataFrame]]:
    """One position vector for each range, and the rows that are kept for them (in memory, then on disk): the matching rows of one
    scan, over which every vector is a filter. ``carry`` names columns that later fetches want."""
    out, kept, bound = [], [], table.snapshot()
    for begin in range(0, len(ranges), MOST):
        some = ranges[begin : begin + MOST]
        inst, df = matching(bound, some, list(carry))
        kept.append(df.persist())
        for c, lo, hi in some:
            keys = [named(inst, c)] if c in table.indexes else []
            frame = Frame(kept[-1], lambda keys=keys, inst=inst: [*keys, named(inst, POS)]).filtered(in_range(named(inst, c), lo, hi))
            out.append(Vector(frame, named(inst, POS), bound, inst))
    return out, kept
