"""Range buckets as native expressions, and the order they give to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(below, splits: Sequence, lo: int = 0, hi: int | None = None) -> Column:
    """The number of ``splits`` (ascending) not above the row: a balanced tree of
    comparisons. ``below(split)`` is the condition that the row lies below a split."""
    hi = len(splits) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(below(splits[mid]), bucket_of(below, splits, lo, mid)).otherwise(bucket_of(below, splits, mid + 1, hi))


def id_splits(docs: DataFrame, parts: int, key: str = "doc_id") -> list:
    """At most ``parts - 1`` distinct ids that cut the rows into about equal counts."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), 10 * parts + 1000)).collect()[0][0]
    return sorted(set(found or []))


def shuffle_parts(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark, factor: int = 1) -> int:
    """As many parts as the session's shuffle partitions, times ``factor``, up to 2,000, as every part is a leaf of an expression."""
    return min(2000, max(1, shuffle_parts(spark) * factor))


def id_bucket(key: Column, splits: Sequence) -> Column:
    """The bucket of an id; null ids go to the last one."""
    if not splits:
        return F.lit(0)
    return F.when(key.isNull(), F.lit(len(splits))).otherwise(bucket_of(lambda s: key < F.lit(s), splits))
