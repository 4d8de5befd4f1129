"""Sharding by histogram sort: shards of near equal bytes, with one exchange of the rows.

The rows are ordered by (hash of the text, doc_id), so equal texts stand together. The
splitters are found on the narrow table of these keys: each pass counts, exactly and over all
partitions, the bytes below 64 candidate boundaries inside every interval
that still holds a splitter, and keeps the candidate nearest to its target once it is near enough. Where one text
fills an interval, its copies are cut by doc_id. Then the rows cross the network once, to the task of
their range, and are sorted there.

Size of a row: UTF-8 bytes of its text and 16. A shard has ``finer`` ranges, each of them a task,
so that a shard larger than a task is sorted by several.

Defined results: a null text counts and sorts as empty; rows without a doc_id come first
among equal texts; rows equal in text and doc_id are not told apart and stay together; with fewer rows than
shards some shards are empty; an empty table gives no row. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.ranges import bucket_of, parts_for
from vectide.llm.scratch import materialize, unused, without

FIRST_BITS, STEP_BITS = 12, 6
TOLERANCE, LOOSE = 0.01, 0.25
_NULL = -(1 << 63)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _key_columns() -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))


def _counts(rows: DataFrame, *by: Column) -> list:
    return rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.min("h").alias("h_lo"), F.max("h").alias("h_hi"), F.min("d").alias("d_lo"), F.max("d").alias("d_hi")).collect()


class _Target:
    """A splitter that is sought: ``goal`` bytes should lie below it, give or take ``slack``."""

    def __init__(self, goal: float, slack: float):
        self.goal, self.slack, self.key = goal, slack, None

    def offer(self, bins: list, below: int):
        """bins: rows of _counts in order, of which the first has ``below`` bytes under it.
        Settles on the boundary nearest to the goal, or returns the bin to look into and the bytes below it."""
        for i, b in enumerate(bins):
            if below + b.bytes >= self.goal or i == len(bins) - 1:
                left, right = self.goal - below, below + b.bytes - self.goal
                single = (b.h_lo, b.d_lo) == (b.h_hi, b.d_hi)
                if left <= right and (left <= self.slack or single):
                    self.key = (b.h_lo, b.d_lo)
                elif left > right and (right <= self.slack or single):
                    self.key = (bins[i + 1].h_lo, bins[i + 1].d_lo) if i + 1 < len(bins) else self.after
                if self.key is None:
                    self.after = (bins[i + 1].h_lo, bins[i + 1].d_lo) if i + 1 < len(bins) else self.after
                    return b, below
                return None
            below += b.bytes
        return None

    after: tuple = (1 << 63, 0)


def splitters(keys: DataFrame, shards: int, finer: int) -> list[tuple[int, int]]:
    """The lower keys (h, d) of all ranges but the first, from exact counts. A splitter
    that no row reaches is beyond the last key."""
    n = shards * finer
    prefix = F.shiftright("h", 64 - FIRST_BITS)
    bins = sorted(_counts(keys, prefix.alias("p")), key=lambda r: r.p)
    total = sum(b.bytes for b in bins)
    share = total / shards if total else 0
    targets = [_Target(total * i / n, share * TOLERANCE / 2 if i % finer == 0 else share / finer * LOOSE / 2) for i in range(1, n)]
    seek = {id(t): found for t in targets if bins and (found := t.offer(bins, 0))}
    shift = 64 - FIRST_BITS
    while seek:
        wanted = {b.h_lo >> shift for b, _ in seek.values() if b.h_lo != b.h_hi}
        hot = {b.h_lo: b for b, _ in seek.values() if b.h_lo == b.h_hi}
        narrow, by_prefix, by_id = max(0, shift - STEP_BITS), {}, {}
        if wanted:
            inside = keys.where(F.shiftright("h", shift).isin(sorted(wanted)))
            for r in _counts(inside, F.shiftright("h", narrow).alias("p")):
                by_prefix.setdefault(r.h_lo >> shift, []).append(r)
        if hot:
            # Candidates inside the copies of one text: 64 steps over the ids that the interval spans.
            spans = {}
            for b, _ in seek.values():
                if b.h_lo == b.h_hi:
                    spans.setdefault(b.h_lo, set()).add((b.d_lo, b.d_hi))
            flat = [(h, lo, hi, max(1, -(-(hi - lo + 1) >> STEP_BITS))) for h, s in spans.items() for lo, hi in s]
            place = F.lit(None).cast("long")
            which = F.lit(None).cast("int")
            for k, (h, lo, hi, step) in enumerate(flat):
                hit = (F.col("h") == h) & F.col("d").between(lo, hi)
                which = F.when(hit, F.lit(k)).otherwise(which)
                place = F.when(hit, F.floor((F.col("d").cast("decimal(20,0)") - F.lit(lo)) / F.lit(step)).cast("long")).otherwise(place)
            inside = keys.where(F.col("h").isin(sorted(spans))).withColumn("k", which).withColumn("p", place).where("k IS NOT NULL")
            for r in _counts(inside, F.col("k"), F.col("p")):
                h, lo, hi, _ = flat[r.k]
                by_id.setdefault((h, lo, hi), []).append(r)
        after = {}
        for t in targets:
            if id(t) in seek:
                b, below = seek[id(t)]
                inner = by_id[b.h_lo, b.d_lo, b.d_hi] if b.h_lo == b.h_hi else by_prefix[b.h_lo >> shift]
                if found := t.offer(sorted(inner, key=lambda r: r.p), below):
                    after[id(t)] = found
        seek, shift = after, narrow
    return sorted(t.key if t.key is not None else (1 << 63, 0) for t in targets)


def shard(docs: DataFrame, shards: int = 40, finer: int | None = None) -> DataFrame:
    """``docs`` with size, shard and slot (both from 0; slots without gaps in each shard)."""
    spark = docs.sparkSession
    finer = finer or max(1, -(-parts_for(spark) // shards))
    h, d = _key_columns()
    keys = materialize(docs.select(h.alias("h"), d.alias("d"), size_of().alias("size")), "keys")
    real = [c for c in splitters(keys, shards, finer) if c[0] < 1 << 63]

    def bucket(hn: str = "h", dn: str = "d") -> Column:
        # Equal splitters leave the ranges between them empty: the last of them counts.
        return bucket_of(lambda s: (F.col(hn) < F.lit(s[0])) | ((F.col(hn) == F.lit(s[0])) & (F.col(dn) < F.lit(s[1]))), real)

    count = {r.b: r.n for r in keys.groupBy(bucket().alias("b")).agg(F.count("*").alias("n")).collect()}
    base, seen = [], 0
    for b in range(shards * finer):
        seen = 0 if b % finer == 0 else seen
        base.append(seen)
        seen += count.get(b, 0)
    own = without(docs.columns, "size", "shard", "slot")
    hn, dn, bn, sn = unused(docs.columns, "_h", "_d", "_b", "_size")
    rows = docs.select(*own, h.alias(hn), d.alias(dn), size_of().alias(sn)).withColumn(bn, bucket(hn, dn))
    dealt = rows.repartitionById(shards * finer, F.col(bn)).sortWithinPartitions(bn, hn, dn)
    local = F.monotonically_increasing_id() % F.lit(1 << 33)
    first = F.element_at(F.array(*map(F.lit, base)), F.col(bn) + 1)
    return dealt.select(*own, F.col(sn).alias("size"), F.floor(F.col(bn) / finer).cast("int").alias("shard"), (first + local).cast("long").alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    rows = shard(docs)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
