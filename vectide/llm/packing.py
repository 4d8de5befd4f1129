"""Harmonic packing: pieces of documents in sequences of a fixed capacity.

The remainder of a document beyond its full sequences is cut into pieces by a table that
weighs padding against cuts. A piece of length n belongs to class j = capacity // n: a sequence of
class j takes exactly j pieces. Every task fills sequences for itself; the
pieces of its unfinished ones (less than a sequence for each class) move on and are
filled over groups of ``FAN`` tasks, then over groups of groups. What the last group leaves, less than a
sequence for each class, is packed first-fit, longest first.

Defined results: a null text is empty and is one piece of one id (the end id); rows that
share a doc_id are packed each for itself; a null doc_id stays null; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.scratch import materialize, ship
from vectide.llm.textvec import runs, strings
from vectide.llm.tokens import Encoder, vocabulary

CAPACITY, END, CUT_COST, FAN = 2048, 1, 8, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, worker long, number long, bin long, offset long"
_TYPES = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 4
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@lru_cache
def cuts(capacity: int = CAPACITY) -> list[int]:
    """For each remainder below the capacity: the length of its first piece. By dynamic
    programming over the padding that a piece's share of a full sequence costs and CUT_COST for each cut."""
    pad = [0.0] + [(capacity - (capacity // n) * n) / (capacity // n) for n in range(1, capacity)]
    best, first = [0.0] * capacity, [0] * capacity
    sizes = sorted({capacity // j for j in range(2, 65)})
    for r in range(1, capacity):
        best[r], first[r] = pad[r], r
        for n in sizes:
            if n < r and (cost := CUT_COST + pad[n] + best[r - n]) < best[r]:
                best[r], first[r] = cost, n
    return first


def pieces(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of n ids, in order."""
    out, r, table = [capacity] * (n // capacity), n % capacity, cuts(capacity)
    while r:
        out.append(table[r])
        r -= table[r]
    return out


class Filler:
    """Unfinished sequences by class; ``add`` returns the rows of one that it completes."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.bins = capacity, {}, 0

    def add(self, row: list) -> list[list]:
        each = self.capacity // row[2]
        held = self.open.setdefault(each, [])
        held.append(row)
        if len(held) < each:
            return []
        self.open[each] = []
        return self._close(held)

    def _close(self, rows: list[list]) -> list[list]:
        at = 0
        for row in rows:
            row[8], row[9] = self.bins, at
            at += row[2]
        self.bins += 1
        return rows

    def rest(self) -> list[list]:
        return [row for held in self.open.values() for row in held]

    def first_fit(self) -> list[list]:
        """Packs what is left, longest first, each into the first sequence with room."""
        room: list[int] = []
        found: list[list[list]] = []
        for row in sorted(self.rest(), key=lambda r: (-r[2], r[6], r[7])):
            k = next((k for k, x in enumerate(room) if x >= row[2]), len(room))
            if k == len(room):
                room.append(self.capacity)
                found.append([])
            room[k] -= row[2]
            found[k].append(row)
        self.open = {}
        return [row for rows in found for row in self._close(rows)]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _fill(path: str, capacity: int, end: int):
    def run(batches):
        encoder, filler, worker, number = Encoder.open(path), Filler(capacity), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            raw, bounds = strings(batch.column("text"))
            for i, j in runs(bounds):
                out = []
                flat, at = encoder.encode(raw, bounds[i : j + 1])
                for d, a, b in zip(ids_of[i:j], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(flat[a:b], np.uint32(end)).astype("<u4")
                    start = 0
                    for n in pieces(len(own), capacity):
                        body = own[start : start + n]
                        out += filler.add([d, start, n, zlib.crc32(body.tobytes()), len(own), _store(body), worker, number, None, None])
                        start, number = start + n, number + 1
                yield _batch(out)
        yield _batch(filler.rest())

    return run


def _store(ids: np.ndarray) -> bytes:
    """Little-endian ids of 16 bits, or of 32 behind an odd byte where one does not fit."""
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\0" + ids.tobytes()


def ids_from(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored[1:], "<u4") if len(stored) % 2 else np.frombuffer(stored, "<u2").astype(np.uint32)


def _refill(capacity: int, last: bool):
    def run(batches):
        filler, group = None, None

        def close():
            return (filler.first_fit() if last else filler.rest()) if filler else []

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = list(row)
                if row[6] != group:
                    out += close()
                    filler, group = Filler(capacity), row[6]
                out += filler.add(row)
            yield _batch(out)
        yield _batch(close())

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents with their ids (``ids_from``), sequence_id and offset."""
    spark = ship(docs.sparkSession)
    tokens = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fill(vocabulary(tokenizer), capacity, end), SCHEMA)
    level = materialize(tokens, "pieces")
    done, counts = [], []
    while True:
        full = level.where("bin IS NOT NULL")
        done.append(full)
        counts.append({r.worker: r.n for r in full.groupBy("worker").agg((F.max("bin") + 1).alias("n")).collect()})
        rest = level.where("bin IS NULL")
        most = rest.agg(F.max("worker")).collect()[0][0]
        if most is None:
            break
        # One task number less for every FAN: the piece's number stays unique beside its old worker.
        grouped = rest.withColumn("number", F.col("worker") * (1 << 40) + F.col("number") % (1 << 40)).withColumn("worker", F.floor(F.col("worker") / FAN))
        dealt = grouped.repartition(max(1, most // FAN + 1), "worker").sortWithinPartitions("worker", "number")
        level = materialize(dealt.mapInArrow(_refill(capacity, most < FAN), SCHEMA), "pieces")
    base, out = 0, None
    for full, count in zip(done, counts, strict=True):
        if not count:
            continue
        bases = []
        for worker in sorted(count):
            bases.append((worker, base))
            base += count[worker]
        one = full.join(F.broadcast(spark.createDataFrame(bases, "worker long, base long")), "worker")
        one = one.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("bin")).alias("sequence_id"), "offset", "ids")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else level.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("bin").alias("sequence_id"), "offset", "ids")


def query(docs: DataFrame) -> DataFrame:
    return pack(docs).drop("ids")
