"""Document fingerprints from closed syncmers, with positions.

A k-mer of the UTF-8 bytes is an anchor where the smallest hash among its inner s-mers
stands at either edge: a property of the k-mer alone, so equal passages give equal
anchors whatever stands around them. A fingerprint keeps the ``SIZE`` smallest distinct
anchor hashes with the place of their first occurrence. Likeness estimates the Dice share of common anchors from the
smallest hashes of the union; only anchors whose shift agrees with the median shift count.

Defined results: a null text is empty; an empty text has the empty fingerprint, alike
only to itself; a text without an anchor has one anchor, its whole; rows that share a
doc_id follow each other by text; rows without a doc_id come last; an only row is its own next.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.ranges import id_bucket, id_splits, parts_for
from vectide.llm.scratch import ship
from vectide.llm.textvec import Powers, mix, strings

K, S, SIZE = 16, 9, 64
RUN = 1 << 18
Print = tuple[np.ndarray, np.ndarray]
EMPTY: Print = (np.zeros(0, np.uint32), np.zeros(0, np.uint32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of a run of bytes."""
    n = len(data)
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    up, down = Powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    inner = (mix((sums[S:] - sums[:-S]) * down[: n - S + 1]) >> np.uint64(32)).astype(np.uint32)
    w = K - S + 1
    low, span = inner, 1
    while span < w:
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[w - 1 :] == low))
    return at, (mix((sums[at + K] - sums[at]) * down[at] + np.uint64(K)) >> np.uint64(32)).astype(np.uint32)


def smallest(h: np.ndarray, at: np.ndarray) -> Print:
    if len(h) > 4 * SIZE:
        few = h <= np.uint32(min(2**32 - 1, 3 * SIZE * 2**32 // len(h)))
        value, first = np.unique(h[few], return_index=True)
        if len(value) >= SIZE:
            return value[:SIZE], at[few][first[:SIZE]].astype(np.uint32)
    value, first = np.unique(h, return_index=True)
    return value[:SIZE], at[first[:SIZE]].astype(np.uint32)


def fingerprints(texts: list[bytes]) -> list[Print]:
    """The fingerprints of whole texts, computed in runs of about ``RUN`` bytes."""
    out: list[Print] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= RUN):
            size += len(texts[j])
            j += 1
        ends = np.cumsum([len(x) for x in texts[i:j]])
        at, h = anchors(np.frombuffer(b"".join(texts[i:j]), np.uint8))
        begin = 0
        for d, end in enumerate(ends.tolist()):
            a, b = np.searchsorted(at, (begin, max(begin, end - K + 1)))
            if a < b:
                out.append(smallest(h[a:b], at[a:b] - begin))
            elif end > begin:
                whole = int.from_bytes(hashlib.blake2b(texts[i + d], digest_size=4).digest(), "little")
                out.append((np.array([whole], np.uint32), np.zeros(1, np.uint32)))
            else:
                out.append(EMPTY)
            begin = end
        i = j
    return out


def text_of(p: Print) -> str:
    return base64.b64encode(np.stack(p, 1).astype("<u4").tobytes()).decode()


def likeness(a: Print, b: Print) -> float:
    """0 to 1; 1 for equal fingerprints."""
    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    if len(ha) == len(hb) and (ha == hb).all() and (pa_ == pb).all():
        return 1.0
    both = np.concatenate((ha, hb))
    both.sort()
    new = np.concatenate(([True], both[1:] != both[:-1]))
    union = both[new][:SIZE]
    common = both[~new]
    common = common[common <= union[-1]]
    if not len(common):
        return 0.0
    shift = pb[hb.searchsorted(common)].astype(np.int64) - pa_[ha.searchsorted(common)]
    spread = 32 + 0.1 * max(pa_.max(), pb.max())
    share = (np.abs(shift - np.median(shift)) <= spread).sum() / len(union)
    return float(2 * share / (1 + share))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Stream:
    """Rows of one part after the other, each with the text that follows it."""

    def __init__(self):
        self.part = self.held = self.head = None
        self.done = False

    def take(self, rows):
        """rows: (part, borrowed, doc_id, text, print). Yields (row, following row)."""
        for row in rows:
            if row[0] != self.part:
                yield from self.close()
                self.part, self.head, self.held, self.done = row[0], row, None, False
            if self.done:
                continue
            if self.held is not None:
                yield self.held, row
            self.held, self.done = row, bool(row[1])

    def close(self):
        if self.held is not None and not self.done:  # the only part: it closes on itself
            yield self.held, self.head
        self.held = None


def _answers(pairs):
    pairs = list(pairs)
    new = [edited(row[3], after[3]) for row, after in pairs]
    prints = fingerprints([x.encode("utf-8", "surrogatepass") for x in new])
    rows = [
        (row[2], len(row[3]), hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest(), text_of(row[4]), text_of(p), likeness(row[4], p), likeness(row[4], after[4]))
        for (row, after), x, p in zip(pairs, new, prints, strict=True)
    ]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


def _run(batches):
    stream = _Stream()
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            raw, at = strings(part.column("text"))
            texts = [raw[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)]
            rows = zip(part.column("part").to_pylist(), part.column("borrowed").to_pylist(), part.column("doc_id").to_pylist(), [t.decode("utf-8", "surrogatepass") for t in texts], fingerprints(texts), strict=True)
            yield _answers(stream.take(rows))
    yield _answers(stream.close())


def neighbours(docs: DataFrame) -> DataFrame:
    """The rows in ascending order of doc_id, cut into parts; the first row of each part
    is lent to the part before it (that of the first to the last), so that every
    part is complete in itself. The text crosses the network once."""
    parts = parts_for(docs.sparkSession, 3)
    splits = id_splits(docs, parts)
    own = docs.withColumn("part", id_bucket(F.col("doc_id"), splits))
    heads = sorted((r.part, r.head) for r in own.groupBy("part").agg(F.min("doc_id").alias("head")).collect())
    lent = [h for _, h in heads if h is not None]
    homes = [p for p, h in heads if h is not None]
    if len(heads) > 1 and lent:
        last = max(p for p, _ in heads)
        to = F.create_map(*(F.lit(x) for k, h in enumerate(lent) for x in (h, homes[k - 1] if k else last)))
        places = F.when(F.col("doc_id").isin(lent), F.array(F.struct(F.col("part"), F.lit(0).alias("borrowed")), F.struct(to[F.col("doc_id")].alias("part"), F.lit(1).alias("borrowed")))).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("borrowed"))))
        own = own.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.*")
    else:
        own = own.select("doc_id", "text", "part", F.lit(0).alias("borrowed"))
    return own.repartition(parts_for(docs.sparkSession), "part").sortWithinPartitions("part", "borrowed", F.asc_nulls_last("doc_id"), "text")


def query(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return neighbours(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(_run, SCHEMA)
