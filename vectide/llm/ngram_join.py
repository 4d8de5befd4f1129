"""Jaccard self-join of documents on word shingles, by parity sketches.

Every shingle of a document flips one bit of its sketch, so two sketches differ in at
most as many bits as their sets differ in shingles. Sets that reach the similarity
differ in at most ``delta`` shingles. A sketch is cut into ``delta + 1 + spare`` segments of 2**32
bits, of which such a pair agrees on ``1 + spare`` at least; the number follows the size band.
A segment's key is a linear hash of its bits. Segments of few shingles agree by chance or by
one passage, so a document with no more than ``spare`` of them leaves them out (up to two shingles, one
or none, as the band allows): of the segments that agree one that is fuller remains on both sides.

One pass over the texts gives each row the 128-bit marks and the size of its set, and the first of equal sets in a
task its keys and a short sketch. Equal sets are one class, a node of the graph of links. First the classes of a key
are held against the key's smallest class, whose set meets the others' in a stream. Keys whose classes are still in several
components are then compared whole, block against block: sketches tell which classes have a partner that they cannot rule out, and
only the sets of those are sent to the block, where each pair that is still in two components is
verified. A block gives the links that join its components and no more. In a first turn every class names
one of its larger keys, so that groups join up before the last turn takes all keys that are left.
So every pair that links is verified or its members are in one component already.

No group meets in one task: copies are counted before they are shuffled, classes with many copies are joined by
broadcast (no more than ``HOT`` of them can hold a ``HOT``-th of the rows), keys of many classes, found in a 64th of the classes, are
salted, and blocks are bounded in rows and in bytes of their sets.

Defined results: null text is empty; a document without words has no shingles and no
link; with fewer words than a shingle the whole sequence is its one shingle; rows that share a doc_id share
their links, whatever their texts; a row without a doc_id has no component and links nothing; only doc_id and text are read.
Sets with the same two 64-bit marks and size count as equal, shingles with the same 64-bit hash too.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.graph import components
from vectide.llm.scratch import counted, materialize, ship, unused
from vectide.llm.textvec import Words, mix, runs, strings, windows

GROWTH = 1.35
#: A block holds about so many classes (up to eight times as many in very large keys), and shingles, at most.
BLOCK, WEIGHT = 256, 1 << 18
#: So many classes, counted, may be broadcast to find their texts; more are found by a join over the network.
FEW = 200_000
#: The first turn is over keys of more classes than this.
LARGE = 8
#: A class with more than a HOT-th of the rows, or a key with more than a HOT-th of all keys, is hot.
HOT, PROBE = 1024, 64
#: So many classes a task remembers, to send the keys of copies once.
SEEN = 50_000


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    words = Words(raw, at, lower=True)
    h = words.hashes()
    grams = windows(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(_short(h[a:b]))
        else:
            out.append(h[:0])
    return out


def _short(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with few words."""
    return mix(windows(h, len(h)) + np.uint64(0x51ED270B * len(h)))


class Bands:
    """Size bands for a similarity of ``num / den``. A pair belongs to the band of its smaller size."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * GROWTH)))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def segments(self, band: int) -> tuple[int, int, int]:
        """Segments; of these, spare ones; and the largest number of shingles for which a segment is
        left out. Without a difference to allow for there are no segments: such pairs are equal."""
        small = self.low[band + 1] - 1
        delta = self.delta(small, small * self.den // self.num)
        if not delta:
            return 0, 0, 0
        for thin in (2, 1, 0):
            # As many spare ones as there are thin segments in all but few documents of the band.
            for spare in range(1, 2 + delta // 4):
                m = delta + 1 + spare
                mean = self.low[band] / m
                few = m * np.exp(-mean) * sum(mean**c / (1, 1, 2)[c] for c in range(thin + 1))
                if spare >= few + 2 * np.sqrt(few):
                    return m, spare, thin
        return delta + 2, 1, 0

    def delta(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def holding(self, n: int) -> range:
        """The bands in which a set of n shingles is the smaller or the larger of a pair."""
        last = self.of(n)
        return range(self.of(-(-n * self.num // self.den)), last + 1)


def segment_keys(s: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the hash of its bits, the xor of a hash for every bit that is set, and
    its number of shingles. A shingle's segment comes from its high half, so the segments of sorted
    hashes are runs; its bit is its low half."""
    segment = (((s >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
    bit = mix((s & np.uint64(0xFFFFFFFF)) + np.uint64(1))
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    out = np.zeros(segments, np.uint64)
    out[segment[first]] = np.bitwise_xor.reduceat(bit, first)
    return out, np.bincount(segment, minlength=segments)


def keys_of(s: np.ndarray, bands: Bands) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for band in bands.holding(len(s)):
        m, spare, thin = bands.segments(band)
        if m:
            value, size = segment_keys(s, m)
            at = np.flatnonzero(size > thin)
            if m - len(at) > spare:
                at = np.arange(m)
            out.append(mix(value[at] + mix(at.astype(np.uint64) + np.uint64(band << 32))))
    return np.concatenate(out).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """A short sketch: a power of two of bits, two to four for each shingle. The xor of
    its halves is the sketch of half the bits."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.bincount(((s >> np.uint64(16)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set."""
    f1 = np.array([np.add.reduce(s) for s in sets], np.uint64)
    return f1, np.array([np.bitwise_xor.reduce(mix(s)) for s in sets], np.uint64)


SURVEY = "doc_id long, digest long, n long, f1 long, f2 long, keys array<long>, sketch binary"


def _survey(k: int, num: int, den: int):
    def run(batches):
        bands, seen = Bands(num, den), set()
        for batch in batches:
            raw, at = strings(batch.column("text"))
            sizes, marks, keys, sketches = [], [], [], []
            for i, j in runs(at):
                sets = shingle_sets(raw, at[i : j + 1], k)
                f1, f2 = _marks(sets)
                marks.append((f1, f2))
                for s, *both in zip(sets, f1.tolist(), f2.tolist(), strict=True):
                    sizes.append(len(s))
                    new = len(s) > 0 and (both := tuple(both)) not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(both)
                    keys.append(keys_of(s, bands) if new else np.zeros(0, np.int64))
                    sketches.append(parity(s).tobytes() if new else None)
            f1, f2 = (np.concatenate([np.zeros(0, np.uint64), *m]).view(np.int64) for m in (zip(*marks, strict=True) if marks else ([], [])))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(f1), pa.array(f2), listed, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SURVEY.split(", ")])

    return run


def _shared(batches):
    """Of rows sorted by place and class, each class of a place once: those whose place holds another, or that are
    salted, with the first class of the place."""
    names = ["place", "key", "salted", "class"]
    place, key, salted, node = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
    centre = None  # of the last row's place

    def told(closed):
        same = np.concatenate(([centre is not None], place[1:] == place[:-1]))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))
        to = node[first]
        if centre is not None:
            to[np.cumsum(~same) == 0] = centre
        hit = same | np.concatenate((same[1:], [False])) | salted
        hit[len(place) - (not closed) :] = False
        out = pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, node, to)], names=["key", "class", "centre"])
        # The last row waits for the next; its place has a centre if it is not the first there.
        return out, int(to[-1]) if same[-1] else None

    for batch in batches:
        more = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        place, key, salted, node = (np.concatenate(x) for x in zip((place, key, salted, node), more, strict=True))
        fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (node[1:] != node[:-1])))
        place, key, salted, node = (x[fresh] for x in (place, key, salted, node))
        if len(place) < 2:
            continue
        out, centre = told(False)
        place, key, salted, node = (x[-1:] for x in (place, key, salted, node))
        yield out
    if len(place):
        yield told(True)[0]


def _near(num: int, den: int):
    """Of pairs with their sketches: those that the sketches cannot rule out."""

    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = []
            for x, y, most in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), bands.delta(n, 0).tolist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                keep.append(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum() <= most)
            part = batch.filter(pa.array(np.array(keep, bool)))
            yield pa.RecordBatch.from_arrays([part.column("centre"), part.column("node")], names=["centre", "node"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            raw, at = strings(batch.column("text"))
            sets = [s.tobytes() for i, j in runs(at) for s in shingle_sets(raw, at[i : j + 1], k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "items"])

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common > 0 and den * common >= num * (len(both) - common)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _star(num: int, den: int):
    """Rows sorted by centre and part, the centre's own first: the members that link to it."""

    def run(batches):
        place, held = None, None
        for batch in batches:
            found = []
            for centre, part, node, items in zip(*(batch.column(c).to_pylist() for c in ("centre", "part", "node", "items")), strict=True):
                items = np.frombuffer(items, np.uint64)
                if (centre, part) != place:
                    place, held = (centre, part), None
                if node == centre:
                    held = items
                elif held is not None and linked(held, items, num, den):
                    found.append((centre, node))
            yield _links(found)

    return run


class Block:
    """The rows of one block, or of two that are held against each other (sides 0 and 1; 2 is a block against itself)."""

    def __init__(self, n, component, side, sketches: list[np.ndarray], num: int, den: int):
        self.n, self.component, self.side = (np.array(x, np.int64) for x in (n, component, side))
        self.num, self.den, self.bands = num, den, Bands(num, den)
        width = min(map(len, sketches))
        self.sketch = np.stack([fold(x, width) for x in sketches])

    def partners(self, rows: np.ndarray) -> np.ndarray:
        """(rows, all): pairs of different components that neither sizes nor sketches rule out."""
        n, m = self.n[rows, None], self.n[None]
        ok = (self.component[rows, None] != self.component[None]) & (self.num * np.maximum(n, m) <= self.den * np.minimum(n, m))
        ok &= (self.side[rows, None] != self.side[None]) | (self.side[None] == 2)
        a, b = np.nonzero(ok)
        step = max(1, (1 << 20) // self.sketch.shape[1])
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            far = np.bitwise_count(self.sketch[rows[x]] ^ self.sketch[y]).sum(1, dtype=np.int64)
            no = far > self.bands.delta(self.n[rows[x]] + self.n[y], 0)
            ok[x[no], y[no]] = False
        return ok

    def parts(self):
        """Rows in lots whose pairs fit in memory."""
        step = max(1, (1 << 20) // len(self.n))
        for i in range(0, len(self.n), step):
            yield np.arange(i, min(i + step, len(self.n)))


def _grouped(batches, names):
    """The rows (dicts of lists) of one (key, i, j) after the other."""
    place, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        cut = np.flatnonzero(reduce(np.logical_or, (x[1:] != x[:-1] for x in at))) + 1
        columns = {c: batch.column(c).to_pylist() for c in names}
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            here = tuple(int(x[a]) for x in at)
            if here != place:
                if held:
                    yield place, held
                place, held = here, {c: [] for c in names}
            for c in names:
                held[c] += columns[c][a:b]
    if held:
        yield place, held


PLACED = "key long, i int, j int, node long, component long, side int"


def _open(num: int, den: int):
    """Blocks with sketches: the rows that have a partner, once for each block pair."""

    def run(batches):
        for place, x in _grouped(batches, ["node", "component", "side", "n", "sketch"]):
            if len(x["node"]) < 2:
                continue
            block = Block(x["n"], x["component"], x["side"], [np.frombuffer(s, np.uint64) for s in x["sketch"]], num, den)
            hit = np.zeros(len(x["node"]), bool)
            for rows in block.parts():
                ok = block.partners(rows)
                hit[rows] |= ok.any(1)
                hit |= ok.any(0)
            if hit.any():
                columns = [np.full(hit.sum(), v, t) for v, t in zip(place, (np.int64, np.int32, np.int32), strict=True)]
                columns += [np.array(x[c], t)[hit] for c, t in (("node", np.int64), ("component", np.int64), ("side", np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in PLACED.split(", ")])

    return run


def settle(nodes: list[int], component: list[int], side: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """The links that join the components of a block."""
    block = Block([len(s) for s in sets], component, side, [parity(s) for s in sets], num, den)
    found = []
    for rows in block.parts():
        ok = block.partners(rows)
        for i, row in zip(rows.tolist(), ok, strict=True):
            for j in np.flatnonzero(row).tolist():
                if block.component[i] != block.component[j] and linked(sets[i], sets[j], num, den):
                    found.append((nodes[i], nodes[j]))
                    block.component[block.component == block.component[j]] = block.component[i]
    return found


def _settle(num: int, den: int):
    def run(batches):
        for _, x in _grouped(batches, ["node", "component", "side", "items"]):
            if len(x["node"]) > 1:
                yield _links(settle(x["node"], x["component"], x["side"], [np.frombuffer(s, np.uint64) for s in x["items"]], num, den))

    return run


MARKS = ["f1", "f2", "n"]


class Groups:
    """The classes of equal sets of ``docs`` (doc_id, text) and the links between them.

    rows: (doc_id, digest, n, f1, f2, ...) for each row. classes: (node, f1, f2, n, copies, who, sketch), who: the first of the
    class's rows by doc_id (rows without one last) and digest of the text."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        ship(docs.sparkSession)
        self.k, self.num, self.den = k, num, den
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
        self.rows = materialize(self.docs.mapInArrow(_survey(k, num, den), SURVEY), "rows")
        who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
        same = self.rows.where("n > 0").groupBy(*MARKS).agg(F.min(who).alias("who"), F.count("*").alias("copies"), F.max("sketch").alias("sketch"))
        self.classes = materialize(same.withColumn("node", F.monotonically_increasing_id()), "classes")
        # doc_ids of several rows, usually none.
        mark = F.xxhash64(*MARKS)
        each = self.rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("rows > 1")
        self.repeated, (self.again,) = counted(each.withColumn("own", -1 - F.monotonically_increasing_id()), "repeated")
        self.found, self.n, self._named = [], 0, None

    def add(self, links: DataFrame):
        """Takes verified links (a, b) in."""
        links, (n,) = counted(links, "links")
        if n:
            self.found.append(links)
            self.n, self._named = self.n + n, None

    def components(self) -> DataFrame | None:
        """(node, component) of the classes that have links; None: there are none."""
        if self._named is None and self.found:
            self._named = components(reduce(DataFrame.unionByName, self.found), self.n)
        return self._named

    def _candidates(self) -> DataFrame:
        """(key, node, n, centre): the classes that share a segment, with the smallest of the segment."""
        keyed = self.rows.where(F.size("keys") > 0).select(F.xxhash64(*MARKS).alias("class"), F.explode("keys").alias("key"))
        total = self.rows.agg(F.sum(F.size("keys"))).collect()[0][0] or 0
        probe = keyed.where(F.pmod("class", F.lit(PROBE)) == 0).distinct().groupBy("key").agg((F.count("*") * PROBE).alias("classes"))
        hot = probe.where(F.col("classes") > max(8 * PROBE, total // HOT))
        salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("classes") / (4 * PROBE)))
        salted = F.col("classes").isNotNull()
        placed = keyed.join(F.broadcast(hot), "key", "left").select(F.when(salted, F.xxhash64("key", salt)).otherwise(F.col("key")).alias("place"), "key", salted.alias("salted"), "class")
        shared = placed.repartition("place").sortWithinPartitions("place", "class").mapInArrow(_shared, "key long, class long, centre long")
        named = self.classes.select(F.xxhash64(*MARKS).alias("class"), "node", "n")
        centre = named.select(F.col("class").alias("centre"), F.col("node").alias("c"))
        return materialize(shared.join(named, "class").join(centre, "centre").select("key", "node", "n", F.col("c").alias("centre")), "segments")

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """(node, items) of classes, from the text of their first row."""
        wanted, (n,) = counted(self.classes.join(nodes, "node", "left_semi").select("node", F.col("who.doc_id").alias("doc"), F.col("who.digest").alias("mark")), "wanted")
        wanted = F.broadcast(wanted) if n <= FEW else wanted
        texts = self.docs.join(wanted, (F.col("digest") == F.col("mark")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("node", "text")
        return materialize(texts.mapInArrow(_sets(self.k), "node long, items binary"), "items")

    def _stars(self, shared: DataFrame):
        """Adds the links of the classes of a key to its smallest one."""
        sketches = self.classes.select("node", "n", "sketch")
        pairs = materialize(shared.where("node <> centre").select("centre", "node").distinct(), "pairs")
        side = [sketches.toDF(own, f"n_{x}", f"sketch_{x}") for own, x in (("node", "a"), ("centre", "b"))]
        sized = F.expr(f"{self.num} * greatest(n_a, n_b) <= {self.den} * least(n_a, n_b)")
        near = pairs.join(side[0], "node").join(side[1], "centre").where(sized).mapInArrow(_near(self.num, self.den), "centre long, node long")
        near, (total,) = counted(near, "near")
        if not total:
            return
        sizes = materialize(near.groupBy("centre").agg(F.count("*").alias("members")), "centres")
        # No more than HOT centres can have a HOT-th of the pairs.
        many = F.broadcast(sizes.where(F.col("members") > total // HOT).select("centre", F.ceil(F.col("members") / max(1, total // HOT)).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        members = near.join(many, "centre", "left").select("centre", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node")
        centres = sizes.join(many, "centre", "left").select("centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("centre").alias("node"))
        items = self._sets(members.select("node").union(centres.select("node")).distinct())
        rows = members.unionByName(centres).join(items, "node")
        dealt = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("node") != F.col("centre"))
        self.add(dealt.mapInArrow(_star(self.num, self.den), "a long, b long"))

    def _blocks(self, known: DataFrame, chosen: DataFrame):
        """Adds the links that join the components within the chosen keys (key, size, weight)."""
        block = F.greatest(F.lit(BLOCK), F.least(F.lit(8 * BLOCK), 4 * F.sqrt("size")))
        blocks = F.ceil(F.greatest(F.col("size") / block, F.col("weight") / WEIGHT)).cast("int")
        rows = known.join(chosen.select("key", blocks.alias("blocks")), "key")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        placed = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", side.alias("side"))
        dealt = lambda x: x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        opened = dealt(placed.join(self.classes.select("node", "n", "sketch"), "node")).mapInArrow(_open(self.num, self.den), PLACED)
        opened, (n,) = counted(opened, "open")
        if not n:
            return
        items = self._sets(opened.select("node").distinct())
        self.add(dealt(opened.join(items, "node")).mapInArrow(_settle(self.num, self.den), "a long, b long"))

    def link(self):
        """Finds links that join up all pairs of classes that link."""
        shared = self._candidates()
        self._stars(shared)
        for last in (False, True):
            known = shared.select("key", "node", "n")
            if (named := self.components()) is not None:
                known = known.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
            else:
                known = known.withColumn("component", F.col("node"))
            # Keys of two classes are settled by their star; those in one component need nothing more.
            sizes = known.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            left, (n,) = counted(sizes.where(f"lo <> hi AND size > {2 if last else LARGE}"), "left")
            if not n:
                continue
            chosen = left
            if not last:
                named = known.join(left.select("key"), "key", "left_semi").groupBy("node").agg(F.min(F.struct(F.xxhash64("key"), "key")).alias("pick"))
                chosen = left.join(named.select("pick.key").distinct(), "key", "left_semi")
            self._blocks(known, chosen)

    def by_class(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``table`` (one row for each class, with its copies)."""
        most = (rows.count()) // HOT
        hot, rest = F.broadcast(table.where(F.col("copies") > most).drop("copies")), table.where(F.col("copies") <= most).drop("copies")
        return rows.join(hot, MARKS).unionByName(rows.join(hot.select(*MARKS), MARKS, "left_anti").join(rest, MARKS))


def similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; similarity num / den or more links."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    groups = Groups(docs.where("doc_id IS NOT NULL"), k, num, den)
    groups.link()
    mixed = groups.repeated.where("lo <> hi")
    if groups.again:
        own = groups.rows.where("n > 0").join(mixed.select("doc_id", "own"), "doc_id").select("own", *MARKS).distinct()
        groups.add(groups.by_class(own, groups.classes.select(*MARKS, "node", "copies")).select(F.col("own").alias("a"), F.col("node").alias("b")))
    table = groups.classes.select(*MARKS, "copies", "node", F.col("who.doc_id").alias("least"))
    if (named := groups.components()) is not None:
        first = table.join(named, "node").groupBy("component").agg(F.min("least").alias("first"))
        named = materialize(named.join(first, "component").select("node", "first"), "named")
        table = table.join(named, "node", "left").withColumn("least", F.coalesce("first", "least")).drop("first")
    rows = groups.rows.select("doc_id", *MARKS)
    full = groups.by_class(rows.where("n > 0"), table.drop("node")).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if groups.again and named is not None:
        linked_ids = mixed.join(named.withColumnRenamed("node", "own"), "own").select("doc_id", "first")
        empty = empty.join(linked_ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("first", "component_id").alias("component_id"))
    nameless = docs.where("doc_id IS NULL").select("doc_id", F.lit(0).cast("long").alias("digest"), "text").mapInArrow(_survey(k, num, den), SURVEY)
    return full.unionByName(empty).unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


#: A text with a word.
WORDY = r"[^\x20\x09-\x0D]"


def dedupe(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row for each group of texts that links join: of its rows that with the smallest doc_id (rows without one
    come last), then the smallest digest of the text. doc_ids do not join groups here, so no text goes
    that has no like among those that stay. Rows equal in doc_id and text are one document; texts without a word link with nothing and stay."""
    groups = Groups(docs.select(F.col("doc_id").cast("long"), "text"), k, num, den)
    groups.link()
    table = groups.classes.select("node", "who")
    if (named := groups.components()) is not None:
        table = table.join(named, "node", "left")
        # Only classes with a link are grouped.
        grouped = table.where("component IS NOT NULL").groupBy("component").agg(F.min("who").alias("who")).select("who")
        table = table.where("component IS NULL").select("who").unionByName(grouped)
    digest, doc, mark = unused(docs.columns, "_digest", "_doc", "_mark")
    stay = materialize(table.select(F.col("who.doc_id").alias(doc), F.col("who.digest").alias(mark)), "stay")
    own = docs.withColumn(digest, F.xxhash64("text"))
    wordy = F.coalesce(F.col("text").rlike(WORDY), F.lit(False))
    kept = own.where(wordy).join(stay, (F.col(digest) == F.col(mark)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")
    kept = kept.unionByName(own.where(~wordy))
    if not groups.again:
        return kept.drop(digest)
    again = groups.repeated.select(F.col("doc_id").alias(doc))
    twice = F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    once = kept.join(again, twice, "left_semi")
    order = F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    once = once.groupBy("doc_id", digest).agg(F.min_by(F.struct(*docs.columns), order).alias(mark)).select(f"{mark}.*")
    return kept.join(again, twice, "left_anti").drop(digest).unionByName(once)


def query(docs: DataFrame) -> DataFrame:
    return similar(docs, 3, 90, 100)
