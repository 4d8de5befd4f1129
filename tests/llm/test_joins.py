"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vectide.llm import ngram_join as g


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    """doc_id to (set size, component); rows that share a doc_id share links."""
    root, sets = {}, []
    for i, t in rows:
        if i is not None:
            root[i] = i
            sets.append((i, shingles(t, k)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None)


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_odd_rows(odd, odd_rows, k, num):
    df = g.similar(odd, k, num, 100)
    assert got(df) == brute(odd_rows, k, num, 100)
    assert df.where("doc_id IS NULL").first().component_id is None


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_families_around_the_bound(spark, k, num):
    rng = random.Random(k)
    rows = []
    for family in range(12):
        base = [f"f{family}x{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 40, 150, 400]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            cut = rng.randrange(0, 1 + len(base) // 12)
            rows.append((len(rows), " ".join(copy[cut:])))
    rng.shuffle(rows)
    assert got(g.similar(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100)) == brute(rows, k, num, 100)


def test_a_large_group_of_near_copies_over_blocks(spark, monkeypatch):
    """Copies of an original that they alone link to: no two edits need to be alike."""
    monkeypatch.setattr(g, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for j in rng.sample(range(200), 3 if i % 2 else 9):
            copy[j] = f"e{i}n{j}"
        rows.append((i, " ".join(copy)))
    rows.append((500, " ".join(base)))
    assert got(g.query(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 3, 90, 100)


def test_empty(empty):
    assert g.query(empty).count() == 0


def test_dedupe_keeps_the_smallest(odd, odd_rows):
    keep = {c for _, _, c in brute(odd_rows, 5, 80, 100)}
    rows = g.dedupe(odd).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(keep)
    assert sum(r.doc_id is None for r in rows) == 1 and rows[0].asDict().keys() == odd.first().asDict().keys()


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 5, 100, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.concatenate((a[n // 10 :], rng.integers(0, 1 << 63, n // 10 + 3).astype(np.uint64))))
        w = min(len(g.parity(a)), len(g.parity(b)))
        far = np.bitwise_count(g.fold(g.parity(a), w) ^ g.fold(g.parity(b), w)).sum()
        assert far <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(5, 600))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n // 12) + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 15) + 1))).astype(np.uint64))))
        rng.shuffle(b)
        b = np.sort(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            bands = g.Bands(90, 100)
            assert np.intersect1d(g.keys_of(a, bands), g.keys_of(b, bands)).size


@pytest.mark.parametrize("num", [25, 30, 50, 80])
def test_sketches_of_all_widths_are_compared(num):
    rng = np.random.default_rng(2)
    whole = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(whole[:n]) for n in (32, 40, 64, 100, 110, 128, 250, 400)]
    block = g.Block([len(x) for x in sets], range(len(sets)), [2] * len(sets), [g.parity(x) for x in sets], num, 100)
    ok = block.partners(np.arange(len(sets)))
    assert all(ok[i, j] for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i]) >= num * len(sets[j]))


def test_a_block_gives_the_links_that_join_its_components():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[int(rng.integers(0, 12)) :], rng.integers(1, 1 << 62, 8).astype(np.uint64)))) for _ in range(60)]
    sets += [np.unique(rng.integers(1, 1 << 62, 300).astype(np.uint64)) for _ in range(20)]
    found = g.settle(list(range(80)), list(range(80)), [2] * 80, sets, 90, 100)
    assert len(found) == 59 and all(g.linked(sets[a], sets[b], 90, 100) for a, b in found)
    # Against each other only: rows of one side are not compared.
    apart = g.settle([0, 1, 2], [0, 1, 2], [0, 0, 1], [sets[0], sets[0], sets[70]], 90, 100)
    assert apart == []


def test_shared_classes_over_many_batches():
    """Whatever the batches, every class of a place with two is told once, with the place's first; salted ones always."""
    rng = random.Random(6)
    rows = sorted((p, p * 10, p % 7 == 0, rng.randrange(6)) for p in (rng.randrange(40) for _ in range(300)))
    want = []
    for p in sorted({r[0] for r in rows}):
        own = sorted({r[3] for r in rows if r[0] == p})
        want += [(p * 10, c, own[0]) for c in own if len(own) > 1 or p % 7 == 0]
    for size in (1, 2, 3, 50, 1000):
        batches = [pa.RecordBatch.from_pydict({n: [r[i] for r in rows[k : k + size]] for i, n in enumerate(("place", "key", "salted", "class"))}) for k in range(0, len(rows), size)]
        told = [tuple(r.values()) for b in g._shared(batches) for r in b.to_pylist()]
        assert told == want


def test_hot_keys_and_classes(spark, monkeypatch):
    """With the bounds so low that keys are salted, classes broadcast and centres split, the result is the same."""
    monkeypatch.setattr(g, "HOT", 4)
    monkeypatch.setattr(g, "PROBE", 1)
    monkeypatch.setattr(g, "WEIGHT", 2000)
    rng = random.Random(8)
    rows = []
    for family, size in (("a", 60), ("b", 25)):
        base = [f"{family}{i}" for i in range(120)]
        for i in range(size):
            copy = list(base)
            for j in rng.sample(range(120), rng.choice([0, 0, 1, 2])):
                copy[j] = f"e{family}{i}n{j}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(f"z{i}x{j}" for j in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(g.query(df)) == brute(rows, 3, 90, 100)


A, B = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")


def test_repeated_ids(spark):
    """Rows that share a doc_id share their links, but each text keeps a like of its own."""
    rows = [(3, A), (5, A), (5, B), (7, B), (9, ""), (9, A + " tail"), (11, None), (11, "only words here"), (5, B), (None, B), (None, "no id " + A), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(g.similar(df)) == brute(rows, 5, 80, 100)
    kept = sorted(map(tuple, g.dedupe(df).collect()), key=str)
    assert kept == sorted([(3, A), (5, B), (9, ""), (11, None), (11, "only words here"), (None, " ")], key=str)


def test_dedupe_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, A, "x", 1), (1, A, "x", 1), (1, A, "w", 2), (2, B, "y", 3), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, _digest long")
    found = sorted(map(tuple, g.dedupe(df).collect()), key=str)
    assert len(found) == 3 and found[0][:2] == (1, A) and found[1:] == [(2, B, "y", 3), (None, None, None, None)]
    assert g.dedupe(df).columns == df.columns


def test_dedupe_of_nothing(empty):
    assert g.dedupe(empty).count() == 0
