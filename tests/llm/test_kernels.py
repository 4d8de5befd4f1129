"""Whole-text kernels and the shared tools against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.llm import graph
from vectide.llm.ranges import bucket_of, id_bucket
from vectide.llm.scratch import scratch_root, unused
from vectide.llm.textvec import Words, runs, segment_sums, spans, strings, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words(odd_rows):
    texts = [t or "" for _, t in odd_rows]
    raw, at = strings(pa.array([t for _, t in odd_rows]))
    for limit in (1, 100, 1 << 20):
        found, by_hash = [], {}
        for i, j in runs(at, limit):
            w = Words(raw, at[i : j + 1])
            for h, a, b in zip(w.hashes().tolist(), w.start.tolist(), w.end.tolist(), strict=True):
                assert by_hash.setdefault(h, w.data[a:b].tobytes()) == w.data[a:b].tobytes()
            assert len(w.hashes()) == w.counts().sum()
            found += w.counts().tolist()
        assert found == [len(WORD.findall(t)) for t in texts]


def test_windows_are_equal_where_words_are():
    w = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64)
    h = windows(w, 3)
    keys = [tuple(w[i : i + 3].tolist()) for i in range(498)]
    assert len(set(keys)) == len(set(h.tolist())) == len(set(zip(keys, h.tolist(), strict=True)))


def test_small_tools():
    assert spans(np.array([5, 0, 9]), np.array([2, 0, 1])).tolist() == [5, 6, 9]
    assert segment_sums(np.array([1, 2, 3]), np.array([0, 2, 2, 3])).tolist() == [3, 0, 3]
    assert strings(pa.array([], pa.string()))[1].tolist() == [0]
    assert unused(["A", "a_"], "a", "b") == ["a__", "b"]


def test_buckets(spark):
    splits = [3, 7, 8, 20]
    rows = spark.range(25).select("id", bucket_of(lambda s: F.col("id") < s, splits).alias("b"), id_bucket(F.col("id"), splits).alias("c")).collect()
    assert all(r.b == r.c == sum(s <= r.id for s in splits) for r in rows)
    assert spark.range(1).select(id_bucket(F.lit(None).cast("long"), splits)).first()[0] == 4


@pytest.mark.parametrize("seed, part", [(0, 500_000), (1, 500_000), (1, 10), (2, 50)])
def test_components(spark, monkeypatch, seed, part):
    monkeypatch.setattr(graph, "PART", part)
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {v: find(v) for v in linked}


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
