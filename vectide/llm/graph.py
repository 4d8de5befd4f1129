"""Connected components over a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.scratch import counted

#: So many links a task takes at most.
PART = 500_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return kept.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, ascending, and the smallest node that each is joined to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
        if (label[x] == label[y]).all():
            break
    return nodes, nodes[label]


def _joined(batches):
    found = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in labels(a, b)], names=["node", "component"])


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b) but those that only link to themselves: component is its smallest node.

    Links that fit into one task are joined there. More are mapped by alternating stars: each round maps every
    neighbourhood onto its smallest member; the rounds needed grow with the logarithm of the longest path. Links are
    kept in the shared folder between rounds. n: the number of links, where it is known.
    """
    now = links.select("a", "b").where("a <> b")
    n = now.count() if n is None else n
    if n <= PART:
        return counted(now.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")[0]
    total = F.bit_xor(F.xxhash64("a", "b"))
    now, state = counted(now.distinct(), "links", total)
    while state[0]:
        # A file for every PART links, however many partitions the session has: the links never become more.
        now, after = counted(_small_star(_large_star(now)).coalesce(1 + state[0] // PART), "links", total)
        if after == state:
            break
        state = after
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
