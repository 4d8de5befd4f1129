"""Soft-membership mixing: document rates whose expected domain totals meet target weights.

A classifier fitted on the labelled table (at most ``sample_rows`` rows, those with the smallest hash of
doc_id) gives every document posteriors over the domains. The rates minimise the squared distance
between expected domain totals, sum of rate x tokens x posterior, and the targets over
rates >= 0; of the rates that do so, those nearest to 1 are taken, in a metric that weighs a document by its
tokens. These are max(0, 1 - posteriors x g) for one vector g, which Newton steps find: each is a pass
over all documents that returns the domain totals and the Gram matrix of the documents with a
positive rate. So rates follow from the posteriors and g, and need no table of their own. Where no rates
meet the targets within ``near`` a warning tells the totals that were reached; a search that does not end raises.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. ``total`` is the number of tokens wanted; None asks for
that at which the first domain of the targets is taken once as a whole. A document is taken floor(rate + u) times, u from a
hash of its doc_id, whatever the rate, so that the copies meet the targets as the rates do, but for the draw.

Defined results: a null text has no tokens and rate by its posteriors like any other; without labels
every document has equal posteriors; an empty table gives no row; repeated rows have equal rates.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.quality import DIMS, SAMPLE_ROWS, SCALE, descend, features, labelled_sample
from vectide.llm.scratch import materialize, ship, unused
from vectide.llm.textvec import Words, range_sums, runs, strings

#: Difference of totals to targets that counts as met, as a share of all tokens.
NEAR = 1e-4
#: Weight of the least change of rates beside the squared distance, as a share of all tokens.
PULL = 1e-9


def domain_of() -> Column:
    """The domains of the labels table: low, toxic or clean."""
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality").isNotNull(), "clean")


TARGETS = {"clean": 0.95, "toxic": 0.04, "low": 0.01}


@dataclass
class Classifier:
    """One logistic regression for each domain; posteriors are their shares."""

    weights: np.ndarray  # (dims, domains)
    bias: np.ndarray

    def posteriors(self, words: Words) -> np.ndarray:
        z = np.tile(self.bias, (len(words.begin) - 1, 1))
        for index, begin, end in features(words):
            for k in range(len(self.bias)):
                z[:, k] += SCALE * range_sums(self.weights[k][index], begin, end) / np.maximum(end - begin, 1)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # Rounded, so that sums in another order of rows lead to the same rates.
        return np.round(p / p.sum(1, keepdims=True), 6)


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """labels: doc_id and domain. Labels of other domains are not used."""
    code = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int")
    coded = labels.select("doc_id", code.alias("code")).where("code > 0")
    rows = labelled_sample(docs, coded, "code", sample_rows)
    if not rows:
        return Classifier(np.zeros((len(domains), DIMS), np.float32), np.zeros(len(domains)))
    index = [np.frombuffer(r["index"], np.int32) for r in rows]
    value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows])
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in index])))
    flat, label = np.concatenate(index), np.array([r["label"] for r in rows])
    fitted = [descend(flat, value, bounds, (label == k + 1).astype(float), np.full(len(rows), 1 / len(rows)), DIMS) for k in range(len(domains))]
    return Classifier(np.stack([w.astype(np.float32) for w, _ in fitted]), np.array([b for _, b in fitted]))


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after the steps: each moves by the posteriors and stays at 0 or above."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return np.round(r, 9)


def _members(model: Classifier):
    def run(batches):
        for batch in batches:
            raw, at = strings(batch.column("text"))
            n, p = [np.zeros(0, np.int64)], [np.zeros((0, len(model.bias)))]
            for i, j in runs(at):
                words = Words(raw, at[i : j + 1])
                n.append(words.counts())
                p.append(model.posteriors(words))
            n, p = np.concatenate(n), np.concatenate(p)
            own = [c for c in batch.schema.names if c != "text"]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n, pa.int64()), flat], names=[*own, "n_tokens", "posteriors"])

    return run


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("posteriors").flatten().to_numpy().reshape(-1, k)


def _sums(steps: list[np.ndarray], k: int):
    """Domain totals, the Gram matrix of the documents with a positive rate, the squared rates."""

    def run(batches):
        total = np.zeros(k + k * k + 1)
        for batch in batches:
            p, n = _matrix(batch, k), batch.column("n_tokens").to_numpy()
            r = rates(p, steps)
            total[:k] += (r * n) @ p
            total[k:-1] += ((p * (n * (r > 0))[:, None]).T @ p).reshape(-1)
            total[-1] += (r * r) @ n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["domain", "total"])

    return run


def _over_all(members: DataFrame, run, n: int) -> np.ndarray:
    """Sums over all documents: every task sends one row for each of n places."""
    out = np.zeros(n)
    for r in members.select("n_tokens", "posteriors").mapInArrow(run, "domain long, total double").groupBy("domain").agg(F.sum("total").alias("total")).collect():
        out[r.domain] = r.total
    return out


def solve(members: DataFrame, weights: list[float], total: float | None = None, rounds: int = 100, near: float = NEAR) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps, expected domain totals after them, and the targets. The steps are one at most: Newton steps with halving
    on the dual of the least change of rates; ``PULL`` makes it that of the least squares where no rates meet the targets."""
    k = len(weights)

    def at(g):
        x = _over_all(members, _sums([g], k), k + k * k + 1)
        return x[:k], x[k:-1].reshape(k, k), x[-1]

    g = np.zeros(k)
    reached, gram, squares = at(g)
    mass = float(reached.sum())
    share = np.array(weights, float) / sum(weights)
    if total is None:
        total = float(max(reached[0], 1e-9) / max(share[0], 1e-12)) if mass > 0 else 0.0
    goal = share * total
    if mass <= 0:
        return [], reached, goal
    pull = PULL * mass

    def height(g, squares):
        return (squares / 2 + goal @ g + pull * (g @ g) / 2) / mass

    for _ in range(rounds):
        slope = goal - reached + pull * g
        if np.abs(slope).max() <= near / 100 * max(total, 1.0):
            break
        move = -np.linalg.solve(gram + pull * np.eye(k), slope)
        low, length = height(g, squares), 1.0
        while True:
            found = at(g + length * move)
            if height(g + length * move, found[2]) <= low + 1e-4 * length * (slope @ move) / mass + 1e-12 * abs(low):
                break
            length /= 2
            if length < 1e-9:
                break
        if length < 1e-9:
            break
        g = g + length * move
        reached, gram, squares = found
    left = float(np.abs(goal - reached + pull * g).max())
    if left > near * max(total, 1.0):
        raise ArithmeticError(f"mixing: the rates are not found within {rounds} rounds; {left:.6g} tokens are left of {total:.6g}")
    return ([g] if g.any() else []), reached, goal


def _plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None, sample_rows: int):
    ship(docs.sparkSession)
    model = fit(docs, labels, list(targets), sample_rows)
    members = docs.select("doc_id", "text").mapInArrow(_members(model), "doc_id long, n_tokens long, posteriors array<double>")
    members = materialize(members, "members")
    steps, reached, goal = solve(members, list(targets.values()), total)
    if np.abs(reached - goal).max() > NEAR * max(goal.sum(), 1.0):
        warnings.warn(f"mixing: no rates meet the targets; tokens {dict(zip(targets, reached.round(1).tolist()))} for {dict(zip(targets, goal.round(1).tolist()))}", stacklevel=3)
    return model, members, steps


def copies(rate: Column) -> Column:
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + u).cast("long")


def _fold(steps: list[np.ndarray], k: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(_matrix(batch, k), steps))], names=[*batch.schema.names, "rate"])

    return run


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate, copies) for each row; posteriors in the order of ``targets``."""
    _, members, steps = _plan(docs, labels, targets, total, sample_rows)
    return members.mapInArrow(_fold(steps, len(targets)), "doc_id long, n_tokens long, posteriors array<double>, rate double").withColumn("copies", copies(F.col("rate")))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``, every row as many times as its rate says. The rates are found again from
    the texts, so nothing is joined."""
    model, _, steps = _plan(docs, labels, targets, total, sample_rows)
    rate, n, one = unused(docs.columns, "_rate", "_copies", "_copy")

    def run(batches):
        for batch in batches:
            raw, at = strings(batch.column("text"))
            p = [model.posteriors(Words(raw, at[i : j + 1])) for i, j in runs(at)]
            p = np.concatenate([np.zeros((0, len(model.bias))), *p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, steps))], names=[*batch.schema.names, rate])

    rated = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(rate, T.DoubleType())]))
    taken = rated.withColumn(n, copies(F.col(rate))).where(F.col(n) > 0)
    return taken.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = document_rates(docs, labels.select("doc_id", domain_of().alias("domain")))
    names = [F.element_at("posteriors", k + 1).alias(f"p_{d}") for k, d in enumerate(TARGETS)]
    return found.select("doc_id", "n_tokens", *names, "rate", "copies")
