"""Quality rules: base rules and a hashed n-gram logistic regression with calibration.

Words are ``[^\\x20\\x09-\\x0D]+``. The model is a logistic regression on the relative
frequencies of hashed words, of hashed pairs of words and of hashed 3-grams of code points, fitted on at most
``sample_rows`` labelled rows and ``sample_bytes`` of their features (those with the smallest hash of doc_id), with Platt scaling on
every fourth row of each class, which the fit does not see; documents are scored in Arrow batches against ``threshold``.

Defined results: a null text has no words and fails the base rules; a doc_id whose labels disagree is not used; of several texts of
one labelled doc_id that with the smallest hash is; without labels of
both classes the model keeps every document (the base rules still hold); with few labels the scaling follows the
prior of Platt's method; repeated rows are scored alike; other columns are carried along unseen.
Lines and windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.scratch import materialize, ship, without
from vectide.llm.textvec import IS_SPACE, Words, mix, range_sums, runs, segment_sums, spans, strings, windows

WORD_BITS, PAIR_BITS, CHAR_BITS = 17, 17, 16
DIMS = (1 << WORD_BITS) + (1 << PAIR_BITS) + (1 << CHAR_BITS)
SCALE = 30.0
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64_000_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def features(words: Words) -> tuple[Part, Part, Part]:
    """Hashed words, pairs of words and 3-grams of code points as indices, each with where those of a text begin and
    end. The 3-grams of a text end with the space behind it; none reaches into another text."""
    h, first = words.hashes(), words.first
    pair = windows(h, 2)
    begin = np.minimum(first[:-1], len(pair))
    pairs = _top(pair, PAIR_BITS) + np.int32(1 << WORD_BITS), begin, np.maximum(begin, first[1:] - 1)
    at, char = words.characters()
    gram = mix((char[:-2] * np.uint64(0x9E3779B97F4A7C15) + char[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + char[2:]) if len(char) > 2 else char[:0]
    edge = np.searchsorted(at, words.begin)
    begin = np.minimum(edge[:-1], len(gram))
    grams = _top(gram, CHAR_BITS) + np.int32((1 << WORD_BITS) + (1 << PAIR_BITS)), begin, np.maximum(begin, edge[1:] - 2)
    return (_top(h, WORD_BITS), first[:-1], first[1:]), pairs, grams


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, words: Words) -> np.ndarray:
        total = np.full(len(words.begin) - 1, self.bias)
        for index, begin, end in features(words):
            total += SCALE * range_sums(self.weights[index], begin, end) / np.maximum(end - begin, 1)
        return total

    def probabilities(self, words: Words) -> np.ndarray:
        """Rounded, so that sums over a run in other company come to the same."""
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * self.scores(words) + self.shift, -500, 500))), 9)


def _sparse(words: Words, d: int, parts) -> tuple[np.ndarray, np.ndarray]:
    index, value = [], []
    for x, begin, end in parts:
        i, n = np.unique(x[begin[d] : end[d]], return_counts=True)
        index.append(i)
        value.append(n * SCALE / max(1, n.sum()))
    return np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)


def _extract(batches):
    for batch in batches:
        raw, at = strings(batch.column("text"))
        rows = []
        for i, j in runs(at):
            words = Words(raw, at[i : j + 1])
            parts = features(words)
            rows += [_sparse(words, d, parts) for d in range(j - i)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())],
            names=["doc_id", "label", "index", "value"],
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int = SAMPLE_BYTES) -> list:
    """At most ``rows`` labelled documents as sparse features, of ``size`` bytes together; bounded, so it may go to the driver."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    order = F.xxhash64("doc_id")
    picked = marked.where("label = other").orderBy(order, "doc_id").limit(rows).select("doc_id", "label")
    text = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    rows_of = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), text)
    found = materialize(ship(docs.sparkSession) and rows_of.mapInArrow(_extract, "doc_id long, label int, index binary, value binary"), "sample")
    used, chosen = 0, []
    for r in found.select("doc_id", F.octet_length("index").alias("n")).orderBy(order, "doc_id").collect():
        used += 2 * r.n
        if used > size and chosen:
            break
        chosen.append(r.doc_id)
    return sorted(found.where(F.col("doc_id").isin(chosen)).collect(), key=lambda r: r.doc_id)


def descend(index, value, bounds, y, weight, dims, steps=120, rate=0.15, penalty=1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; y holds 0 or 1."""
    w, b = np.zeros(dims + 1), 0.0
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    for t in range(1, steps + 1):
        z = segment_sums(value * w[index], bounds) + w[dims]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(index, value * error[row], dims + 1)
        g[:dims] += penalty * w[:dims]
        g[dims] = error.sum()
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    return w[:dims], float(w[dims] + b)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (above 0) and shift that make sigmoid(slope * z + shift) the rate of y, by Newton steps on
    Platt's smoothed targets; without rows 1 and 0."""
    pos = y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -50, 50)))
        h = p * (1 - p) + 1e-9
        d = p - target
        g = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, c = a - step[0], c - step[1]
    return max(float(a), 1e-6), float(c)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """The model, or None where the labels do not hold both classes."""
    rows = labelled_sample(docs, labels, label, sample_rows, sample_bytes)
    if len({r.label > 0 for r in rows}) < 2:
        return None
    return fit_rows(rows)


def fit_rows(rows: list) -> Model:
    index = [np.frombuffer(r["index"], np.int32) for r in rows]
    value = [np.frombuffer(r["value"], np.float32) for r in rows]
    y = np.array([float(r["label"] > 0) for r in rows])
    held = np.zeros(len(rows), bool)
    for k in (0, 1):
        held[np.flatnonzero(y == k)[3::4]] = True

    at = np.flatnonzero(~held)
    share = y[at].mean()
    weight = np.where(y[at] > 0, 0.5 / share, 0.5 / (1 - share)) / len(at)
    bounds = np.concatenate(([0], np.cumsum([len(index[i]) for i in at])))
    w, b = descend(np.concatenate([index[i] for i in at]), np.concatenate([value[i] for i in at]), bounds, y[at], weight, DIMS)
    z = np.array([float((value[i] * w[index[i]]).sum() + b) for i in np.flatnonzero(held)])
    return Model(w.astype(np.float32), b, *platt(z, y[held]))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _again(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash equals an earlier one of its text, and whether any other one."""
    key = mix(h + text.astype(np.uint64) * _ODD)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def repeated_words(words: Words, k: int) -> np.ndarray:
    """For each text its words in windows of k words that occur twice or more in it."""
    n = words.counts()
    size = np.maximum(n - k + 1, 0)
    at, text = spans(words.first[:-1], size), np.repeat(np.arange(len(n)), size)
    _, hit = _again(windows(words.hashes(), k)[at], text)
    cover = np.zeros(int(n.sum()) + k + 1, np.int32)
    np.add.at(cover, at[hit], 1)
    np.add.at(cover, at[hit] + k, -1)
    return segment_sums((np.cumsum(cover)[: int(n.sum())] > 0).astype(np.int64), words.first - words.first[0])


def dup_lines(words: Words) -> np.ndarray:
    """For each text its lines with a word that equal an earlier one."""
    cut = np.flatnonzero(words.data == 0x0A)
    begin, end = np.sort(np.concatenate((words.begin[:-1], cut + 1))), np.sort(np.concatenate((cut, words.begin[1:] - 1)))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[full], end[full]
    text = np.searchsorted(words.begin, begin, "right") - 1
    later, _ = _again(words.hashes_of(begin, end), text)
    return np.bincount(text[later], minlength=len(words.begin) - 1)


def measures(raw: np.ndarray, at: np.ndarray, model: Model | None, k: int = 5) -> dict[str, np.ndarray]:
    """The base figures and the model's probability for a run of texts."""
    words = Words(raw, at)
    data, begin = words.data, words.begin
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    inner = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~IS_SPACE[data])))
    ends = begin[1:] - 1
    return {
        "n_words": words.counts(),
        "word_chars": inner[ends] - inner[begin[:-1]],
        "n_symbols": symbols[ends] - symbols[begin[:-1]],
        "n_dup_lines": dup_lines(words),
        "n_repeat_words": repeated_words(words, k),
        "p_quality": model.probabilities(words) if model else np.ones(len(words.counts())),
    }


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_quality double, base_failed boolean, kept boolean"


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with the figures and the verdict of each document beside its own columns."""
    added = T._parse_datatype_string(COLUMNS)
    own = docs.select(*without(docs.columns, *added.names))

    def run(batches):
        for batch in batches:
            raw, at = strings(batch.column("text"))
            found = [measures(raw, at[i : j + 1], model) for i, j in runs(at)]
            x = {k: np.concatenate([f[k] for f in found]) for k in found[0]} if found else None
            if x is None:
                continue
            failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
            x |= {"base_failed": failed, "kept": ~failed & (x["p_quality"] >= threshold)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x[f.name]) for f in added)], names=[*batch.schema.names, *(f.name for f in added)])

    ship(docs.sparkSession)
    return own.mapInArrow(run, T.StructType([*own.schema, *added]))


def query(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
