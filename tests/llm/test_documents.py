"""Quality rules, mixing, licences, sharding, chat, fingerprints, the pipeline."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from vectide.llm import chat, fingerprints, licences, mixing, quality, registry, sharding
from vectide.llm.textvec import Words, strings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_figures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat), failed


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_figures(odd, odd_rows, real, labels, empty):
    for df, rows in ((odd, odd_rows), (real, [(r.doc_id, r.text) for r in real.collect()])):
        got = sorted(((r.doc_id, *(r[c] for c in FIGURES)) for r in quality.query(None, df, labels).collect()), key=str)
        assert got == sorted(((i, *base_figures(t)) for i, t in rows), key=str)
    assert quality.query(None, empty, labels).count() == 0


def test_quality_model_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = quality.query(None, docs, fitted).join(held, "doc_id").collect()
    fine = [r for r in rows if not r.base_failed]
    assert np.mean([(r.p_quality >= 0.5) == bool(r.quality) for r in fine]) > 0.97
    assert all(not r.kept for r in rows if r.base_failed)
    assert np.mean([r.kept for r in fine if r.quality]) > 0.98


def test_quality_without_labels(odd, labels):
    for some in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        rows = quality.query(None, odd, some).collect()
        assert all(r.kept != r.base_failed and r.p_quality == 1.0 for r in rows)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["a", "", "bc d", "ef", "longer text here"]

    def sparse(some):
        raw, at = strings(pa.array(some))
        words = Words(raw, at)
        parts = quality.features(words)
        return [[x.tolist() for x in quality._sparse(words, d, parts)] for d in range(len(some))]

    assert sparse(texts) == [sparse([t])[0] for t in texts] == sparse(texts[::-1])[::-1]


M64 = (1 << 64) - 1


def mixed(x):
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 29
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 32


def hashed(word):
    """The polynomial hash of a word's bytes, one by one."""
    h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word.encode()))
    return mixed((h + len(word.encode())) & M64)


def plain_score(model, text):
    """The model's probability from words, pairs and 3-grams taken one at a time."""
    words = [hashed(w) for w in WORD.findall(text)]
    pairs = [mixed((a * 0xD6E8FEB86659FD93 + b) & M64) for a, b in zip(words, words[1:])]
    code = [int.from_bytes(c.encode(), "little") for c in text + " "]
    grams = [mixed(((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 + c) & M64) for a, b, c in zip(code, code[1:], code[2:])]
    z, base = model.bias, 0
    for items, bits in ((words, quality.WORD_BITS), (pairs, quality.PAIR_BITS), (grams, quality.CHAR_BITS)):
        z += quality.SCALE * sum(float(model.weights[base + (h >> 64 - bits)]) for h in items) / max(1, len(items))
        base += 1 << bits
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -500, 500)))


def test_quality_verdicts_against_a_plain_scorer(odd, odd_rows, real, labels):
    model = quality.fit(real, labels)
    for df, rows in ((odd, odd_rows), (real.limit(60), [(r.doc_id, r.text) for r in real.limit(60).collect()])):
        want = sorted(((i, round(plain_score(model, t or ""), 6), not base_figures(t)[-1] and plain_score(model, t or "") >= 0.5) for i, t in rows), key=str)
        got = sorted(((r.doc_id, round(r.p_quality, 6), r.kept) for r in quality.score(df, model).collect()), key=str)
        assert got == want


def test_quality_model_is_repeatable_and_its_sample_bounded(spark, real, labels):
    """Labels that disagree are left out, of two texts of an id one is used, whatever the order of rows."""
    docs = real.select("doc_id", "text")
    torn = labels.limit(5).withColumn("quality", 1 - F.col("quality"))
    more = docs.unionByName(docs.limit(30).withColumn("text", F.concat("text", F.lit(" tail"))))
    first = quality.fit(more.repartition(3), labels.unionByName(torn))
    again = quality.fit(more.orderBy(F.desc("doc_id")).repartition(7), torn.unionByName(labels).repartition(2))
    assert (first.weights == again.weights).all() and (first.bias, first.slope, first.shift) == (again.bias, again.slope, again.shift)
    ids = {r.doc_id for r in torn.collect()}
    assert not ids & {r.doc_id for r in quality.labelled_sample(more, labels.unionByName(torn), "quality", 3000)}
    few = quality.labelled_sample(docs, labels, "quality", 3000, 20000)
    assert 0 < sum(len(r["index"]) * 2 for r in few) <= 20000 and len(few) < labels.count()
    assert len(quality.labelled_sample(docs, labels, "quality", 7)) == 7


@pytest.mark.parametrize("n", [2, 3, 9])
def test_quality_with_few_labels(spark, n):
    rows = [(i, ("good plain text " if i % 2 else "### junk $$$ ") * 8, i % 2) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs, docs)
    assert 0 < model.slope and plain_score(model, rows[1][1]) > plain_score(model, rows[0][1])


def test_platt_scaling_follows_its_prior_where_rows_are_few():
    assert quality.platt(np.zeros(0), np.zeros(0)) == (1.0, 0.0)
    a, c = quality.platt(np.array([0.0]), np.array([1.0]))
    assert abs(1 / (1 + np.exp(-c)) - 2 / 3) < 1e-3 and a > 0
    assert quality.platt(np.array([3.0, -3.0] * 40), np.array([0.0, 1.0] * 40))[0] > 0


def test_platt_scaling():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(float)
    a, c = quality.platt(z, y)
    assert abs(a - 0.5) < 0.1 and abs(c - 1) < 0.2


def test_mixing_meets_its_targets(real, labels):
    rows = mixing.query(real, labels.select("doc_id", mixing.domain_of().alias("domain"))
                        .selectExpr("doc_id", "CASE domain WHEN 'low' THEN 0 ELSE 1 END AS quality", "CASE domain WHEN 'toxic' THEN 1 ELSE 0 END AS toxic")).collect()
    total = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS}
    whole = sum(total.values())
    for d, share in mixing.TARGETS.items():
        assert abs(total[d] / whole - share) < 0.002
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert sorted(r.n_tokens for r in rows) == sorted(len(WORD.findall(r.text or "")) for r in real.collect())


def test_mixing_solver_reaches_the_least_squares_solution(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    rows = [(int(rng.integers(1, 500)), [float(x) for x in q]) for q in p]
    members = spark.createDataFrame(rows, "n_tokens long, posteriors array<double>")
    steps, reached, goal = mixing.solve(members, [0.5, 0.3, 0.2], 20000.0)
    r = mixing.rates(p, steps)
    n = np.array([x for x, _ in rows])
    assert np.allclose((r * n) @ p, reached) and np.abs(reached - goal).max() < 10 and (r >= 0).all()


def test_copies_of_small_rates_are_drawn(spark):
    for rate in (0.014, 0.05, 0.96, 1.04, 2.97):
        n = spark.range(40000).select(F.lit(rate).alias("rate"), F.col("id").alias("doc_id")).agg(F.avg(mixing.copies(F.col("rate")))).first()[0]
        assert abs(n - rate) < 0.003


def test_mixed_tokens_meet_small_targets(spark):
    rng = random.Random(5)
    rows = [(i, k, " ".join(f"{'clean' if k else 'low'}{rng.randrange(40)}" for _ in range(60))) for i in range(12000) for k in [int(i % 3 > 0)]]
    docs = spark.createDataFrame(rows, "doc_id long, k long, text string").repartition(4).cache()
    marks = docs.select("doc_id", F.when(F.col("k") == 0, "low").otherwise("clean").alias("domain"))
    mixed = {r.k: r["count"] for r in mixing.mix(docs, marks, {"clean": 0.99, "low": 0.01}).groupBy("k").count().collect()}
    p = sum(60 * r.copies * np.array(r.posteriors) for r in mixing.document_rates(docs, marks, {"clean": 0.99, "low": 0.01}).collect())
    assert abs(p[1] / p.sum() - 0.01) < 0.003
    assert 0 < mixed[0] < 0.02 * mixed[1] and abs(mixed[1] - 8000) < 200


def sharp(shares, size=6000, seed=1):
    """Posteriors of a classifier that is sure of most documents, and tokens."""
    rng = np.random.default_rng(seed)
    d = rng.choice(len(shares), size, p=shares)
    z = rng.normal(0, 1, (size, len(shares)))
    z[np.arange(size), d] += 3.5
    p = np.exp(2 * z)
    return np.round(p / p.sum(1, keepdims=True), 6), rng.integers(1, 900, size)


@pytest.mark.parametrize("shares, weights", [([0.8, 0.073, 0.127], [0.95, 0.04, 0.01]), ([0.88, 0.12], [0.96, 0.04]), ([0.5, 0.5], [0.96, 0.04]), ([0.6, 0.39, 0.01], [0.3, 0.3, 0.4])])
def test_mixing_solver_meets_far_targets(spark, shares, weights):
    p, n = sharp(shares)
    members = spark.createDataFrame([(int(x), q.tolist()) for x, q in zip(n, p)], "n_tokens long, posteriors array<double>")
    steps, reached, goal = mixing.solve(members, weights)
    assert np.abs((mixing.rates(p, steps) * n) @ p - goal).max() <= 1e-4 * goal.sum()


@pytest.mark.parametrize("total", [3000.0, 20000.0, 60000.0])
def test_mixing_against_projected_gradients(spark, total):
    """An independent solver of the least squares over rates >= 0, with many small steps, reaches the same totals."""
    rng = np.random.default_rng(11)
    p, n = rng.dirichlet([0.4, 0.6, 0.5], 80), rng.integers(1, 300, 80)
    members = spark.createDataFrame([(int(x), q.tolist()) for x, q in zip(n, p)], "n_tokens long, posteriors array<double>")
    weights = np.array([0.85, 0.1, 0.05])
    _, reached, goal = mixing.solve(members, weights.tolist(), total)
    a, r = (p * n[:, None]).T, np.ones(80)
    step = 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(60000):
        r = np.maximum(0, r - step * a.T @ (a @ r - weights * total))
    assert np.allclose(goal, weights * total) and np.abs(a @ r - reached).max() < 2e-3 * total


def test_mixing_solver_out_of_reach(spark):
    """The conditions of least squares over rates >= 0 hold where the targets cannot be met."""
    p, n = sharp([0.5, 0.5], 2000)
    p = np.round(0.3 + 0.4 * p, 6)
    members = spark.createDataFrame([(int(x), q.tolist()) for x, q in zip(n, p)], "n_tokens long, posteriors array<double>")
    steps, reached, goal = mixing.solve(members, [0.99, 0.01], float(n.sum()))
    r, pull = mixing.rates(p, steps), p @ (reached - goal) / n.sum()
    assert np.abs(reached - goal).max() > 0.1 * n.sum()
    assert pull.min() > -1e-4 and np.abs(pull[r > 0]).max() < 1e-4


def test_mixing_warns_where_targets_are_out_of_reach(real, labels):
    with pytest.warns(UserWarning, match="no rates meet"):
        mixing.query(real, labels.limit(0))


def test_mixing_odd_rows(odd, labels, empty):
    some = labels.select("doc_id", mixing.domain_of().alias("domain"))
    mixed = mixing.mix(odd, some, {"clean": 1.0, "toxic": 0.2})
    assert mixed.columns == odd.columns
    mixed.count()
    assert mixing.mix(empty, some).count() == 0
    assert mixing.query(odd, labels.limit(0)).count() == odd.count()


def test_licences(spark, odd, empty, real, sf):
    name, text = licences.KNOWN[2]
    rows = [(1, "Copyright (c) 2020 Me\r\n\r\n" + text.upper().replace("SUBLICENSE", "sub-licence")), (2, text + " and more"), (3, None), (4, "  © 2001 them\n"), (5, "released under the MIT Licence"), (1, text)]
    got = sorted((r.doc_id, r.license) for r in licences.query(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.license)
    assert got == [(1, name), (1, name), (5, "MIT-notice")]
    assert licences.scan(odd).count() == odd.count() and licences.query(empty).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(licences.ORACLE).fetchall()
    assert sorted(map(tuple, licences.query(real).collect())) == sorted(want)


def test_licences_of_the_common_list(spark):
    from vectide.llm.licence_list import BSD, THIRD, listed

    text = dict(reversed(listed()))
    mit = licences.KNOWN[2][1].split("\n\n", 1)[1]
    bsd = BSD.format(third=THIRD.format(name="the copyright holder"), whose="COPYRIGHT HOLDER", who="COPYRIGHT HOLDER")
    texts = [("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Me\n\n" + mit), ("ISC", "ISC License\n\n" + licences.KNOWN[1][1]),
             ("MIT", "MIT License Copyright (c) 2020 Me " + " ".join(mit.split())), ("BSD-3-Clause", "Copyright (c) 2020, Me All rights reserved. " + " ".join(bsd.split())),
             ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2020 Me\nAll rights reserved.\n\n" + bsd.replace(" copyright", "\ncopyright"))]
    texts += [(n, text[n]) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")]
    texts += [("Apache-2.0", text["Apache-2.0"].split("   APPENDIX")[0]), (None, mit + " and more"), (None, "copyright 2020 me")]
    got = licences.query(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in sorted(got)] == [(i, n) for i, (n, _) in enumerate(texts)]


def test_licences_do_not_depend_on_line_wrap(spark):
    """Every text of the short list, and two of the long one, wrapped at all widths."""
    import textwrap

    from vectide.llm.licence_list import listed

    texts = dict(licences.KNOWN[:5]) | {n: t for n, t in listed() if n in ("BSD-2-Clause", "BSD-3-Clause")}
    rows = []
    for name, text in texts.items():
        for width in range(24, 121):
            wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
            rows.append((name, width, "Copyright (c) 2020 Some One <a@b.c>\n\n" * (width % 2) + wrapped))
    df = spark.createDataFrame(rows, "name string, width int, text string")
    lost = licences.scan(df).where("license IS NULL OR license <> name").select("name", "width").collect()
    assert lost == []


def test_licences_from_a_table(spark, tmp_path):
    spark.createDataFrame([("Own", "Do what you like,\nbut say so."), ("Own", None), ("Other", "No.")], "license string, text string").write.parquet(f"file://{tmp_path}/l")
    listed = licences.table_of(spark, f"file://{tmp_path}/l")
    docs = spark.createDataFrame([(1, "© 2001 Me\nDo what you LIKE but say so"), (2, "no"), (3, "yes"), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licences.scan(docs, listed).orderBy("doc_id").collect()] == [(1, "Own"), (2, "Other"), (3, None), (4, None)]
    with pytest.raises(ValueError):
        licences.known(docs, listed, most=1)


def check_shards(rows, found, shards=40):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    by = {}
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by.get(k, [])) for k in range(shards)]
    # Near equal: within the tolerance, give or take a row that cannot be cut.
    mean, largest = sum(sizes) / shards, max((r.size for r in found), default=0)
    assert all(abs(s - mean) <= sharding.TOLERANCE * mean + largest for s in sizes)
    return sizes


def test_shards(spark, odd, odd_rows, real, empty):
    check_shards(odd_rows, sharding.query(odd).collect())
    assert sharding.query(empty).count() == 0
    check_shards([(r.doc_id, r.text) for r in real.collect()], sharding.query(real).collect())
    rng = random.Random(4)
    rows = [(i, "same text " * 20 if i % 3 == 0 else str(rng.random()) * rng.randrange(1, 30)) for i in range(4000)]
    found = sharding.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes = check_shards(rows, found)
    mean = sum(sizes) / 40
    assert max(abs(s - mean) for s in sizes) < 0.01 * mean + 2 * 700
    groups = {}
    for r in found:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 or len(s) == max(s) - min(s) + 1 for s in groups.values())


def test_chat(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.execute(chat.ORACLE).fetchall()
    assert sorted(map(tuple, chat.query(spark, spark.read.parquet(f"{sf}/conversations.parquet")).collect())) == sorted(want)


TALKS = [
    (1, 0, "user", "hi ### </turn> \\ \\\\ ##### </"),
    (1, 1, "assistant", "#"),
    (1, 2, "assistant", None),
    (1, 3, "user", "after <\\/ all\n\n"),
    (2, 5, None, "#\\# </role>\n"),
    (2, 5, None, "#\\# </role>\n"),
    (None, 0, "assistant", "no conversation 日本"),
    (3, None, "assistant", "\\"),
    (3, 0, "we</ird##", "<"),
]


def test_chat_odd_rows(spark):
    turns = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)).withColumn("i", F.lit(2))
    found = {r.conv_id: r for r in chat.query(spark, turns).collect()}
    talks = {}
    for c, t, role, text in TALKS + [(-7, 0, "user", chat.EXTRA), (-7, 1, "assistant", chat.EXTRA)]:
        talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert found.keys() == talks.keys()
    for c, own in talks.items():
        own.sort()
        said = "".join(x for *_, role, x in own if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for *_, role, x in own)
        r = found[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    examples = chat.examples(turns).collect()
    assert sum(e.loss_start is not None for e in examples) == sum(role == "assistant" for _, _, role, _ in TALKS)
    assert chat.digest(chat.examples(turns.limit(0))).count() == 0


def plain_hash(data, more=0):
    return mixed((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(data)) + more) & M64) >> 32


def brute_anchors(data):
    """Closed syncmers by definition: (place, hash) of k-mers whose smallest inner s-mer stands at an edge."""
    k, s, out = fingerprints.K, fingerprints.S, []
    inner = [plain_hash(data[i : i + s]) for i in range(len(data) - s + 1)]
    for i in range(len(data) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out.append((i, plain_hash(data[i : i + k], k)))
    return out


def brute_print(data):
    """(hash, first place) of the smallest anchors."""
    first = {}
    for i, h in brute_anchors(data):
        first.setdefault(h, i)
    return sorted(first.items())[: fingerprints.SIZE]


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    union = sorted({h for h, _ in a + b})[: fingerprints.SIZE]
    da, db = dict(a), dict(b)
    shifts = [db[h] - da[h] for h in union if h in da and h in db]
    if not shifts:
        return 0.0
    spread = 32 + 0.1 * max(p for _, p in a + b)
    share = sum(abs(x - np.median(shifts)) <= spread for x in shifts) / len(union)
    return 2 * share / (1 + share)


@pytest.mark.parametrize("seed", range(4))
def test_fingerprints_by_definition(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcd é") for _ in range(900))
    texts = [base, base[:700] + "x" * 100 + base[700:], base[300:] + base[:300], base[:20], base[:16], base[:15], "ab" * 400, "", base[::-1]]
    data = [t.encode() for t in texts]
    prints = fingerprints.fingerprints(data)
    want = [brute_print(d) for d in data]
    pairs = [list(zip(*(x.tolist() for x in p))) for p in prints]
    for d, got, plain in zip(data, pairs, want):
        assert got == plain or (not plain and len(got) == (len(d) > 0))
    for x, a in zip(prints, pairs):
        for y, b in zip(prints, pairs):
            assert abs(fingerprints.likeness(x, y) - brute_likeness(a, b)) < 1e-12


def test_likeness_estimates_the_share_of_anchors():
    """The estimate from 64 anchors stays within 0.2 of the share over all anchors, on long texts too."""
    rng = np.random.default_rng(7)
    off = []
    for n in (3000, 20000, 120000):
        base = bytes(rng.integers(97, 123, n).astype(np.uint8))
        for part in (0.0, 0.1, 0.25, 0.5):
            other = base[: int(n * (1 - part))] + bytes(rng.integers(97, 123, int(n * part)).astype(np.uint8))
            a, b = ({*fingerprints.anchors(np.frombuffer(x, np.uint8))[1].tolist()} for x in (base, other))
            exact = 2 * len(a & b) / (len(a) + len(b))
            off.append(abs(fingerprints.likeness(*fingerprints.fingerprints([base, other])) - exact))
    assert max(off) < 0.2 and np.mean(off) < 0.08


def test_anchors_are_free_of_context():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 101, 600).astype(np.uint8))
    at, h = fingerprints.anchors(np.frombuffer(data, np.uint8))
    assert list(zip(at.tolist(), h.tolist())) == brute_anchors(data)
    at2, h2 = fingerprints.anchors(np.frombuffer(b"xyz" + data, np.uint8))
    kept = at2 >= 3
    assert (at2[kept] - 3).tolist() == at.tolist() and (h2[kept] == h).all()
    gap = np.diff(at)
    assert gap.max() <= fingerprints.K - fingerprints.S + 1


def test_fingerprints(odd, odd_rows, empty, real):
    for df, rows in ((odd, odd_rows), (real, [(r.doc_id, r.text) for r in real.collect()])):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
        want = []
        for k, (i, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            q = len(t) // 4
            want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
        found = fingerprints.query(df).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(want, key=str)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
        prints = {}
        for i, t in rows:
            same = [r for r in found if r.doc_id == i and r.n_chars == len(t or "")]
            prints.setdefault(t or "", set()).update(r.fingerprint for r in same)
        assert all(len(p) == 1 for t, p in prints.items() if sum(len(x or "") == len(t) and x != t for _, x in rows) == 0)
        for t, p in prints.items():
            assert fingerprints.text_of(fingerprints.fingerprints([t.encode()])[0]) in p
    long = [r for r in found if r.n_chars > 400]
    assert np.median([r.near_edited for r in long]) > 0.65 and np.median([r.near_next for r in long]) < 0.05
    assert fingerprints.query(empty).count() == 0


def test_equal_texts_have_equal_fingerprints():
    texts = [b"", b"short", b"some text that is longer than a window of it" * 30]
    twice = [fingerprints.text_of(p) for p in fingerprints.fingerprints(texts * 2)]
    assert twice[:3] == twice[3:] and len(set(twice)) == 3
    p = fingerprints.fingerprints(texts)
    assert [fingerprints.likeness(x, x) for x in p] == [1.0, 1.0, 1.0] and fingerprints.likeness(p[0], p[2]) == 0.0


def test_registry():
    names = registry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert names.keys() <= entry.queries().keys() and "pipeline" in entry.queries()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now = docs.columns, docs
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, sf).cache()
        seen.append(after.count())
        if k < 3:
            assert after.columns == columns
            now = after
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.query(spark, docs, labels).where("kept").count()
    assert seen[0] == kept < docs.count() and seen[1] <= seen[0]
    assert corpus_pipeline.run(spark, sf).count() == seen[3]


@pytest.fixture(scope="module")
def odd_folder(odd, labels, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('odd')}"
    odd.unionByName(odd).write.parquet(f"{root}/documents.parquet")
    marks = labels.unionByName(odd.where("doc_id IS NOT NULL").selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "CAST(NULL AS INT) AS toxic"))
    marks.write.parquet(f"{root}/labels.parquet")
    return root


def test_pipeline_stages_take_odd_rows(spark, odd_folder, odd_rows):
    """Nulls, empty and long texts, ties, repeated rows and columns with the stages' own names."""
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, odd_folder)
        assert after.columns == docs.columns and {r.doc_id for r in after.collect()} <= {i for i, _ in odd_rows}
    fine = quality.query(None, docs, spark.read.parquet(f"{odd_folder}/labels.parquet")).where("kept").count()
    assert corpus_pipeline.quality_rules(spark, docs, odd_folder).count() == fine
    pieces = corpus_pipeline.STAGES[names.index("packing")][1](spark, docs, odd_folder).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in odd_rows}
    first, second = (sorted(map(str, corpus_pipeline.run(spark, odd_folder).drop("sequence_id", "offset").collect())) for _ in range(2))
    assert first == second


def test_pipeline_of_nothing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_pipeline_keeps_a_like_of_every_text(spark):
    """Rows that share a doc_id but not their text: one of each group of texts stays."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect())) == [(3, a), (5, b)]
