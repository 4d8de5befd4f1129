"""Token ids, files of them, packing and unigram counts."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vectide.llm import packing, rangecoder, token_files, tokens, trie_counts
from vectide.llm.textvec import runs, strings
from vectide.llm.tokens import Encoder, vocabulary


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


M64 = (1 << 64) - 1


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


MARKS = ["a b", "a  b", " a", "a ", "a\nb", "a\n b", "a \nb", "a\n\nb", "a\tb c", "a\xa0 b", "a \xa0b", "é é", "à, b", "×, ÷.", "—, —.", "it's, we'll; don't!", "a,b.c:d", "1, 2.5", "x\x1c y", "İ, ß. ſ", "é ́x", "$$$ *** !!! a!! b??", "ΑΣ ΑΣΑ,"]
MARKS += ["say <|endoftext|> now", "<|endoftext|>", "a<|endoftext|>b", "a.<|endoftext|>. b", "<|ENDOFTEXT|> <|startoftext|>\n<|endoftext|>", "<|endoftext| >", "x <|startoftext|><|endoftext|>,", "w" * 3000 + "<|endoftext|>" + "w" * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_librarys_ids(name, odd_rows, real):
    rng = random.Random(1)
    soup = ["".join(rng.choice(" \n\t.,;'aAbé—×日\xa0") for _ in range(rng.randrange(40))) for _ in range(400)]
    texts = [t or "" for _, t in odd_rows] + MARKS + soup + [r.text or "" for r in real.limit(60).collect()]
    raw, at = strings(pa.array(texts))
    for literal in (False, True):
        encoder, want = Encoder(vocabulary(name), literal), library(name)
        want.encode_special_tokens = literal
        for _ in range(2):
            for i, j in runs(at, 20000):
                flat, bounds = encoder.encode(raw, at[i : j + 1])
                for k in range(i, j):
                    assert flat[bounds[k - i] : bounds[k - i + 1]].tolist() == want.encode(texts[k], add_special_tokens=False).ids, texts[k]


def test_special_tokens_are_the_librarys():
    for name, end in (("word_bpe_49k.json", 49407), ("byte_bpe_50k.json", 50256)):
        raw, at = strings(pa.array(["say <|endoftext|> now"]))
        assert end in Encoder(vocabulary(name)).encode(raw, at)[0] and end not in Encoder(vocabulary(name), literal=True).encode(raw, at)[0]


def test_a_tokenizer_that_cuts_cannot_respect_encodes_whole_texts(tmp_path):
    t = library("byte_bpe_50k.json")
    t.add_special_tokens(["<a b>"])
    t.save(str(tmp_path / "t.json"))
    texts = ["x <a b> y", "plain text here.", "", "<a b>"]
    raw, at = strings(pa.array(texts))
    encoder = Encoder(str(tmp_path / "t.json"))
    flat, bounds = encoder.encode(raw, at)
    assert not encoder.chunked and [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_the_memo_may_fill_up(monkeypatch):
    monkeypatch.setattr(tokens, "LIMIT", 50)
    rng = random.Random(5)
    texts = [" ".join("w%d" % rng.randrange(300) for _ in range(20)) for _ in range(40)]
    raw, at = strings(pa.array(texts))
    encoder, want = Encoder(vocabulary("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for i in range(40):
        assert encoder.encode(raw, at[i : i + 2])[0].tolist() == want.encode(texts[i], add_special_tokens=False).ids


def test_memo_against_a_dictionary():
    rng = np.random.default_rng(3)
    memo, held = tokens.Memo(8), {}
    for _ in range(6):
        names = np.unique(rng.integers(1, 400, 20).astype(np.uint64))
        found = memo.find(names)
        assert found.tolist() == [held.get(x, -1) for x in names.tolist()]
        new = names[found < 0]
        memo.put(new, np.arange(len(held), len(held) + len(new), dtype=np.int32))
        held |= {x: len(held) + k for k, x in enumerate(new.tolist())}


def test_names_of_chunks():
    rng = random.Random(4)
    chunks = list({"".join(rng.choice("ab \x00é") for _ in range(rng.randrange(1, 40))).encode() for _ in range(3000)}) + [b"a" * n for n in range(1, 600)]
    data = np.frombuffer(b"".join(chunks), np.uint8)
    ends = np.cumsum([len(c) for c in chunks])
    names = tokens.chunk_names(data, ends - [len(c) for c in chunks], ends)
    assert names.min() > 0 and len(set(names.tolist())) == len(set(chunks))
    again = [tokens.chunk_names(np.frombuffer(c, np.uint8), np.zeros(1, int), np.array([len(c)]))[0] for c in chunks]
    assert names.tolist() == again


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 33, 100, 4095, 4096, 4097, 17000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.zeros(n, int), rng.zipf(1.3, n) % 49408, np.tile([1, 2, 3], n)[:n], np.full(n, 49407)):
        assert (rangecoder.decode_blocks(rangecoder.encode_blocks(ids, 49408)) == ids).all()
    wide = rng.integers(0, 3_000_000, n)
    assert (rangecoder.decode_blocks(rangecoder.encode_blocks(wide, 3_000_000)) == wide).all()
    assert (rangecoder.decode_blocks(rangecoder.encode_blocks(ids, 49408, 7)) == ids).all()


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(0).zipf(1.2, 40000) % 5000
    blocks, n = rangecoder.encode_blocks(ids, 5000), rangecoder.BLOCK
    assert (rangecoder.decode_blocks([blocks[3]]) == ids[3 * n : 4 * n]).all()
    assert sum(map(len, blocks)) < 2 * len(ids)
    hurt = bytearray(blocks[2])
    hurt[60] ^= 4
    for bad in (bytes(hurt), blocks[2][:-2], b"", b"x" * 40):
        with pytest.raises(ValueError):
            rangecoder.decode_blocks([bad])
    with pytest.raises(ValueError):
        rangecoder.encode_blocks(np.array([7]), 7)
    assert rangecoder.encode_blocks(np.zeros(0, int), 9) == [] and len(rangecoder.decode_blocks([])) == 0


def test_repetition_is_cheap():
    line = np.random.default_rng(1).integers(0, 40000, 50)
    blocks = rangecoder.encode_blocks(np.tile(line, 80), 40000)
    assert sum(map(len, blocks)) < 900


def plain_bits(ids, vocabulary):
    """The length in bits that the mixture gives, told id by id from its definition."""
    number, counted, n_counted, history = {}, {}, 0, []
    t1, t2, weights, bits = {}, {}, {}, 0.0
    last = before = 0
    renewals, widths = rangecoder._renewals(len(ids)), [1.0] * ((vocabulary - 1).bit_length() + 1)
    for t, x in enumerate(ids):
        i2 = (((last * 0x9E3779B1 + before) & M64) >> 9) & ((1 << rangecoder._BITS2) - 1)
        (p1, c1), (p2, c2) = t1.get(last, (0, 0)), t2.get(i2, (0, 0))
        w = weights.setdefault((c2, c1, p1 == p2), [1 + 40 * c2, 1 + 20 * c1, 60, 40])
        d = number.get(x)
        late = len(number) - len(counted)
        total0 = max(1, n_counted + late)
        if d is None:
            width = int(x).bit_length()
            bits += math.log2(sum(w) / w[3]) + math.log2(sum(widths) / widths[width]) + max(0, width - 1)
            widths[width] += rangecoder._BITS_GAIN
            d, which = number.setdefault(x, len(number)), 3
        else:
            p = w[0] * (p2 == d) + w[1] * (p1 == d) + w[2] * counted.get(d, 1) / total0
            bits += math.log2(sum(w) / p)
            which = 0 if p2 == d else 1 if p1 == d else 2
        w[which] += rangecoder._GAIN
        new = which == 3
        t1[last] = (d, min(c1 + 1, 3)) if p1 == d and not new else (d, 1)
        t2[i2] = (d, min(c2 + 1, 3)) if p2 == d and not new else (d, 1)
        history.append(d)
        before, last = (last * 0xC2B2AE35) & M64, d
        if (t + 1) % rangecoder._EVERY == 0:
            for own in weights.values():
                if sum(own) > rangecoder._MOST:
                    own[:] = [v // 2 + 1 for v in own]
        if t + 1 in renewals:
            counted, n_counted = dict(Counter(history)), t + 1
    return bits


def test_probabilities_are_those_of_the_mixture(real):
    encoder = Encoder.open(vocabulary("word_bpe_49k.json"))
    raw, at = strings(pa.array([r.text or "" for r in real.limit(40).collect()]))
    ids = encoder.encode(raw, at)[0][: 3 * rangecoder.BLOCK]
    for own in (ids[:5000], np.random.default_rng(2).zipf(1.4, 3000) % 900, np.tile(np.arange(60), 40)):
        (block,) = rangecoder.encode_blocks(own, 49408, rangecoder.LONGEST)
        bits = plain_bits(own.tolist(), 49408)
        assert abs(8 * len(block) - bits) < 0.01 * bits + 8 * 40


def test_blocks_are_smaller_than_zlibs_and_than_order_0(real):
    """On ids of real texts: below zlib's of the same blocks, and below the entropy of the ids' own frequencies."""
    encoder = Encoder.open(vocabulary("word_bpe_49k.json"))
    raw, at = strings(pa.array([r.text or "" for r in real.collect()]))
    ids = encoder.encode(raw, at)[0]
    n = rangecoder.BLOCK
    ids = ids[: len(ids) // n * n]
    ours = sum(map(len, rangecoder.encode_blocks(ids, 49408)))
    theirs = sum(len(zlib.compress(ids[i : i + n].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), n))
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    assert ours < 0.85 * theirs and 8 * ours < -(share * np.log2(share)).sum() * len(ids)


def test_coding_takes_few_calls_a_step():
    """Calls are what a step costs beside the lanes; what can be told of all steps at once is."""
    ids = np.random.default_rng(0).zipf(1.3, 8 * rangecoder.BLOCK) % 49408
    calls = Counter()

    def took(what, *args):
        sys.setprofile(lambda frame, event, arg: calls.update([what.__name__] if event in ("call", "c_call") else []))
        try:
            return what(*args)
        finally:
            sys.setprofile(None)

    assert (took(rangecoder.decode_blocks, took(rangecoder.encode_blocks, ids, 49408)) == ids).all()
    assert calls["encode_blocks"] < 35 * rangecoder.BLOCK and calls["decode_blocks"] < 76 * rangecoder.BLOCK


def test_the_format_stays():
    """Digests of blocks as the coder wrote them that went step by step."""
    rng = np.random.default_rng(7)
    for ids, size, want in ((rng.zipf(1.2, 70000) % 49408, 49408, "ccaa7a771ae0e237"), (rng.integers(0, 3_000_000, 9000), 3_000_000, "88c073bd93f907ee")):
        blocks = rangecoder.encode_blocks(ids, size)
        assert hashlib.sha256(b"".join(blocks)).hexdigest()[:16] == want and (rangecoder.decode_blocks(blocks) == ids).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_learnt_together(name):
    """New words of letters take a call of the library for hundreds, whatever their letters; İ becomes two words in lower case."""
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdeéüß") for _ in range(rng.randrange(3, 12))) for _ in range(1500)})
    want, calls = library(name), Counter()
    for text, most in ((" ".join(words), 6), ("\n".join(x.upper() for x in words), 6), ("a " + " ".join(words[:40]) + " İb xİ日 c3 d'e\nİ\nÀ", 99)):
        encoder = Encoder(vocabulary(name))
        whole = encoder.library

        class Counting:
            get_vocab_size = whole.get_vocab_size

            def encode(self, *args, **more):
                calls["encode"] += 1
                return whole.encode(*args, **more)

            def encode_batch_fast(self, texts, **more):
                calls["encode"] += len(texts)
                return whole.encode_batch_fast(texts, **more)

        encoder.library, calls["encode"] = Counting(), 0
        raw, at = strings(pa.array([text]))
        assert encoder.encode(raw, at)[0].tolist() == want.encode(text, add_special_tokens=False).ids
        assert calls["encode"] <= most


def expected_files(rows):
    t, out, at = library("word_bpe_49k.json"), [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_files(odd, odd_rows, empty):
    got = [tuple(r)[:4] for r in token_files.query(odd).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected_files(odd_rows)
    assert token_files.query(empty).count() == 0


def test_files_of_real_texts(real):
    got = [tuple(r)[:4] for r in token_files.query(real).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected_files([(r.doc_id, r.text) for r in real.collect()])


def test_images_are_checked():
    image = token_files.write_image([1, None], [2, 3], np.arange(5, dtype=np.uint32), 100)
    ids, bounds, flat = token_files.read_image(image)
    assert ids == [1, None] and bounds.tolist() == [0, 2, 5] and flat.tolist() == list(range(5))
    hurt = bytearray(image)
    hurt[20] ^= 1
    for bad in (bytes(hurt), b"no", image[:-3]):
        with pytest.raises(ValueError):
            token_files.read_image(bad)


def check_packing(rows, df, spread=0.0):
    t = library("byte_bpe_50k.json")
    found = df.collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = {}
    for i, x in rows:
        want.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    assert by_doc.keys() == want.keys()
    for i, texts in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i])
        if len(texts) == 1:
            at = 0
            for start, n, c, total in pieces:
                assert start == at and c == crc(texts[0][at : at + n]) and total == len(texts[0])
                at += n
            assert at == len(texts[0])
        else:
            assert sum(p[1] for p in pieces) == sum(map(len, texts))
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows_ in bins.values():
        at = 0
        for offset, n in sorted(rows_):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert sorted(bins) == list(range(len(bins)))
    return 1 - sum(r.length for r in found) / max(1, len(bins) * packing.CAPACITY)


def test_packing(odd, odd_rows, empty, real):
    check_packing(odd_rows, packing.query(odd))
    assert packing.query(empty).count() == 0
    padding = check_packing([(r.doc_id, r.text) for r in real.collect()], packing.query(real.repartition(7)))
    assert padding < 0.02


def test_packing_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(2)
    rows = [(i, " ".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(1, 900)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert check_packing(rows, packing.query(df)) < 0.03


def test_packed_ids(real):
    r = packing.pack(real.limit(3)).orderBy("doc_id", "start").first()
    assert crc(packing.ids_from(r.ids)) == r.ids_crc32
    wide = np.array([1, 70000], np.uint32)
    assert packing.ids_from(packing._store(wide)).tolist() == [1, 70000]


def test_cuts():
    table = packing.cuts()
    assert all(0 < table[r] <= r for r in range(1, packing.CAPACITY))
    for n in (1, 2047, 2048, 2049, 100000):
        assert sum(packing.pieces(n)) == n and max(packing.pieces(n)) <= packing.CAPACITY


def viterbi(word, scores):
    best = [(0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 40), j):
            s = scores.get(word[i:j])
            if s is not None and best[i] is not None:
                new = (best[i][0] + s, best[i][1] - 1)
                if best[j] is None or new > best[j]:
                    best[j] = new
    return -best[-1][1]


def test_trie_counts(odd, odd_rows, empty, real):
    pieces = trie_counts.Pieces.open(vocabulary("piece_bpe_32k.model"))

    def want(rows):
        out = []
        for i, t in rows:
            w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
            out.append((i, len(w), sum(viterbi(bytes([trie_counts.MARK]) + x, pieces.scores) for x in w)))
        return sorted(out, key=str)

    assert sorted((tuple(r) for r in trie_counts.query(odd).collect()), key=str) == want(odd_rows)
    some = real.limit(25)
    assert sorted((tuple(r) for r in trie_counts.query(some).collect()), key=str) == want([(r.doc_id, r.text) for r in some.collect()])
    assert trie_counts.query(empty).count() == 0


def test_trie_memo_can_be_emptied(monkeypatch):
    pieces = trie_counts.Pieces.open(vocabulary("piece_bpe_32k.model"))
    raw, at = strings(pa.array(["some words here", "other words there", "some more"]))
    whole = trie_counts.Counter(pieces).count(raw, at)
    for memo, nodes in ((2, 1000), (1000, 5)):
        monkeypatch.setattr(trie_counts, "MEMO", memo)
        monkeypatch.setattr(trie_counts, "NODES", nodes)
        small = trie_counts.Counter(pieces)
        parts = [small.count(raw, at[i : i + 2]) for i in range(3)]
        assert [x.tolist() for x in whole] == [np.concatenate(c).tolist() for c in zip(*parts, strict=True)]


def test_prefixes_are_scored_once(monkeypatch):
    """The trie stays from run to run: a word that shares a prefix adds the nodes of its end alone."""
    pieces = trie_counts.Pieces.open(vocabulary("piece_bpe_32k.model"))
    counter, sizes = trie_counts.Counter(pieces), []
    for text in ("international", "internationally internally", "inter national", "international"):
        counter.count(*strings(pa.array([text])))
        sizes.append(counter.trie.size)
    assert sizes == [15, 20, 28, 28]


@pytest.mark.parametrize("stretch", [50, 1 << 16])
def test_long_words(monkeypatch, stretch):
    monkeypatch.setattr(trie_counts, "STRETCH", stretch)
    monkeypatch.setattr(trie_counts, "FEW", 5)
    pieces = trie_counts.Pieces.open(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdetionhé日") for _ in range(n)) for n in (1, 64, 65, 66, 300, 1000, 4000)]
    words += [words[4] + "x", words[4][:200] + "y" * 400, "z" * 3000]
    for some in (words, words[::-1], words[6:]):
        raw, at = strings(pa.array([" ".join(some)]))
        want = sum(viterbi(bytes([trie_counts.MARK]) + w.encode(), pieces.scores) for w in some)
        assert trie_counts.Counter(pieces).count(raw, at)[1].tolist() == [want]
