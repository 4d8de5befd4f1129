"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+``, each behind the word mark of the vocabulary. They
are put in one trie for each worker process, level by level; every node keeps the best score of its prefix
and the number of pieces that reaches it, computed once however many words and texts share the
prefix: the pieces that end at a node are read upwards along its ancestors. Words end at nodes, whose counts are
stored. Where no more than ``FEW`` words are left that go on for long, their ends are not shared and are scored along the path, by the same rule, without nodes.
The vocabulary is a public one whose pieces come by rank; a piece's log-probability is taken as
-ln(rank + 2) (Zipf's law), in fixed point, so sums are exact. Bytes without a piece fall back to one
piece each. Of segmentations of the same score the one with fewer pieces counts.

Defined results: a null or empty text has no token; repeated rows are counted each; columns beside
doc_id and text are not read. The trie is emptied at ``NODES`` nodes. A word that the task has met is known by a 64-bit hash
of its bytes: at ``MEMO`` words the odds that any two share one are below 1 in 10 million.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.scratch import ship
from vectide.llm.textvec import Words, runs, segment_sums, strings
from vectide.llm.tokens import Memo, vocabulary

MARK = 0xFF  # stands for the word mark: no UTF-8 byte
FIXED = 1 << 20
MEMO, NODES = 500_000, 1_000_000
FEW, FAR, STRETCH = 128, 64, 1 << 16
#: Bytes of new words that are put in the trie at a time.
LOT = 1 << 19
_NONE = -(1 << 62)


class Pieces:
    """The vocabulary as a trie of bytes read backwards: the state that each (state, byte) leads to,
    and the score where a piece is complete (else 1)."""

    _open: dict[str, Pieces] = {}

    def __init__(self, scores: dict[bytes, int]):
        self.scores = scores
        self.longest = max(map(len, scores))
        states, ends, edges = {b"": 0}, [1], {}
        for piece in sorted(x[::-1] for x in scores):
            at = 0
            for n in range(1, len(piece) + 1):
                head = piece[:n]
                if head not in states:
                    states[head] = len(ends)
                    ends.append(1)
                    edges[at << 8 | piece[n - 1]] = states[head]
                at = states[head]
            ends[at] = scores[piece[::-1]]
        self.memo = Memo((2 * len(edges)).bit_length())
        self.memo.put(np.array(list(edges), np.uint64) + np.uint64(1), np.array(list(edges.values()), np.int32))
        self.score = np.array(ends, np.int64)

    @classmethod
    def open(cls, path: str) -> Pieces:
        if path not in cls._open:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            ranked, n = {}, model.get_piece_size()
            for i in range(n):
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                    text = model.id_to_piece(i)
                    if "▁" not in text[1:]:
                        body = text.encode().replace("▁".encode(), bytes([MARK]))
                        ranked[body] = max(zipf(round(-model.get_score(i))), ranked.get(body, -(1 << 60)))
            lowest = zipf(10 * n)
            for b in range(256):
                ranked.setdefault(bytes([b]), lowest)
            cls._open[path] = cls(ranked)
        return cls._open[path]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the transitions lead, -1 where there is none."""
        return self.memo.find((state.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)) + np.uint64(1))

    def edges(self, data: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in ``data`` that end behind ``begin``: ends (ascending), lengths and scores."""
        end = np.arange(begin + 1, len(data) + 1)
        state, found = np.zeros(len(end), np.int64), []
        for n in range(1, self.longest + 1):
            inside = end >= n
            end, state = end[inside], state[inside]
            state = self.step(state, data[end - n])
            end, state = end[state >= 0], state[state >= 0]
            done = self.score[state] <= 0
            found.append((end[done], np.full(done.sum(), n), self.score[state[done]]))
        end, n, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return end[order], n[order], score[order]


def zipf(rank: int) -> int:
    return -round(math.log(rank + 2) * FIXED)


class Trie:
    """Prefixes of marked words. Node 0 is the empty one."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memo = Memo((2 * NODES).bit_length())
        self.size = 1
        self.parent, self.byte = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.uint8)
        self.score, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def children(self, parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes below some nodes by a byte each; pairs are distinct. New ones are scored."""
        name = (parent.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)) + np.uint64(1)
        node = self.memo.find(name)
        new = np.flatnonzero(node < 0)
        if len(new):
            fresh = np.arange(self.size, self.size + len(new), dtype=np.int32)
            self.size += len(new)
            while self.size > len(self.parent):
                for x in ("parent", "byte", "score", "n"):
                    setattr(self, x, np.concatenate((getattr(self, x), np.zeros_like(getattr(self, x)))))
            self.parent[fresh], self.byte[fresh] = parent[new], byte[new]
            self.memo.put(name[new], fresh)
            node[new] = fresh
            self._settle(fresh)
        return node

    def _settle(self, fresh: np.ndarray):
        """Best score and pieces of new nodes, from their ancestors."""
        score, n = np.full(len(fresh), _NONE), np.zeros(len(fresh), np.int32)
        live, state, at = np.arange(len(fresh)), np.zeros(len(fresh), np.int64), fresh
        while len(live):
            state = self.pieces.step(state, self.byte[at])
            on = state >= 0
            live, state, up = live[on], state[on], self.parent[at[on]]
            ends = self.pieces.score[state]
            mine, more = self.score[up] + ends, self.n[up] + 1
            better = (ends <= 0) & ((mine > score[live]) | ((mine == score[live]) & (more < n[live])))
            score[live[better]], n[live[better]] = mine[better], more[better]
            on = up > 0
            live, state, at = live[on], state[on], up[on]
        self.score[fresh], self.n[fresh] = score, n

    def _path(self, node: int, rest: np.ndarray) -> int:
        """The pieces of the prefix of a node with ``rest`` behind it."""
        back, held = [], [(int(self.score[node]), int(self.n[node]))]
        while node and len(back) < self.pieces.longest:
            back.append(self.byte[node])
            node = self.parent[node]
            held.append((int(self.score[node]), int(self.n[node])))
        held.reverse()
        head = np.array(back[::-1], np.uint8)
        for i in range(0, len(rest), STRETCH):
            data = np.concatenate((head, rest[i : i + STRETCH]))
            best = held + [(_NONE, 0)] * (len(data) - len(head))
            for end, n, s in zip(*(x.tolist() for x in self.pieces.edges(data, len(head))), strict=True):
                before, pieces = best[end - n]
                before += s
                now = best[end]
                if before > now[0] or (before == now[0] and pieces + 1 < now[1]):
                    best[end] = before, pieces + 1
            held, head = best[-self.pieces.longest - 1 :], data[-self.pieces.longest :]
        return held[-1][1]

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The pieces of each word ``data[start : start + size]``, its mark before it."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        node = np.full(len(start), self.children(np.zeros(1, np.int64), np.full(1, MARK))[0], np.int64)
        out = np.full(len(start), -1, np.int64)
        going, level = len(start), 0
        while going:
            going = int(np.searchsorted(-size, -level, "left"))
            if going <= FEW:
                for k in range(going):
                    if size[k] - level > FAR:
                        out[k] = self._path(int(node[k]), data[start[k] + level : start[k] + size[k]])
                if (out[:going] >= 0).all():
                    break
            key, at = np.unique(node[:going] << 8 | data[start[:going] + level], return_inverse=True)
            node[:going] = self.children(key >> 8, key & 255)[at]
            level += 1
        out = np.where(out < 0, self.n[node], out)
        back = np.empty_like(out)
        back[order] = out
        return back


class Counter:
    """Piece counts of the words of a process: its trie, and the words that it has met."""

    _open: dict[str, Counter] = {}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    @classmethod
    def open(cls, path: str) -> Counter:
        if path not in cls._open:
            cls._open[path] = cls(Pieces.open(path))
        return cls._open[path]

    def clear(self):
        self.trie = Trie(self.pieces)
        self.memo = Memo((2 * MEMO).bit_length())
        self.met = 0
        self.n = np.zeros(1 << 12, np.int32)

    def count(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each text of a run."""
        words = Words(raw, at)
        # 0 is no name.
        h = np.maximum(words.hashes(), np.uint64(1))
        slot = self.memo.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if self.met + len(new) > MEMO:
                self.clear()
                new = np.arange(len(h))
            names, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            n = self._scored(words.data, words.start[new[first]], words.end[new[first]])
            while self.met + len(n) > len(self.n):
                self.n = np.concatenate((self.n, np.zeros_like(self.n)))
            self.n[self.met : self.met + len(n)] = n
            slots = np.arange(self.met, self.met + len(n), dtype=np.int32)
            if self.met + len(n) <= MEMO:
                self.memo.put(names, slots)
            self.met += len(n)
            slot[new] = slots[which]
        return words.counts(), segment_sums(self.n[slot].astype(np.int64), words.first)

    def _scored(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lot = np.cumsum(end - start) // LOT
        out = [np.zeros(0, np.int64)]
        for k in np.unique(lot):
            if self.trie.size > NODES:
                self.trie = Trie(self.pieces)
            out.append(self.trie.count(data, start[lot == k], (end - start)[lot == k]))
        return np.concatenate(out)


SCHEMA = "doc_id long, n_pretokens long, n_tokens long"


def _run(path: str):
    def run(batches):
        counter = Counter.open(path)
        for batch in batches:
            raw, at = strings(batch.column("text"))
            found = [counter.count(raw, at[i : j + 1]) for i, j in runs(at)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True))], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def count(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_run(vocabulary(model)), SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return count(docs)
