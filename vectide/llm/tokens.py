"""Token ids of whole texts by the tokenizers library, with a memo of chunks.

A text is cut where the tokenizers used here must cut it themselves whatever stands around: before
a single space, and on both sides of a single newline, between characters that are not white space
(the space begins the next chunk), and between a letter and a mark of ``MARKS``. That holds for byte-level models, whose words take
one space before them, and for those that drop white space. Chunks are looked up in lower case where the model lowers letters. Every chunk that is new to the
process is encoded by the library; the ids of a text are those of its chunks in order.

Special tokens in a text are the library's: by its default their strings become their ids; with ``literal`` they
are ordinary text. No cut falls inside of one; a tokenizer of which that cannot be said encodes whole texts.

The memo names a chunk of up to seven bytes by these bytes, a longer one by a 63-bit hash of all its bytes: at
``LIMIT`` chunks, when it is emptied, the odds that any two of them share a name are below 1 in 10 million.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np

from vectide.llm.textvec import LOWER, mix, spans

LIMIT = 1 << 20
_BITS = 21
#: So many new chunks are encoded as one text.
_JOINED = 128
#: So many where each chunk is a word of letters, whose ids are told apart by the library's numbers of words.
_WORDS_JOINED = 512
#: A chunk longer than so many words of eight bytes is hashed by itself.
_WORDS = 32

MARKS = ".,;:!?#*$%&()[]{}\"/\\@^_+=~-"
#: White space, or a control character that some patterns count as such.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of characters among which there is other white space: C2 and E1 to E3.
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC2] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[0xE1:0xE4] = True
#: Marks and ASCII letters; C3 begins Latin letters but for two signs.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
#: The first n bytes of a little-endian word.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_HASHED = np.uint64(1 << 63)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file by its name; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that stand end to end; ``begin``: where the texts do."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    at = np.flatnonzero(_GAP[data])
    at = at[(at > 0) & (at < n - 1)]
    if len(at):
        before, after = data[at - 1], data[at + 1]
        wide = (before >= 0x80) & (_LEAD2[data[at - 2]] | _LEAD3[data[np.maximum(at - 3, 0)]])
        at = at[~(_SPACE[before] | wide | _SPACE[after] | _LEAD2[after] | _LEAD3[after])]
        edge[at] = True
        edge[at[data[at] == 0x0A] + 1] = True
    mark = np.flatnonzero(_MARK[data])
    mark = mark[mark > 1]
    if len(mark):
        before, lead = data[mark - 1], data[mark - 2]
        edge[mark[_LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]] = True
    edge[begin] = True
    return np.flatnonzero(edge[:n])


def chunk_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A name above 0 for each chunk: its own bytes where these are few, else a hash."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = end - start
    word = words[start] & _HEAD[np.minimum(size, 8)]
    name = word | size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > 7)
    if not len(long):
        return name
    h, at, left = mix(word[long] + size[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start[long] + 8, size[long] - 8
    live = np.flatnonzero(left > 0)
    for _ in range(_WORDS):
        if not len(live):
            break
        more = words[at[live]] & _HEAD[np.minimum(left[live], 8)]
        h[live] = mix(h[live] * np.uint64(0xD6E8FEB86659FD93) + more)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    for i in live.tolist():
        a, b = int(start[long[i]]), int(end[long[i]])
        h[i] = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little")
    name[long] = h | _HASHED
    return name


class Memo:
    """Names to numbers, by open addressing, for many names at a time."""

    def __init__(self, bits: int = _BITS):
        self.bits, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.names, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _home(self, names: np.ndarray) -> np.ndarray:
        return (mix(names) >> self.bits).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The number of each name, -1 where there is none."""
        place = self._home(names)
        held = self.names[place]
        out = np.where(held == names, self.numbers[place], np.int32(-1))
        todo = np.flatnonzero((held != names) & (held != 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & self.mask
            held = self.names[place[todo]]
            hit = held == names[todo]
            out[todo[hit]] = self.numbers[place[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def put(self, names: np.ndarray, numbers: np.ndarray):
        """names: distinct, and not held yet."""
        place, todo = self._home(names), np.arange(len(names))
        while len(todo):
            free = self.names[place[todo]] == 0
            mine = todo[free]
            self.names[place[mine]] = names[mine]
            won = self.names[place[mine]] == names[mine]
            self.numbers[place[mine[won]]] = numbers[mine[won]]
            todo = np.concatenate((todo[~free], mine[~won]))
            place[todo] = (place[todo] + 1) & self.mask


class Encoder:
    """Encodes runs of texts; ``open`` keeps one for each file and process."""

    _open: dict[tuple, Encoder] = {}

    def __init__(self, path: str, literal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = literal
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.lowers = ids("AQZ") == ids("aqz")
        added = [t for t in self.library.get_added_tokens_decoder().values() if not (literal and t.special)]
        self.added = [t.content.encode().lower() for t in added]
        uncut = lambda t: not (set(t.content) & {*MARKS, *" \n"} or t.lstrip or t.rstrip or t.single_word)
        self.chunked = all(uncut(t) for t in added)
        #: Whether a newline between words is a word of its own, and not dropped.
        self.newline = len(set(self.library.encode("a\na", add_special_tokens=False).word_ids)) == 3
        self.clear()

    @classmethod
    def open(cls, path: str, literal: bool = False) -> Encoder:
        if (path, literal) not in cls._open:
            cls._open[path, literal] = cls(path, literal)
        return cls._open[path, literal]

    def clear(self):
        self.memo = Memo()
        self.flat = np.zeros(1 << 16, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.at = np.zeros(1 << 16, np.int32)
        self.n = self.used = 0

    def _keep(self, ids: list | np.ndarray, size: np.ndarray) -> np.ndarray:
        """Takes the ids of new chunks, end to end, and numbers the chunks."""
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(size) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.flat[self.used : self.used + total] = ids
        self.at[self.n + 1 : self.n + 1 + len(size)] = self.used + np.cumsum(size)
        numbers = np.arange(self.n, self.n + len(size), dtype=np.int32)
        self.n += len(size)
        self.used += total
        return numbers

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers for new chunks. Those that may stand side by side, a newline before those that begin without a
        space, are encoded as one text, whose ids go to chunks by their places; the others one by one."""
        out = np.zeros(len(chunks), np.int32)
        after_space, after_line, joined, alone = kinds = [], [], [], []
        for k, c in enumerate(chunks):
            kinds[_kind(c)].append(k)
        for words, between in ((after_space, b""), (after_line, b"\n")):
            for i in range(0, len(words), _WORDS_JOINED):
                some = words[i : i + _WORDS_JOINED]
                numbers = self._learn_words([chunks[k] for k in some], between)
                if numbers is None:
                    joined += some
                else:
                    out[some] = numbers
        for i in range(0, len(joined), _JOINED):
            some = joined[i : i + _JOINED]
            pieces = [x for k in some for x in ((chunks[k],) if chunks[k][0] == 0x20 else (b"\n", chunks[k]))]
            text = b"".join(pieces)
            ends = np.cumsum([len(p) for p in pieces])
            if not np.isin(ends[:-1], chunk_starts(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))).all():
                alone += some
                continue
            # Places are told in characters.
            chars = np.cumsum([len(p.decode()) for p in pieces])
            found = self.library.encode(text.decode(), add_special_tokens=False)
            which = np.searchsorted(chars, np.fromiter((a for a, _ in found.offsets), np.int64, len(found)), "right")
            own = np.array([p != b"\n" or chunks[some[0]] == b"\n" for p in pieces])
            size = np.bincount(which, minlength=len(pieces))[own]
            out[some] = self._keep([x for x, k in zip(found.ids, own[which].tolist(), strict=True) if k], size)
        if alone:
            ids = [e.ids for e in self.library.encode_batch_fast([chunks[k].decode("utf-8", "replace") for k in alone], add_special_tokens=False)]
            out[alone] = self._keep([x for e in ids for x in e], np.fromiter(map(len, ids), np.int64, len(ids)))
        return out

    def _learn_words(self, chunks: list[bytes], between: bytes) -> np.ndarray | None:
        """Numbers for new chunks that are encoded as one text, if each proves to be one word of the library's. As no
        word lies in two chunks and none is without one, that is so where there are as many words as chunks."""
        text = between.join(chunks)
        begin = np.cumsum([0, *map(len, chunks[:-1])])
        begin += len(between) * np.arange(len(chunks))
        edges = np.concatenate((begin[1:], begin[1:] - len(between)))
        if not np.isin(edges, chunk_starts(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))).all():
            return None
        found = self.library.encode(text.decode(), add_special_tokens=False)
        size = np.bincount(np.array(found.word_ids, np.int64))
        ids = np.array(found.ids)
        if between and self.newline:
            if len(size) != 2 * len(chunks) - 1:
                return None
            ids = ids[np.repeat(np.arange(len(size)) % 2 == 0, size)]
            size = size[::2]
        return self._keep(ids, size) if len(size) == len(chunks) and size.all() else None

    def _whole(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body = data.tobytes()
        ids = [self.library.encode(body[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return np.array([x for e in ids for x in e], np.uint32), np.concatenate(([0], np.cumsum([len(e) for e in ids], dtype=np.int64)))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``raw[at[i] : at[i + 1]]`` end to end, and the bounds of each text's ids."""
        data = raw[at[0] : at[-1]]
        bounds = at - at[0]
        if not self.chunked:
            return self._whole(data, bounds)
        start = chunk_starts(data, bounds)
        end = np.append(start[1:], len(data))
        seen = data
        if self.lowers:
            low = LOWER[data]
            body = low.tobytes() if self.added else b""
            # Special tokens are told apart by case.
            seen = data if any(t in body for t in self.added) else low
        names = chunk_names(seen, start, end)
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(names), LIMIT // 2):
            some = slice(i, i + LIMIT // 2)
            ids, n = self._look_up(data, start[some], end[some], names[some])
            flat.append(ids)
            size.append(n)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(size))))
        return np.concatenate(flat), ends[np.searchsorted(start, bounds)]

    def _look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks end to end, and how many each has. No more chunks than the memo holds."""
        chunk = self.memo.find(names)
        new = np.flatnonzero(chunk < 0)
        if len(new):
            some, first, which = np.unique(names[new], return_index=True, return_inverse=True)
            if self.n + len(some) > LIMIT:
                self.clear()
                new = np.arange(len(names))
                some, first, which = np.unique(names, return_index=True, return_inverse=True)
            body = data.tobytes()
            numbers = self._learn([body[a:b] for a, b in zip(start[new[first]].tolist(), end[new[first]].tolist(), strict=True)])
            self.memo.put(some, numbers)
            chunk[new] = numbers[which]
        begin = self.at[chunk].astype(np.int64)
        size = self.at[chunk + 1] - begin
        return self.flat[spans(begin, size)].astype(np.uint32), size


def _may_join(c: bytes) -> bool:
    """Whether other chunks may stand before and behind this one without a change to either."""
    head = c[1:] if c[:1] == b" " else c
    last = c[-1]
    # What C3 begins is no white space.
    return bool(head) and not (_SPACE[head[0]] or _LEAD2[head[0]] or _LEAD3[head[0]]) and (last < 0x80 or c[-2:-1] == b"\xc3") and not _SPACE[last]


def _kind(c: bytes) -> int:
    """0 and 1: letters alone, with a space before them and without; 2: others that may be joined; 3: the rest."""
    space = c[:1] == b" "
    head = c[1:] if space else c
    if head.isalpha():  # of ASCII
        return 0 if space else 1
    if not _may_join(c):
        return 3
    return (0 if space else 1) if head.decode("utf-8", "replace").isalpha() else 2
