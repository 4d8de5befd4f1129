"""Adaptive context-mixing range coder for token ids, in independent blocks.

Each block starts from nothing. Ids are numbered in order of their first occurrence in the block. For the next
number three models speak: order 2 and order 1 name the one that last followed the same two, or the same one, with a
confidence of 0 to 3; order 0 gives every number its frequency, renewed as the block grows by a fifth; numbers that
are newer than that count as seen once. Their shares are added up: the probability of a number is

    (w2 [order 2 names it] + w1 [order 1 names it] + w0 n(number) / n) / (w2 + w1 + w0 + w3)

where w3 is the share of an id not met before, which is coded by its number of bits (by how often new ids of the block had as many), then evenly. The weights adapt, one set for each
pair of confidences and for whether both orders name the same. A number's interval is its place among the numbers in order, so one
range coder of 48 bits codes it in one step.

Blocks are coded side by side, one numpy lane for each, so a step costs the same few array
operations for hundreds of blocks; any block can be decoded alone. A block carries its
number of ids and their CRC-32, which decoding verifies.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LANES = 3584
_HEAD = struct.Struct("<4sIIIII")  # magic, steps, ids, crc32 of the ids, vocabulary, words
_MAGIC = b"vrc3"
_BITS2 = 12
_GAIN, _MOST, _EVERY = 24.0, 1500.0, 64
_BITS_GAIN = 4.0
#: The interval has 48 bits and is never below 32; words of 16 go out. All of it is exact in doubles, for
#: weights stay below 2**13 and blocks at 2**14 ids.
_FULL, _LOW, _WORD = float(1 << 48), float(1 << 32), float(1 << 16)
LONGEST = 1 << 14


def _renewals(steps: int) -> set[int]:
    """The steps at which order 0 is counted anew."""
    out, t = set(), 8
    while t < steps:
        out.add(t)
        t = max(t + 4, t * 6 // 5)
    return out


#: By what came true (order 1, order 2, a new id): the model whose weight grows.
_WHICH = np.array([2, 0, 1, 1, 3])
#: Lanes whose steps are prepared together when coding, by sorting each lane's ids by context.
_TOGETHER = 64


class _Weights:
    """The weights of order 1, order 2, order 0 and of new ids by context and lane, 16 bits of a number each."""

    def __init__(self, lanes: int):
        start = [(1 + 20 * (k & 3), 1 + 40 * (k >> 2 & 3), 60, 40) for k in range(32)]
        self.all = np.repeat(np.array(start, "<u2").view("<u8").reshape(-1), lanes)
        self.each = self.all.view("<u2").reshape(-1, 4)
        self.gain = np.left_shift(np.uint64(_GAIN), _WHICH.astype(np.uint64) * np.uint64(16))

    def settle(self):
        total = self.each[:, 0] + self.each[:, 1]
        total += self.each[:, 2]
        total += self.each[:, 3]
        full = np.flatnonzero(total > _MOST)
        if len(full):
            self.each[full] = (self.each[full] >> np.uint16(1)) + np.uint16(1)


def _numbered(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, steps): the number of each id by first occurrence in its lane, and where that is. first: room for each id."""
    lanes, steps = ids.shape
    number, new = np.zeros((lanes, steps), np.uint32), np.zeros((lanes, steps), bool)
    at = np.arange(steps, dtype=np.int32)
    back = at[::-1].copy()
    for k in range(lanes):
        row = ids[k].astype(np.int64)
        first[row[::-1]] = back
        where = first.take(row)
        np.equal(where, at, out=new[k])
        number[k] = (np.cumsum(new[k], dtype=np.uint32) - np.uint32(1)).take(where)
    return number, new


def _named(context: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number that last followed the same context in the lane, and its confidence. All uint32, (lanes, steps)."""
    lanes, steps = d.shape
    row = np.arange(lanes, dtype=np.int64)[:, None] * steps
    order = context << np.uint32(14)
    order |= np.arange(steps, dtype=np.uint32)
    order.sort(axis=1)
    at = (order & np.uint32(LONGEST - 1)) + row
    order >>= np.uint32(14)
    then = d.take(at)
    same, again = np.zeros((lanes, steps), bool), np.zeros((lanes, steps), bool)
    np.equal(order[:, 1:], order[:, :-1], out=same[:, 1:])
    np.equal(then[:, 1:], then[:, :-1], out=again[:, 1:])
    again &= same
    sure = same.astype(np.uint32)
    sure[:, 1:] += same[:, 1:] & again[:, :-1]
    sure[:, 2:] += same[:, 2:] & again[:, 1:-1] & again[:, :-2]
    entry = sure
    entry[:, 1:] |= (then[:, :-1] * same[:, 1:]) << np.uint32(2)
    out = np.empty(lanes * steps, np.uint32)
    out[at.reshape(-1)] = entry.reshape(-1)
    out = out.reshape(lanes, steps)
    return out >> np.uint32(2), out & np.uint32(3)


def _hashed(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Contexts of order 2, of uint32."""
    h = last * np.uint32(0x9E3779B1)
    h += before * np.uint32(0xC2B2AE35)
    h >>= np.uint32(9)
    h &= np.uint32((1 << _BITS2) - 1)
    return h


def _facts(d: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By order 0, (lanes, steps): ids before each number, its own count, and the count of all; of a new id the count of all and none."""
    lanes, steps = d.shape
    known = np.cumsum(new, axis=1, dtype=np.uint32)
    wide = int(known[:, -1].max())
    known -= new
    places = d + np.arange(lanes, dtype=np.int64)[:, None] * wide
    count = np.zeros((lanes, wide), np.uint32)
    low, own, n = (np.empty((lanes, steps), np.uint32) for _ in range(3))
    bounds = [0, *sorted(_renewals(steps)), steps]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a:
            count += np.bincount(places[:, since:a].reshape(-1), minlength=lanes * wide).reshape(lanes, wide).astype(np.uint32)  # noqa: F821
        since = a
        counted = np.maximum(count, 1)
        ends = np.cumsum(counted, axis=1, dtype=np.uint32)
        ends -= counted
        at = places[:, a:b]
        low[:, a:b] = ends.take(at)
        own[:, a:b] = counted.take(at)
        n[:, a:b] = np.maximum(known[:, a:b] - known[:, a : a + 1] + np.uint32(a), 1)
    np.copyto(low, n, where=new)
    np.copyto(own, 0, where=new)
    return low, own, n


class _Out:
    """The range coder's lower ends and the words of all lanes. A carry stays in its word as a 17th bit until the end."""

    def __init__(self, lanes: int, wide: int):
        self.low, self.span = np.zeros(lanes), np.full(lanes, _FULL)
        self.words = np.zeros(lanes * wide, np.uint32)
        self.wide, self.pos = wide, np.arange(lanes, dtype=np.int64) * wide

    def room(self, more: int):
        """Sees to it that ``more`` words fit in each lane."""
        lanes = len(self.pos)
        base = np.arange(lanes, dtype=np.int64) * self.wide
        if (self.pos - base).max() + more > self.wide:
            wide = self.wide * 3 // 2 + more
            words = np.zeros((lanes, wide), np.uint32)
            words[:, : self.wide] = self.words.reshape(lanes, self.wide)
            self.pos += np.arange(lanes, dtype=np.int64) * (wide - self.wide)
            self.words, self.wide = words.reshape(-1), wide

    def narrow(self, begin: np.ndarray, size: np.ndarray, total: np.ndarray):
        r = self.span / total
        np.floor(r, out=r)
        self.low += r * begin
        np.multiply(r, size, out=self.span)
        self.settle(self.low, self.span, self.pos)

    def rest(self):
        """Words that are still certain, of the few lanes that have any."""
        at = np.flatnonzero(self.span < _LOW)
        if len(at):
            self.narrow_some(at, self.low[at], self.span[at])

    def narrow_some(self, at: np.ndarray, low: np.ndarray, span: np.ndarray):
        """Gives the lanes ``at`` these ends, and out what is certain."""
        pos = self.pos[at]
        while self.settle(low, span, pos).any():
            pass
        self.low[at], self.span[at], self.pos[at] = low, span, pos

    def settle(self, low: np.ndarray, span: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """A word where one is certain, and where another one is."""
        some = span < _LOW
        top = low * (1 / _LOW)
        np.floor(top, out=top)
        self.words[pos] = top.astype(np.uint32)  # where it is not certain, the next one takes its place
        pos += some
        top *= some
        top *= _LOW
        low -= top
        more = some * (_WORD - 1)
        more += 1
        low *= more
        span *= more
        return span < _LOW

    def close(self) -> list[np.ndarray]:
        """The words of each lane."""
        self.room(8)
        for _ in range(3):
            top = np.floor(self.low / _LOW)
            self.words[self.pos] = top.astype(np.uint32)
            self.pos += 1
            self.low = (self.low - top * _LOW) * _WORD
        out = []
        for k, end in enumerate(self.pos.tolist()):
            words = self.words[k * self.wide : end]
            while (carry := words >> np.uint32(16)).any():
                words &= np.uint32(0xFFFF)
                words[:-1] += carry[1:]
            out.append(words.astype(np.uint16))
        return out


def _new_ids(ids: np.ndarray, new: np.ndarray, vocabulary: int) -> tuple[np.ndarray, ...]:
    """Of new ids, lane by lane, (lanes, steps): place and step of each, and what codes it: where the share of its number of bits
    begins, that share, all shares; its bits but for the highest and their number."""
    lane, step = np.nonzero(new)
    value = ids[lane, step].astype(np.int64)
    bits = np.frexp(value)[1].astype(np.int64)
    kinds, each = (vocabulary - 1).bit_length() + 1, np.arange(len(value))
    fewer = np.zeros((len(value) + 1, kinds + 1), np.uint16)  # ids before each one of fewer bits, modulo 2**16, of all lanes
    np.less(bits[:, None], np.arange(kinds + 1), out=fewer[1:], casting="unsafe")
    np.cumsum(fewer, axis=0, dtype=np.uint16, out=fewer)
    first = np.searchsorted(lane, np.arange(len(new)))[lane]
    low = fewer[each, bits] - fewer[first, bits]
    high = fewer[each, bits + 1] - fewer[first, bits + 1]
    begin, end = bits + _BITS_GAIN * low, bits + 1 + _BITS_GAIN * high
    rest = np.maximum(bits - 1, 0)
    return lane, step.astype(np.uint16), begin, end - begin, kinds + _BITS_GAIN * (each - first), value - (1 << rest) * (bits > 0), rest


def _encode(ids: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    """ids: (lanes, steps). The words of each lane. What the orders name and count is found for all steps beforehand, as the ids are known."""
    lanes, steps = ids.shape
    codes = np.empty((steps, lanes), np.uint16)  # context; below, named by order 1 and order 2; new; what came true
    low, own, n = (np.empty((steps, lanes), np.uint16) for _ in range(3))
    room, news = np.zeros(vocabulary, np.int32), []
    for k in range(0, lanes, _TOGETHER):
        some = ids[k : k + _TOGETHER]
        mine = slice(k, k + len(some))
        d, new = _numbered(some, room)
        last, before = np.zeros_like(d), np.zeros_like(d)
        last[:, 1:], before[:, 2:] = d[:, :-1], d[:, :-2]
        p1, sure1 = _named(last, d)
        p2, sure2 = _named(_hashed(last, before), d)
        code = sure2 << np.uint32(2)
        code |= sure1
        code |= (p1 == p2) * np.uint32(16)
        hit1, hit2 = (p1 == d) & ~new, (p2 == d) & ~new
        for bit, flag in enumerate(((p1 < d) | new, (p2 < d) | new, hit1, hit2, new), 5):
            code |= flag.astype(np.uint32) << np.uint32(bit)
        code |= (hit1 + hit2 * np.uint32(2) + new * np.uint32(4)) << np.uint32(10)
        codes[:, mine] = code.T
        for whole, part in zip((low, own, n), _facts(d, new), strict=True):
            whole[:, mine] = part.T
        lane, *more = _new_ids(some, new, vocabulary)
        news.append((lane + k, *more))
    lane, step, *more = (np.concatenate(x) for x in zip(*news, strict=True))
    order = np.argsort(step, kind="stable")
    lane, step = lane[order], step[order]
    bits_begin, bits_own, bits_total, value, rest = (x[order] for x in more)
    at_step = np.searchsorted(step, np.arange(steps + 1)).tolist()

    weights, out, each = _Weights(lanes), _Out(lanes, steps + 8), np.arange(lanes, dtype=np.int64)
    for a in range(0, steps, _EVERY):
        out.room(8 * _EVERY)
        code = codes[a : a + _EVERY]
        flag = [(code >> np.uint16(bit) & np.uint16(1)).astype(bool) for bit in range(5, 10)]
        at = (code & np.uint16(31)) * np.int64(lanes) + each
        gain = weights.gain.take(code >> np.uint16(10))
        w = np.empty((len(code), lanes), np.uint64)
        for t in range(len(code)):
            weights.all.take(at[t], out=w[t], mode="clip")
            weights.all[at[t]] = w[t] + gain[t]
        if len(code) == _EVERY:
            weights.settle()
        some = slice(a, a + _EVERY)
        w1, w2, w0, w3 = (w.view(np.uint16)[:, k::4].astype(float) for k in range(4))
        count = n[some].astype(float)
        begin = (w1 * flag[0] + w2 * flag[1]) * count + w0 * low[some]
        size = (w1 * flag[2] + w2 * flag[3] + w3 * flag[4]) * count + w0 * own[some]
        total = (w1 + w2 + w0 + w3) * count
        for t in range(len(code)):
            out.narrow(begin[t], size[t], total[t])
            i, j = at_step[a + t : a + t + 2]
            if i < j:
                who = lane[i:j]
                lower, span = out.low[who], out.span[who]
                if span.min() < _LOW:
                    out.narrow_some(who, lower, span)
                r = np.floor(span / bits_total[i:j])
                lower += r * bits_begin[i:j]
                span, left, v = r * bits_own[i:j], rest[i:j], value[i:j]
                if vocabulary > 1 << 17:
                    out.narrow_some(who, lower, span)
                    r = np.floor(out.span[who] / (1 << np.maximum(left - 16, 0)))
                    out.narrow_some(who, out.low[who] + r * (v >> 16), r)
                    lower, span = out.low[who], out.span[who]
                r = np.floor(span / (1 << np.minimum(left, 16)))
                lower += r * (v & 0xFFFF)
                out.low[who], out.span[who] = lower, r
            out.rest()
    return out.close()


class _In:
    """The words of all lanes and what of them is taken in."""

    def __init__(self, words: list[np.ndarray]):
        size = np.array([len(x) for x in words])
        self.words = np.concatenate([*words, np.zeros(4, "<u2")]).astype(np.uint16)
        pos = np.cumsum(size) - size
        head = self.words[pos[:, None] + np.arange(3)].astype(float)
        self.x = (head[:, 0] * _WORD + head[:, 1]) * _WORD + head[:, 2]
        self.pos = pos + 3
        self.span = np.full(len(words), _FULL)

    def narrow(self, lower: np.ndarray, span: np.ndarray):
        self.x -= lower
        self.span = span
        self.settle(self.x, self.span, self.pos)

    def rest(self):
        """Words that are still to be taken in, of the few lanes that lack any."""
        at = np.flatnonzero(self.span < _LOW)
        if len(at):
            self.narrow_some(at, self.x[at], self.span[at])

    def narrow_some(self, at: np.ndarray, x: np.ndarray, span: np.ndarray):
        """Gives the lanes ``at`` these values, and takes in words until the spans are large."""
        pos = self.pos[at]
        while self.settle(x, span, pos).any():
            if span.min() < 1:
                raise ValueError("a block is not what was written")
        self.x[at], self.span[at], self.pos[at] = x, span, pos

    def settle(self, x: np.ndarray, span: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Takes in a word where the span is small, and tells where it still is."""
        some = span < _LOW
        word = self.words.take(pos, mode="clip")
        word *= some
        pos += some
        more = some * (_WORD - 1)
        more += 1
        x *= more
        x += word
        span *= more
        return span < _LOW

    def even(self, x: np.ndarray, span: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values below ``most``, all as likely, and the new spans; ``x`` becomes what is left."""
        r = np.floor(span / most)
        value = np.minimum(np.floor(x / np.maximum(r, 1)), most - 1)
        x -= r * value
        return value.astype(np.int64), r


class _Order0:
    """Frequencies of numbers as of the last renewal; a number that is newer counts as seen once. Tables by number are laid
    out number after number, lane beside lane: lanes that are at a common number share memory lines."""

    def __init__(self, lanes: int, steps: int):
        self.lanes, self.bounds = lanes, [*sorted(_renewals(steps)), steps]
        self.count = np.zeros((lanes, steps), np.uint16)
        self.since = 0
        self.renew(np.zeros((0, lanes), np.uint16), np.zeros(lanes, np.uint16))

    def renew(self, history: np.ndarray, known: np.ndarray):
        """history: the numbers of all steps so far."""
        now, until = len(history), next(x for x in self.bounds if x > len(history))
        wide = min(int(known.max()) + until - now, self.count.shape[1])
        place, self.numbers = np.empty((wide, self.lanes), np.uint32), np.empty((self.lanes, until), np.uint16)
        each = np.arange(wide, dtype=np.uint16)
        for k in range(0, self.lanes, _TOGETHER):
            mine = slice(k, min(k + _TOGETHER, self.lanes))
            n = mine.stop - k
            count = self.count[mine, :wide]
            if self.since < now:
                some = history[self.since : now, mine].astype(np.int64)
                some += np.arange(n, dtype=np.int64) * wide
                count += np.bincount(some.reshape(-1), minlength=n * wide).reshape(n, wide).astype(np.uint16)
            # Each lane's numbers in use and as many new ones as may come: ``until`` places in all.
            own = np.maximum(count, each < (known[mine] + np.uint16(until - now))[:, None])
            ends = np.cumsum(own, axis=1, dtype=np.uint32)
            ends -= own
            ends <<= np.uint32(16)
            ends |= own
            place[:, mine] = ends.T
            self.numbers[mine] = np.repeat(np.tile(each, n), own.reshape(-1)).reshape(n, until)
        self.place, self.numbers = place.reshape(-1), self.numbers.reshape(-1)  # place: ids before a number << 16 | its own count
        self.since, self.until = now, until


def _decode(words: list[np.ndarray], steps: int, vocabulary: int) -> np.ndarray:
    """The ids, (lanes, steps)."""
    lanes = len(words)
    code, weights, order0 = _In(words), _Weights(lanes), _Order0(lanes, steps)
    ids = np.zeros((lanes, steps), np.uint16 if vocabulary <= 1 << 16 else np.uint32)  # by number
    history = np.zeros((steps, lanes), np.uint16)
    table = np.zeros((steps + (1 << _BITS2)) * lanes, np.uint16)  # order 1, then order 2: a number << 2 | its confidence
    kinds = np.arange((vocabulary - 1).bit_length() + 2, dtype=np.uint16)
    shares = np.tile(kinds, (lanes, 1))  # of new ids by number of bits: where each one's begins, and the sum
    gain = np.uint16(_BITS_GAIN) * (kinds > kinds[:-1, None])  # by number of bits
    rests = np.maximum(kinds[:-1].astype(np.int64) - 1, 0)
    heads, most, most_above = (1 << rests) * (kinds[:-1] > 0), 1 << np.minimum(rests, 16), 1 << np.maximum(rests - 16, 0)
    lane = np.arange(lanes, dtype=np.int64)
    lane_2 = lane + steps * lanes
    slots = np.stack((lane, lane_2))
    known, n = np.zeros(lanes, np.uint16), np.ones(lanes)  # numbers in use, and the count of all by order 0
    lane_until = lane * order0.until
    last, w, z = np.zeros(lanes, np.uint32), np.empty((4, lanes)), np.empty((4, lanes))
    side = np.empty((2, lanes))
    for t in range(steps):
        if t == order0.until:
            order0.renew(history[:t], known)
            lane_until = lane * order0.until
            n[:] = t
        # What the orders name, and the shares.
        entry = table.take(slots, mode="clip")
        p, sure = entry >> np.uint16(2), entry & np.uint16(3)
        same = p[0] == p[1]
        ctx = sure[1] << np.uint16(2)
        ctx |= sure[0]
        ctx += same * np.uint16(16)
        at = ctx * np.int64(lanes)
        at += lane
        packed = weights.all.take(at, mode="clip")
        np.copyto(w, packed.view(np.uint16).reshape(lanes, 4).T)
        np.multiply(w, n, out=z)
        own, w0 = z[:2], w[2]
        old = own[0] + own[1]
        old += z[2]
        total = old + z[3]
        r = code.span / total
        np.floor(r, out=r)
        y = code.x / r
        np.floor(y, out=y)
        total -= 1
        np.minimum(y, total, out=y)
        # Where the two numbers' intervals lie, and the number at y. Where both are the same, order 1 has both shares.
        both = own[1] * same
        own[0] += both
        own[1] -= both
        where = p * np.int64(lanes)
        where += lane
        f = order0.place.take(where, mode="clip").view(np.uint16)
        begin = w0 * f[:, 1::2]
        above = p[1] < p[0]
        np.multiply(own[1], above, out=side[0])
        np.multiply(own[0], ~above, out=side[1])
        begin += side
        end = w0 * f[:, ::2]
        end += begin
        end += own
        gone = y >= end
        inside = y >= begin
        inside &= ~gone
        np.multiply(own, gone, out=side)
        below = side[0] + side[1]
        slot = y - below
        slot /= w0
        place = slot.astype(np.int64)
        place += lane_until
        d = order0.numbers.take(place, mode="clip")
        np.copyto(d, p[0], where=inside[0])
        np.copyto(d, p[1], where=inside[1])
        fresh = y >= old
        np.copyto(d, known, where=fresh)
        # Its interval: a named number lies below just where y is beyond its end.
        at_d = d * np.int64(lanes)
        at_d += lane
        g = order0.place.take(at_d, mode="clip").view(np.uint16)
        hit = p == d
        np.multiply(own, hit, out=side)
        begin = w0 * g[1::2]
        begin += below
        size = w0 * g[::2]
        size += side[0]
        size += side[1]
        np.copyto(begin, old, where=fresh)
        np.copyto(size, z[3], where=fresh)
        hit &= ~fresh
        begin *= r
        size *= r
        code.narrow(begin, size)
        new = np.flatnonzero(fresh)
        if len(new):
            mine = shares.take(new, axis=0, mode="clip")
            span, x = code.span[new], code.x[new]
            if span.min() < _LOW:
                code.narrow_some(new, x, span)
            total = mine[:, -1]
            r = np.floor(span / total)
            v = np.minimum(np.floor(x / r), total - 1).astype(np.uint16)
            bits = (mine > v[:, None]).argmax(1) - 1
            at_bits = bits + np.arange(len(new)) * len(kinds)
            begin, end = mine.take(at_bits), mine.take(at_bits + 1)
            x -= r * begin
            span = r * (end - begin)
            mine += gain.take(bits, axis=0)
            shares[new] = mine
            value = heads.take(bits)
            if vocabulary > 1 << 17:
                code.narrow_some(new, x, span)
                high, span = code.even(x, code.span[new], most_above.take(bits))
                value += high << 16
                code.narrow_some(new, x, span)
            more, span = code.even(x, span, most.take(bits))
            code.x[new], code.span[new] = x, span
            value += more
            np.minimum(value, vocabulary - 1, out=value)
            ids.reshape(-1)[new * steps + d.take(new)] = value
            known += fresh
            if t:
                n += fresh
        code.rest()
        # What is learnt from it.
        which = hit[1].view(np.uint8) << np.uint8(1)
        which |= hit[0].view(np.uint8)
        which |= fresh.view(np.uint8) << np.uint8(2)
        packed += weights.gain.take(which, mode="clip")
        weights.all[at] = packed
        if (t + 1) % _EVERY == 0:
            weights.settle()
        np.minimum(sure, np.uint16(2), out=sure)
        sure *= hit
        sure += (d << np.uint16(2)) | np.uint16(1)
        table[slots] = sure
        history[t] = d
        before, last = last, d.astype(np.uint32)
        slots[0] = at_d
        np.multiply(_hashed(last, before), np.int64(lanes), out=slots[1])
        slots[1] += lane_2
    for k in range(0, lanes, _TOGETHER):
        for own, row in zip(ids[k : k + _TOGETHER], np.ascontiguousarray(history[:, k : k + _TOGETHER].T), strict=True):
            own[:] = own.take(row)
    return ids


def encode_blocks(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> list[bytes]:
    """The blocks of a row of ids below ``vocabulary``, ``block`` ids in each but the last."""
    if not len(ids):
        return []
    if int(ids.max()) >= vocabulary or not 0 < block <= LONGEST:
        raise ValueError("an id is not below the vocabulary's size, or a block is too long")
    n = -(-len(ids) // block)
    steps = min(block, len(ids))
    padded = np.full(n * steps, ids[-1], np.uint16 if vocabulary <= 1 << 16 else np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(n, steps)
    lots = -(-n // LANES)
    out = []
    for lot in np.array_split(np.arange(n), lots):
        for k, words in zip(lot, _encode(grid[lot[0] : lot[-1] + 1], vocabulary), strict=True):
            real = ids[k * steps : (k + 1) * steps].astype("<u4")
            out.append(_HEAD.pack(_MAGIC, steps, len(real), zlib.crc32(real.tobytes()), vocabulary, len(words)) + words.astype("<u2").tobytes())
    return out


def block_size(image: bytes, at: int = 0) -> int:
    """The bytes of the block that begins at ``at``."""
    return _HEAD.size + 2 * _HEAD.unpack_from(image, at)[5]


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks, end to end. ValueError where a block is not what was written."""
    heads = []
    for b in blocks:
        if len(b) < _HEAD.size or (h := _HEAD.unpack_from(b))[0] != _MAGIC or len(b) != _HEAD.size + 2 * h[5] or not 0 < h[2] <= h[1] <= LONGEST or h[5] < 3 or not h[4]:
            raise ValueError("not a block of ids")
        heads.append(h)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for kind in {(h[1], h[4]) for h in heads}:
        alike = [k for k, h in enumerate(heads) if (h[1], h[4]) == kind]
        for lot in np.array_split(alike, -(-len(alike) // LANES)):
            ids = _decode([np.frombuffer(blocks[k], "<u2", heads[k][5], _HEAD.size) for k in lot], *kind)
            for lane, k in enumerate(lot):
                own = ids[lane, : heads[k][2]].astype("<u4")
                if zlib.crc32(own.tobytes()) != heads[k][3]:
                    raise ValueError("a block's checksum differs")
                out[k] = own
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
