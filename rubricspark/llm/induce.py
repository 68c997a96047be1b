"""External induced sorting of the suffixes of one shard, with common prefixes, to a depth of DEPTH bytes.

Suffixes at leftmost-S positions (seeds) are ordered first: few of them by a sort, many by naming the strings between
them through the same induction and ordering the string of names, which is a third as long or less, by recursion. The
seeds then induce all other suffixes in two passes. Suffix tuples (symbol, position, common prefix with the tuple before
it) wait in priority queues that write sorted runs to disk beyond their room; what the first pass gives lies in a spool on
disk until the second one, and the result is a stream. Only seeds, at most half of all positions, are held as arrays.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes to which order and common prefixes are exact.
DEPTH = 50
#: Bytes that a queue, a spool or a text holds in memory; seeds, and half of the names, that are ordered by a sort in memory.
ROOM, BASE = 1 << 23, 1 << 20
_BLOCK, _PAD = 1 << 20, 64


class TupleQueue:
    """Priority queue of suffix tuples by key; equal keys leave in the order in which they came.

    A key that was popped must not be pushed again, which induction never does.
    """

    def __init__(self, room: int):
        self.room, self.held = room, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.keys: list[int] = []
        self.known: set[int] = set()
        self.runs: list[tuple] = []  # (file, keys, ends in tuples), oldest first
        self.spilled = 0

    def push(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples whose equal keys lie together."""
        if not len(key):
            return
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        both = np.stack([pos, lcp], axis=1)
        for k, a, b in zip(key[cuts].tolist(), cuts, [*cuts[1:], len(key)], strict=True):
            if k not in self.known:
                self.known.add(k)
                heapq.heappush(self.keys, k)
            self.parts.setdefault(k, []).append(both[a:b])
        self.held += both.nbytes
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        f, keys, ends, end = tempfile.TemporaryFile(), sorted(self.parts), [], 0
        for k in keys:
            for part in self.parts[k]:
                f.write(part.tobytes())
                end += len(part)
            ends.append(end)
        self.runs.append((f, np.array(keys, np.int64), np.array(ends, np.int64)))
        self.parts, self.held, self.spilled = {}, 0, self.spilled + 1

    def least(self) -> int | None:
        return self.keys[0] if self.keys else None

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and common prefixes of the least key."""
        key = heapq.heappop(self.keys)
        self.known.discard(key)
        found = []
        for f, keys, ends in self.runs:
            i = int(np.searchsorted(keys, key))
            if i < len(keys) and keys[i] == key:
                begin = int(ends[i - 1]) if i else 0
                f.seek(begin * 16)
                found.append(np.frombuffer(f.read((int(ends[i]) - begin) * 16), np.int64).reshape(-1, 2))
        mine = self.parts.pop(key, [])
        self.held -= sum(p.nbytes for p in mine)
        both = np.concatenate(found + mine)
        return both[:, 0], both[:, 1]


class Spool:
    """A stack of (symbol, positions, common prefixes); what does not fit its room lies on disk."""

    def __init__(self, room: int):
        self.room, self.held, self.file = room, 0, None
        self.items: list[tuple] = []

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        both = np.stack([pos, lcp], axis=1)
        if self.held + both.nbytes <= self.room:
            self.held += both.nbytes
            self.items.append((symbol, both, 0, 0))
            return
        self.file = self.file or tempfile.TemporaryFile()
        self.items.append((symbol, None, self.file.seek(0, 2), both.nbytes))
        self.file.write(both.tobytes())

    def symbol(self) -> int | None:
        return self.items[-1][0] if self.items else None

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        _, both, at, size = self.items.pop()
        if both is None:
            self.file.seek(at)
            both = np.frombuffer(self.file.read(size), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


class Prefixes:
    """Common prefixes of induced tuples. A pass reads its sources in order, batch after batch; two sources that put
    their predecessors behind one symbol give them one more than the least common prefix between the two."""

    def __init__(self, symbols: int):
        self.batch = np.full(symbols, -1, np.int64)  # of the last source that used the symbol
        self.tail = np.zeros(symbols, np.int64)  # least prefix behind that source, in its batch
        self.since = np.full(DEPTH, -1, np.int64)  # [v]: the last batch with a prefix of at most v
        self.now = 0

    def of(self, symbol: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """symbol, at (index of the source): sorted by (symbol, at). lcp: of all sources of the batch."""
        if len(at):
            new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
            ranges = np.empty(2 * len(at), np.int64)
            ranges[::2] = np.where(new, 0, np.concatenate([[0], at[:-1] + 1]))
            ranges[1::2] = at + 1
            more = np.append(lcp, DEPTH)
            least = np.minimum.reduceat(more, ranges)[::2]
            own, last = symbol[new], np.append(np.flatnonzero(new)[1:], len(at)) - 1
            before = np.minimum(np.searchsorted(self.since, self.batch[own], side="right"), self.tail[own])
            least[new] = np.where(self.batch[own] < 0, -1, np.minimum(least[new], before))
            behind = np.minimum.accumulate(more[::-1])[::-1]
            self.batch[own], self.tail[own] = self.now, behind[at[last] + 1]
        else:
            least = np.zeros(0, np.int64)
        if len(lcp):
            self.since[lcp.min() :] = self.now
        self.now += 1
        return np.minimum(least + 1, DEPTH)


def _run(s: np.ndarray, pos: int) -> int:
    """How often the symbol at pos follows itself, itself included."""
    part = s[pos : pos + DEPTH]
    other = part != part[0]
    return int(other.argmax()) if other.any() else len(part)


def _step(s: np.ndarray, prefixes: Prefixes, pos: np.ndarray, lcp: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, position, common prefix) of the predecessors whose symbols keep() takes, by symbol, then source."""
    before = pos - 1
    symbol = s[before]  # that of the end, before the text
    at = np.flatnonzero(keep(symbol) & (before >= 0))
    symbol = symbol[at]
    by = np.argsort(symbol, kind="stable")  # bytes by radix
    at, symbol = at[by], symbol[by].astype(np.int64)
    return symbol, before[at], prefixes.of(symbol, at, lcp)


def _induce(s: np.ndarray, symbols: int, seeds: np.ndarray, seed_lcp: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the one before), from the largest suffix down; s ends with its only 0."""
    first = s[seeds].astype(np.int64)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(seeds)).tolist()
    queue, prefixes, larger, i = TupleQueue(room), Prefixes(symbols), Spool(room), 0
    while queue.least() is not None or i + 1 < len(cuts):
        c = min(x for x in (queue.least(), int(first[cuts[i]]) if i + 1 < len(cuts) else None) if x is not None)
        own = []
        if queue.least() == c:
            wave = queue.pop()
            while len(wave[0]):
                own.append(wave)
                symbol, pos, lcp = _step(s, prefixes, *wave, lambda x: x >= c)
                n = int(np.searchsorted(symbol, c, side="right"))
                wave = pos[:n], lcp[:n]
                queue.push(symbol[n:], pos[n:], lcp[n:])
            larger.push(c, *(np.concatenate(x) for x in zip(*own, strict=True)))
        if i + 1 < len(cuts) and first[cuts[i]] == c:
            pos, lcp = seeds[cuts[i] : cuts[i + 1]], seed_lcp[cuts[i] : cuts[i + 1]].copy()
            # a larger suffix falls behind its run of c, a smaller one rises
            lcp[0] = min(_run(s, int(own[-1][0][-1])), _run(s, int(pos[0]))) if own else 0
            queue.push(*_step(s, prefixes, pos, lcp, lambda x: x > c))
            i += 1
    queue, prefixes = TupleQueue(room), Prefixes(symbols)
    while queue.least() is not None or larger.symbol() is not None:
        c = max(x for x in (None if queue.least() is None else -queue.least(), larger.symbol()) if x is not None)
        low = None
        if queue.least() == -c:
            wave = queue.pop()
            while len(wave[0]):
                yield wave
                low = int(wave[0][-1])
                symbol, pos, lcp = _step(s, prefixes, *wave, lambda x: x <= c)
                n = int(np.searchsorted(symbol, c))
                wave = pos[n:], lcp[n:]
                queue.push(-symbol[:n], pos[:n], lcp[:n])
        if larger.symbol() == c:
            pos, up = larger.pop()
            pos, lcp = pos[::-1], np.append(0, up[::-1][:-1])
            if low is not None:
                lcp[0] = min(_run(s, low), _run(s, int(pos[0])))
            yield pos, lcp
            symbol, pos, lcp = _step(s, prefixes, pos, lcp, lambda x: x < c)
            queue.push(-symbol, pos, lcp)


def _seeds(s: np.ndarray) -> np.ndarray:
    """Leftmost-S positions, ascending, the end included; read in blocks from the end."""
    hi, is_s, found = len(s) - 1, True, []
    while hi > 0:
        lo = max(0, hi - _BLOCK)
        part = np.asarray(s[lo : hi + 1])
        m = hi - lo
        next_other = np.minimum.accumulate(np.where(part[:-1] != part[1:], np.arange(m), m)[::-1])[::-1]
        up = np.append(part[:-1] < part[1:], is_s)[next_other]
        kind = np.append(up, is_s)
        found.append(lo + 1 + np.flatnonzero(kind[1:] & ~kind[:-1]))
        hi, is_s = lo, bool(up[0])
    return np.concatenate(found[::-1]) if found else np.array([len(s) - 1])


def _names(s: np.ndarray, symbols: int, seeds: np.ndarray, room: int) -> np.ndarray:
    """For each seed but the last the rank of the string from it to the next one, from 1; 0 for the last."""
    start = seeds[np.argsort(s[seeds], kind="stable")]
    rank = []
    for pos, _ in _induce(s, symbols, start, np.zeros(len(start), np.int64), room):
        i = np.searchsorted(seeds, pos)
        rank.append(i[(i < len(seeds)) & (seeds[np.minimum(i, len(seeds) - 1)] == pos)])
    rank = np.concatenate(rank)[::-1]
    length = np.minimum(np.diff(seeds), DEPTH)[rank]
    same = length[1:] == length[:-1]
    for k in range(DEPTH + 1):
        ask = np.flatnonzero(same & (length[1:] >= k))
        if not len(ask):
            break
        same[ask] = s[seeds[rank[ask]] + k] == s[seeds[rank[ask + 1]] + k]
    names = np.zeros(len(seeds), np.int64)
    names[rank] = np.cumsum(np.append(True, ~same)) if len(rank) else 0
    return names


def _order(s: np.ndarray, room: int, base: int) -> np.ndarray:
    """All positions of a string of names that ends with its only 0, in order, to a depth of DEPTH names."""
    if len(s) > base:
        symbols = int(s.max()) + 1
        seeds = _seeds(s)
        seeds = seeds[_order(_names(s, symbols, seeds, room), room, base)]
        down = [pos for pos, _ in _induce(s, symbols, seeds, np.zeros(len(seeds), np.int64), room)]
        return np.concatenate([*down, [len(s) - 1]])[::-1]
    rank, step = s, 1
    while step < DEPTH:
        pair = rank * (int(rank.max()) + 1) + np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
        rank, step = np.unique(pair, return_inverse=True)[1].astype(np.int64), step * 2
    return np.argsort(rank, kind="stable")


def _words(text: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The first DEPTH bytes and some more from each place on, eight bytes a number, the first byte highest."""
    raw = np.empty(len(text), np.uint8)
    for lo in range(0, len(text), _BLOCK):
        raw[lo : lo + _BLOCK] = np.asarray(text[lo : lo + _BLOCK]) - 1
    every = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
    for k in range(0, DEPTH, 8):
        yield every[at + k].astype(np.uint64)


def _sort_seeds(s: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds in order by their first DEPTH bytes, and the common prefix of each with the one before.

    Word by word, each time only those that agree in all words before; their group and the rank of the next word are one number.
    """
    words = list(_words(s, seeds[:-1]))  # padding makes all of them whole
    order = np.argsort(words[0])
    differs = np.append(True, np.diff(words[0][order]) != 0) if len(order) else np.zeros(0, bool)
    for word in words[1:]:
        at = np.flatnonzero(~(differs & np.append(differs[1:], True)))
        if not len(at):
            break
        mine, group = word[order[at]], np.cumsum(differs[at])
        by = np.argsort(mine)
        rank = np.empty(len(at), np.int64)
        rank[by] = np.cumsum(np.append(False, np.diff(mine[by]) != 0))
        by = np.argsort((group << 32) | rank)
        order[at] = order[at][by]
        key, group = rank[by], group[by]
        differs[at] = np.append(True, (np.diff(group) != 0) | (np.diff(key) != 0))
    lcp, ask = np.zeros(len(seeds), np.int64), np.arange(1, len(order))
    for word in words:
        other = word[order[ask - 1]] ^ word[order[ask]]
        same = np.zeros(len(ask), np.int8)
        for bits in range(56, -8, -8):
            same += other < np.uint64(1 << bits)
        lcp[ask + 1] += same
        ask = ask[other == 0]
    return np.append(seeds[-1:], seeds[:-1][order]), np.minimum(lcp, DEPTH)


def _compare(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each seed with the one before; the end comes first."""
    lcp, ask = np.zeros(len(order), np.int64), np.arange(2, len(order))
    for k in range(DEPTH):
        ask = ask[s[order[ask - 1] + k] == s[order[ask] + k]]
        lcp[ask] += 1
    return lcp


def suffixes_down(text: np.ndarray, room: int = ROOM, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the one before, at most DEPTH) of a byte array, from the largest suffix down.

    Suffixes that agree in DEPTH bytes may stand in any order. Positions from len(text) on belong to padding. A text
    longer than room lies on disk and is read through the page cache.
    """
    n = len(text)
    if 2 * (n + _PAD) > room:
        with tempfile.TemporaryFile() as f:  # the map keeps the file
            s = np.memmap(f, np.int16, "w+", shape=(n + _PAD + 1,))
    else:
        s = np.empty(n + _PAD + 1, np.int16)
    for lo in range(0, n, _BLOCK):
        s[lo : min(lo + _BLOCK, n)] = text[lo : lo + _BLOCK].astype(np.int16) + 1
    s[n:], s[-1] = 1, 0  # a seed is followed by all the bytes it is compared by
    seeds = _seeds(s)
    if len(seeds) <= base:
        order, lcp = _sort_seeds(s, seeds)
    else:
        order = seeds[_order(_names(s, 257, seeds, room), room, 2 * base)]
        lcp = _compare(s, order)  # those of seeds are compared, all others are induced from them
    yield from _induce(s, 257, order, lcp, room)
