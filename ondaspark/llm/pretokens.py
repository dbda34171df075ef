"""Cutting text at single spaces, where byte-level BPE can never join, so that pieces can be cached.

The public pattern lets a token begin with one space but never run over a
space that stands between two non-space characters. So a text is the
concatenation of pieces, every one but the first with its space in front, and
the ids of a text are the concatenated ids of its pieces.
"""

from __future__ import annotations

import re

import numpy as np

from .common import U, mix

#: Ids are kept for twice as many pieces at most in each worker.
CACHE_PIECES = 400_000

#: White space other than space and line feed.
_RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Pieces without the space in front of all but the first."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _RARE.search(text):
        return _CUT.split(text)
    return text.split(" ")


class PieceCache:
    """Packed ids of pieces, and through them of texts.

    ``encode`` turns a list of texts into a list of packed ids. Pieces that
    were met since the last but one renewal are remembered, so frequent ones
    stay while the table keeps a fixed size.
    """

    def __init__(self, encode, limit: int = CACHE_PIECES):
        self.encode, self.limit = encode, limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, wanted: set[str]) -> None:
        missing = wanted.difference(self.new)
        if len(self.new) + len(missing) > self.limit and self.new:
            self.old, self.new = self.new, {}
            missing = wanted
        # set.intersection() would go through the whole table
        old, unknown = self.old, []
        for p in missing:
            ids = old.get(p)
            if ids is None:
                unknown.append(p)
            else:
                self.new[p] = ids
        self.new.update(zip(unknown, self.encode([" " + p for p in unknown]), strict=True))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A first piece has no space in front and goes to encode as it is."""
        cut = [pieces(t) if t else [] for t in texts]
        firsts = iter(self.encode([c[0] for c in cut if c]))
        self._learn(set().union(*(c[1:] for c in cut)))
        get = self.new.__getitem__
        return [b"".join([next(firsts), *map(get, c[1:])]) if c else b"" for c in cut]


#: Longest piece, in bytes, that a table holds; characters of the texts that it takes at once.
TABLE_BYTES, TABLE_CHARS = 23, 1 << 19
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_KEEP = [_MASKS[np.clip(np.arange(TABLE_BYTES + 1) - 8 * j, 0, 8)] for j in range(3)]


class PieceTable:
    """What PieceCache does, in arrays: a piece's bytes and its size are its key, compared whole, and its ids stand in one pool.

    When limit pieces are held, those that were met again since the last
    renewal stay. First and longer pieces go to encode as they are, texts with
    white space other than space and line feed through a PieceCache.
    """

    def __init__(self, encode, limit: int = 2 * CACHE_PIECES):
        self.encode, self.limit = encode, limit
        self.rare = PieceCache(encode, limit // 8)
        self.n = self.n_ids = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self._room(limit)

    def _room(self, size: int) -> None:
        self.keys = np.zeros((3, size), U)
        self.off, self.count, self.used = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        self.table = np.full(1 << (2 * size - 1).bit_length(), -1, np.int32)

    def _slots(self, words: np.ndarray) -> np.ndarray:
        h = mix(mix(words[0] * U(0x9E3779B97F4A7C15) + words[1]) * U(0xA24BAED4963EE407) + words[2])
        return (h & U(len(self.table) - 1)).astype(np.int64)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        out, slot, left, last = np.full(words.shape[1], -1, np.int64), self._slots(words), np.arange(words.shape[1]), len(self.table) - 1
        while len(left):
            e = self.table[slot]
            some = e >= 0
            left, slot, e = left[some], slot[some], e[some]
            same = (self.keys[0][e] == words[0][left]) & (self.keys[1][e] == words[1][left]) & (self.keys[2][e] == words[2][left])
            out[left[same]] = e[same]
            left, slot = left[~same], (slot[~same] + 1) & last
        return out

    def _add(self, words: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The entries of distinct keys that the table doesn't hold."""
        new = np.arange(self.n, self.n + words.shape[1])
        self.keys[:, new], self.count[new], self.used[new] = words, count, False
        self.off[new] = self._stand(ids) + np.cumsum(count) - count
        self.n, self.n_ids = self.n + len(new), self.n_ids + len(ids)
        slot, left, last = self._slots(words), new, len(self.table) - 1
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of those that want a slot, one gets it
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & last
        return new

    def _stand(self, ids: np.ndarray) -> int:
        """Where ids stand in the pool, after those of the entries."""
        if self.n_ids + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.n_ids], np.zeros(self.n_ids + 2 * len(ids), np.uint32)])
        self.pool[self.n_ids : self.n_ids + len(ids)] = ids
        return self.n_ids

    def _renew(self, at: np.ndarray, more: int) -> np.ndarray:
        """Make room for more entries; at (-1 or entries, which all stay) as they are numbered then."""
        keep = np.flatnonzero(self.used[: self.n])
        if len(keep) + more > self.limit // 2:
            keep = np.unique(at[at >= 0])
        words, count = self.keys[:, keep], self.count[keep]
        ids = self.pool[spread(self.off[keep], count)]
        place = np.full(self.n + 1, -1, np.int64)
        place[keep] = np.arange(len(keep))
        self.n = self.n_ids = 0
        self._room(max(self.limit, len(keep) + more))
        self._add(words, ids, count)
        return place[at]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if t and _RARE.search(t)]
        for i, ids in zip(odd, self.rare.many([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        run, n = [], 0
        for i in sorted({i for i, t in enumerate(texts) if t}.difference(odd)):
            run.append(i)
            n += len(texts[i])
            if n >= TABLE_CHARS:
                self._run(texts, run, out)
                run, n = [], 0
        if run:
            self._run(texts, run, out)
        return out

    def _run(self, texts: list[str], run: list[int], out: list[bytes]) -> None:
        coded = [texts[i].encode() for i in run]
        size = np.array([len(x) for x in coded])
        begins = np.cumsum(size + 1) - size - 1
        blob = b"\n".join(coded) + bytes(32)
        data = np.frombuffer(blob, np.uint8)
        # a line feed between texts: a space at the edge of one is no cut
        space = data == 32
        solid = ~(space | (data == 10))
        cuts = np.flatnonzero(space[1:-1] & solid[:-2] & solid[2:]) + 1
        cuts = cuts[cuts < begins[-1] + size[-1] - 1]
        lo, hi = np.sort(np.concatenate([begins, cuts + 1])), np.sort(np.concatenate([cuts, begins + size]))
        first = np.searchsorted(lo, begins)
        size = hi - lo
        short = size <= TABLE_BYTES
        short[first] = False
        at = np.flatnonzero(short)
        eights = np.ndarray(len(blob) - 7, "<u8", blob, strides=(1,))
        words = np.stack([eights[lo[at] + 8 * j] & _KEEP[j][size[at]] for j in range(3)])
        words[2] |= size[at].astype(U) << U(56)
        entry = self._find(words)
        self.used[entry[entry >= 0]] = True
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            number: dict[bytes, int] = {}
            of = [number.setdefault(blob[a:b], len(number)) for a, b in zip(lo[at[miss]].tolist(), hi[at[miss]].tolist(), strict=True)]
            of = np.array(of)
            one = np.empty(len(number), np.int64)
            one[of] = miss
            ids = self.encode([" " + x.decode() for x in number])
            if self.n + len(number) > len(self.off):
                entry = self._renew(entry, len(number))
            entry[miss] = self._add(words[:, one], np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) // 4 for x in ids]))[of]
        off, count = np.empty(len(lo), np.int64), np.empty(len(lo), np.int64)
        off[at], count[at] = self.off[entry], self.count[entry]
        rest = np.flatnonzero(~short)
        is_first = np.isin(rest, first).tolist()
        ids = self.encode([("" if f else " ") + blob[a:b].decode() for a, b, f in zip(lo[rest].tolist(), hi[rest].tolist(), is_first, strict=True)])
        count[rest] = [len(x) // 4 for x in ids]
        off[rest] = self._stand(np.frombuffer(b"".join(ids), np.uint32)) + np.cumsum(count[rest]) - count[rest]
        raw = self.pool[spread(off, count)].tobytes()
        edges = (4 * np.append(np.cumsum(count) - count, count.sum())[np.append(first, len(lo))]).tolist()
        for i, a, b in zip(run, edges[:-1], edges[1:], strict=True):
            out[i] = raw[a:b]


def spread(off: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of runs of count that begin at off, one run after the other."""
    return np.repeat(off - np.cumsum(count) + count, count) + np.arange(count.sum())
