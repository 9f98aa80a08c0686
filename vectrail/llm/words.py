"""Words that come again from slice to slice, told apart by their own characters."""

from __future__ import annotations

import numpy as np

from vectrail.llm.common import U64, Rolling

_code = Rolling(11)


class Column:
    """A growing array."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1 << 10, kind), 0

    def __len__(self) -> int:
        return self.size

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]

    def add(self, part: np.ndarray) -> None:
        need = self.size + len(part)
        if need > len(self.held):
            grown = np.empty(max(need, len(self.held) * 3 // 2), self.held.dtype)
            grown[: self.size] = self.all
            self.held = grown
        self.held[self.size : need] = part
        self.size = need

    def keep(self, at: np.ndarray) -> None:
        self.size, self.held[: len(at)] = len(at), self.all[at]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (n[i] of them) in a row."""
    total = np.cumsum(n)
    return np.repeat(first - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)


def word_hashes(chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return _code.ranges(_code.of_values(chars.astype(U64) + U64(1)), starts, starts + sizes)


class Words:
    """Numbers of words. A hash only proposes a number: every word is compared with the characters kept under it, and
    one that differs gets a number of its own."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.chars, self.hashes, self.used = Column(np.uint32), Column(U64), Column(np.int32)
        self.bits = 16  # of the open table: places of hashes, the number of the word or -1
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.ends = Column(np.int64)
        self.ends.add(np.zeros(1, np.int64))

    def __len__(self) -> int:
        return len(self.hashes)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, live = np.full(len(h), -1, np.int64), np.arange(len(h))
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(live):
            n = self.place[at]
            on = n >= 0
            hit = on & (self.hashes.all[n] == h[live]) if len(self) else on
            out[live[hit]] = n[hit]
            on &= ~hit
            live, at = live[on], (at[on] + 1) & (len(self.place) - 1)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Enter hashes; of equal ones the first that gets a place is found later."""
        if 2 * len(self) > len(self.place):
            while 2 * len(self) > 1 << self.bits:
                self.bits += 1
            self.place = np.full(1 << self.bits, -1, np.int32)
            h, number = self.hashes.all, np.arange(len(self))
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.place[at] < 0)
            self.place[at[free]] = number[free]
            out = self.place[at] != number
            h, number, at = h[out], number[out], (at[out] + 1) & (len(self.place) - 1)

    def numbers(self, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word of a slice, which the words fill, and which of them (one each) stand for new numbers."""
        sizes = np.diff(np.append(starts, len(chars)))
        h = word_hashes(chars, starts, sizes)
        out = self._find(h)
        hit = np.flatnonzero(out >= 0)
        if len(hit):
            begin = self.ends.all[out[hit]]
            differ = self.ends.all[out[hit] + 1] - begin != sizes[hit]
            out[hit[differ]] = -1
            shift = (-starts).astype(np.int32)
            shift[hit[~differ]] += begin[~differ].astype(np.int32)
            at = np.repeat(shift, sizes)
            at += np.arange(len(chars), dtype=np.int32)
            wrong = np.flatnonzero(self.chars.all.take(at, mode="clip") != chars)
            out[np.searchsorted(starts, wrong, side="right") - 1] = -1  # others have no number yet
        miss = np.flatnonzero(out < 0)
        rep = miss
        if len(miss):
            _, first, kind = np.unique(h[miss], return_index=True, return_inverse=True)
            rep = miss[first]
            mine, model = sizes[miss], rep[kind]
            if (mine != sizes[model]).any() or (chars[ranges(starts[miss], mine)] != chars[ranges(starts[model], mine)]).any():
                rep, kind = miss, np.arange(len(miss))  # two words of one hash
            base = len(self)
            self.chars.add(chars[ranges(starts[rep], sizes[rep])])
            self.ends.add(self.ends.all[-1] + np.cumsum(sizes[rep]))
            self.hashes.add(h[rep])
            self.used.add(np.zeros(len(rep), np.int32))
            self._put(h[rep], np.arange(base, base + len(rep)))
            out[miss] = base + kind
        asked = np.zeros(len(self), bool)
        asked[out] = True
        self.used.all[asked] += 1
        return out, rep

    def shrink(self, most: int) -> np.ndarray:
        """Forget the words that one slice had, and of the others all but the most used `most`; the old numbers that stay."""
        used = self.used.all
        least = max(2, int(np.partition(used, -most)[-most])) if len(used) > most else 2
        kept = np.flatnonzero(used >= least)
        first, n = self.ends.all[kept], self.ends.all[kept + 1] - self.ends.all[kept]
        self.chars.keep(ranges(first, n))
        self.ends.held, self.ends.size = np.concatenate([[0], np.cumsum(n)]), len(kept) + 1
        self.hashes.keep(kept)
        self.used.held, self.used.size = used[kept] // 2, len(kept)
        self.bits = 16
        self.place = np.full(1 << self.bits, -1, np.int32)
        self._put(self.hashes.all, np.arange(len(kept)))
        return kept
