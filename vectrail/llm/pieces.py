"""Sampled segmentations of whole texts into pieces of a SentencePiece vocabulary, and back.

A text is a path through the lattice of pieces: white space ' ' is written U+2581 with one more in front, a character
that no piece holds (and a literal U+2581) is spelled in byte pieces. A path's log-weight is the sum over its pieces of
-`alpha` * ln(2 + rank), the rank being the model's own (its scores are the merge order), and `BYTE` for each byte; path
probabilities are weights over the sum of all paths' weights, which one backward pass over the lattice gives.

Gumbel top-k without replacement: the k paths of largest log-probability + Gumbel noise are k distinct samples. They are
found top down by best-first (A-star) search over sets of paths: a set is a prefix of pieces with the next pieces that
it may not take, its key the largest perturbed value in it, drawn as a Gumbel at the set's log-mass under the bound of
its parent, so the key is exact and a set that is taken from the queue holds the next sample. That sample is drawn
forward by the exact piece probabilities, and the rest of the set splits at every piece of it. The lattice falls apart
where no piece can reach across (before a word's U+2581, around characters that stand alone), so each distinct word of a
slice has its lattice built once. Keys, draws and results depend only on the row key, the seed and the text.

A sample's inclusion score is 1 - exp(-exp(log_prob - kappa)), kappa being the k+1st perturbed value: the probability of
being among k given kappa; 1 where no other path is left.

Defined cases: a null or empty text has one segmentation, of no pieces; a text with fewer than k segmentations gives
them all; rows with one doc_id and text get equal samples; a null doc_id is a key like any other; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import U64, as_long, binary_parts, mix, read_table, release, slices
from vectrail.llm.words import Column, Words, ranges

MARK = "▁"
LITERAL = 0x110000  # a U+2581 of the text itself
BYTE = -12.0
SLOTS = 19
#: Slots of word lattices that a worker keeps, 25 bytes each, besides those of the slice at hand.
LATTICE_SLOTS = 3_000_000
GOLDEN = 0x9E3779B97F4A7C15
_state: dict = {}


def unit(seed: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Uniform numbers in (0, 1) from row seeds and counters."""
    with np.errstate(over="ignore"):
        x = mix(np.asarray(seed, U64) + np.asarray(number, U64) * U64(GOLDEN))
    x >>= U64(11)
    x = x.astype(float)
    x += 0.5
    x *= 2.0**-53
    return x


class Vocabulary:
    """Pieces of a SentencePiece model: a table of their prefixes, log-weights and spellings."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, model.id_to_piece(i)) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = [(i, p) for i, p in pieces if MARK not in p.lstrip(MARK)]  # a piece that reaches into the next word would join their lattices
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.vocab_size()) if model.is_byte(i)}
        rank = {i: -model.get_score(i) for i, _ in pieces}
        self.longest = max(len(p) for _, p in pieces)
        sizes = np.array([len(p) for _, p in pieces])
        chars = np.array([ord(c) for _, p in pieces for c in p], np.uint32)
        own, first = np.array([i for i, _ in pieces], np.int32), np.cumsum(sizes) - sizes
        worth = -alpha * np.log(2 + np.array([rank[i] for i, _ in pieces]))
        found, h = [], np.zeros(len(pieces), U64)
        for n in range(self.longest):
            live = np.flatnonzero(sizes > n)
            h[live] = self.step(h[live], chars[first[live] + n])
            prefixes, ends = np.unique(h[live]), np.flatnonzero(sizes == n + 1)
            at, ids, weights = np.searchsorted(prefixes, h[ends]), np.full(len(prefixes), -1, np.int32), np.full(len(prefixes), -np.inf)
            ids[at], weights[at] = own[ends], worth[ends]
            found.append((prefixes, ids, weights))
        hashes, self.ids, self.weights = (np.concatenate(x) for x in zip(*found))
        # one open table of all prefixes: most questions end at its first, empty place
        self.keys, self.place = np.zeros(1 << SLOTS, U64), np.full(1 << SLOTS, -1, np.int32)
        for n, h in enumerate(hashes.tolist()):
            at = h >> (64 - SLOTS)
            while self.place[at] >= 0:
                at = (at + 1) % (1 << SLOTS)
            self.keys[at], self.place[at] = h, n
        joined = {ord(c) for _, p in pieces if len(p) > 1 for c in p}
        self.alone = np.ones(LITERAL + 1, bool)
        self.alone[list(joined)] = False
        self.lattice = Lattice(self)
        self.spelled = [b""] * model.vocab_size()
        for i, p in pieces:
            self.spelled[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        self.letters = pa.array(self.spelled, pa.large_binary())
        self.spelled = np.array(self.spelled, object)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each prefix hash; -1 for those of no piece."""
        out, at = np.full(len(h), -1, np.int32), (h >> U64(64 - SLOTS)).astype(np.int64)
        n = self.place.take(at, mode="clip")
        live = np.flatnonzero(n >= 0)
        at, n = at[live], n[live]
        while len(live):
            hit = self.keys[at] == h[live]
            out[live[hit]] = n[hit]
            on = np.flatnonzero(~hit)
            live, at = live[on], (at[on] + 1) % (1 << SLOTS)
            n = self.place[at]
            on = np.flatnonzero(n >= 0)
            live, at, n = live[on], at[on], n[on]
        return out

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(h * U64(0x9E3779B97F4A7C15) + c.astype(U64) + U64(1))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(self.spelled[np.asarray(ids, np.int64)].tolist())[1:]

    def decode_each(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """`decode_bytes` of many runs of ids, which stand in a row; all pieces are spelled at once."""
        if not len(ids):
            return [b""] * len(counts)
        spelled = self.letters.take(pa.array(ids))
        _, off, data = spelled.buffers()
        ends = np.frombuffer(off, np.int64)[np.concatenate([[0], np.cumsum(counts)])].tolist()
        data = memoryview(data)
        return [bytes(data[a + 1 : b]) for a, b in zip(ends, ends[1:])]

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode()


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _state:
        _state[path, alpha] = Vocabulary(path, alpha)
    return _state[path, alpha]


def spans_of(chars: np.ndarray) -> np.ndarray:
    """Bytes of some characters in UTF-8."""
    chars = np.where(chars == LITERAL, ord(MARK), chars)
    return 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)


class Lattice:
    """Lattices of the words met so far, place after place (their code points in a row). A place has its pieces in slots
    that follow each other, the longest first, as it mostly is the likeliest and a draw seldom looks further: their
    lengths, ids, log-probabilities given the place and probabilities summed up (2 at the last, so that no draw goes on).

    Words stay from slice to slice; past `LATTICE_SLOTS` those that came once go."""

    def __init__(self, v: Vocabulary):
        self.v, self.words = v, Words()
        self.first, self.last = Column(np.int64), Column(np.int8)
        self.size, self.ids = Column(np.int8), Column(np.int32)  # a negative size: the piece ends the word
        self.log, self.cum = Column(float), Column(float)

    def places(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first place of each of the words that fill a slice."""
        if len(self.ids) > LATTICE_SLOTS:
            self._shrink()
        number, new = self.words.numbers(chars, starts)
        if len(new):
            sizes = np.diff(np.append(starts, len(chars)))[new]
            self._add(chars[ranges(starts[new], sizes)], sizes)
        return self.words.ends.all[number]

    def _shrink(self) -> None:
        old, total = self.words.ends.all.copy(), len(self.words)
        kept = self.words.shrink(max(1, total // 3))
        place = ranges(old[kept], old[kept + 1] - old[kept])
        per = self.last.all[place].astype(np.int64) + 1
        slot = ranges(self.first.all[place], per)
        for c in (self.size, self.ids, self.log, self.cum):
            c.keep(slot)
        self.first.held, self.first.size = np.cumsum(per) - per, len(place)
        self.last.keep(place)

    def _add(self, chars: np.ndarray, sizes: np.ndarray) -> None:
        v, n, slots = self.v, len(chars), len(self.ids)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        found, live, h = [], np.arange(n), np.zeros(n, U64)
        per = np.zeros(n, np.int64)
        for k in range(v.longest):
            inside = room[live] > k
            live, h = live[inside], h[inside]
            if not len(live):
                break
            h = v.step(h, chars[live + k])
            at = v.find(h)
            ok = at >= 0
            live, h, at = live[ok], h[ok], at[ok]
            piece = v.ids[at] >= 0
            place, at = live[piece], at[piece]
            found.append((place, k + 1, at))
            per[place] += 1
            if not k:
                single = per > 0
        lone = np.flatnonzero(~single)
        per[lone] += 1
        # slots stand by the room their places have, so that those worked on together are neighbours
        key = room * 32 + (31 - per)
        most = int(room.max())
        order = np.argsort(key.astype(np.uint16) if most < 2000 else key, kind="stable")
        begin = np.cumsum(per[order]) - per[order]
        first = np.empty(n, np.int64)
        first[order] = begin
        total = int(per.sum())
        size, number = np.ones(total, np.int8), np.zeros(total, np.int32)
        free = first + per
        free[lone] -= 1
        for place, length, own in found:
            slot = free[place] - 1
            free[place] = slot
            size[slot], number[slot] = length, own
        many = per[order]
        ids, weight, target = v.ids.take(number, mode="clip"), v.weights.take(number, mode="clip"), np.repeat(order, many) + size
        ids[first[lone]], weight[first[lone]] = -1, BYTE * spans_of(chars[lone])
        end = np.flatnonzero(size == np.repeat(room[order], many))
        target[end] = n
        size[end] = -size[end]
        back, log, p = np.zeros(n + 1), np.empty(total), np.empty(total)
        edge = np.searchsorted(room[order], np.arange(1, most + 2))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if lo == hi:
                continue
            at = order[lo:hi]
            a, b = int(begin[lo]), int(begin[hi]) if hi < n else total
            seg, many = begin[lo:hi] - a, per[at]
            y = weight[a:b] + back.take(target[a:b], mode="clip")
            top = np.maximum.reduceat(y, seg)
            y -= np.repeat(top, many)
            e = np.exp(y)
            sums = np.add.reduceat(e, seg)
            back[at] = top + np.log(sums)
            log[a:b], p[a:b] = y - np.repeat(np.log(sums), many), e / np.repeat(sums, many)
        by = np.argsort(-per, kind="stable")
        seg = first[by]
        has = np.searchsorted(-per[by], -np.arange(int(per.max()) + 1), side="left").tolist()  # how many have a slot s
        for s in range(1, len(has)):
            at = seg[: has[s]] + s
            p[at] += p[at - 1]
        p[first + per - 1] = 2.0
        for column, part in ((self.first, first + slots), (self.last, per - 1), (self.size, size), (self.ids, ids), (self.log, log), (self.cum, p)):
            column.add(part)

    def padded(self, at: np.ndarray) -> np.ndarray:
        """Probabilities of all slots of some places, by rows; 0 where there is none."""
        last = self.last.all[at].astype(np.int64)
        row = np.arange(int(last.max(initial=0)) + 1)[:, None]
        return np.where(row <= last, np.exp(self.log.all.take(self.first.all[at] + np.minimum(row, last), mode="clip")), 0.0)

    def others(self, at: np.ndarray, pick: np.ndarray, bars: np.ndarray) -> np.ndarray:
        """The log of what all slots of some places have together but for one each and for those of a bit mask."""
        p = self.padded(at)
        p[pick, np.arange(len(at))] = 0.0
        some = np.flatnonzero(bars)
        p[:, some] = np.where((bars[some] >> np.arange(len(p))[:, None]) & 1 == 1, 0.0, p[:, some])
        with np.errstate(divide="ignore"):
            return np.log(p.sum(axis=0))

    def spell(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and their numbers: characters in bytes become their byte pieces."""
        ids, lens = self.ids.all.take(slot, mode="clip"), np.ones(len(at), np.int64)
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, lens
        kinds, which = np.unique(self.words.chars.all[at[lone]], return_inverse=True)
        lens[lone] = spans_of(kinds)[which]
        out = np.repeat(ids, lens)
        first = (np.cumsum(lens) - lens)[lone]
        table = np.zeros((len(kinds), 4), np.int32)
        for i, c in enumerate(kinds.tolist()):
            parts = [self.v.bytes[b] for b in (MARK if c == LITERAL else chr(c)).encode()]
            table[i, : len(parts)] = parts
        for k in range(4):
            has = lens[lone] > k
            out[first[has] + k] = table[which[has], k]
        return out, lens


def _forward(lat: Lattice, at: np.ndarray, seed: np.ndarray, some: np.ndarray, bars: np.ndarray):
    """Draw pieces from word places `at` to the words' ends, each with its seed: their numbers, places and slots.

    bars: bit masks of the slots that the first pieces of `some` may not have."""
    live, pos = np.arange(len(at)), at
    first, cum, size = (c.all for c in (lat.first, lat.cum, lat.size))
    steps, pieces = [], np.empty(len(at), np.int64)
    while len(live):
        u = unit(seed, len(steps))
        slot = first.take(pos, mode="clip")  # which skips a look for places out of range; there are none
        open_ = np.flatnonzero(u >= cum.take(slot, mode="clip"))
        there, left = slot[open_], u[open_]
        while len(open_):
            there += 1
            slot[open_] = there
            on = np.flatnonzero(left >= cum.take(there, mode="clip"))
            open_, there, left = open_[on], there[on], left[on]
        if not steps and len(some):
            p = lat.padded(pos[some])
            p[(bars >> np.arange(len(p))[:, None]) & 1 == 1] = 0.0
            sums = np.cumsum(p, axis=0)
            slot[some] = first[pos[some]] + np.minimum((u[some] * sums[-1] >= sums).sum(axis=0), len(p) - 1 - np.argmax((p > 0)[::-1], axis=0))
        steps.append((live, pos, slot))
        length = size.take(slot, mode="clip")
        on = length > 0
        pieces[live[~on]] = len(steps)
        on = np.flatnonzero(on)
        live, pos, seed = live[on], pos[on] + length[on], seed[on]
    begin = np.cumsum(pieces) - pieces
    got_at, got_slot = (np.empty(int(pieces.sum()), np.int64) for _ in range(2))
    for step, (live, pos, slot) in enumerate(steps):
        to = begin[live] + step
        got_at[to], got_slot[to] = pos, slot
    return pieces, got_at, got_slot


class _Text:
    """One document's search: its words' lattice places, its samples and its queue of sets."""

    __slots__ = ("words", "seed", "samples", "queue", "task", "total")

    def __init__(self, words: np.ndarray, seed: int):
        self.words, self.seed, self.samples, self.total = words, seed, [], 0.0
        g = -float(np.log(-np.log(unit(np.array([seed], U64), 1)[0])))
        self.queue = [(-g, 0, None, 0, 0, 0.0)]  # (-key, tie, base sample, pieces kept of it, barred lengths, log-mass of the prefix)
        self.task = None


#: Bytes that are searched together; the more, the fewer lattices of the same words.
SLICE = 1 << 19
#: No Gumbel draw from `unit` exceeds this.
NOISE = 38.0


CHUNK = 384


def _split(tasks: list, lat: Lattice, got: np.ndarray, slot: np.ndarray, edges: np.ndarray, k: int, ties) -> None:
    """Record the samples of some documents and queue what is left of their sets.

    Each task is (text, key, kept, barred, before); its sample's new pieces are got and slot between its edges. Sets
    split off further along have less mass; where even the largest draw could not lift one among the best k, the rest
    cannot matter and is not drawn."""
    logs = lat.log.all.take(slot, mode="clip")
    tasks = [(i, *t) for i, t in enumerate(tasks)]
    for _, t, _, _, _, before in tasks:
        t.total = before
    tasks = [t for t in tasks if edges[t[0] + 1] > edges[t[0]]]
    if not tasks:
        return
    lo, hi = (np.array([edges[t[0] + x] for t in tasks]) for x in (0, 1))
    for (_, t, *_), own in zip(tasks, np.add.reduceat(logs, lo).tolist()):
        t.total += own
    texts, key, kept, barred, before = (list(x) for x in list(zip(*tasks))[1:])
    seed, number = np.array([t.seed for t in texts], U64), np.array([len(t.samples) for t in texts], U64)
    key, before, bars = np.array(key), np.array(before), np.array(barred, np.int64)
    best: list[list[tuple]] = [[] for _ in tasks]
    live, start = np.arange(len(tasks)), 0
    while len(live):
        idx = lo[live, None] + np.arange(start, start + CHUNK)
        valid = idx < hi[live, None]
        idx = np.where(valid, idx, lo[live, None])
        prefix = before[live, None] + np.concatenate([np.zeros((len(live), 1)), np.cumsum(np.where(valid, logs[idx], 0.0), axis=1)], axis=1)
        before[live] = prefix[:, -1]
        u = unit(seed[live, None], (U64(1 << 40) * (number[live] + U64(1)))[:, None] + (start + np.arange(CHUNK)).astype(U64)[None, :])
        noise = np.log(-np.log(u))
        # a set's key is -log(exp(-key) + exp(noise - mass)): it grows with mass - noise, and the prefix bounds the mass
        bound = np.where(valid, prefix[:, :-1] - noise, -np.inf)
        rows, take = np.arange(len(live)), min(CHUNK, 8 * k)
        while len(rows):
            some = np.argpartition(-bound[rows], take - 1, axis=1)[:, :take]
            at = idx[rows[:, None], some]
            where = got[at]
            pick = slot[at] - lat.first.all[where]
            barring = np.where((some == 0) & (start == 0), bars[live[rows], None], 0)
            left = lat.others(where.ravel(), pick.ravel(), barring.ravel()).reshape(at.shape)
            before_it, own_noise = prefix[rows[:, None], some], noise[rows[:, None], some]
            mass = before_it + left
            value = np.where(valid[rows[:, None], some], mass - own_noise, -np.inf)
            order = np.argsort(-value, axis=1, kind="stable")[:, :k]
            worst = np.take_along_axis(value, order[:, -1:], axis=1)[:, 0] if take >= k else np.full(len(rows), -np.inf)
            # those where a set that wasn't drawn could still be among the best are drawn in full
            done = (take == CHUNK) | ((bound[rows] > worst[:, None]).sum(axis=1) <= (bound[rows[:, None], some] > worst[:, None]).sum(axis=1))
            r = np.flatnonzero(done)[:, None]
            x = order[done]
            keys = mass[r, x] - np.logaddexp(mass[r, x] - key[live[rows[r]]], own_noise[r, x])
            keys[value[r, x] == -np.inf] = -np.inf
            for d, *found in zip(live[rows[done]].tolist(), keys.tolist(), some[r, x].tolist(), pick[r, x].tolist(), before_it[r, x].tolist()):
                mine = best[d]
                for value_, j, p_, mass_ in zip(*found):
                    if value_ > -np.inf:
                        mine.append((value_, kept[d] + start + j, (1 << p_) | (barred[d] if start + j == 0 else 0), mass_))
                mine.sort(key=lambda b: -b[0])
                del mine[k:]
            rows, take = rows[~done], min(CHUNK, 3 * take)
        start += CHUNK
        live = np.array([d for d in live.tolist() if lo[d] + start < hi[d] and (len(best[d]) < k or before[d] + NOISE >= best[d][k - 1][0])], np.int64)
    for t, found in zip(texts, best):
        for value, place, b, mass in found:
            heapq.heappush(t.queue, (-value, next(ties), len(t.samples), place, b, mass))


def sample_texts(v: Vocabulary, raw: np.ndarray, off: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: (ids, log-probability, perturbed value, inclusion score)."""
    text = raw.tobytes().decode()
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    chars[chars == ord(MARK)] = LITERAL
    chars[chars == 32] = ord(MARK)
    has = np.flatnonzero(np.diff(first))
    chars = np.insert(chars, first[has], ord(MARK))
    off2 = first + np.concatenate([[0], np.cumsum(np.diff(first) > 0)])
    solo = v.alone[chars]
    mark = chars == ord(MARK)
    cut = np.zeros(len(chars) + 1, bool)
    cut[off2] = True
    cut[1:-1] |= (mark[1:] & ~mark[:-1]) | solo[1:] | solo[:-1]
    if len(chars):
        cut[0] = True
    starts = np.flatnonzero(cut[:-1])
    lat = v.lattice
    place = lat.places(chars, starts) if len(starts) else starts
    by_doc = np.searchsorted(starts, off2)
    ties = count(1)
    texts = [_Text(place[by_doc[d] : by_doc[d + 1]], int(seeds[d])) for d in range(len(off) - 1)]
    for _ in range(k):
        at, base, barred, done = [], [], [], []
        for t in texts:
            if not t.queue:
                continue
            key, _, base_of, kept, bars, before = heapq.heappop(t.queue)
            if base_of is None:
                where, word0, head = [t.words], 0, None
            else:
                a, s, w = t.samples[base_of][:3]
                word0 = int(w[kept])
                where, head = [a[kept : kept + 1], t.words[word0 + 1 :]], (a[:kept], s[:kept], w[:kept])
            t.task = (-key, kept, bars, before, head, word0)
            at += where
            base.append((t.seed + (word0 + (len(t.samples) + 1) * (1 << 24)) * (GOLDEN << 20)) % (1 << 64))
            barred.append(bars)
            done.append((t, sum(map(len, where))))
        if not done:
            break
        done, cuts = zip(*done)
        begin = np.concatenate([[0], np.cumsum(cuts)])
        stride = U64((GOLDEN << 20) % (1 << 64))
        seed = np.repeat(np.array(base, U64) - begin[:-1].astype(U64) * stride, cuts) + np.arange(begin[-1], dtype=U64) * stride
        bars = np.array(barred, np.int64)
        some = np.flatnonzero(bars)
        pieces, got, slot = _forward(lat, np.concatenate(at), seed, begin[some], bars[some])
        edges = np.concatenate([[0], np.cumsum(pieces)])[begin]
        which = np.repeat(np.arange(len(pieces), dtype=np.int32), pieces)
        _split([(t, *t.task[:4]) for t in done], lat, got, slot, edges, k, ties)
        edges, begin = edges.tolist(), begin.tolist()
        for i, t in enumerate(done):
            key, *_, head, word0 = t.task
            lo, hi = edges[i], edges[i + 1]
            own = (got[lo:hi], slot[lo:hi], which[lo:hi] + np.int32(word0 - begin[i]))
            t.samples.append((*(own if head is None else (np.concatenate(x) for x in zip(head, own))), key, t.total))
    every = [x for t in texts for x in t.samples]
    counts = np.array([len(x[0]) for x in every], np.int64)
    ids, lens = lat.spell(np.concatenate([x[0] for x in every]), np.concatenate([x[1] for x in every])) if every else (np.zeros(0, np.int32), counts)
    total = np.concatenate([[0], np.cumsum(lens)])
    spelled = iter(np.split(ids, total[np.cumsum(counts)[:-1]]) if every else ())
    out = []
    for t in texts:
        kappa = -t.queue[0][0] if t.queue else -np.inf
        out.append([(next(spelled), logp, key, 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(logp - kappa)))) for _, _, _, key, logp in t.samples])
    return out


def _samples(path: str, alpha: float, k: int, digest: bool, keep_words: bool):
    def run(batches):
        v = vocabulary(path, alpha)
        try:
            yield from sampled(v, batches)
        finally:
            if not keep_words:
                v.lattice = Lattice(v)
                release()

    def sampled(v, batches):
        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            seeds, names = batch.column(2).to_numpy().view(U64), batch.column(0).to_pylist()
            for i, j in slices(off, SLICE):
                got = sample_texts(v, raw[off[i] : off[j]], off[i : j + 1] - off[i], seeds[i:j], k)
                samples = [(names[i + d], rank, *x) for d, rows in enumerate(got) for rank, x in enumerate(rows, 1)]
                doc, rank, ids, logp, key, score = zip(*samples)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                if digest:
                    own = [x for d, rows in enumerate(got) for x in [raw[off[i + d] : off[i + d + 1]].tobytes()] * len(rows)]
                    last = [pa.array([zlib.crc32(x.astype("<u4", copy=False).data) for x in ids], pa.int64()), pa.array([x == t for x, t in zip(v.decode_each(np.concatenate(ids), n), own)])]
                else:
                    last = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))]
                columns = [pa.array(doc, pa.int64()), pa.array(rank, pa.int32()), pa.array(n), pa.array(logp, pa.float64()), pa.array(key, pa.float64()), pa.array(score, pa.float64()), *last]
                del got, samples, ids
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{c}" for c in range(len(columns))])
                release()

    return run


def sample_segmentations(documents: DataFrame, model: str, *, k: int = 3, alpha: float = 1.0, seed: int = 42, digest: bool = False, keep_words: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rank, n_pieces, log_prob, perturbed, inclusion, ids) for every document's k samples; with digest the ids
    give way to their crc32 (as little-endian 32-bit numbers) and to whether they decode to the text. With keep_words a
    worker keeps the lattices of its words for its next task (some 100 MB); the samples are the same either way."""
    key = F.xxhash64(as_long(documents, doc_id), F.coalesce(F.col(text), F.lit("")), F.lit(seed))
    rows = documents.select(as_long(documents, doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("seed"))
    end = "ids_crc32 long, round_trip boolean" if digest else "ids array<int>"
    return rows.mapInArrow(_samples(model, alpha, k, digest, keep_words), f"doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, {end}")


def op10_gumbel_pieces(spark, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document."""
    import public_tokenizers

    return sample_segmentations(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
