"""Exact substring dedup over a partitioned enhanced suffix array.

A byte goes if a string of `length` (400) bytes that covers it also starts anywhere else. Every start of such a string
is a suffix that shares a prefix of `length` bytes with another: a node of depth `length` or more in the common-prefix
interval tree. The suffix array is built in parts:

1. Suspects. Each window of `length` bytes is counted under its least-hashed run of `COARSE` bytes in a count-min
   sketch (two bit maps of fixed size, see substring); windows under a run that occurs once are unique and leave.
2. Routing. The other windows go to the bucket of their least-hashed run of `FINE` bytes, so equal windows meet.
   Neighbouring windows of one such run travel as one piece of text; a task folds its equal pieces into one with a list
   of places, so that copies are sent once a batch. A bucket has `PARTS` parts (by the same run) that its task sorts one
   after the other: its arrays are those of one part, and pieces are folded by their bytes.
3. A part's suffixes are first grouped by a hash of their first `length` bytes. A group whose members all have the same
   byte to their left is the shift of another and leaves. What stays is compared byte by byte (a hash only proposes),
   sorted by what follows, seven bytes a round, which also gives the common prefixes of neighbours; `stack_scan` then
   makes the tree's intervals of depth `length` or more from them. An interval with different left extensions is a
   maximal repeat of the part, with all its places; its members are covered for its depth.
4. The covered runs of every piece go back to all places of the piece, and the bytes out of the documents.

`repeat_groups` gives the groups of step 3 with all their places; `maximal_repeats` is the same tree over one list of
texts, for small inputs and tests.

Defined cases: null and empty texts and those under `length` bytes lose nothing; repeated rows are separate documents
and so repeat each other; null doc_ids are fine; matches never cross documents; a text of any length is read in
overlapping chunks of 256 kB; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm import substring
from vectrail.llm.common import U64, Rolling, as_long, binary_parts, read_table, release, row_keys, shuffle_parts, sliding_min, slices
from vectrail.llm.exchange import MARKS, pack_marks, with_marks
from vectrail.llm.words import ranges

COARSE = 256
FINE = 48
#: Bytes that are hashed together; a task's arrays hold some ten numbers for each.
SLICE_BYTES = 1 << 18
BUCKET_BYTES = 16 << 20
PARTS = 32
FLUSH_BYTES = 8 << 20
_one = Rolling(5)
_LOW = U64((1 << 24) - 1)


def _keyed(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash (40 bits) and position (24 bits) of every run of `width` bytes."""
    h = _one.windows(prefix, width)
    return (h & ~_LOW) | (np.arange(len(h), dtype=U64) & _LOW)


def _starts(off: np.ndarray, length: int) -> np.ndarray:
    """All window starts that stay inside their document."""
    room = np.diff(off) - length + 1
    room = np.maximum(room, 0)
    return np.repeat(off[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())


def _chunks(off: np.ndarray, length: int):
    """(first document, byte offsets of some documents): slices, and long documents cut so that each window is in one."""
    for i, j in slices(off, SLICE_BYTES):
        if off[j] - off[i] <= 2 * SLICE_BYTES or j - i > 1:
            yield i, off[i : j + 1]
            continue
        for a in range(int(off[i]), int(off[j]) - length + 1, SLICE_BYTES):
            yield i, np.array([a, min(int(off[j]), a + SLICE_BYTES + length - 1)])


def _sketch(length: int):
    def run(batches):
        held, size, seen = [], 0, 0
        for batch in batches:
            raw, off = binary_parts(batch.column(0))
            for _, own in _chunks(off, length):
                lo, hi = own[0], own[-1]
                at = _starts(own - lo, length)
                seen += int(hi - lo)
                if not len(at):
                    continue
                least = sliding_min(_keyed(_one.of_bytes(raw[lo:hi]), COARSE), length - COARSE + 1)[at]
                held.append(np.unique(least) >> U64(24))
                size += len(held[-1])
                if size > 1 << 22:
                    yield substring.sketch_rows(held)
                    held, size = [], 0
        yield substring.sketch_rows(held, seen)

    return run


PIECE = ("k1", "k2", "parts", "size", "text", "n", "doc", "at")
_KINDS = dict(zip(PIECE, (np.int64, np.int64, np.uint32, np.uint32, None, np.uint32, np.uint32, np.uint32)))


def _pieces(shared, length: int, buckets: int):
    def found_in(raw, off, sketch):
        """(route, first byte, bytes, document) of the pieces, by slices."""
        for i, where in _chunks(off, length):
            lo, hi = where[0], where[-1]
            own = where - lo
            at = _starts(own, length)
            if not len(at):
                continue
            a = _one.of_bytes(raw[lo:hi])
            coarse = sliding_min(_keyed(a, COARSE), length - COARSE + 1)[at]
            new = np.flatnonzero(np.concatenate([[True], coarse[1:] != coarse[:-1]]))
            at = at[np.repeat(sketch.repeated(coarse[new] >> U64(24)), np.diff(np.concatenate([new, [len(at)]])))]
            if not len(at):
                continue
            fine = sliding_min(_keyed(a, FINE), length - FINE + 1)[at]
            doc = np.searchsorted(own, at, side="right") - 1
            cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (fine[1:] != fine[:-1]) | (doc[1:] != doc[:-1])]))
            first, last = at[cut], at[np.concatenate([cut[1:], [len(at)]]) - 1] + length
            yield fine[cut] >> U64(24), first + lo, last - first, doc[cut] + i

    def packed(raw, off, k1, k2, found):
        route, first, size, doc = (np.concatenate(x) for x in zip(*found))
        home = (route % U64(buckets * PARTS)).astype(np.int64)  # bucket by bucket, part by part
        order = np.lexsort((first, home))
        home, first, size, doc = (x[order] for x in (home, first, size, doc))
        kinds: dict[bytes, int] = {}
        kind = np.fromiter((kinds.setdefault(raw[a:b].tobytes(), len(kinds)) for a, b in zip(first.tolist(), (first + size).tolist())), np.int64, len(first))
        lead = np.unique(kind, return_index=True)[1]
        times = np.bincount(kind, minlength=len(lead))
        by = np.argsort(kind, kind="stable")
        doc, at = doc[by], (first - off[doc])[by]
        place = np.concatenate([[0], np.cumsum(times)])
        texts, rows, where, pack = list(kinds), {c: [] for c in PIECE}, [], zstandard.ZstdCompressor(level=1).compress
        edges = np.searchsorted(home[lead], np.arange(0, buckets * PARTS + 1, PARTS))
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = int(edges[bucket]), int(edges[bucket + 1])
            own = slice(place[lo], place[hi])
            used, back = np.unique(doc[own], return_inverse=True)
            where.append(bucket)
            parts = np.bincount(home[lead[lo:hi]] % PARTS, minlength=PARTS)
            for name, part in (("k1", k1[used]), ("k2", k2[used]), ("parts", parts), ("size", size[lead[lo:hi]]), ("n", times[lo:hi]), ("doc", back), ("at", at[own])):
                rows[name].append(part.astype(_KINDS[name]).tobytes())
            rows["text"].append(pack(b"".join(texts[lo:hi])))
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *(pa.array(rows[c], pa.binary()) for c in PIECE)], names=["bucket", *PIECE])

    def run(batches):
        sketch = shared.value
        for batch in batches:
            raw, off = binary_parts(batch.column(0))
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            found, held = [], 0
            for x in found_in(raw, off, sketch):
                found.append(x)
                held += int(x[2].sum())
                if held > FLUSH_BYTES:
                    yield packed(raw, off, k1, k2, found)
                    found, held = [], 0
            if found:
                yield packed(raw, off, k1, k2, found)

    return run


def stack_scan(lcp: list[int]) -> list[tuple[int, int, int]]:
    """All intervals (depth, first, last) of the common-prefix tree; lcp[i] belongs to neighbours i and i + 1."""
    out, stack = [], []
    for i, value in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > value:
            depth, left = stack.pop()
            out.append((depth, left, i))
        if not stack or stack[-1][0] < value:
            stack.append((value, left))
    return [x for x in out if x[0] >= 0]


_WORD = 7  # bytes compared at once; the eighth says how many of them there are
_MASK = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(_WORD + 1)], U64)


class Tree:
    """The interval tree of depth `length` and more over some pieces of text, each with a weight (its copies).

    `at` has the members (suffixes with another of the same first `length` bytes, whose left bytes differ) in order of
    the suffix array, `lcp` the common prefixes of neighbours (-1 where they share less than `length`), and `intervals`
    the left-diverse intervals as (depth, first, last); a single member of several copies is an interval of its own."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, weight: np.ndarray, length: int):
        self.raw, self.length, self.weight = raw, length, weight
        self.off = np.concatenate([[0], np.cumsum(sizes)])
        self._words = np.ndarray((len(raw),), ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
        at = _starts(self.off, length)
        h = _one.windows(_one.of_bytes(raw), length)[at]
        order = np.argsort(h)
        at, h = at[order], h[order]
        node = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        del h, order
        self._members(at, node)
        if len(self.at) and not self._same_heads():
            # two strings of one hash: the members' nodes by their bytes
            names: dict[bytes, int] = {}
            node = np.array([names.setdefault(raw[a : a + length].tobytes(), len(names)) for a in self.at.tolist()])
            by = np.argsort(node, kind="stable")
            self._members(self.at[by], node[by])
        self._sort()
        self._scan()

    def _members(self, at: np.ndarray, node: np.ndarray) -> None:
        """Keep the suffixes (in order of their nodes) of nodes with several places and different left bytes."""
        self.at, self.of, self.node, self.left = at, np.zeros(0, np.int64), node, np.zeros(0, np.int64)
        if not len(at):
            return
        of = np.searchsorted(self.off, at, side="right") - 1
        # the byte before; a piece's begin is unlike any other, even itself
        begins = at == self.off[of]
        left = np.where(begins, 256 + np.arange(len(at)), self.raw[np.maximum(at - 1, 0)].astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        count = np.add.reduceat(self.weight[of], first)
        low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
        keep = np.repeat((count > 1) & ((low != high) | (high > 255)), np.diff(np.append(first, len(at))))
        self.at, self.of, self.node, self.left = at[keep], of[keep], node[keep], left[keep]

    def _same_heads(self) -> bool:
        """Whether neighbours of one node do share their first bytes."""
        pairs = np.flatnonzero(self.node[1:] == self.node[:-1])
        a, b = self.at[pairs], self.at[pairs + 1]
        steps = [*range(0, self.length - 7, 8), self.length - 8]
        return all((self._words[a + k] == self._words[b + k]).all() for k in steps) if self.length >= 8 else all((self.raw[a + k] == self.raw[b + k]).all() for k in range(self.length))

    def _sort(self) -> None:
        """Sort the members of every node by what follows the first `length` bytes, and measure common prefixes."""
        n = len(self.at)
        self.lcp = np.full(max(0, n - 1), -1, np.int64)
        self.room = self.off[self.of + 1] - self.at
        order, depth = np.arange(n), self.length
        first = np.concatenate([[True], self.node[1:] != self.node[:-1]]) if n else np.zeros(0, bool)
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        place = np.flatnonzero(~(first & np.append(first[1:], True)))  # of nodes with several members
        while len(place):
            member, own = order[place], group[place]
            has = np.minimum(self.room[member] - depth, _WORD)
            key = (self._words[np.minimum(self.at[member] + depth, len(self.raw) - 1)].astype(U64) & _MASK[has]) | has.astype(U64)
            by = np.lexsort((key, own))
            order[place], key = member[by], key[by]
            same = own[1:] == own[:-1]
            differ = same & (key[1:] != key[:-1])
            # common bytes of neighbours that differ here, or of those that both end here
            at = np.flatnonzero(differ)
            x = key[at] ^ key[at + 1]
            common = sum((x < U64(1 << 8 * k)).astype(np.int64) for k in range(_WORD, 0, -1))
            ends = np.minimum(key[at] & U64(255), key[at + 1] & U64(255)).astype(np.int64)
            self.lcp[place[at]] = depth + np.minimum(common, ends)
            at = np.flatnonzero(same & ~differ & ((key[1:] & U64(255)) < _WORD))
            self.lcp[place[at]] = depth + (key[at] & U64(255)).astype(np.int64)
            first = np.concatenate([[True], ~same | differ])
            group[place] = place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
            alone = first & np.append(first[1:], True)
            place = place[~alone & ((key & U64(255)) == _WORD)]
            depth += _WORD
        self.at, self.of, self.left, self.room = self.at[order], self.of[order], self.left[order], self.room[order]

    def _scan(self) -> None:
        """The left-diverse intervals."""
        found = np.array(stack_scan(self.lcp.tolist()), np.int64).reshape(-1, 3)
        copies = np.flatnonzero((self.weight[self.of] > 1) & (self.left > 255)) if len(self.at) else np.zeros(0, np.int64)
        changes = np.concatenate([[0], np.cumsum(self.left[1:] != self.left[:-1])])
        found = found[changes[found[:, 2]] > changes[found[:, 1]]]
        alone = np.column_stack([self.room[copies], copies, copies]) if len(copies) else found[:0]
        self.intervals = np.concatenate([found, alone])

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, from, to) of what each member's deepest interval covers."""
        deep = np.zeros(len(self.at), np.int64)
        for depth, i, j in self.intervals[np.argsort(self.intervals[:, 0], kind="stable")].tolist():
            deep[i : j + 1] = depth
        has = np.flatnonzero(deep)
        lo = self.at[has] - self.off[self.of[has]]
        return self.of[has], lo, lo + deep[has]

    def groups(self):
        """Maximal repeats: (length, members' pieces, members' places in them)."""
        for depth, i, j in self.intervals.tolist():
            yield depth, self.of[i : j + 1], self.at[i : j + 1] - self.off[self.of[i : j + 1]]


def maximal_repeats(texts: list[bytes], length: int = 400) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of `length` bytes or more in some texts: (bytes, all its places as text and position)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return sorted((n, sorted(zip(of.tolist(), at.tolist()))) for n, of, at in Tree(raw, sizes, np.ones(len(texts)), length).groups())


def merge_spans(piece: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by piece."""
    if not len(lo):
        return piece, lo, hi
    order = np.lexsort((lo, piece))
    piece, lo, hi = piece[order], lo[order], hi[order]
    shift = piece.astype(np.int64) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.concatenate([[True], lo[1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(lo)]]) - 1
    return piece[first], lo[first], reach[last] - shift[last]


class _Bucket:
    """The pieces of a bucket, from all tasks that sent some."""

    def __init__(self, blocks: list[dict]):
        unpack = zstandard.ZstdDecompressor().decompress
        self.blocks, base = [], 0
        for b in blocks:
            one = {c: np.frombuffer(b[c], _KINDS[c]).astype(np.int64) for c in PIECE if c != "text"}
            one |= {"text": unpack(b["text"]), "edge": np.concatenate([[0], np.cumsum(one["parts"])]), "byte": np.concatenate([[0], np.cumsum(one["size"])]), "place": np.concatenate([[0], np.cumsum(one["n"])])}
            one["doc"] += base
            base += len(one["k1"])
            self.blocks.append(one)
        self.k1, self.k2 = (np.concatenate([b[c] for b in self.blocks]) for c in ("k1", "k2"))

    def part(self, p: int):
        """The distinct pieces of a part, the number of places of each, and by place: its piece, document and position."""
        kinds: dict[bytes, int] = {}
        kind, n, doc, at = [], [], [], []
        for b in self.blocks:
            lo, hi = int(b["edge"][p]), int(b["edge"][p + 1])
            ends = b["byte"][lo : hi + 1].tolist()
            kind += [kinds.setdefault(b["text"][x:y], len(kinds)) for x, y in zip(ends, ends[1:])]
            n.append(b["n"][lo:hi])
            doc.append(b["doc"][b["place"][lo] : b["place"][hi]])
            at.append(b["at"][b["place"][lo] : b["place"][hi]])
        n, doc, at = (np.concatenate(x) for x in (n, doc, at))
        kind = np.array(kind, np.int64)
        return list(kinds), np.bincount(kind, weights=n, minlength=len(kinds)), np.repeat(kind, n), doc, at


def _tree(texts: list[bytes], weight: np.ndarray, length: int) -> Tree:
    return Tree(np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts)), weight, length)


def _repeats(length: int, buckets: int):
    """The covered spans of all documents."""

    def done(blocks):
        bucket, found = _Bucket(blocks), []
        for p in range(PARTS):
            texts, weight, of, doc, at = bucket.part(p)
            if not texts:
                continue
            piece, lo, hi = merge_spans(*_tree(texts, weight, length).covered())
            # every place of a piece gets the piece's spans
            edges = np.searchsorted(piece, np.arange(len(texts) + 1))
            times = np.diff(edges)[of]
            place, span = np.repeat(np.arange(len(of)), times), ranges(edges[of], times)
            found.append((bucket.k1[doc[place]], bucket.k2[doc[place]], at[place] + lo[span], at[place] + hi[span]))
        return pack_marks(*(np.concatenate(x) for x in zip(*found)), buckets)

    return _by_bucket(done)


def _groups(length: int):
    """All groups of the buckets' trees, a row a place."""

    def done(blocks):
        bucket = _Bucket(blocks)
        names, sizes, docs, starts = [], [], [], []
        for p in range(PARTS):
            texts, weight, of, doc, at = bucket.part(p)
            by = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[by], np.arange(len(texts) + 1))
            for n, (depth, pieces, shifts) in enumerate(_tree(texts, weight, length).groups() if texts else ()):
                times = edges[pieces + 1] - edges[pieces]
                place = by[ranges(edges[pieces], times)]
                names += [f"{blocks[0]['bucket']}.{p}.{n}"] * len(place)
                sizes.append(np.full(len(place), depth))
                docs.append(bucket.k1[doc[place]])
                starts.append(at[place] + np.repeat(shifts, times))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(cat, (sizes, docs, starts))], names=["group", "length", "doc_id", "start"])

    return _by_bucket(done)


def _by_bucket(done):
    def run(batches):
        now, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and blocks:
                    yield done(blocks)
                    blocks = []
                    release()
                now = row["bucket"]
                blocks.append(row)
        if blocks:
            yield done(blocks)

    return run


def _routed(documents: DataFrame, doc_id: str, text: str, length: int) -> tuple[DataFrame, int]:
    """The suspects' pieces, bucket by bucket, and the number of buckets."""
    if length <= COARSE:
        raise ValueError(f"a string has more than {COARSE} bytes")
    spark = documents.sparkSession
    texts = documents.select(F.col(text).alias("text"), *row_keys(documents, doc_id, text))
    sketch = substring.merge_sketch(texts.select("text").mapInArrow(_sketch(length), substring.SKETCH))
    buckets = max(shuffle_parts(spark), sketch.words // BUCKET_BYTES)
    schema = ", ".join(["bucket int", *(f"{c} binary" for c in PIECE)])
    sent = texts.mapInArrow(_pieces(spark.sparkContext.broadcast(sketch), length, buckets), schema)
    return sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket"), buckets


def repeated_spans(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> tuple[DataFrame, int]:
    """Marks (see exchange) of the repeated byte spans of every document, and the number of buckets."""
    routed, buckets = _routed(documents, doc_id, text, length)
    return routed.mapInArrow(_repeats(length, buckets), MARKS), buckets


def repeat_groups(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """(group, length, doc_id, start): the maximal repeats of every part of the suffix array with all their places, a row
    a place. A repeat that is longer than a part's pieces comes as several groups that overlap."""
    routed, _ = _routed(documents, doc_id, text, length)
    rows = routed.mapInArrow(_groups(length), "group string, length long, doc_id long, start long")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))


def _union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    _, a, b = merge_spans(np.zeros(len(lo), np.int64), lo, hi)
    return list(zip(a.tolist(), b.tolist()))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:a])
        last = b
    return b"".join([*out, text[last:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """`documents` without the repeated spans of their texts (whole characters only). Columns stay the same."""
    marks, buckets = repeated_spans(documents, doc_id=doc_id, text=text, length=length)

    def kernel(texts, found):
        return [[cut(t, whole_characters(t, _union(*m))) for t, m in zip(texts, found)]]

    return with_marks(documents, marks, buckets, kernel, [], doc_id=doc_id, text=text, replace_text=True)


def op5_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    """One row per document with what the 400-byte dedup takes from it."""
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select(as_long(docs, "doc_id").alias("doc_id"), "text")
    marks, buckets = repeated_spans(docs)

    def kernel(texts, found):
        spans = [_union(*m) for m in found]
        kept = [hashlib.sha256(cut(t, s)).hexdigest() for t, s in zip(texts, spans)]
        removed = [sum(b - a for a, b in s) for s in spans]
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.string())]

    out = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    return with_marks(docs, marks, buckets, kernel, out).drop("text")
