"""Substring dedup with a count-min prefilter.

A window is `width` (20) consecutive words of one document; a word goes if a window with the same words starts earlier
(smaller doc_id, or earlier in the same document). Two passes:

1. Each window is counted under its minimiser, the least-hashed run of `GRAM` words in it. Every task counts the
   minimiser positions it meets into a sketch of two rows of `CELLS` counters (0, 1, "2 or more"), written sparsely and
   summed by slice of the cells: the merged sketch is two bits maps of which cells are repeated (2 x 16 MB whatever the
   input), which never says "once" of a window that occurs twice: equal windows have equal minimisers at different
   positions.
2. Only windows that the sketch calls repeated are sent on, as packed 96-bit hashes by bucket, each task's own repeats
   folded first, so a very frequent window sends one entry a batch. The bucket's task finds the first occurrence of
   each and sends back the starts of the others to their documents.

When an input outgrows the sketch more windows pass it and are grouped exactly; the result is the same. Hash equality
of 96 bits stands for equality of windows.

Defined cases: null, empty and short texts (under `width` words) lose nothing; null doc_ids come first; rows of one
doc_id are told apart by a hash of their texts, in whose order they stand; repeated rows (same id and text) are one
document that is listed as often as it occurs.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import U64, Rolling, as_long, binary_parts, mix, read_table, row_keys, shuffle_parts, sliding_min, slices
from vectrail.llm.exchange import MARKS, pack_marks, with_marks

GRAM = 12
CELLS = 1 << 27
ROWS = 2
SLICES = 128
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_byte, _one, _two = Rolling(7), Rolling(8), Rolling(9)


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a slice of documents, and each document's first word (and the number of all)."""
    gap = SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate([[True], gap[:-1]]) | edge[:-1]
    after = np.concatenate([gap[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def _windows(raw: np.ndarray, off: np.ndarray, width: int):
    """(window starts as word numbers, their minimisers' hashes, their minimisers' positions, word hashes, first words)."""
    starts, ends, first = word_bounds(raw, off)
    words = _byte.ranges(_byte.of_bytes(raw), starts, ends)
    n = len(words) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(U64), none, words, first
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= last)
    grams = _one.windows(_one.of_values(words), GRAM)
    low = U64((1 << 24) - 1)
    keyed = (grams & ~low) | (np.arange(len(grams), dtype=U64) & low)
    least = sliding_min(keyed, width - GRAM + 1)[at]
    return at, least >> U64(24), (least & low).astype(np.int64), words, first


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (mix(h ^ U64(0x5851F42D4C957F2D * (row + 1) & 0xFFFFFFFFFFFFFFFF)) & U64(CELLS - 1)).astype(np.int64)


SKETCH = "slice int, what long, cells binary"


def sketch_rows(held: list[np.ndarray], seen: int = 0) -> pa.RecordBatch:
    """A sparse sketch of some hashes, by slice of the cells; slice -1 counts what was read."""
    h = np.concatenate(held) if held else np.zeros(0, U64)
    rows = [(-1, seen, b"")]
    for row in range(ROWS):
        cells, times = np.unique(_cells(h, row), return_counts=True)
        for what, kept in ((1, cells[times == 1]), (2, cells[times > 1])):
            part = kept // (CELLS // SLICES)
            edges = np.searchsorted(part, np.arange(SLICES + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                rows.append((row * SLICES + s, what, (kept[edges[s] : edges[s + 1]] % (CELLS // SLICES)).astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["slice", "what", "cells"])


def _sketch(width: int):
    def run(batches):
        held, size, seen = [], 0, 0
        for batch in batches:
            raw, off = binary_parts(batch.column(0))
            for i, j in slices(off):
                lo, hi = off[i], off[j]
                at, h, pos, words, _ = _windows(raw[lo:hi], off[i : j + 1] - lo, width)
                seen += len(words)
                if not len(at):
                    continue
                if len(words) >= 1 << 24:  # positions no longer fit beside the hash: every minimiser counts as repeated
                    held.append(np.repeat(np.unique(h), 2))
                else:
                    held.append(h[np.unique(pos, return_index=True)[1]])
                size += len(held[-1])
                if size > 1 << 22:
                    yield sketch_rows(held)
                    held, size = [], 0
        yield sketch_rows(held, seen)

    return run


def _merge(batches):
    now, count = None, None

    def done():
        bits = np.packbits(count > 1)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([int(bits.any())], pa.int64()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["slice", "what", "cells"])

    total = 0
    for batch in batches:
        for s, what, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if s < 0:
                total += what
                continue
            if s != now:
                if now is not None:
                    yield done()
                now, count = s, np.zeros(CELLS // SLICES, np.uint8)
            cells = np.frombuffer(blob.as_py(), np.uint32)
            count[cells] = np.minimum(count[cells] + what, 2)
    if now is not None:
        yield done()
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total], pa.int64()), pa.array([b""], pa.binary())], names=["slice", "what", "cells"])


class Sketch:
    """The merged sketch: which cells of each row are repeated. Of fixed size."""

    def __init__(self, rows: list):
        self.bits = np.zeros((ROWS, CELLS // 8), np.uint8)
        flat = self.bits.reshape(ROWS * SLICES, -1)
        self.words = 0
        for r in rows:
            if r["slice"] < 0:
                self.words += r["what"]
            else:
                flat[r["slice"]] = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)

    def repeated(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in range(ROWS):
            c = _cells(h, row)
            out &= (self.bits[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return out


def merge_sketch(parts: DataFrame) -> Sketch:
    merged = parts.repartition(shuffle_parts(parts.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(_merge, SKETCH)
    return Sketch(merged.collect())


def build_sketch(documents: DataFrame, *, text: str = "text", width: int = 20) -> Sketch:
    return merge_sketch(documents.select(F.col(text).alias("text")).mapInArrow(_sketch(width), SKETCH))


COLUMNS = ("k1", "k2", "h1", "h2", "doc", "start", "more_doc", "more_start")


def _candidates(shared, width: int, buckets: int):
    def run(batches):
        sketch = shared.value
        for batch in batches:
            raw, off = binary_parts(batch.column(0))
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            found = []
            for i, j in slices(off):
                lo, hi = off[i], off[j]
                at, h, _, words, first = _windows(raw[lo:hi], off[i : j + 1] - lo, width)
                if not len(at):
                    continue
                at = at[sketch.repeated(h)]
                a, b = (r.windows(r.of_values(words), width)[at] for r in (_one, _two))
                doc = np.searchsorted(first, at, side="right") - 1
                found.append((a, (b >> U64(32)).astype(np.uint32), (doc + i).astype(np.int64), (at - first[doc]).astype(np.int64)))
            if not found:
                continue
            h1, h2, doc, start = (np.concatenate(x) for x in zip(*found))
            place = np.empty(len(k1), np.int64)
            place[np.lexsort((k2, k1))] = np.arange(len(k1))
            # of one batch's equal windows only the first is sent with its hash; the others are known to go
            order = np.lexsort((start, place[doc], h2, h1))
            h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
            fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, bool)
            same = ~fresh
            if len(same):  # a repeated row is the same document: its windows are no later occurrences
                head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                same &= (k1[doc] != k1[doc[head]]) | (k2[doc] != k2[doc[head]]) | (start != start[head])
            to = (h1 % U64(buckets)).astype(np.int64)
            rows = {c: [] for c in COLUMNS}
            where = []
            for bucket, send, more in _by_bucket(to, fresh, same, buckets):
                send, more = send[np.lexsort((start[send], doc[send]))], more[np.lexsort((start[more], doc[more]))]
                used, back = np.unique(np.concatenate([doc[send], doc[more]]), return_inverse=True)
                where.append(bucket)
                for name, part in (("k1", k1[used]), ("k2", k2[used]), ("h1", h1[send]), ("h2", h2[send]), ("doc", back[: len(send)].astype(np.uint32)), ("start", start[send].astype(np.uint32)), ("more_doc", back[len(send) :].astype(np.uint32)), ("more_start", start[more].astype(np.uint32))):
                    rows[name].append(part.tobytes())
            if where:
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *(pa.array(rows[c], pa.binary()) for c in COLUMNS)], names=["bucket", *COLUMNS])

    return run


def _by_bucket(to, fresh, same, buckets):
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[bucket] : edges[bucket + 1]]
        yield bucket, own[fresh[own]], own[same[own]]


def _later(buckets: int):
    """Of each bucket's windows, the occurrences that are not the first."""

    def done(blocks):
        kinds = dict(zip(COLUMNS, (np.int64, np.int64, U64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)))
        parts, base = [{c: np.frombuffer(b[c], kinds[c]) for c in COLUMNS} for b in blocks], 0
        docs, more = [], []
        for p in parts:
            docs.append(p["doc"].astype(np.int64) + base)
            more.append(p["more_doc"].astype(np.int64) + base)
            base += len(p["k1"])
        k1, k2, h1, h2, start, more_start = (np.concatenate([p[c] for p in parts]) for c in ("k1", "k2", "h1", "h2", "start", "more_start"))
        doc, more = np.concatenate(docs), np.concatenate(more)
        by = np.lexsort((k2, k1))
        place = np.empty(len(k1), np.int64)
        new = np.concatenate([[True], (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])])
        place[by] = np.cumsum(new) - 1
        at = (place[doc].astype(U64) << U64(32)) | start.astype(U64)
        order = np.argsort(h1)
        s1, s2 = h1[order], h2[order]
        first = np.concatenate([[True], s1[1:] != s1[:-1]])
        if ((s2[1:] != s2[:-1]) & ~first[1:]).any():
            order = np.lexsort((h2, h1))
            s1, s2 = h1[order], h2[order]
            first = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        edges = np.flatnonzero(first)
        least = np.minimum.reduceat(at[order], edges)
        gone = order[at[order] != np.repeat(least, np.diff(np.concatenate([edges, [len(order)]])))]
        d, s = np.concatenate([doc[gone], more]), np.concatenate([start[gone], more_start])
        return pack_marks(k1[d], k2[d], s, np.zeros(len(s), np.uint32), buckets)

    def run(batches):
        now, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and blocks:
                    yield done(blocks)
                    blocks = []
                now = row["bucket"]
                blocks.append(row)
        if blocks:
            yield done(blocks)

    return run


def later_windows(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 20) -> tuple[DataFrame, int]:
    """Marks (see exchange) of all window starts whose words also start earlier, and the number of buckets."""
    if width <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    sketch = build_sketch(documents, text=text, width=width)
    spark = documents.sparkSession
    buckets = max(shuffle_parts(spark), sketch.words // 2_000_000)
    rows = documents.select(F.col(text).alias("text"), *row_keys(documents, doc_id, text))
    schema = ", ".join(["bucket int", *(f"{c} binary" for c in COLUMNS)])
    sent = rows.mapInArrow(_candidates(spark.sparkContext.broadcast(sketch), width, buckets), schema)
    return sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_later(buckets), MARKS), buckets


def gone_words(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    step[starts] += 1
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


def _kept(texts: list[bytes], marks, width: int):
    for text, (starts, _) in zip(texts, marks):
        words = text.split()
        gone = gone_words(len(words), starts, width) if len(starts) else None
        yield len(words), 0 if gone is None else int(gone.sum()), words if gone is None else [w for w, x in zip(words, gone.tolist()) if not x]


def remove_repeated_windows(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """`documents` with the kept words of each text, joined by one space. Columns stay the same."""
    marks, buckets = later_windows(documents, doc_id=doc_id, text=text, width=width)
    kernel = lambda texts, found: [[b" ".join(k) for _, _, k in _kept(texts, found, width)]]
    return with_marks(documents, marks, buckets, kernel, [], doc_id=doc_id, text=text, replace_text=True)


def op7_countmin_substrings(spark, sf_dir: str) -> DataFrame:
    """One row per document with what the window dedup takes from it."""
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select(as_long(docs, "doc_id").alias("doc_id"), "text")
    marks, buckets = later_windows(docs)

    def kernel(texts, found):
        got = [(n, r, hashlib.sha256(b" ".join(k)).hexdigest()) for n, r, k in _kept(texts, found, 20)]
        return [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())]

    out = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return with_marks(docs, marks, buckets, kernel, out).drop("text")
