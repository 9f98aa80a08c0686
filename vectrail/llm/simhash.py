"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link at `radius` (4) or fewer differing bits. Every fingerprint stands for all its
variants within half the radius; two fingerprints within the radius share a variant at least, and two that share one
are within the radius by the triangle inequality (checked again with the bits). A variant group of m fingerprints
gives m - 1 edges to its least one, never all pairs: that keeps every component whole.

The variants are dealt by their leading bits. What is sent is the fingerprint, once to each bucket that holds one of
its variants (1 + B + B(B-1)/2 of 2**B buckets); the bucket's task makes the variants, splitting the bucket further by
the next bits while it has more than `VARIANTS` of them, so its memory is bounded whatever the data. B follows from
the number of distinct fingerprints: copies are folded into one fingerprint before anything is dealt.

Defined cases: a text without words (or null) has fingerprint zero, which links like any other; fewer words than a
shingle make one shingle of them all; a null doc_id has a fingerprint and a component but is no component's id (the id
is null where a component has no other); repeated rows each get a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import as_long, binary_parts, checkpoint, read_table, release, row_keys, shuffle_parts, spread_join
from vectrail.llm.components import connected_components

VARIANTS = 1 << 20
UP = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    words = text.translate(UP).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    size = min(size, len(words))
    first = (ends - lens + 1)[: len(words) - size + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(first, ends[size - 1 :].tolist())], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little")
    pad = -len(hashes) % 255
    rows = np.concatenate([bits, np.zeros(pad * 64, np.uint8)]) if pad else bits
    counts = rows.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int, seed: int):
    def run(batches):
        for batch in batches:
            raw, off = binary_parts(batch.column(0))
            got = np.array([fingerprint(raw[a:b].tobytes(), size, seed) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got.view(np.int64))], names=["k1", "k2", "doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """(k1, k2, doc_id, fp): one row per document; fp holds the 64 bits as a signed long, k1 and k2 identify the row."""
    return documents.select(F.col(text).alias("text"), *row_keys(documents, doc_id, text), as_long(documents, doc_id).alias("doc_id")).mapInArrow(
        _fingerprints(size, seed), "k1 long, k2 long, doc_id long, fp long"
    )


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of at most `most` (0 to 2) of the low `bits` bits."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    masks = [np.zeros(1, np.uint64)]
    if most > 0:
        masks.append(one)
    if most > 1:
        a, b = np.triu_indices(bits, 1)
        masks.append(one[a] | one[b])
    return np.concatenate(masks)


def _sends(lead: int, half: int):
    """Each fingerprint to all buckets of its variants: blobs of fingerprints by bucket."""
    masks = _flips(lead, half)

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            top = fps >> np.uint64(64 - lead) if lead else np.zeros(len(fps), np.uint64)
            to, what = (top[:, None] ^ masks[None, :]).ravel(), np.repeat(fps, len(masks))
            order = np.argsort(to, kind="stable")
            to, what = to[order], what[order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            blobs = [x.tobytes() for x in np.split(what, first[1:])] if len(to) else []
            yield pa.RecordBatch.from_arrays([pa.array(to[first].view(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "fps"])

    return run


def star_edges(fps: np.ndarray, prefix: int, lead: int, half: int, limit: int = VARIANTS) -> np.ndarray:
    """(n, 2) edges of the sorted distinct `fps` that share a variant whose first `lead` bits are `prefix`."""
    top = fps >> np.uint64(64 - lead) if lead else np.zeros(len(fps), np.uint64)
    away = np.bitwise_count(top ^ np.uint64(prefix)).astype(np.int64)
    fps, away = fps[away <= half], away[away <= half]
    low = 64 - lead
    per = np.array([sum(math.comb(low, j) for j in range(half - a + 1)) for a in range(half + 1)])
    if len(fps) < 2:
        return np.zeros((0, 2), np.uint64)
    if per[away].sum() > limit and lead < 64:
        return np.unique(np.concatenate([star_edges(fps, 2 * prefix + bit, lead + 1, half, limit) for bit in (0, 1)]), axis=0)
    keep = np.uint64((1 << low) - 1) if low < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    parts, source = [], []
    for a in range(half + 1):
        own = np.flatnonzero(away == a)
        masks = _flips(low, half - a)
        parts.append(((fps[own] & keep)[:, None] ^ masks[None, :]).ravel())
        source.append(np.repeat(own, len(masks)))
    variants, source = np.concatenate(parts), np.concatenate(source)
    order = np.argsort(variants)
    variants, source = variants[order], source[order]
    first = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(variants)]]))
    many = sizes > 1
    if not many.any():
        return np.zeros((0, 2), np.uint64)
    least = np.repeat(np.minimum.reduceat(source, first)[many], sizes[many])
    member = source[np.repeat(many, sizes)]
    pairs = np.unique(least[least != member] * np.int64(len(fps)) + member[least != member])
    a, b = fps[pairs // len(fps)], fps[pairs % len(fps)]
    near = np.bitwise_count(a ^ b) <= 2 * half
    return np.stack([a[near], b[near]], axis=1)


def _links(lead: int, half: int):
    def run(batches):
        def done(bucket, blobs):
            fps = np.unique(np.frombuffer(b"".join(blobs), np.uint64))
            pairs = star_edges(fps, bucket, lead, half).view(np.int64)
            release()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        bucket, blobs = None, []
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != bucket:
                    if blobs:
                        yield done(bucket, blobs)
                    bucket, blobs = at, []
                blobs.append(blob.as_py())
        if blobs:
            yield done(bucket, blobs)

    return run


def link_fingerprints(distinct: DataFrame, *, radius: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): enough of those within `radius` (0 to 5) to keep every
    component whole."""
    half = -(-radius // 2)
    if radius % 2 or half > 2:
        raise ValueError("radius is 0, 2 or 4")
    total = distinct.count()
    lead = max(0, min(40, math.ceil(math.log2(max(1, total * 2081 / VARIANTS)))))
    parts = shuffle_parts(distinct.sparkSession)
    sent = distinct.select("fp").mapInArrow(_sends(lead, half), "bucket long, fps binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(_links(lead, half), "a long, b long").distinct()


def _components(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, int]:
    """From fingerprinted rows: the distinct fingerprints (fp, root, copies), their components (root, component_id, first,
    members), first being the row that stands for one, and the number of fingerprints."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("k1"), F.col("k2")))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), first.alias("first"), F.count("*").alias("copies")))
    roots = connected_components(link_fingerprints(distinct, radius=radius))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", "first", "copies", F.coalesce("root", "fp").alias("root"))
    best = known.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("first"), F.count("*").alias("members"))
    return known.select("fp", "root", "copies"), best, distinct.count()


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(k1, k2, doc_id, fp, component_id, keep_k1, keep_k2) for every document; component_id is the smallest doc_id of
    its component, keep_* the keys of the row that stands for it (smallest doc_id, then smallest text key). The members
    of a giant component and the copies of one text are dealt over many tasks."""
    rows = checkpoint(fingerprints(documents, doc_id=doc_id, text=text, size=size, seed=seed))
    known, best, total = _components(rows, radius)
    classes = spread_join(known, best, "root", "members", total).select("fp", "copies", "component_id", F.col("first.k1").alias("keep_k1"), F.col("first.k2").alias("keep_k2"))
    return spread_join(rows, classes, "fp", "copies", rows.count())


def deduplicate(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """`documents` with one row of each component: its smallest doc_id. Columns stay the same."""
    rows = checkpoint(fingerprints(documents, doc_id=doc_id, text=text, size=size, seed=seed))
    _, best, _ = _components(rows, radius)
    keep = best.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2"))
    k1, k2 = row_keys(documents, doc_id, text)
    keyed = documents.withColumns({"__k1": k1, "__k2": k2})
    return keyed.join(keep, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")


def op6_simhash_balls(spark, sf_dir: str) -> DataFrame:
    """One row per document with its fingerprint and component."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
