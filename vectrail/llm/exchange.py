"""Bringing marks (positions found elsewhere) and the rows of documents together in one shuffle.

Marks are sent as packed arrays, not as rows: a task sorts what it has found by document and writes one block for each
bucket. Documents go to the bucket of their text key, marks first, so that a task holds the marks of one bucket and
streams its documents past them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import row_keys

MARKS = "bucket int, k1 binary, k2 binary, n binary, a binary, b binary"
PARTS = ("k1", "k2", "n", "a", "b")


def bucket_of(k2: np.ndarray, buckets: int) -> np.ndarray:
    return (k2.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets


def pack_marks(k1: np.ndarray, k2: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks of (document key, a, b) by bucket. The whole k2 travels: rows without an id share their k1."""
    to = bucket_of(k2, buckets)
    order = np.lexsort((a, k2, k1, to))
    to, k1, k2, a, b = to[order], k1[order], k2[order], a[order], b[order]
    new = np.concatenate([[True], (to[1:] != to[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(to) else np.zeros(0, bool)
    docs = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([docs, [len(to)]])).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], to[docs][1:] != to[docs][:-1]])) if len(docs) else np.zeros(0, np.int64)
    rows: dict[str, list] = {x: [] for x in PARTS}
    for i, j in zip(first, np.concatenate([first[1:], [len(docs)]]).astype(int)):
        lo, hi = docs[i], docs[j] if j < len(docs) else len(to)
        for name, part in (("k1", k1[docs[i:j]]), ("k2", k2[docs[i:j]]), ("n", sizes[i:j]), ("a", a[lo:hi].astype(np.uint32)), ("b", b[lo:hi].astype(np.uint32))):
            rows[name].append(part.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(to[docs[first]].astype(np.int32)), *(pa.array(rows[x], pa.binary()) for x in PARTS)], names=["bucket", *PARTS])


class Marks:
    """The marks of one bucket, by document."""

    def __init__(self, blocks: list[tuple]):
        kinds = (np.int64, np.int64, np.uint32, np.uint32, np.uint32)
        k1, k2, n, a, b = (np.concatenate([np.frombuffer(x[i], kind) for x in blocks] or [np.zeros(0, kind)]) for i, kind in enumerate(kinds))
        k1, k2 = np.repeat(k1, n), np.repeat(k2, n)
        order = np.lexsort((a, k2, k1))
        k1, k2, self.a, self.b = k1[order], k2[order], a[order].astype(np.int64), b[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(k1) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(k1)]]).astype(np.int64)
        self.at = dict(zip(zip(k1[first].tolist(), k2[first].tolist()), zip(first.tolist(), last.tolist())))

    def of(self, k1: int, k2: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = self.at.get((k1, k2), (0, 0))
        return self.a[i:j], self.b[i:j]


def with_marks(documents: DataFrame, marks: DataFrame, buckets: int, kernel: Callable[[list[bytes], list[tuple[np.ndarray, np.ndarray]]], list[pa.Array]], out: list[T.StructField], *, doc_id: str = "doc_id", text: str = "text", replace_text: bool = False) -> DataFrame:
    """Every row of `documents` with the columns of `out` more, which `kernel(texts, marks)` makes; with replace_text
    its first array takes the place of the text instead."""
    k1, k2 = row_keys(documents, doc_id, text)
    rows = documents.select(F.struct(*(F.col(c) for c in documents.columns)).alias("doc"), k1, k2)
    rows = rows.select(F.pmod(F.col("k2").bitwiseAND(0xFFFFFFFF), F.lit(buckets)).cast("int").alias("bucket"), F.struct("k1", "k2", "doc").alias("row"))
    blocks = marks.select("bucket", F.struct(*PARTS).alias("marks"))
    both = blocks.unionByName(rows, allowMissingColumns=True).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", F.col("row").isNotNull())
    at = documents.columns.index(text)
    names, kind = [f"c{i}" for i in range(len(documents.columns))], documents.schema.fields[at].dataType

    def run(batches: Iterable[pa.RecordBatch]):
        now, blocks, held = None, [], None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for i, j in zip(edges, [*edges[1:], len(bucket)]):
                if bucket[i] != now:
                    now, blocks, held = bucket[i], [], None
                part = batch.slice(i, j - i)
                is_row = np.asarray(part.column(2).is_valid().to_numpy(zero_copy_only=False))
                n = int((~is_row).sum())
                for x in part.column(1).slice(0, n).to_pylist():
                    blocks.append(tuple(x[p] for p in PARTS))
                if n == len(part):
                    continue
                if held is None:
                    held, blocks = Marks(blocks), []
                row = pa.concat_arrays([part.column(2).slice(n)])
                keys1, keys2, doc = row.field(0).to_pylist(), row.field(1).to_pylist(), row.field(2)
                columns = [doc.field(c) for c in range(doc.type.num_fields)]
                raw = columns[at].cast(pa.binary()).to_pylist()
                made = kernel([x or b"" for x in raw], [held.of(x, y) for x, y in zip(keys1, keys2)])
                if replace_text:
                    old = columns[at]
                    keep = [new if before is not None else None for new, before in zip(made[0], raw)]
                    columns[at] = pa.array(keep, pa.binary()).cast(old.type)
                    made = made[1:]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, *(f.name for f in out)])

    del kind
    return both.mapInArrow(run, T.StructType([*documents.schema.fields, *out]))
