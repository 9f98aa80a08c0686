"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against the windows of every document.

Words are maximal runs of bytes outside `\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F` after A-Z are lower-cased. A window
is `n` consecutive words of a benchmark item; an item of fewer words (but not none) is one window. Documents are
scanned in whole, each once for every block of the benchmark; nothing is shuffled. A window found by hash is then
compared word by word.

The broadcast holds at most `block_words` benchmark words (default 2,000,000, some 100 MB in a Python worker). A
larger benchmark is cut into several such blocks: each is one more job over the documents, whose rows are kept in the
shared folder for the next, and what the jobs find is united on the rows of a document, so the result is the same.

Defined cases: a null or empty text has no words and is clean; an item with a null or empty text, or without words,
has no window; items with a null id take part under the id string "null"; repeated items count once by id; repeated
documents each get a row; an empty benchmark leaves every document clean; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import binary_parts, checkpoint, fresh, slices, with_schema

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BASE = 0x9E3779B97F4A7C15
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Index:
    """The windows of one block of benchmark items, by length."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.tables: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int32)
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.tables.setdefault(size, {}).setdefault(ids[i : i + size].tobytes(), set()).add(item)
        self.hashes = {size: np.unique(_hash(np.frombuffer(b"".join(t), np.int32).reshape(-1, size).T)) for size, t in self.tables.items()}

    def find(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(start, end, items) of the windows in a sequence of word numbers; 0 is a word that no item has."""
        found = []
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, table in self.tables.items():
            at = np.flatnonzero(gaps[size:] == gaps[:-size]) if len(ids) >= size else []
            if len(at):
                known, h = self.hashes[size], _hash([ids[at + j] for j in range(size)])
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for i in at[known[k] == h].tolist():
                    if items := table.get(ids[i : i + size].tobytes()):
                        found.append((i, i + size, items))
        return found


def _hash(columns) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c.astype(np.uint64)) * np.uint64(BASE)
        h ^= h >> np.uint64(29)
    return h


def _scan(text_at: int, index, has_before: bool, name: str):
    def run(batches):
        idx = index.value
        get = idx.vocab.get
        for batch in batches:
            raw, off = binary_parts(batch.column(text_at))
            before = batch.column(batch.num_columns - 1).to_pylist() if has_before else repeat(None)
            rows = []
            for i, j in slices(off):
                flat, sizes = [], []
                for k in range(i, j):
                    words = words_of(raw[off[k] : off[k + 1]].tobytes())
                    sizes.append(len(words))
                    flat += words
                    flat.append(b"")
                first = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
                ids = np.array(list(map(get, flat, repeat(0))), np.int32)
                hits: dict[int, list] = {}
                for a, b, items in idx.find(ids):
                    d = int(np.searchsorted(first, a, side="right")) - 1
                    hits.setdefault(d, []).append((a - int(first[d]), b - int(first[d]), items))
                for d, size in enumerate(sizes):
                    rows.append((size, hits.get(d, ())))
            out = []
            for (size, hits), old in zip(rows, before):
                spans, items = [(a, b) for a, b, _ in hits], {x for h in hits for x in h[2]}
                if old is not None:
                    spans += zip(old["starts"], old["ends"])
                    items |= set(old["items"])
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out.append({"n_words": size, "starts": [a for a, _ in merged], "ends": [b for _, b in merged], "items": sorted(items)})
            kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            columns = batch.columns[: batch.num_columns - has_before]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[*batch.schema.names[: len(columns)], name])

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text).cast("binary")).toLocalIterator():
        raw = bytes(row[1] or b"")
        n = len(words_of(raw))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], raw))
        size += n
    yield block


def find_windows(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, block_words: int = 2_000_000) -> tuple[DataFrame, str]:
    """Every row and column of `documents` with a struct column more, and its name.

    The struct has n_words, starts and ends (maximal runs of hit words, end exclusive) and items (sorted ids).
    """
    spark, name, out = documents.sparkSession, fresh(documents, "found"), documents
    at = documents.columns.index(text)
    schema = with_schema(documents, **{name: FOUND})
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block, k = next(blocks), 0
    while block is not None:
        out = out.mapInArrow(_scan(at, shared := spark.sparkContext.broadcast(Index(block, n)), k > 0, name), schema)
        block, k = next(blocks, None), k + 1
        if block is not None:  # a job for each block, so that one block is in the workers at a time
            out = checkpoint(out)
            shared.destroy()
    return out, name


def decontamination_report(documents: DataFrame, benchmark: DataFrame, *, threshold: int = 20, **options) -> tuple[DataFrame, str]:
    """`find_windows` with n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and threshold * n_hit >= n_words)."""
    found, name = find_windows(documents, benchmark, **options)
    f = F.col(name)
    hit = F.aggregate(F.zip_with(f["starts"], f["ends"], lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    report = F.struct(
        f["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        ((hit > 0) & (threshold * hit >= f["n_words"])).alias("contaminated"),
        f["starts"].alias("starts"),
        f["ends"].alias("ends"),
        f["items"].alias("items"),
    )
    return found.withColumn(name, report), name


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the given runs and what lies between the words of a run."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(WORD, raw.translate(FOLD))]
    out, last = [], 0
    for a, b in zip(starts, ends):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """`documents` without the contaminated ones (remove="documents"), or with the hit spans of contaminated
    documents cut out of their texts (remove="spans"). Clean rows stay as they are; columns stay the same."""
    report, name = decontamination_report(documents, benchmark, text=text, **options)
    if remove == "documents":
        return report.filter(~F.col(name)["contaminated"]).drop(name)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")

    @F.pandas_udf("string")
    def cut(texts, starts, ends):
        return pd.Series([None if t is None else cut_words(t, list(a), list(b)) for t, a, b in zip(texts, starts, ends)], dtype=object)

    f = F.col(name)
    where = F.when(f["contaminated"], cut(F.col(text), f["starts"], f["ends"])).otherwise(F.col(text))
    return report.withColumn(text, where).drop(name)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document with its hit words and items."""
    from vectrail.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    report, name = decontamination_report(docs, read_table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", *(F.col(name)[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))
