"""Shared pieces of the corpus operators: table access, shared storage, Arrow buffers and rolling hashes.

Everything here is bounded by one slice of one Arrow batch; nothing depends on the size of a table.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.sources.paths import shared_dir

U64 = np.uint64
SLICE_BYTES = 1 << 20
BLOCK = 1 << 15


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def shared_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_table(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, members: str, total: int) -> DataFrame:
    """Inner join of `rows` with `lookup`, in which each `key` stands once with the number of its rows (`members`, left
    out of the result). A key with more than an even share of the `total` rows (so there are fewer of them than shuffle
    partitions, and they can be broadcast) is dealt over four salts for each of its shares."""
    share = max(1, total // shuffle_parts(rows.sparkSession))
    salts = F.ceil(4 * F.col(members) / F.lit(share)).cast("int")
    heavy = lookup.filter(F.col(members) > share).select(key, salts.alias("__salts"))
    others = [c for c in rows.columns if c != key]
    left = rows.join(F.broadcast(heavy), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*others), F.coalesce("__salts", F.lit(1))).cast("int"))
    copies = F.when(F.col(members) > share, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("__salt", F.explode(copies)).drop(members)
    return left.drop("__salts").join(right, [key, "__salt"]).drop("__salt")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a variant that no column of `df` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_long(df: DataFrame, name: str):
    return F.col(name).cast("long")


def with_schema(df: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in fields.items())])


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and their executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; a null counts as empty. Each kernel calls it for each
    batch, when the batch before is done with."""
    release()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_binary():
        col = col.cast(pa.binary()).cast(pa.large_binary()) if col.type == pa.string() else col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out; every bit depends on every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Rolling:
    """Polynomial hashes (modulo 2**64, odd base) of all ranges of a sequence from one pass of prefix sums. The powers of
    the base are kept for one block; those of later blocks are these times one number a block."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        self.back = pow(self.base, -1, 1 << 64)
        self.up, self.down = self._powers(self.base, BLOCK), self._powers(self.back, BLOCK)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, U64)
        out[:1] = 1
        return np.cumprod(out)

    def _prefix(self, values: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(values) + 1, U64)
        for a in range(0, len(values), BLOCK):
            part = values[a : a + BLOCK]
            part = part if table is None else table[part]
            out[a + 1 : a + 1 + len(part)] = part * self.up[: len(part)] * U64(pow(self.base, a, 1 << 64))
        return np.cumsum(out, out=out)

    def of_values(self, values: np.ndarray) -> np.ndarray:
        return self._prefix(values, None)

    def of_bytes(self, raw: np.ndarray) -> np.ndarray:
        return self._prefix(raw, self.table)

    def ranges(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        far = self._powers(pow(self.back, BLOCK, 1 << 64), len(prefix) // BLOCK + 1)
        return mix((prefix[hi] - prefix[lo]) * self.down[lo % BLOCK] * far[lo // BLOCK])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all ranges of `width` values, by start."""
        n = max(0, len(prefix) - width)
        out = np.empty(n, U64)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            out[a:b] = mix((prefix[a + width : b + width] - prefix[a:b]) * self.down[: b - a] * U64(pow(self.back, a, 1 << 64)))
        return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by start."""
    m = len(h) - width + 1
    if m <= 0:
        return h[:0]
    rows = -(-len(h) // width)
    p = np.full(rows * width, U64(0xFFFFFFFFFFFFFFFF))
    p[: len(h)] = h
    p = p.reshape(rows, width)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def row_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple:
    """Two longs that tell rows of different id or text apart; equal rows share them."""
    return (
        F.coalesce(as_long(df, doc_id), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(as_long(df, doc_id), F.col(text)).alias("k2"),
    )
