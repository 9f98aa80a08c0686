"""fvecs and ivecs files: rows of a little-endian int32 length and that many 4-byte values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.types import InvalidFormat


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs", limit: int | None = None) -> DataFrame:
    """(pos, vector) of fixed-length records, in file order; pos starts at 0. Files are split by records.

    A file whose size is no multiple of its first record's is rejected."""
    dtype = {"fvecs": "<f4", "ivecs": "<i4"}[kind]
    files = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
    if not files:
        raise InvalidFormat("no files")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts, before = None, 0
    for f in files:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f["path"])
        stream = target.getFileSystem(conf).open(target)
        try:
            dim = int.from_bytes(bytes((stream.read() & 0xFF) for _ in range(4)), "little", signed=True) if f["length"] >= 4 else 0
        finally:
            stream.close()
        size = 4 + 4 * dim
        if dim < 1 or f["length"] % size:
            raise InvalidFormat(f"{f['path']} has no whole records of {dim} values")
        rows = spark.sparkContext.binaryRecords(f["path"], size).zipWithIndex().map(lambda r: (r[1], bytes(r[0])))
        df = spark.createDataFrame(rows, "pos long, raw binary").withColumn("pos", F.col("pos") + before)
        before += f["length"] // size
        parts = df if parts is None else parts.unionByName(df)
    if limit is not None:
        parts = parts.filter(F.col("pos") < limit)

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                if int.from_bytes(raw[:4], "little", signed=True) * 4 + 4 != len(raw):
                    raise InvalidFormat("records differ in length")
                rows.append(np.frombuffer(raw, dtype, offset=4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32() if kind == "fvecs" else pa.int32()))], names=["pos", "vector"])

    return parts.mapInArrow(run, f"pos long, vector array<{'float' if kind == 'fvecs' else 'int'}>")


def to_vectors(rows: DataFrame) -> DataFrame:
    """Records as a collection's vectors: ids from 1."""
    return rows.select((F.col("pos") + 1).alias("vector_id"), "vector", F.lit(None).cast("map<string,struct<t:tinyint,b:boolean,i:bigint,f:double,s:string>>").alias("metadata"))


def write_vecs(path: str, rows: list, kind: str = "fvecs") -> None:
    """A small local file, for fixtures; collections are saved as Parquet."""
    with open(path, "wb") as f:
        for r in rows:
            f.write(np.int32(len(r)).tobytes() + np.asarray(r, "<f4" if kind == "fvecs" else "<i4").tobytes())
