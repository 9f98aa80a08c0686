"""8-bit scalar quantisation: calibration, codes, exhaustive search over codes, snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.functions.validate import check_search, check_vector
from vectrail.operators.kernels import TopK, matrix
from vectrail.operators.search import PARTIAL, query_blocks
from vectrail.types import EmptyIndex, InvalidFormat, InvalidInput, Metric

FLOAT_MAX = float(np.finfo(np.float32).max)


def train(vectors: DataFrame) -> DataFrame:
    """(dim, mn, scale): least component and (max - min) / 255 by dimension. A task sends one row a dimension."""

    def run(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), np.float32)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    parts = vectors.select("vector").mapInArrow(run, "dim int, low float, high float")
    out = parts.groupBy("dim").agg(F.min("low").alias("mn"), F.max("high").alias("mx"))
    return out.select("dim", "mn", ((F.col("mx").cast("double") - F.col("mn").cast("double")) / 255.0).alias("scale"))


def _literals(calibration: list) -> tuple[Column, Column]:
    rows = sorted(calibration, key=lambda r: r["dim"])
    return F.array(*(F.lit(r["mn"]).cast("float") for r in rows)), F.array(*(F.lit(r["scale"]).cast("double") for r in rows))


def encode_column(vector: Column, calibration: list) -> Column:
    """Codes 0 to 255: round half away from zero, clamped; 0 where a dimension is constant."""
    mins, scales = _literals(calibration)
    code = lambda x, m, s: F.when(s > 0, F.least(F.greatest(F.round((x.cast("double") - m.cast("double")) / s), F.lit(0.0)), F.lit(255.0))).otherwise(F.lit(0.0))
    return F.transform(F.arrays_zip(vector.alias("v"), mins.alias("m"), scales.alias("s")), lambda z: code(z["v"], z["m"], z["s"]).cast("smallint"))


def decode_column(codes: Column, calibration: list) -> Column:
    mins, scales = _literals(calibration)
    value = lambda z: F.least(F.greatest(z["m"].cast("double") + z["c"].cast("double") * z["s"], F.lit(-FLOAT_MAX)), F.lit(FLOAT_MAX))
    return F.transform(F.arrays_zip(codes.alias("c"), mins.alias("m"), scales.alias("s")), value)


def encode_error(vectors: DataFrame, calibration: list) -> DataFrame:
    """(vector_id, error): largest absolute difference after a round trip."""
    back = decode_column(encode_column(F.col("vector"), calibration), calibration)
    return vectors.select("vector_id", F.array_max(F.zip_with("vector", back, lambda a, b: F.abs(a.cast("double") - b))).alias("error"))


@dataclass
class Sq8Index:
    """Codes of all vectors with their calibration; the query stays in full precision."""

    codes: DataFrame
    calibration: list
    metric: Metric

    @classmethod
    def build(cls, vectors: DataFrame, metric: Metric | str = Metric.L2) -> Sq8Index:
        calibration = train(vectors).collect()  # one row a dimension
        if not calibration:
            raise EmptyIndex("nothing to quantise")
        return cls(vectors.select("vector_id", encode_column(F.col("vector"), calibration).alias("codes")), calibration, Metric.parse(metric))

    @property
    def dimension(self) -> int:
        return len(self.calibration)

    def __len__(self) -> int:
        return self.codes.count()

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(q_id, rank, vector_id, distance) of queries (q_id, q), by decoded vectors."""
        mins = np.array([r["mn"] for r in sorted(self.calibration, key=lambda r: r["dim"])], np.float64)
        scales = np.array([r["scale"] for r in sorted(self.calibration, key=lambda r: r["dim"])], np.float64)
        metric, spark = self.metric, queries.sparkSession

        def near(rows) -> DataFrame:
            shared = spark.sparkContext.broadcast((np.array([r["q_id"] for r in rows], np.int64), np.array([r["q"] for r in rows], float).reshape(len(rows), -1), mins, scales))

            def run(batches):
                q_ids, q, mins, scales = shared.value
                top = TopK(q, k, metric)
                for batch in batches:
                    if batch.num_rows:
                        top.see(batch.column(0).to_numpy(), np.clip(mins + matrix(batch.column(1)) * scales, -FLOAT_MAX, FLOAT_MAX))
                yield top.rows(q_ids)

            return self.codes.select("vector_id", "codes").mapInArrow(run, PARTIAL)

        order = Window.partitionBy("q_id").orderBy("distance", "vector_id")
        parts = [near(block) for block in query_blocks(queries.select("q_id", F.col("q").cast("array<double>").alias("q")), self.dimension)]
        hits = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PARTIAL)
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q_id", "rank", "vector_id", "distance")

    def search(self, query, k: int = 10) -> DataFrame:
        check_search(k)
        query = check_vector(query, self.dimension)
        one = self.codes.sparkSession.createDataFrame([(0, query)], "q_id long, q array<double>")
        return self.search_batch(one, k).orderBy("rank").select("vector_id", "distance")

    def save(self, path: str) -> None:
        """Codes and calibration as Parquet, the calibration last with a checksum over its values and the row count."""
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        spark = self.codes.sparkSession
        count = spark.read.parquet(f"{path}/codes").count()
        rows = [(int(r["dim"]), float(r["mn"]), float(r["scale"])) for r in sorted(self.calibration, key=lambda r: r["dim"])]
        meta = spark.createDataFrame(rows, "dim int, mn float, scale double").coalesce(1)
        meta = meta.withColumns({"version": F.lit(1), "metric": F.lit(int(self.metric)), "rows": F.lit(count).cast("long")})
        meta.withColumn("crc", _crc()).write.mode("overwrite").parquet(f"{path}/calibration")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Sq8Index:
        rows = spark.read.parquet(f"{path}/calibration").withColumn("sum", _crc()).collect()
        codes = spark.read.parquet(f"{path}/codes")
        if not rows or any(r["version"] != 1 or r["crc"] != r["sum"] for r in rows):
            raise InvalidFormat("the calibration is damaged or of another version")
        if sorted(r["dim"] for r in rows) != list(range(len(rows))) or codes.count() != rows[0]["rows"]:
            raise InvalidFormat("the snapshot is incomplete")
        if codes.filter((F.size("codes") != len(rows)) | F.exists("codes", lambda c: (c < 0) | (c > 255))).limit(1).count():
            raise InvalidFormat("codes are out of range")
        return cls(codes, rows, Metric.parse(rows[0]["metric"]))


def _crc() -> Column:
    return F.crc32(F.to_json(F.struct("dim", "mn", "scale", "version", "metric", "rows")).cast("binary"))


def load_parts(codes: DataFrame, mins, scales, metric: Metric | str = Metric.L2) -> Sq8Index:
    """An index from trained state."""
    if len(mins) != len(scales) or not len(mins):
        raise InvalidInput("mins and scales have one value a dimension")
    if not np.isfinite([*mins, *scales]).all() or min(scales) < 0:
        raise InvalidInput("calibration is finite, scales are not negative")
    return Sq8Index(codes, [{"dim": i, "mn": float(np.float32(m)), "scale": float(s)} for i, (m, s) in enumerate(zip(mins, scales))], Metric.parse(metric))
