"""Streams of operations folded into state, one commit a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.sources import oplog
from vectrail.types import OP_LOG


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(OP_LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fold_stream(log: DataFrame, state: str, checkpoint: str, trigger: dict | None = None):
    """Append every micro-batch of log rows to the folder `state` (batch=N inside it, overwritten if a batch is retried,
    so each counts once). `folded_state` reads what they amount to. Returns the running query."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return log.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def folded_state(spark: SparkSession, state: str) -> DataFrame:
    """(vector_id, vector, metadata, deleted) of all batches so far; the same fold as for a log at rest."""
    log = spark.read.schema(OP_LOG).option("recursiveFileLookup", "true").parquet(state)
    return oplog.fold(oplog.valid_prefix(log))


def count_operations(log: DataFrame) -> DataFrame:
    """(op, n) running counts of a stream, for monitoring."""
    return log.groupBy("op").agg(F.count("*").alias("n"))


def stage_log(rows: DataFrame, path: str, files: int = 3) -> None:
    """Write log rows as files in order of seq, for file streams."""
    oplog.with_checksum(rows).repartitionByRange(files, "seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(path)
