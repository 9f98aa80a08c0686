"""The operation log: rows of inserts, metadata changes and deletes, and the state they fold to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions.metadata import canonical_key
from vectrail.types import OP_LOG

INSERT, INSERT_META, UPDATE_META, CLEAR_META, DELETE = "insert", "insert_meta", "update_meta", "clear_meta", "delete"
OPS = (INSERT, INSERT_META, UPDATE_META, CLEAR_META, DELETE)


def checksum() -> Column:
    """crc32 over all fields of a log row."""
    meta = F.when(F.col("metadata").isNull(), "").otherwise(F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), canonical_key(e["value"])))), ";"))
    vector = F.coalesce(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), F.lit(""))
    return F.crc32(F.concat_ws("|", F.col("seq").cast("string"), "op", F.col("vector_id").cast("string"), vector, meta).cast("binary"))


def with_checksum(rows: DataFrame) -> DataFrame:
    return rows.withColumn("crc", checksum()).select(*OP_LOG.fieldNames())


def first_bad(log: DataFrame) -> DataFrame:
    """(bad): the least seq whose checksum fails or whose operation is unknown, null if there is none."""
    return log.filter((F.col("crc") != checksum()) | ~F.col("op").isin(*OPS)).agg(F.min("seq").alias("bad"))


def valid_prefix(log: DataFrame) -> DataFrame:
    """Rows before the first whose checksum fails; the first bad seq is one aggregate, not a sort."""
    bad = first_bad(log)
    return log.crossJoin(F.broadcast(bad)).filter(F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).drop("bad")


def fold(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(vector_id, vector, metadata, deleted) after all rows in order of seq; replaying a row twice changes nothing.

    One aggregate by id: an insert counts once, metadata changes and deletes only after it. A snapshot's rows (vector_id,
    vector, metadata) stand before the log."""
    rows = log.select("seq", "op", "vector_id", "vector", "metadata").dropDuplicates(["seq"])
    if snapshot is not None:
        before = snapshot.select(F.lit(-1).cast("long").alias("seq"), F.lit(INSERT_META).alias("op"), "vector_id", "vector", "metadata")
        rows = before.unionByName(rows)
    is_insert = F.col("op").isin(INSERT, INSERT_META)
    born = F.min(F.when(is_insert, F.struct("seq", "vector"))).alias("born")
    first = F.min(F.when(is_insert, F.col("seq"))).over(Window.partitionBy("vector_id"))
    died = F.min(F.when((F.col("op") == DELETE) & (F.col("seq") > F.col("born_seq")), F.col("seq"))).over(Window.partitionBy("vector_id"))
    rows = rows.withColumn("born_seq", first).filter("born_seq is not null and seq >= born_seq").withColumn("died", died)
    meta_op = (is_insert & (F.col("seq") == F.col("born_seq"))) | F.col("op").isin(UPDATE_META, CLEAR_META)
    alive_op = meta_op & (F.col("died").isNull() | (F.col("seq") < F.col("died")))
    value = F.struct(F.when(F.col("op").isin(INSERT_META, UPDATE_META), F.col("metadata")).alias("m"))
    folded = rows.groupBy("vector_id").agg(born, F.max_by(F.when(alive_op, value), F.when(alive_op, F.col("seq"))).alias("meta"), F.bool_or(F.col("died").isNotNull()).alias("deleted"))
    return folded.select("vector_id", F.col("born.vector").alias("vector"), F.col("meta.m").alias("metadata"), "deleted")


def state(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Live rows of a snapshot and the log since. Rows of the snapshot that no logged change names are passed on as they
    are: only the log, and the rows that it changes, are folded. Ids are never used twice, so inserts name no old row."""
    changed = log.filter(F.col("op").isin(UPDATE_META, CLEAR_META, DELETE)).select("vector_id").distinct()
    same = snapshot.join(changed, "vector_id", "left_anti")
    return same.unionByName(live(fold(log, snapshot.join(changed, "vector_id", "left_semi"))))


def live(folded: DataFrame) -> DataFrame:
    return folded.filter("not deleted and vector is not null").select("vector_id", "vector", "metadata")


def max_vector_id(log: DataFrame) -> DataFrame:
    """(max_vector_id): the high-water mark over all inserts, deleted ones too."""
    return log.filter(F.col("op").isin(INSERT, INSERT_META)).agg(F.coalesce(F.max("vector_id"), F.lit(0).cast("long")).alias("max_vector_id"))


def deletes(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") == DELETE).select("vector_id")


def checkpoint_log(log: DataFrame) -> DataFrame:
    """What a log keeps once a snapshot holds the vectors: plain inserts go, inserts with metadata become metadata
    updates, the rest stays; order by seq is kept."""
    op = F.when(F.col("op") == INSERT_META, UPDATE_META).otherwise(F.col("op"))
    return with_checksum(log.filter(F.col("op") != INSERT).withColumns({"op": op, "vector": F.when(op.isin(UPDATE_META, CLEAR_META, DELETE), F.lit(None)).otherwise(F.col("vector")).cast("array<float>")}))


def assign_ids(batch: DataFrame, order: str, start: int) -> DataFrame:
    """Contiguous ids after `start` in order of a column, ties by the rows' contents, without sorting the batch in one task:
    rows are numbered inside a fixed number of range partitions, and the partitions' sizes summed up."""
    tie = F.xxhash64(*(F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in batch.schema.fields))
    count = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = batch.withColumn("__tie", tie).repartitionByRange(count, order, "__tie").withColumn("__part", F.spark_partition_id())
    numbered = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(order, "__tie"))).drop("__tie")
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    return numbered.join(F.broadcast(before), "__part").withColumn("vector_id", F.lit(start).cast("long") + F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")
