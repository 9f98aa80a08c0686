"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, passages that repeat go out of the
texts, contaminated documents go, and what is left is segmented into pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run`
writes each stage's rows to the shared folder and reads them back for the next, so that a lost executor costs tasks of
one stage and no stage runs twice; a stage's rows are deleted once the next stage's are written. Where a text changes, n_chars follows it.

Defined cases, for all stages: an empty table gives an empty result; documents with a null or empty text are clean and stay
(of those without words one, as near copies of each other); a null doc_id is an id like any other and stands last among
near copies; repeated rows are near copies; texts of any length are read whole; further columns, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import decontaminate, pieces, simhash, suffix, toxicity
from vectrail.llm.common import delete_table, read_table, shared_table_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the models learn from the labelled ones among `docs`. Without labels of both kinds
    nothing is toxic."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id, then the least text hash) of each group linked by SimHash at 4 bits over 4-word
    shingles."""
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that occur more than once among `docs`."""
    cut = suffix.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    count = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", count)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words under a twentieth are in benchmark windows of 13 words."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document, with their ids; fewer where a text has fewer. Workers give
    up their words' lattices after each task, as they serve the other stages too."""
    import public_tokenizers

    return pieces.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_words=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece segmentation", segment),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        where = shared_table_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(where)
        if before:
            delete_table(spark, before)
        docs, before = spark.read.parquet(where), where
    return docs
