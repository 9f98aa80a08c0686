"""Texts to normalised feature vectors by hashed words, for semantic search demonstrations."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_vectors(texts: DataFrame, text: str = "text", features: int = 384, out: str = "vector") -> DataFrame:
    """`texts` with an array of `features` word counts scaled to length one; a text without words has zeros."""
    df = texts.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    df = Tokenizer(inputCol="__text", outputCol="__words").transform(df)
    df = df.withColumn("__words", F.filter("__words", lambda w: w != ""))
    df = HashingTF(numFeatures=features, inputCol="__words", outputCol="__tf").transform(df)
    df = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(df)
    return df.withColumn(out, vector_to_array("__unit", "float32")).drop("__text", "__words", "__tf", "__unit")
