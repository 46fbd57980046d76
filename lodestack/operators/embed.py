"""Embedding a text column with a function the caller supplies, and an offline stand-in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import words


def embed(
    df: DataFrame, fn: Callable[[Sequence[str]], Sequence[Sequence[float]]], text: str = "text", vector: str = "vector"
) -> DataFrame:
    """Adds `vector` from `fn(texts) -> vectors`, called per Arrow batch. An empty vector is an error."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = [list(v) for v in fn(texts.tolist())]
        if len(vectors) != len(texts) or not all(vectors):
            raise ValueError("received empty embeddings")
        return pd.Series(vectors, dtype=object)

    return df.withColumn(vector, run(text))


def embed_hashed(df: DataFrame, text: str = "text", vector: str = "vector", size: int = 256) -> DataFrame:
    """Adds unit-length hashed word counts: no model, but equal texts get equal vectors and similar ones near ones."""
    tokens = df.withColumn("_words", words(F.lower(F.col(text))))
    counted = HashingTF(numFeatures=size, inputCol="_words", outputCol="_counts").transform(tokens)
    scaled = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.withColumn(vector, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")
