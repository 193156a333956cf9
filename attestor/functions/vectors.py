"""Vector expressions and the text-embedding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from attestor import presets
from attestor.functions.text import collapse


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, clamped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b)))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors given as maps, clamped to [0, 1]."""
    shared = F.aggregate(
        F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0))
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared))


def word_vectors(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    """The offline default embedder: word counts of distinct texts scaled to unit length, as a map from word to weight.

    Nothing is hashed, so different words never fall together; a text without words has an empty map.
    """
    words = F.filter(F.split(F.lower(collapse(text_col)), r"(?U)[^\w]+"), lambda w: w != "")
    # Texts are dealt by a digest and then stay: their words are counted and joined back where they are.
    keyed = df.select(text_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("_key")).repartition("_key")
    counted = keyed.select("_key", F.explode(words).alias("_word")).groupBy("_key", "_word").agg(F.count(F.lit(1)).alias("_n"))
    listed = counted.groupBy("_key").agg(F.collect_list(F.struct(F.col("_word").alias("w"), F.col("_n").alias("n"))).alias("_words"))
    listed = keyed.join(listed, "_key", "left").withColumn("_words", F.coalesce("_words", F.array().cast("array<struct<w:string,n:bigint>>")))
    length = F.sqrt(F.aggregate("_words", F.lit(0.0), lambda acc, e: acc + e["n"].cast("double") * e["n"].cast("double")))
    entries = F.transform("_words", lambda e: F.struct(e["w"].alias("key"), (e["n"] / F.col("_length")).alias("value")))
    return listed.withColumn("_length", length).select(text_col, F.map_from_entries(entries).alias(out))


def hashed_embedding(df: DataFrame, text_col: str, out: str = "embedding", size: int = 512) -> DataFrame:
    """Hashed word counts scaled to unit length, as dense vectors of a fixed size."""
    words = df.withColumn("_words", F.split(F.lower(collapse(text_col)), r"(?U)[^\w]+"))
    words = words.withColumn("_words", F.filter("_words", lambda w: w != ""))
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(words)
    scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def embed_with(
    df: DataFrame,
    text_col: str,
    embed: Callable[[Sequence[str]], Sequence[Sequence[float]]],
    out: str = "embedding",
    batch: int = presets.EMBEDDING_BATCH,
) -> DataFrame:
    """Run a user's embedding function over ``(text)`` rows, ``batch`` texts per call, order kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = [[float(x) for x in v] for v in embed(part[text_col].tolist())]
                yield part.assign(**{out: vectors})

    return df.select(text_col).mapInPandas(run, f"`{text_col}` string, `{out}` array<float>")
