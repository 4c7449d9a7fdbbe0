"""Vector operators: cosine similarity, top-k, normalisation, pooling, embedding texts, byte codec, which nodes need embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from skein.functions.text import embed_text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and those of norm zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def normalised(a: Column) -> Column:
    """A vector of length one; unchanged if its norm is at most 1e-9."""
    n = norm(a)
    return F.when(n <= 1e-9, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def top_similar(vectors: DataFrame, query: list[float], limit: int = 10, least: float = 0.3, key: str = "node_id") -> DataFrame:
    """The limit rows most similar to query, of those that reach least; each partition keeps its best, no row is sorted globally."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", cosine(F.col("embedding"), wanted)).filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(limit)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token states that the mask keeps; zeros if it keeps none."""
    kept = mask.astype(bool)
    return states[kept].mean(axis=0) if kept.any() else np.zeros(states.shape[1], states.dtype)


@F.pandas_udf(BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4"))


@F.pandas_udf(ArrayType(FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """A stand-in for a model where none is installed: hashed character trigrams, 256 dimensions, length one."""
    import zlib

    def one(text: str | None) -> np.ndarray:
        v = np.zeros(256, np.float32)
        text = f" {(text or '').lower()} "
        for i in range(len(text) - 2):
            h = zlib.crc32(text[i : i + 3].encode())
            v[h % 256] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        return v / n if n > 1e-9 else v

    return texts.map(one)


def embedded(nodes: DataFrame, model: str = "hashed-trigrams", embed=hashed_embedding) -> DataFrame:
    """Vectors of nodes. embed is any pandas UDF from text to array<float>."""
    text = embed_text(F.col("name"), F.col("qualified_name"), F.col("docstring"), F.col("signature"))
    return nodes.select(F.col("id").alias("node_id"), embed(text).alias("embedding"), F.lit(model).alias("model"), F.unix_millis(F.current_timestamp()).alias("created_at"))


def unembedded(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    return nodes.join(vectors.select(F.col("node_id").alias("id")), "id", "left_anti")


def stale(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes without a vector, or changed since theirs was made."""
    made = vectors.select(F.col("node_id").alias("id"), "created_at")
    return nodes.join(made, "id", "left").filter("created_at is null or updated_at > created_at").drop("created_at")
