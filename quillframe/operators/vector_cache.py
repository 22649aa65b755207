"""A cache of vectors by content: what is there and fits is read, only what is missing is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(cache: DataFrame, *, model: str, chunk_max: int, dimension: int) -> DataFrame:
    """Cached vectors that were made by the same model on chunks of the same size and have the right length; a content
    with any unfit chunk is not usable at all. cache: text_sha, model, chunk_max, chunk_no, vector."""
    own = cache.where((F.col("model") == model) & (F.col("chunk_max") == chunk_max))
    unfit = own.where(F.col("vector").isNull() | (F.size("vector") != dimension)).select("text_sha").distinct()
    return own.join(unfit, "text_sha", "left_anti").select("text_sha", "chunk_no", "vector")


def missing(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """Chunks of contents that the cache does not hold whole, each distinct content once. chunks: text_sha, chunk_no."""
    distinct = chunks.dropDuplicates(["text_sha", "chunk_no"])
    have = cached.select("text_sha", "chunk_no").distinct().withColumn("_have", F.lit(1))
    lacking = distinct.join(have, ["text_sha", "chunk_no"], "left").where("_have IS NULL").select("text_sha").distinct()
    return distinct.join(lacking, "text_sha", "left_semi")


def appended(vectors: DataFrame, path: str, *, model: str, chunk_max: int) -> None:
    """Appends new vectors as Parquet, in single precision. vectors: text_sha, chunk_no, vector."""
    vectors.select("text_sha", F.lit(model).alias("model"), F.lit(chunk_max).alias("chunk_max"), "chunk_no", F.col("vector").cast("array<float>")).write.mode("append").parquet(path)
