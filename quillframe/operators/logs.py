"""Call logs and deferred work as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_calls(calls: DataFrame, path: str) -> None:
    """Appends call events as JSON lines, one folder of files per batch."""
    calls.write.mode("append").json(path)


def truncations(parts: DataFrame, text: str, limit: int, name: str) -> DataFrame:
    """Original and kept characters of every text that a limit cuts."""
    size = F.length(text)
    return parts.where(size > limit).select(F.lit(name).alias("limit_name"), size.alias("original_chars"), F.lit(limit).alias("kept_chars"))


def usage(batches: DataFrame, group: str) -> DataFrame:
    return batches.groupBy(group).agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("n_calls"))


def kept_report(parts: DataFrame, previous: DataFrame, group: str) -> DataFrame:
    """New parts, unless all model-backed parts of a group failed: then the previous report stays. parts: group, part,
    body, error; previous: group, part, body."""
    failed = parts.groupBy(group).agg(F.every(F.col("error").isNotNull()).alias("_failed"))
    fresh = parts.join(failed.where("NOT _failed"), group, "left_semi").select(group, "part", F.coalesce("body", F.concat(F.lit("failed: "), "error")).alias("body"))
    old = previous.join(failed.where("_failed"), group, "left_semi").select(group, "part", "body")
    return fresh.unionByName(old)


def deferred_work(cache: DataFrame, needed: DataFrame, key: str = "content_hash") -> DataFrame:
    """Deferred texts that some selected document needs now; all others stay as they are."""
    return cache.where("method = 'deferred'").join(needed.select(key).distinct(), key, "left_semi")
