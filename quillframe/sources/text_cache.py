"""A text cache by content: extracted once for each distinct content, refreshed only where it was deferred.

The cache is an upsert table whose buckets are the first byte of the content's hash, so a look-up reads the buckets of the
hashes it asks for, and a refresh writes the buckets in which something is pending. A second refresh with nothing pending
writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.streaming.upsert import UpsertTable

SCHEMA = "content_hash string, text string, char_count int, status string"


class TextCache:
    """status is done, failed or deferred; only deferred and unknown contents are extracted."""

    def __init__(self, path: str):
        first_byte = F.conv(F.substr("content_hash", F.lit(1), F.lit(2)), 16, 10).cast("int")
        self.table = UpsertTable(path, ["content_hash"], ["text", "char_count", "status"], buckets=256, bucket=first_byte)

    def cached(self, spark: SparkSession, hashes: DataFrame | None = None) -> DataFrame:
        """The cache, or what it has of the contents of ``hashes`` (content_hash), from their buckets alone."""
        if hashes is None:
            return self.table.read(spark, SCHEMA)
        buckets = sorted(r[0] for r in hashes.select(self.table.bucket.alias("b")).where("b IS NOT NULL").distinct().collect())  # 256 at most
        return self.table.read(spark, SCHEMA, buckets=buckets).join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")

    def refresh(self, contents: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> bool:
        """Extracts what is unknown or deferred of contents (content_hash, ...); False if nothing was pending. ``extract``
        gets one row of each pending content and returns content_hash, text and status."""
        spark = contents.sparkSession
        settled = self.cached(spark, contents).where("status <> 'deferred'").select("content_hash")
        pending = contents.where("content_hash IS NOT NULL").dropDuplicates(["content_hash"]).join(settled, "content_hash", "left_anti")
        if pending.isEmpty():
            return False
        found = extract(pending).select("content_hash", "text", F.length("text").alias("char_count"), "status")
        return self.table.apply(found, self.table.manifest(spark)["batch"] + 1)

    def forget(self, orphans: DataFrame) -> bool:
        """Drops contents that no document has any more; False if none was there."""
        spark = orphans.sparkSession
        return self.table.remove(orphans.select("content_hash"), self.table.manifest(spark)["batch"] + 1)

    def texts(self, documents: DataFrame, digest: str) -> DataFrame:
        """documents with the text, char_count and status of their content; null where the cache has none."""
        hashes = documents.select(F.col(digest).alias("content_hash"))
        found = self.cached(documents.sparkSession, hashes).withColumnRenamed("content_hash", "_hash")
        return documents.join(found, F.col(digest) == F.col("_hash"), "left").drop("_hash")
