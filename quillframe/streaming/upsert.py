"""An upsert sink for streams: a Parquet table in buckets of its key, changed by one moved file a batch.

A batch rewrites only the buckets that its keys fall into, each into a folder of its own version, and then moves one
manifest into place: it names each bucket's current version and the last batch that is in. A batch that fails before the
move has changed nothing, and one that is replayed after it is recognised by its number, so each counts once. Readers see
the manifest's versions only, before or after a batch, never between.

The driver handles the manifest, which has one entry a bucket, and no row of the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillframe.operators.notices import upsert


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path, so that any shared store serves."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@dataclass
class UpsertTable:
    """A table below ``path`` with one row for each key. ``editorial`` columns follow the latest batch; ``protected`` ones
    are set when a key first comes and never touched again. A null key is a key."""

    path: str
    key: list[str]
    editorial: list[str]
    protected: list[str] = field(default_factory=list)
    buckets: int = 16
    bucket: Column | None = None

    def __post_init__(self):
        if self.bucket is None:
            self.bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession) -> dict:
        fs, at = _store(spark, f"{self.path}/manifests")
        numbers = [int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")] if fs.exists(at) else []
        if not numbers:
            return {"number": -1, "batch": -1, "versions": {}}
        text = spark.read.option("wholetext", True).text(f"{self.path}/manifests/{max(numbers):012d}.json").first()[0]
        return json.loads(text)

    def read(self, spark: SparkSession, schema, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows as the manifest has them; some of its buckets, if named."""
        versions = (manifest or self.manifest(spark))["versions"]
        paths = [f"{self.path}/rows/{v}/_bucket={b}" for b, v in sorted(versions.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, number: int, order: list[str] | None = None) -> bool:
        """Brings a batch in; False if it was in already. Of several rows of one key the last in ``order`` counts, or any of
        them where no order is named."""
        spark = batch.sparkSession
        before = self.manifest(spark)
        if number <= before["batch"]:
            return False
        columns = [*self.key, *self.editorial, *self.protected]
        fresh = batch.dropDuplicates(self.key)
        if order:
            latest = Window.partitionBy(*self.key).orderBy(*(F.desc(c) for c in order))
            fresh = batch.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1")
        fresh = fresh.select(*columns)
        self._rewrite(fresh, number, before, lambda stored: upsert(stored, fresh, self.key, self.editorial, self.protected).select(*columns), fresh.schema)
        return True

    def remove(self, keys: DataFrame, number: int) -> bool:
        """Drops the rows of the keys; False if there was none of them or the batch was in already."""
        spark = keys.sparkSession
        before = self.manifest(spark)
        if number <= before["batch"] or not before["versions"]:
            return False
        schema = StructType.fromJson(before["schema"])
        there = self.read(spark, schema, before).join(keys, self.key, "left_semi").select(*self.key)
        if there.isEmpty():
            return False
        self._rewrite(there, number, before, lambda stored: stored.join(keys, self.key, "left_anti"), schema)
        return True

    def _rewrite(self, changed: DataFrame, number: int, before: dict, change: Callable[[DataFrame], DataFrame], schema) -> None:
        """Writes the buckets of the changed keys anew, then moves the manifest into place."""
        spark = changed.sparkSession
        touched = sorted(r[0] for r in changed.select(self.bucket.alias("b")).distinct().collect())  # no more than the buckets
        version = f"{before['number'] + 1:012d}"
        if touched:
            placed = change(self.read(spark, schema, before, touched)).withColumn("_bucket", self.bucket).repartition("_bucket")
            placed.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows/{version}")
        fs, at = _store(spark, f"{self.path}/rows/{version}")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if touched else []
        filled = [n.removeprefix("_bucket=") for n in names if n.startswith("_bucket=")]
        versions = {b: v for b, v in before["versions"].items() if int(b) not in touched} | dict.fromkeys(sorted(filled), version)
        self._commit(spark, {"number": before["number"] + 1, "batch": number, "versions": versions, "schema": schema.jsonValue()})

    def _commit(self, spark: SparkSession, manifest: dict) -> None:
        version = f"{manifest['number']:012d}"
        fs, draft = _store(spark, f"{self.path}/drafts/{version}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = _store(spark, f"{self.path}/manifests/{version}.json")
        fs.mkdirs(final.getParent())
        if not fs.rename(draft, final):
            raise RuntimeError(f"another writer has brought in version {version}")

    def sink(self, stream: DataFrame, checkpoint: str, order: list[str] | None = None):
        """Runs the stream into the table over the data at hand."""
        query = stream.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number, order) and None).option("checkpointLocation", checkpoint)
        started = query.trigger(availableNow=True).start()
        started.awaitTermination()
        return started
