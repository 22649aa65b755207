"""Written intermediate tables, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few plain columns up to which a counted table is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 1_000_000


def shared_folder(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets a new temporary folder,
    a cluster's session without one is refused, as its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, key: str) -> Iterator[DataFrame]:
    """df as a table of the warehouse bucketed by key, one bucket for each shuffle partition, read back: a join on the key
    leaves it where it lies. The table is dropped afterwards, so what is made of it must be written within."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    try:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).saveAsTable(table)
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def lookup(df: DataFrame) -> DataFrame:
    """df (a written table of labelled ids or of lists of an index) as the small side of a join: broadcast if its counted rows are few, else left
    to a shuffle join."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df dealt by something else than its key, so that a join on the key deals both sides and may split a hot key."""
    return df.repartition(F.xxhash64(key, F.lit(1)))
