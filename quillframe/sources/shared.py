"""The folder that driver and executors share, for streams and intermediate tables, and tasks for rows that stand for files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Tasks of a stage at most: beyond, each does more.
MOST_TASKS = 10_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. A local session without that setting gets a temporary folder; a cluster's
    session without it is refused, as its executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession, rows: int, work: int, each: int) -> int:
    """In how many tasks to deal rows that stand for files: ``each`` of the work a task, and no fewer than there are cores
    and rows. A count is kept by adaptive execution, which otherwise goes by the rows' own bytes: a few megabytes of paths
    become one task, however much lies in the files."""
    return max(1, min(MOST_TASKS, max(-(-work // each), min(rows, spark.sparkContext.defaultParallelism))))
