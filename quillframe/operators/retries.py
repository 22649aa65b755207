"""Provider calls to their end: refused batches are halved, failed ones asked again, in rounds over what is pending.

A call is a range of a list of items. Each round asks for all pending ranges at once, keeps what is settled, and turns the
rest into the next round's: a refused range into its halves, a failed one into itself with one more attempt. Rounds end
when nothing is pending; there are at most as many as halvings of the longest list and attempts together, and each is a
written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.sources.shared import new_folder

FIELDS = "lo int, hi int, attempt int"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(calls: DataFrame, key: str, provider: Callable[[DataFrame], DataFrame], *, attempts: int = 3) -> DataFrame:
    """(key, lo, hi, attempt, status, answer): the ranges that calls ended as.

    calls: key, size (items in its list). ``provider`` gets key, lo, hi (exclusive) and attempt (from 1) and returns them
    with ``status`` and ``answer``: ``ok`` is kept; ``refused`` halves a range of several items and ends one of one item;
    anything else is asked again, up to ``attempts`` times in all, and then ends as it is. Halves start at attempt 1. A list
    without items makes no call, and a range that the provider leaves out counts as failed, with the status ``missing``.
    """
    asked = calls.where("size > 0").select(key, F.lit(0).alias("lo"), F.col("size").cast("int").alias("hi"), F.lit(1).alias("attempt"))
    pending, ended = _written(asked, "calls"), []
    while not pending.isEmpty():
        same = [key, "lo", "hi", "attempt"]
        told = pending.join(provider(pending).select(*same, "status", "answer"), same, "left")
        round_ = _written(told.withColumn("status", F.coalesce("status", F.lit("missing"))), "answers")
        refused = F.col("status") == "refused"
        halves = refused & (F.col("hi") - F.col("lo") > 1)
        again = (F.col("status") != "ok") & ~refused & (F.col("attempt") < attempts)
        ended.append(round_.where(~halves & ~again))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.when(halves, F.array(F.struct(F.col("lo"), middle.alias("hi"), F.lit(1).alias("attempt")), F.struct(middle.alias("lo"), F.col("hi"), F.lit(1).alias("attempt"))))
        parts = parts.when(again, F.array(F.struct("lo", "hi", (F.col("attempt") + 1).alias("attempt"))))
        pending = _written(round_.select(key, F.inline(parts)), "calls")
    out = pending.select("*", F.lit("").alias("status"), F.lit("").alias("answer")).limit(0)
    for part in ended:
        out = out.unionByName(part)
    return out
