"""The boundary to outside models. A provider turns a table of calls into a table of answers; nothing else knows it.

The library ships one provider: answers looked up in a table. Text recognition, hazard reports, structured answers and
embeddings all have this shape, so a live service is one more class with the same method.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def answer(self, calls: DataFrame) -> DataFrame:
        """calls with answer columns and ``error``: one row for each call, errors as data."""


class TableProvider:
    """Answers from a table with the calls' key columns; a call without one is an error row."""

    def __init__(self, answers: DataFrame, *key: str):
        self.answers, self.key = answers, list(key)

    def answer(self, calls: DataFrame) -> DataFrame:
        known = self.answers.withColumn("_known", F.lit(True))
        joined = calls.join(known, self.key, "left")
        error = F.col("error") if "error" in self.answers.columns else F.lit(None).cast("string")
        return joined.withColumn("error", F.coalesce(error, F.when(F.col("_known").isNull(), "no answer"))).drop("_known")


def once_per_content(calls: DataFrame, digest: str, provider: Provider) -> DataFrame:
    """Each distinct content is asked once and its answer shared."""
    asked = provider.answer(calls.select(digest).distinct())
    return calls.join(asked, digest)
