"""A plan module's book of queries: each function with its SQL for DuckDB, if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return add


#: How the driver's documents stand for analysed ones: source is the dossier, lang the lot and the category.
SIGNALS_SQL = """(SELECT doc_id, source AS dossier, lang AS lot, 'CAT/' || upper(lang) AS category, source || '-' || lang || '-' || doc_id || '.pdf' AS filename,
  (doc_id % 100) / 100.0::DOUBLE AS confidence, coalesce(text, '') AS text FROM documents)"""


def signals(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillframe.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.col("source").alias("dossier"), F.col("lang").alias("lot"), F.concat(F.lit("CAT/"), F.upper("lang")).alias("category"),
        F.concat("source", F.lit("-"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        ((F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence"), F.coalesce("text", F.lit("")).alias("text"),
    )
