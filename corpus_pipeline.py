"""Corpus preparation over ``documents``: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; a stage's result is written as Parquet
and read again. All stages but the last return the columns of ``documents``; further columns of any name pass through
them. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import byte_bpe, decontaminate, minhash_dedup, quality, secret_scan
from quillframe.llm.storage import written
from quillframe.sources.tables import table

#: The words of a text, as the near-duplicate operator takes them.
WORD = r"[^\x20\x09-\x0D]"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels``, accepts.

    Without labelled rows of both kinds there is nothing to judge by, and all rows stay. Null and empty texts are judged
    as empty texts, long texts whole, repeated rows each; rows without an id are judged too.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = quality.score(docs.select(row, F.col("text")), model)
    return judged.where("predicted = 1").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates.

    Rows are judged by their own text: of an id with several texts only those go that repeat a smaller id. A repeated
    row (same id and text) stays once, the one whose other columns have the least hash. Rows without an id or without words are nobody's
    duplicate and all stay.
    """
    found = minhash_dedup.near_duplicates(docs).where("kept AND n_shingles > 0").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    worded = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False)) & F.col("doc_id").isNotNull()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.where(worded).select(F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_hash"), row)
    kept = keyed.join(found, (F.col("_own") == F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left_semi")
    others = F.to_json(F.struct(*(F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text")))
    once = kept.groupBy("_own", "_hash").agg(F.min_by("row", F.xxhash64(others)).alias("row"))
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)).unionByName(docs.where(~worded))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts have none and stay; repeated rows are judged
    each, rows without an id too; an empty benchmark drops nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and ``n_chars`` counted anew. Nulls and empty texts stay
    as they are, repeated rows and rows without an id are redacted each."""
    redacted = secret_scan.redact(docs)
    size = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", size).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and whether they decode to its text. Nulls and empty texts have no tokens and round-trip;
    repeated rows and rows without an id are encoded each; only the named columns stay."""
    plain = docs.select("doc_id", "lang", "source", "n_chars", "text")
    coded = byte_bpe.encode(plain, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

#: Compression sizes, Poisson signatures and merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
