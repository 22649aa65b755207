"""Resolving one outcome from ordered candidates and the decisions a provider made on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(candidates: DataFrame, decisions: DataFrame, group: str, doc: str) -> DataFrame:
    """Per group the first candidate (by ``rank``) decided present or partial; else an error outcome; else absent.

    decisions: group, doc, presence, confidence, error.
    """
    joined = candidates.join(decisions, [group, doc], "left")
    confirmed = F.col("error").isNull() & F.col("presence").isin("present", "partial")
    best = F.min(F.when(confirmed, F.struct("rank", doc, "presence", "confidence")))
    last_error = F.max(F.when(F.col("error").isNotNull(), F.struct("rank", "error")))
    found = joined.groupBy(group).agg(best.alias("b"), last_error.alias("e"))
    return found.select(
        group, F.col(f"b.{doc}").alias(doc), F.coalesce("b.presence", F.lit("absent")).alias("presence"), F.col("b.confidence").alias("confidence"),
        F.when(F.col("b").isNull(), F.col("e.error")).alias("error"),
        F.when(F.col("b").isNotNull(), "llm").when(F.col("e").isNotNull(), "content").otherwise("none").alias("layer"),
    )


def first_confirming(candidates: DataFrame, decisions: DataFrame, group: str, doc: str) -> DataFrame:
    """Per group the found value of the candidate that comes first; an error only where nothing is found.

    decisions: group, doc, found, value, confidence, error. A decision beats the error of a sibling batch.
    """
    joined = candidates.join(decisions, [group, doc], "left")
    best = F.min(F.when(F.col("found"), F.struct("rank", doc, "value", "confidence")))
    error = F.min(F.when(F.col("error").isNotNull(), F.struct("rank", "error")))
    found = joined.groupBy(group).agg(best.alias("b"), error.alias("e"))
    return found.select(group, F.col(f"b.{doc}").alias(doc), F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), F.when(F.col("b").isNull(), F.col("e.error")).alias("error"))


def folded_value(value: Column) -> Column:
    """A value as it is compared: stripped, case-folded."""
    return F.replace(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), F.lit("ß"), F.lit("ss"))


def cross_check(sources: DataFrame, group: str, *, most: int = 2) -> DataFrame:
    """Compares the first ``most`` sources (by ``rank``) of each group: single_source, coherent or incoherent; the value
    is that of highest confidence, the first on ties. sources: group, rank, value, confidence."""
    ranked = sources.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("rank"))).where(F.col("_n") <= most)
    found = ranked.groupBy(group).agg(F.count("*").alias("n_sources"), F.count_distinct(folded_value(F.col("value"))).alias("v"), F.max(F.struct("confidence", (-F.col("_n")).alias("_o"), "value")).alias("b"))
    status = F.when(F.col("n_sources") == 1, "single_source").when(F.col("v") == 1, "coherent").otherwise("incoherent")
    return found.select(group, "n_sources", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), status.alias("status"))


def file_match(pieces: DataFrame, docs: DataFrame, *, sure: float = 0.75) -> DataFrame:
    """Pieces that some document's category resolves. pieces: piece, category; docs: doc, category, confidence."""
    found = pieces.join(docs, "category", "left").groupBy("piece", "category").agg(F.count("doc").alias("n_docs"), F.min("confidence").alias("least"))
    certainty = F.when(F.col("n_docs") == 0, None).when(F.col("least") < sure, "probable").otherwise("certain")
    return found.select("piece", "n_docs", F.col("least").alias("least_confidence"), certainty.alias("certainty"))


def absent_certainty(own_category: Column, may_hide: Column) -> Column:
    """An absence is certain only for a piece with a category of its own that cannot be inside another document."""
    return F.when((F.coalesce(own_category, F.lit("")) != "") & ~may_hide, "certain").otherwise("probable")


def lot_coverage(docs: DataFrame, group: str, lot: str, all_lots: Column) -> DataFrame:
    """Covered and missing lots of each group; partial if any is missing."""
    covered = F.array_sort(F.collect_set(F.when(F.coalesce(F.col(lot), F.lit("")) != "", F.col(lot))))
    found = docs.groupBy(group).agg(covered.alias("covered"))
    return found.withColumn("missing", F.array_except(all_lots, "covered")).withColumn("presence", F.when(F.size("missing") > 0, "partial").otherwise("present"))


def merged_answers(batches: DataFrame, doc: str) -> DataFrame:
    """Disjoint batch decisions of a document as one map; the first batch's error is kept. batches: doc, batch, answers
    (map), error."""
    entries = F.flatten(F.collect_list(F.map_entries("answers")))
    return batches.groupBy(doc).agg(F.map_from_entries(entries).alias("answers"), F.min(F.when(F.col("error").isNotNull(), F.struct("batch", "error")))["error"].alias("error"))


def by_index(items: DataFrame, answers: DataFrame, batch: str, index: str) -> DataFrame:
    """Answers matched to their items by index; an item without one gets an error."""
    return items.join(answers, [batch, index], "left").withColumn("error", F.when(F.col("answer").isNull(), F.lit("missing answer")))
