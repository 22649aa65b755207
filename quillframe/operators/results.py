"""Results as rows: proposals that start as final values, text results, and the joins behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proposed(results: DataFrame, *columns: str, error: str = "error") -> DataFrame:
    """results with proposed_* and final_* of each column, the final value starting as the proposal even where there is
    an error, and ``status``."""
    rest = [c for c in results.columns if c not in columns]
    return results.select(*rest, *(F.col(c).alias(f"proposed_{c}") for c in columns), *(F.col(c).alias(f"final_{c}") for c in columns), F.when(F.coalesce(error, F.lit("")) != "", "error").otherwise("proposed").alias("status"))


def text_result(docs: DataFrame, text: Column, title: Column, mentions: Column, error: Column, *keep: str, preview: int = 1000) -> DataFrame:
    """What a document keeps of its text: title, preview, mentions as JSON (null without any), and its stage."""
    failed = F.coalesce(error, F.lit("")) != ""
    return docs.select(*keep, title.alias("detected_title"), F.left(text, F.lit(preview)).alias("preview_text"), F.when(F.size(mentions) > 0, F.to_json(mentions)).alias("key_mentions"), F.when(failed, "error").otherwise("text_extracted").alias("stage"), F.when(failed, error).alias("stage_error"))


def completeness_rows(checks: DataFrame, pieces: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """One row per check of a known piece, with its catalog row and its matched documents in the order they were matched;
    unknown documents are left out. checks: key, piece, matched (array of ids); docs: doc_id, filename, relative_path.

    Matches are exploded before they meet the documents, so a document that many checks match is one row of the join.
    """
    known = checks.join(F.broadcast(pieces), "piece")  # the checklist's own table
    each = known.select(*key, "piece", F.posexplode("matched").alias("_pos", "doc_id"))
    files = each.join(docs.select("doc_id", "filename", "relative_path"), "doc_id").groupBy(*key, "piece").agg(F.array_sort(F.collect_list(F.struct("_pos", "doc_id", "filename", "relative_path"))).alias("_files"))
    shown = F.transform(F.coalesce("_files", F.slice("_files", 1, 0)), lambda f: F.struct(f["doc_id"].alias("doc_id"), f["filename"].alias("filename"), f["relative_path"].alias("relative_path")))
    return known.join(files, [*key, "piece"], "left").withColumn("documents", F.coalesce(shown, F.expr("CAST(array() AS array<struct<doc_id:bigint,filename:string,relative_path:string>>)"))).drop("_files", "matched")


def extraction_rows(results: DataFrame, fields: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """One row per result of a known field, its sources each with the path of its document (null where there is none).
    results: key, field, sources (array of struct with document_id); docs: doc_id, relative_path."""
    known = results.join(F.broadcast(fields), "field")  # the schema's own table
    each = known.select(*key, "field", F.posexplode("sources").alias("_pos", "source"))
    with_path = each.join(docs.select("doc_id", "relative_path"), F.col("source.document_id") == F.col("doc_id"), "left")
    listed = with_path.groupBy(*key, "field").agg(F.array_sort(F.collect_list(F.struct("_pos", "source", "relative_path"))).alias("_sources"))
    return known.drop("sources").join(listed, [*key, "field"], "left").withColumn("sources", F.transform("_sources", lambda s: F.struct(s["source"]["document_id"].alias("document_id"), s["relative_path"].alias("relative_path")))).drop("_sources")


def sections_in_order(rows: DataFrame, section: str, declared: list[str]) -> DataFrame:
    """Rows with the place of their section: declared ones in their order, then all others by name. A section without
    rows has no place to fill."""
    listed = F.array_position(F.array(*map(F.lit, declared)), F.col(section))
    return rows.withColumn("section_place", F.when(listed > 0, F.lpad(listed.cast("string"), 6, "0")).otherwise(F.concat(F.lit("~"), F.coalesce(section, F.lit("")))))


def top_matches(rows: DataFrame, group: str, name: str, most: int = 5) -> DataFrame:
    """The names of the best matches of each group, at most ``most``, by score and then by the catalog's order. The best
    are kept in each task before they are shuffled."""
    order = F.struct((-F.col("score")).alias("neg"), "ord", name)
    return rows.groupBy(group).agg(F.transform(F.slice(F.array_sort(F.collect_set(order)), 1, most), lambda s: s[name]).alias("matches"))


def topics_for_documents(docs: DataFrame, topics: DataFrame, doc: str) -> DataFrame:
    """(doc, topic, pos): the topics a document feeds, so each document is read once. topics: topic, source, pivots; docs:
    doc, category, text."""
    pivots = topics.where("source = 'documents'").select("topic", F.posexplode("pivots").alias("pos", "category"))
    return docs.where((F.length("text") > 0) & F.col("category").isNotNull()).join(F.broadcast(pivots), "category").select(doc, "topic", "pos")  # the catalog's own table


def pivot_documents(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Documents in the union of all topics' pivot categories."""
    return docs.join(F.broadcast(topics.select(F.explode("pivots").alias("category")).distinct()), "category", "left_semi")


def uncovered(requests: DataFrame, answers: DataFrame, group: str, ids: str) -> DataFrame:
    """(group, missing): the requested ids of each group that no answer covers. requests: group, ids (array); answers:
    group, id."""
    given = answers.groupBy(group).agg(F.collect_set("id").alias("_given"))
    joined = requests.join(given, group, "left")
    return joined.select(group, F.array_sort(F.array_except(ids, F.coalesce("_given", F.slice(ids, 1, 0)))).alias("missing"))
