"""Derived counters, proposals and corrections, status order, cascades and rollbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of a dossier's statuses; ``error`` has no place in it.
STATUSES = ["uploaded", "unzipping", "inventorying", "extracting_text", "ready_step1", "classifying", "classified", "reorganizing", "reorganized", "analyzing_completeness", "completeness_review", "completeness_validated", "extracting", "extraction_review", "extraction_validated"]


def filled(value: Column) -> Column:
    """Null and empty both count as absent."""
    return F.coalesce(value, F.lit("")) != ""


def document_counters(docs: DataFrame, group: str) -> DataFrame:
    """docs: analyzable, at_risk, stage (pending, text_extracted, error), class_status (pending, proposed, corrected, error)."""
    return docs.groupBy(group).agg(
        F.count("*").alias("n_total"), F.count_if(F.col("stage") == "text_extracted").alias("n_extracted"), F.count_if(~F.col("analyzable")).alias("n_not_analyzable"),
        F.count_if(~F.col("analyzable") & F.col("at_risk")).alias("n_at_risk"), F.count_if(F.col("stage") == "error").alias("n_error"), F.count_if(F.col("class_status").isin("proposed", "corrected", "error")).alias("n_classified"),
    )


def piece_counters(checks: DataFrame, group: str) -> DataFrame:
    """Counts over selected checks only. checks: selected, presence, status."""
    on = F.col("selected")
    return checks.groupBy(group).agg(F.count_if(on).alias("n_selected"), F.count_if(on & (F.col("status") != "pending")).alias("n_analyzed"), F.count_if(on & F.col("presence").isin("present", "partial")).alias("n_present"), F.count_if(on & (F.col("presence") == "absent")).alias("n_absent"), F.count_if(on & (F.col("status") == "error")).alias("n_error"))


def field_counters(results: DataFrame, group: str) -> DataFrame:
    """results: final_value, status, cross_check. Absent: no longer pending and without value."""
    has = filled(F.col("final_value"))
    return results.groupBy(group).agg(F.count_if(has).alias("n_present"), F.count_if(~has & (F.col("status") != "pending")).alias("n_absent"), F.count_if(F.col("cross_check") == "incoherent").alias("n_incoherent"), F.count_if(F.col("status") == "error").alias("n_error"))


def with_corrections(proposals: DataFrame, corrections: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """proposals with final_* columns: the correction where there is one (a null corrects to null), else the proposal;
    proposals never change."""
    fixed = corrections.select(*key, *(F.col(c).alias(f"_fix_{c}") for c in columns), F.lit(True).alias("_fixed"))
    joined = proposals.join(fixed, key, "left")
    return joined.select(*proposals.columns, *(F.when(F.col("_fixed"), F.col(f"_fix_{c}")).otherwise(F.col(c)).alias(f"final_{c}") for c in columns), F.when(F.col("_fixed"), "corrected").otherwise("proposed").alias("decision"))


def at_or_after(status: Column, target: Column, order: list[str] = STATUSES) -> Column:
    """Whether a status has reached another; an unknown one never has."""
    listed = F.array(*map(F.lit, order))
    a, b = F.array_position(listed, status), F.array_position(listed, target)
    return F.coalesce((a > 0) & (b > 0) & (a >= b), F.lit(False))


def orphans(cache: DataFrame, docs: DataFrame, deleted: Column, key: str) -> DataFrame:
    """Cache rows of deleted documents that no other document uses."""
    gone = docs.where(deleted).select(key).distinct()
    kept = docs.where(~deleted).select(key).distinct()
    return cache.join(gone, key, "left_semi").join(kept, key, "left_anti")


def reopened(tables: dict[str, DataFrame], dossier: str, stage: str) -> dict[str, DataFrame]:
    """Tables after reopening a stage. Reorganisation drops both downstream results; completeness and extraction only
    turn their own final decisions back into proposals."""
    out = dict(tables)
    if stage == "reorganization":
        for name in ("checks", "results"):
            out[name] = tables[name].where(F.col("dossier_id") != dossier)
        status = "classified"
    else:
        status = {"completeness": "completeness_review", "extraction": "extraction_review"}[stage]
    out["dossiers"] = tables["dossiers"].withColumn("status", F.when(F.col("dossier_id") == dossier, status).otherwise(F.col("status")))
    return out


def without_dossier(tables: dict[str, DataFrame], dossier: str) -> dict[str, DataFrame]:
    """Tables without a dossier's rows and without the cache rows that only it used."""
    gone = orphans(tables["text_cache"], tables["documents"], F.col("dossier_id") == dossier, "content_hash")
    out = {n: t.where(F.col("dossier_id") != dossier) for n, t in tables.items() if "dossier_id" in t.columns}
    return out | {"text_cache": tables["text_cache"].join(gone.select("content_hash"), "content_hash", "left_anti")}


def progress(base: Column, touched: Column, total: Column) -> Column:
    """An optimistic counter never passes its total."""
    return F.least(base + touched, total)


def migrated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)
