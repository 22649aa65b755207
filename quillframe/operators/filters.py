"""Filters of results, notices and dossiers. An empty selection never filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.state import filled


def manual_scope(candidates: DataFrame, docs: DataFrame, chosen: DataFrame | None, fields: list[str], doc: str) -> DataFrame:
    """Candidates of a run. Without a choice of documents these are the given ones; a choice takes the place of the
    category filter: every chosen document with text is a candidate of every field, in the documents' order.

    candidates: field, doc, rank; docs: doc, text; chosen: doc.
    """
    if chosen is None:
        return candidates
    scope = docs.where(F.length("text") > 0).join(chosen.select(doc).distinct(), doc, "left_semi").select(doc)
    return scope.select(F.explode(F.array(*map(F.lit, fields))).alias("field"), doc, F.col(doc).alias("rank"))


def allowed_nature(nature: Column, excluded: list[str]) -> Column:
    """Whether a notice's nature is none of the excluded ones, whatever the case; a missing one is allowed."""
    upper = F.upper(F.coalesce(nature, F.lit("")))
    return ~upper.isin(*(e.upper() for e in excluded)) if excluded else F.lit(True)


def allowed_type(notice_type: Column, prefixes: list[str]) -> Column:
    """Whether a notice's type starts with none of the prefixes; a missing one is allowed."""
    return ~F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.coalesce(notice_type, F.lit("")), p)) if prefixes else F.lit(True)


def shown_status(status: Column, chosen: list[str], hidden: str = "dismissed") -> Column:
    """The chosen statuses; without a choice all but the hidden one."""
    return status.isin(*chosen) if chosen else status != hidden


def field_filter(value: Column, cross_check: Column, which: str) -> Column:
    """Absent, coherent or incoherent entries of an extraction; any other choice is all of them."""
    tests = {"absent": ~filled(value), "coherent": cross_check == "coherent", "incoherent": cross_check == "incoherent"}
    return F.coalesce(tests.get(which, F.lit(True)), F.lit(False))


def risk_filter(status: Column, section: Column, statuses: list[str], sections: list[str]) -> Column:
    return (status.isin(*statuses) if statuses else F.lit(True)) & (section.isin(*sections) if sections else F.lit(True))


def dossier_search(name: Column, bucket: Column, query: str, buckets: list[str]) -> Column:
    """Dossiers whose file name holds the query in any case and whose status is in one of the buckets."""
    holds = F.contains(F.lower(name), F.lit(query.strip().lower())) if query.strip() else F.lit(True)
    return holds & (bucket.isin(*buckets) if buckets else F.lit(True))


def divergent(topics: DataFrame) -> DataFrame:
    """Topics with at least one line of divergence."""
    return topics.where(F.size("divergences") > 0)
