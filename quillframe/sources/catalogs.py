"""Catalogs: short tables that a user brings, checked once and then joined or turned into score entries.

A catalog is read from JSON (any path that Spark's text reader opens) or given as parsed data. Each loader checks what
its rows must hold and raises ``CatalogError`` with every fault it finds; patterns are compiled where they are used, so a
pattern that Spark's engine refuses is a fault as well.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.scoring import Entry

CATEGORY = "path string, ord int, label string, alt_names array<string>, filename_patterns array<string>, content_patterns array<string>, lot_aware boolean, doc_type string, is_pivot boolean, is_fallback boolean"
PIECE = "piece string, ord int, label string, phase string, alias array<string>, category string, required boolean, may_hide boolean, patterns array<string>, per_lot boolean, date_check string, fallback string"
SECTION = "section string, section_ord int, section_label string"
FIELD = "field string, ord int, label string, section string, expected string, categories array<string>, patterns array<string>"
TOPIC = "topic string, ord int, title string, format string, source string, most_lines int, fields array<string>, pivots array<string>, grounding array<string>, cross_document boolean, instructions string"
AUDIT = "section string, ord int, title string, pivots array<string>, keywords array<string>, aspects array<string>, points string, instructions string"
TOPIC_SOURCES = ("extraction_fields", "documents")


class CatalogError(ValueError):
    """The faults of a catalog, one a line."""


def read_json(spark: SparkSession, path: str):
    """The parsed JSON of one file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _checked(faults: list[str]) -> None:
    if faults:
        raise CatalogError("\n".join(faults))


def _unique(kind: str, names: list[str]) -> list[str]:
    return [f"{kind} {n!r} stands {k} times" for n, k in Counter(names).items() if k > 1]


def _lacking(kind: str, rows: list[dict], *needed: str) -> list[str]:
    return [f"{kind} {i} lacks {k!r}" for i, r in enumerate(rows) for k in needed if not r.get(k)]


def _pattern_faults(spark: SparkSession, rows: list[dict], *keys: str) -> list[str]:
    """Patterns that the engine cannot compile: only if one fails for all are they tried one by one."""
    found = sorted({p for r in rows for k in keys for p in r.get(k) or []})

    def fails(patterns: list[str]) -> bool:
        try:
            spark.range(1).select(*(F.regexp_like(F.lit(""), F.lit(p)) for p in patterns)).collect()
            return False
        except Exception:  # an unreadable pattern is data here
            return True

    return [f"pattern {p!r} cannot be read" for p in found if fails([p])] if found and fails(found) else []


def _table(spark: SparkSession, rows: list[dict], schema: str, row: Callable[[dict], tuple]) -> DataFrame:
    return spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(map(row, rows))], schema)


def categories(spark: SparkSession, raw: dict) -> DataFrame:
    """The taxonomy; the fallback category must be one of its rows."""
    rows = raw.get("categories") or []
    fallback = raw.get("fallback_category")
    faults = _lacking("category", rows, "path", "label") + _unique("category", [r.get("path") for r in rows]) + _pattern_faults(spark, rows, "filename_patterns", "content_patterns")
    _checked(faults + ([] if fallback in [r.get("path") for r in rows] else [f"fallback {fallback!r} is no category"]))
    return _table(spark, rows, CATEGORY, lambda r: (r["path"], r["label"], r.get("alt_names", []), r.get("filename_patterns", []), r.get("content_patterns", []), bool(r.get("lot_aware")), r.get("doc_type", "AUTRES"), bool(r.get("is_pivot")), r["path"] == fallback))


def pieces(spark: SparkSession, raw: dict) -> DataFrame:
    """The checklist of expected pieces; their ids are unique."""
    rows = raw.get("pieces") or []
    _checked(_lacking("piece", rows, "id", "label", "phase") + _unique("piece", [r.get("id") for r in rows]) + _pattern_faults(spark, rows, "patterns"))
    return _table(spark, rows, PIECE, lambda r: (r["id"], r["label"], r["phase"], r.get("alias", []), r.get("category"), bool(r.get("required")), bool(r.get("may_hide")), r.get("patterns", []), bool(r.get("per_lot")), r.get("date_check"), r.get("fallback")))


def fields(spark: SparkSession, raw: dict) -> DataFrame:
    """The fields to extract, each with its section's place and label; ids are unique and sections known."""
    sections, rows = raw.get("sections") or [], raw.get("fields") or []
    known = [s.get("id") for s in sections]
    faults = _lacking("section", sections, "id", "label") + _lacking("field", rows, "id", "label", "section") + _unique("section", known) + _unique("field", [r.get("id") for r in rows]) + _pattern_faults(spark, rows, "patterns")
    _checked(faults + [f"field {r.get('id')!r} names an unknown section {r.get('section')!r}" for r in rows if r.get("section") not in known])
    listed = _table(spark, rows, FIELD, lambda r: (r["id"], r["label"], r["section"], r.get("expected"), r.get("categories", []), r.get("patterns", [])))
    return listed.join(F.broadcast(_table(spark, sections, SECTION, lambda s: (s["id"], s["label"]))), "section", "left")  # the catalog's own table


def topics(spark: SparkSession, raw: dict) -> DataFrame:
    """The topics of a synthesis: what a topic needs depends on where it comes from."""
    rows = raw.get("topics") or []
    faults = _lacking("topic", rows, "id", "title", "format", "source") + _unique("topic", [r.get("id") for r in rows])
    for r in rows:
        name, source = r.get("id"), r.get("source")
        if source and source not in TOPIC_SOURCES:
            faults.append(f"topic {name!r} has an unknown source {source!r}")
        if r.get("most_lines") is not None and r["most_lines"] <= 0:
            faults.append(f"topic {name!r} has no lines")
        needed = {"extraction_fields": ("fields",), "documents": ("pivots", "instructions")}.get(source, ())
        faults += [f"topic {name!r} of {source} lacks {k!r}" for k in needed if not r.get(k)]
    _checked(faults)
    return _table(spark, rows, TOPIC, lambda r: (r["id"], r["title"], r["format"], r["source"], r.get("most_lines"), r.get("fields", []), r.get("pivots", []), r.get("grounding", []), bool(r.get("cross_document")), r.get("instructions")))


def audit_sections(spark: SparkSession, raw: dict, aspects: list[str]) -> DataFrame:
    """The sections of an audit; their aspects come from a closed set."""
    rows = raw.get("sections") or []
    faults = _lacking("section", rows, "id", "title", "pivots", "instructions") + _unique("section", [r.get("id") for r in rows])
    _checked(faults + [f"section {r.get('id')!r} names an unknown aspect {a!r}" for r in rows for a in r.get("aspects") or [] if a not in aspects])
    return _table(spark, rows, AUDIT, lambda r: (r["id"], r["title"], r["pivots"], r.get("keywords", []), r.get("aspects", []), r.get("points"), r["instructions"]))


def entries(catalog: DataFrame, name: str, patterns: str) -> list[Entry]:
    """A catalog's rows as score entries, in its order; the driver holds a catalog anyway."""
    return [Entry(r[0], tuple(r[1] or ())) for r in catalog.orderBy("ord").select(name, patterns).collect()]


def with_category(docs: DataFrame, catalog: DataFrame, category: str) -> DataFrame:
    """docs with their category's label, document type and lot rule; an unknown category takes the fallback's."""
    rows = catalog.select(F.col("path").alias("_path"), "label", "doc_type", "lot_aware")
    fallback = catalog.where("is_fallback").select(F.col("path").alias("_fallback")).first()[0]
    known = [r[0] for r in catalog.select("path").collect()]
    resolved = docs.withColumn("final_category", F.when(F.col(category).isin(*known), F.col(category)).otherwise(fallback))
    return resolved.join(F.broadcast(rows), F.col("final_category") == F.col("_path")).drop("_path")  # the catalog's own table
