"""Catalog loaders, filters, results and the vector cache on small invented cases."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from quillframe.operators import filters, reports, results, scoring, vector_cache
from quillframe.plans.results import CHECKLIST, FIELDS, TAXONOMY, TOPICS
from quillframe.sources import catalogs


def changed(raw: dict, rows: str, i: int, **values) -> dict:
    raw = copy.deepcopy(raw)
    raw[rows][i] |= values
    return raw


def test_catalogs_load(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TAXONOMY))
    found = catalogs.categories(spark, catalogs.read_json(spark, str(tmp_path / "t.json")))
    assert [(r.path, r.ord, r.is_fallback, r.doc_type) for r in found.orderBy("ord").collect()] == [("CAT/EN", 0, False, "NOTE"), ("CAT/FR", 1, False, "AUTRES"), ("OTHER", 2, True, "AUTRES")]
    assert catalogs.pieces(spark, CHECKLIST).count() == 4 and catalogs.topics(spark, TOPICS).count() == 3
    assert {(r.field, r.section_label) for r in catalogs.fields(spark, FIELDS).collect()} == {("f0", "Who"), ("f1", "Who"), ("f2", "What"), ("f3", "What")}
    audit = {"sections": [{"id": "s", "title": "S", "pivots": ["a"], "instructions": "do", "aspects": ["clay"]}]}
    assert catalogs.audit_sections(spark, audit, ["clay"]).first().aspects == ["clay"]
    assert catalogs.pieces(spark, {}).count() == 0
    assert catalogs.entries(found, "path", "content_patterns")[1] == scoring.Entry("CAT/FR", ("é", "(?i)ment"))


@pytest.mark.parametrize(("load", "raw", "fault"), [
    (catalogs.categories, TAXONOMY | {"fallback_category": "GONE"}, "fallback"),
    (catalogs.categories, changed(TAXONOMY, "categories", 0, content_patterns=["ok", "(broken"]), "'(broken'"),
    (catalogs.categories, changed(TAXONOMY, "categories", 0, label=""), "'label'"),
    (catalogs.pieces, changed(CHECKLIST, "pieces", 1, id="p0"), "2 times"),
    (catalogs.fields, changed(FIELDS, "fields", 0, section="nowhere"), "unknown section"),
    (catalogs.fields, changed(FIELDS, "sections", 1, id="who"), "2 times"),
    (catalogs.topics, changed(TOPICS, "topics", 0, pivots=[]), "lacks 'pivots'"),
    (catalogs.topics, changed(TOPICS, "topics", 2, fields=[]), "lacks 'fields'"),
    (catalogs.topics, changed(TOPICS, "topics", 1, most_lines=0), "no lines"),
    (catalogs.topics, changed(TOPICS, "topics", 1, source="rumour"), "unknown source"),
    (lambda s, r: catalogs.audit_sections(s, r, ["clay"]), {"sections": [{"id": "s", "title": "S", "pivots": ["a"], "instructions": "do", "aspects": ["radon"]}]}, "unknown aspect"),
])
def test_faulty_catalogs_are_refused(spark, load, raw, fault):
    with pytest.raises(catalogs.CatalogError, match="(?s).*" + fault.replace("(", r"\(")):
        load(spark, raw)


def test_names_that_say_nothing(spark):
    rows = spark.createDataFrame([("scan 12",), ("IMG_0001",), ("Sans titre",), ("CCTP lot 3",), (" document (2) ",)], "n string")
    assert [r.g for r in rows.select(scoring.says_nothing(F.col("n")).alias("g")).collect()] == [True, True, True, False, True]


def test_titles_of_an_index(spark):
    titles = ["Short", "Qualification de l'opération, volumétrie", "Une phrase bien trop longue pour tenir ici", "x" * 40, "(only)"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select(reports.short_title(F.col("t")).alias("s"), reports.anchor(F.col("t"), F.lit(3)).alias("a")).collect()
    assert [r.s for r in rows] == ["Short", "Qualification de l'opération", "Une phrase bien trop longue…", "x" * 30 + "…", "(only)"]
    assert rows[1].a == "theme-3-qualification-de-l-operation-volumetrie" and rows[4].a == "theme-3-only"


def test_empty_selections_never_filter(spark):
    rows = spark.createDataFrame([("a", "s"), ("dismissed", "t"), (None, "t")], "status string, section string")
    assert rows.where(filters.risk_filter(F.col("status"), F.col("section"), [], [])).count() == 3
    assert rows.where(filters.shown_status(F.col("status"), ["dismissed"])).count() == 1 and rows.where(filters.allowed_nature(F.col("status"), [])).count() == 3
    assert rows.where(filters.allowed_type(F.col("status"), ["dis"])).count() == 2 and rows.where(filters.dossier_search(F.col("section"), F.col("status"), "  ", [])).count() == 3


def test_a_cached_content_is_used_whole_or_not_at_all(spark, tmp_path):
    vectors = spark.createDataFrame([("x", 0, [1.0, 0.0]), ("x", 1, [0.0, 1.0]), ("y", 0, [1.0])], "text_sha string, chunk_no int, vector array<double>")
    vector_cache.appended(vectors, str(tmp_path / "v"), model="m", chunk_max=800)
    cache = spark.read.parquet(str(tmp_path / "v"))
    good = vector_cache.usable(cache, model="m", chunk_max=800, dimension=2)
    assert sorted((r.text_sha, r.chunk_no) for r in good.collect()) == [("x", 0), ("x", 1)]
    assert vector_cache.usable(cache, model="m", chunk_max=400, dimension=2).count() == 0
    chunks = spark.createDataFrame([("x", 0), ("x", 1), ("x", 2), ("y", 0), ("y", 0)], "text_sha string, chunk_no int")
    assert sorted((r.text_sha, r.chunk_no) for r in vector_cache.missing(chunks, good).collect()) == [("x", 0), ("x", 1), ("x", 2), ("y", 0)]


def test_a_correction_to_null_counts(spark):
    from quillframe.operators.state import with_corrections

    fixed = with_corrections(spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, None)], "id int, v string"), ["id"], "v").first()
    assert (fixed.final_v, fixed.decision) == (None, "corrected")


def test_proposals_start_as_final_values(spark):
    row = results.proposed(spark.createDataFrame([(1, "a", "boom")], "id int, category string, error string"), "category").first()
    assert (row.proposed_category, row.final_category, row.status) == ("a", "a", "error")
