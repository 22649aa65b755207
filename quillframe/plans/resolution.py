"""Outcome resolution, call plans and counters over documents, labels and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import planning, resolve, state
from quillframe.operators.scoring import score_rows
from quillframe.plans.book import SIGNALS_SQL, Book, signals
from quillframe.plans.scoring import FIELDS, _scores_sql
from quillframe.sources.tables import table

book = Book()
PIECES = [("piece_en", "CAT/EN"), ("piece_fr", "CAT/FR"), ("piece_es", "CAT/ES"), ("piece_de", "CAT/DE"), ("piece_it", "CAT/IT")]
REFERENCES = [("address", 0, ["CAT/FR", "CAT/EN"]), ("owner", 1, ["CAT/EN"]), ("amount", 2, ["CAT/DE", "CAT/ES", "CAT/FR"]), ("date", 3, ["CAT/ES"])]
PIECES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in PIECES) + ") AS t(piece, category))"
REFERENCES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{f}', {o}, {i}, '{c}')" for f, o, cs in REFERENCES for i, c in enumerate(cs)) + ") AS t(field, ord, pos, category))"


def _references(spark):
    return spark.createDataFrame(REFERENCES, "field string, ord int, categories array<string>")


@book.query(f"""
SELECT piece, count(doc_id) AS n_docs, min(confidence) AS least_confidence,
  CASE WHEN count(doc_id) = 0 THEN NULL WHEN min(confidence) < 0.75 THEN 'probable' ELSE 'certain' END AS certainty
FROM {PIECES_SQL} p LEFT JOIN {SIGNALS_SQL} d USING (category) GROUP BY piece""")
def piece_file_match(spark, sf_dir):
    pieces = spark.createDataFrame(PIECES, "piece string, category string")
    return resolve.file_match(pieces, signals(spark, sf_dir).select(F.col("doc_id").alias("doc"), "category", "confidence"))


@book.query(f"""
WITH l AS (SELECT DISTINCT lot FROM {SIGNALS_SQL}), d AS (SELECT DISTINCT dossier, lot FROM {SIGNALS_SQL}), g AS (SELECT DISTINCT dossier FROM d)
SELECT dossier, (SELECT string_agg(lot, ',' ORDER BY lot) FROM d WHERE d.dossier = g.dossier) AS covered,
  coalesce((SELECT string_agg(lot, ',' ORDER BY lot) FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.dossier = g.dossier AND d.lot = l.lot)), '') AS missing,
  CASE WHEN (SELECT count(*) FROM d WHERE d.dossier = g.dossier) < (SELECT count(*) FROM l) THEN 'partial' ELSE 'present' END AS presence
FROM g""")
def lot_coverage(spark, sf_dir):
    docs = signals(spark, sf_dir)
    lots = docs.select(F.array_sort(F.collect_set("lot"))).scalar()
    found = resolve.lot_coverage(docs, "dossier", "lot", lots)
    return found.select("dossier", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), "presence")


def _ranked(spark, sf_dir):
    """Candidates of each field: all scoring documents, ranked by score."""
    rows = score_rows(signals(spark, sf_dir), FIELDS, F.col("text"), "doc_id")
    return rows.select(F.col("name").alias("field"), "doc_id", F.struct((-F.col("score")).alias("neg"), "doc_id").alias("rank"))


_RANKED_SQL = f"(SELECT name AS field, doc_id, row_number() OVER (PARTITION BY name ORDER BY score DESC, doc_id) AS rank FROM {_scores_sql(FIELDS, 'text')})"


def _each(names):
    return F.explode(F.array(*map(F.lit, names)))


@book.query(f"""
WITH j AS (SELECT c.field, c.doc_id, c.rank, l.quality, l.toxic FROM {_RANKED_SQL} c LEFT JOIN labels l USING (doc_id))
SELECT field, arg_min(doc_id, rank) FILTER (quality = 1 AND toxic = 0) AS doc_id,
  CASE WHEN count(*) FILTER (quality = 1 AND toxic = 0) > 0 THEN 'present' ELSE 'absent' END AS presence,
  CASE WHEN count(*) FILTER (quality = 1 AND toxic = 0) = 0 AND count(*) FILTER (toxic = 1) > 0 THEN 'failed' END AS error,
  CASE WHEN count(*) FILTER (quality = 1 AND toxic = 0) > 0 THEN 'llm' WHEN count(*) FILTER (toxic = 1) > 0 THEN 'content' ELSE 'none' END AS layer
FROM j GROUP BY field""")
def layer_resolution(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    decisions = labels.select(_each(e.name for e in FIELDS).alias("field"), "doc_id", F.when(F.col("quality") == 1, "present").otherwise("absent").alias("presence"), F.lit(0.8).alias("confidence"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return resolve.first_match(_ranked(spark, sf_dir), decisions, "field", "doc_id").select("field", "doc_id", "presence", "error", "layer")


@book.query(f"""
WITH j AS (SELECT c.field, c.doc_id, c.rank, l.quality, l.toxic FROM {_RANKED_SQL} c LEFT JOIN labels l USING (doc_id))
SELECT field, arg_min(doc_id, rank) FILTER (quality = 1) AS doc_id, 'v' || (arg_min(doc_id, rank) FILTER (quality = 1) % 7) AS value,
  CASE WHEN count(*) FILTER (quality = 1) = 0 AND count(*) FILTER (toxic = 1) > 0 THEN 'failed' END AS error
FROM j GROUP BY field""")
def first_confirming(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    decisions = labels.select(_each(e.name for e in FIELDS).alias("field"), "doc_id", (F.col("quality") == 1).alias("found"), F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string")).alias("value"), F.lit(0.8).alias("confidence"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return resolve.first_confirming(_ranked(spark, sf_dir), decisions, "field", "doc_id").select("field", "doc_id", "value", "error")


@book.query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN ' ' || l_returnflag ELSE lower(l_returnflag) END AS value, l_discount AS confidence FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, value, confidence) AS n FROM s), f AS (SELECT * FROM r WHERE n <= 2)
SELECT l_orderkey, count(*) AS n_sources, arg_max(value, confidence * 1000 - n) AS value, max(confidence) AS confidence,
  CASE WHEN count(*) = 1 THEN 'single_source' WHEN count(DISTINCT lower(trim(value))) = 1 THEN 'coherent' ELSE 'incoherent' END AS status
FROM f GROUP BY l_orderkey""")
def cross_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), "l_returnflag")).otherwise(F.lower("l_returnflag"))
    sources = lines.select("l_orderkey", value.alias("value"), F.col("l_discount").alias("confidence"), "l_linenumber")
    return resolve.cross_check(sources.withColumn("rank", F.struct("l_linenumber", "value", "confidence")), "l_orderkey")


@book.query(f"""
SELECT field, doc_id, row_number() OVER (PARTITION BY field ORDER BY pos, doc_id)::INT AS rank FROM {REFERENCES_SQL} r JOIN {SIGNALS_SQL} d USING (category) WHERE length(text) > 0""")
def reference_candidates(spark, sf_dir):
    return planning.reference_candidates(_references(spark), signals(spark, sf_dir), "doc_id")


@book.query(f"""
SELECT doc_id, batch, string_agg(field, ',' ORDER BY ord) AS fields FROM (
  SELECT doc_id, field, ord, ((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 2)::BIGINT AS batch FROM {REFERENCES_SQL} r JOIN {SIGNALS_SQL} d USING (category)) GROUP BY doc_id, batch""")
def call_plan_batches(spark, sf_dir):
    return planning.call_batches(_references(spark), signals(spark, sf_dir), "doc_id", size=2)


@book.query(f"""
SELECT d.dossier, f.field FROM (SELECT DISTINCT dossier FROM {SIGNALS_SQL}) d, (SELECT DISTINCT field FROM {REFERENCES_SQL}) f
WHERE NOT EXISTS (SELECT 1 FROM {_scores_sql(FIELDS, 'text')} s WHERE s.dossier = d.dossier AND s.name = f.field AND score >= 2)""")
def missing_fields(spark, sf_dir):
    docs = signals(spark, sf_dir)
    wanted = docs.select("dossier").distinct().select("dossier", _each(f for f, _, _ in REFERENCES).alias("field"))
    found = score_rows(docs, FIELDS, F.col("text"), "dossier").where("score >= 2").select("dossier", F.col("name").alias("field"))
    return planning.missing(wanted, found, "dossier", "field")


@book.query("""
SELECT source AS dossier, count(*) AS n_total, count(*) FILTER (quality IS NOT NULL) AS n_extracted, count(*) FILTER (lang = 'de') AS n_not_analyzable,
  count(*) FILTER (lang = 'de' AND n_chars > 2000) AS n_at_risk, count(*) FILTER (toxic = 1 AND quality IS NULL) AS n_error, count(*) FILTER (quality = 1 OR toxic = 1) AS n_classified
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def dossier_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ready = docs.select(
        F.col("source").alias("dossier"), (F.coalesce("lang", F.lit("")) != "de").alias("analyzable"), (F.col("n_chars") > 2000).alias("at_risk"),
        F.when(F.col("quality").isNotNull(), "text_extracted").when(F.col("toxic") == 1, "error").otherwise("pending").alias("stage"),
        F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "proposed").otherwise("pending").alias("class_status"),
    )
    return state.document_counters(ready, "dossier")


@book.query("""
SELECT doc_id % 10 AS dossier, count(*) FILTER (doc_id % 3 <> 0) AS n_selected, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS n_analyzed,
  count(*) FILTER (doc_id % 3 <> 0 AND quality = 1) AS n_present, count(*) FILTER (doc_id % 3 <> 0 AND quality = 0) AS n_absent, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND toxic = 1) AS n_error
FROM labels GROUP BY 1""")
def completeness_counters(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("doc_id") % 5 == 0, "pending").when(F.col("toxic") == 1, "error").otherwise("proposed")
    checks = labels.select((F.col("doc_id") % 10).alias("dossier"), (F.col("doc_id") % 3 != 0).alias("selected"), F.when(F.col("quality") == 1, "present").otherwise("absent").alias("presence"), status.alias("status"))
    return state.piece_counters(checks, "dossier")


@book.query("""
SELECT source AS dossier, count(*) FILTER (v <> '') AS n_present, count(*) FILTER (v = '' AND quality IS NOT NULL) AS n_absent, count(*) FILTER (toxic = 1) AS n_incoherent, count(*) FILTER (quality = 0) AS n_error
FROM (SELECT *, CASE WHEN quality = 1 AND toxic = 0 THEN lang ELSE '' END AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source""")
def extraction_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    value = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("lang")).otherwise("")
    results = docs.select(F.col("source").alias("dossier"), value.alias("final_value"), F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 0, "error").otherwise("proposed").alias("status"), F.when(F.col("toxic") == 1, "incoherent").otherwise("coherent").alias("cross_check"))
    return state.field_counters(results, "dossier")


@book.query("""
SELECT d.doc_id, lang AS proposed, coalesce(CASE WHEN l.toxic = 1 THEN 'fix-' || l.quality END, lang) AS final_proposed, CASE WHEN l.toxic = 1 THEN 'corrected' ELSE 'proposed' END AS decision
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1""")
def corrections_overlay(spark, sf_dir):
    proposals = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("proposed"))
    fixes = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.concat(F.lit("fix-"), F.col("quality").cast("string")).alias("proposed"))
    return state.with_corrections(proposals, fixes, ["doc_id"], "proposed")
