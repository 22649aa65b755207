"""Rule classification and keyword candidates over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions.text import fold_accents
from quillframe.operators.scoring import Entry, classify, classify_files, score_rows, top_candidates
from quillframe.plans.book import SIGNALS_SQL, Book, signals

book = Book()


def _word(w: str) -> str:
    return f"(?i)(?<![A-Za-z0-9]){w}(?![A-Za-z0-9])"


CATALOG = [
    Entry("EN/FUNC", tuple(map(_word, ("the", "with", "this")))),
    Entry("EN/MORPH", ("(?i)tion", "(?i)ing", "(?i)ther")),
    Entry("FR/FUNC", tuple(map(_word, ("des", "dans", "une")))),
    Entry("ES/FUNC", tuple(map(_word, ("los", "por", "que")))),
    Entry("DE/FUNC", tuple(map(_word, ("und", "der", "nicht")))),
    Entry("ADMIN/LICENSE", ("(?i)license", "(?i)copyright", "(?i)mit license")),
]
FIELDS = [
    Entry("owner", ("(?i)password", "(?i)token", "(?i)licen[sc]e")),
    Entry("contact", (r"[a-z0-9.]+@[a-z0-9.]+", r"\+1 \(\d{3}\)")),
    Entry("article", ("(?i)tion", "(?i)ment", "(?i)ung")),
    Entry("accented", ("é", "ó", "ü")),
]


def _sql_pattern(p: str) -> str:
    if "(?<!" in p:
        word = p[len("(?i)(?<![A-Za-z0-9])") : -len("(?![A-Za-z0-9])")]
        p = f"(?i)(^|[^A-Za-z0-9]){word}([^A-Za-z0-9]|$)"
    return p.replace("'", "''")


def _catalog_sql(entries: list[Entry]) -> str:
    rows = ", ".join(f"('{e.name}', {i}, '{_sql_pattern(p)}')" for i, e in enumerate(entries) for p in e.patterns)
    return f"(SELECT * FROM (VALUES {rows}) AS t(name, ord, pattern))"


def _scores_sql(entries: list[Entry], text: str) -> str:
    return f"(SELECT doc_id, dossier, name, ord, count(*) AS score FROM {SIGNALS_SQL} d JOIN {_catalog_sql(entries)} c ON regexp_matches({text}, pattern) GROUP BY ALL)"


@book.query(f"""
WITH s AS (SELECT doc_id, name, ord, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn,
  score - coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, ord), 0) AS gap FROM {_scores_sql(CATALOG, "strip_accents(text)")})
SELECT doc_id, CASE WHEN score >= 2 AND gap >= 1 THEN name END AS category, score::INT AS score, gap::INT AS gap FROM s WHERE rn = 1""")
def classify_by_rules(spark, sf_dir):
    return classify(signals(spark, sf_dir), CATALOG, fold_accents(F.col("text")), "doc_id")


@book.query(f"SELECT doc_id, name, score::INT AS score FROM {_scores_sql(CATALOG, 'strip_accents(text)')}")
def pattern_scores(spark, sf_dir):
    return score_rows(signals(spark, sf_dir), CATALOG, fold_accents(F.col("text")), "doc_id").select("doc_id", "name", "score")


def _topk_sql(text: str) -> str:
    return f"""
SELECT name, dossier, doc_id, score::INT AS score, rn::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY name || '#' || dossier ORDER BY score DESC, doc_id) AS rn FROM {_scores_sql(FIELDS, text)}) WHERE rn <= 3"""


def _topk(docs, text):
    rows = score_rows(docs, FIELDS, text, "doc_id", "dossier").withColumn("grp", F.concat("name", F.lit("#"), "dossier"))
    return top_candidates(rows, "grp", "doc_id").select("name", "dossier", "doc_id", "score", "rank")


@book.query(_topk_sql("text"))
def keyword_topk_per_field(spark, sf_dir):
    return _topk(signals(spark, sf_dir), F.col("text"))


@book.query(_topk_sql("strip_accents(text)"))
def piece_candidates(spark, sf_dir):
    return _topk(signals(spark, sf_dir), fold_accents(F.col("text")))


@book.query(f"""
WITH f AS (SELECT doc_id, name, ord, score FROM {_scores_sql(CATALOG, "filename")}), t AS (SELECT doc_id, name, ord, score FROM {_scores_sql(CATALOG, "strip_accents(text)")})
SELECT doc_id, name, sum(score)::BIGINT AS score FROM (FROM f UNION ALL FROM t) GROUP BY doc_id, name""")
def combined_scores(spark, sf_dir):
    from quillframe.operators.scoring import combined

    docs = signals(spark, sf_dir)
    return combined(score_rows(docs, CATALOG, F.col("filename"), "doc_id"), score_rows(docs, CATALOG, fold_accents(F.col("text")), "doc_id"), "doc_id").select("doc_id", "name", "score")


NAMED = [*CATALOG, Entry("ADMIN/SCAN", ("(?i)scan", "(?i)untitled", "(?i)title"))]


@book.query(f"""
WITH f AS (SELECT doc_id, name, ord, score FROM {_scores_sql(NAMED, "CASE WHEN doc_id % 3 = 2 THEN 'scan of the title' ELSE '' END")}), t AS (SELECT doc_id, name, ord, score FROM {_scores_sql(NAMED, "strip_accents(text)")}),
b AS (SELECT doc_id, name, ord, sum(score) AS score FROM (FROM f UNION ALL FROM t) GROUP BY ALL),
s AS (SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn, score - coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, ord), 0) AS gap FROM b)
SELECT doc_id, CASE WHEN score >= 2 AND gap >= 1 THEN name END AS category, score::INT AS score, gap::INT AS gap FROM s WHERE rn = 1""")
def classify_named_files(spark, sf_dir):
    """Names and texts together; two names of three say nothing, though the catalog knows their words."""
    stem = F.when(F.col("doc_id") % 3 == 0, "scan 4").when(F.col("doc_id") % 3 == 1, "Untitled").otherwise("scan of the title")
    return classify_files(signals(spark, sf_dir), NAMED, stem, fold_accents(F.col("text")), "doc_id")
