"""Sections, citations, contexts and reports over documents, benchmark passages, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions.text import fold_citation
from quillframe.operators import citations, planning, reports
from quillframe.plans.book import SIGNALS_SQL, Book, signals
from quillframe.sources.tables import table

book = Book()
SECTIONS = [("ground", 0, ["CAT/DE", "CAT/EN"], ["src1", "-7"]), ("structure", 1, ["CAT/EN", "CAT/FR"], ["src2"]), ("roof", 2, ["CAT/ES"], [])]
FILTERED = ["CAT/EN"]
_SECTIONS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{s}', {p}, '{c}', {kws})" for s, _, cs, kw in SECTIONS for p, c in enumerate(cs) for kws in ["[" + ", ".join(f"'{k}'" for k in kw) + "]::VARCHAR[]"]) + ") AS t(section, pos, category, keywords))"


@book.query(f"""
SELECT section, doc_id, pos::INT AS pos FROM {_SECTIONS_SQL} s JOIN {SIGNALS_SQL} d USING (category)
WHERE category <> 'CAT/EN' OR len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(lower(filename || ' ' || lot), k))) > 0""")
def section_documents(spark, sf_dir):
    schema = "section string, ord int, pivots array<string>, keywords array<string>"
    sections = spark.createDataFrame(SECTIONS, schema)
    return planning.section_documents(sections, signals(spark, sf_dir), "doc_id", FILTERED)


@book.query(f"SELECT category, count(*) AS n, category IN ('CAT/FR', 'CAT/DE') AS is_pivot FROM {SIGNALS_SQL} GROUP BY category")
def cartography(spark, sf_dir):
    return reports.cartography(signals(spark, sf_dir), "category", ["CAT/FR", "CAT/DE"])


_LABELLED_SQL = "(SELECT 's' || (conv_id % 5) AS scope, conv_id * 100 + turn AS pos, 'Text [D' || (turn % 4 + 1) || '.' || (conv_id % 3 + 1) || '] and (D' || (conv_id % 6 + 1) || ', D9) end [D8]' AS text FROM conversations)"


def _labelled(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    parts = [F.lit("Text [D"), F.col("turn") % 4 + 1, F.lit("."), F.col("conv_id") % 3 + 1, F.lit("] and (D"), F.col("conv_id") % 6 + 1, F.lit(", D9) end [D8]")]
    return t.select(F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")).alias("scope"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.concat(*(p.cast("string") for p in parts)).alias("text"))


_REFS_SQL = "(SELECT DISTINCT 's' || (doc_id % 5) AS scope, CASE WHEN doc_id % 2 = 0 THEN 'D' || (doc_id % 6 + 1) ELSE 'D' || (doc_id % 4 + 1) || '.' || (doc_id % 3 + 1) END AS label, 'doc' || (doc_id % 4) AS document_id, 'f' || (doc_id % 4) AS filename, 'x' || (doc_id % 3) AS excerpt FROM documents)"


def _refs(spark, sf_dir):
    d = F.col("doc_id")
    n = lambda m, plus=0: (d % m + plus).cast("string")
    label = F.when(d % 2 == 0, F.concat(F.lit("D"), n(6, 1))).otherwise(F.concat(F.lit("D"), n(4, 1), F.lit("."), n(3, 1)))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), n(5)).alias("scope"), label.alias("label"), F.concat(F.lit("doc"), n(4)).alias("document_id"), F.concat(F.lit("f"), n(4)).alias("filename"), F.concat(F.lit("x"), n(3)).alias("excerpt")).distinct()


@book.query(f"""
WITH g AS (SELECT scope, pos, unnest(regexp_extract_all(text, 'D[0-9]+(?:[.][0-9]+)?')) AS label, generate_subscripts(regexp_extract_all(text, 'D[0-9]+(?:[.][0-9]+)?'), 1) AS n FROM {_LABELLED_SQL}),
f AS (SELECT document_id, scope, excerpt, min(filename) AS filename, min(pos * 1000 + n) AS first FROM g JOIN {_REFS_SQL} r USING (scope, label) GROUP BY 1, 2, 3)
SELECT 'c' || row_number() OVER (ORDER BY first, scope, document_id, excerpt) AS key, document_id, scope, filename, excerpt FROM f""")
def citation_registry(spark, sf_dir):
    return citations.registry(_labelled(spark, sf_dir), _refs(spark, sf_dir))


@book.query("""
WITH q AS (SELECT item_id AS cite_id, trim(regexp_replace(strip_accents(text), '[[:space:]]+', ' ', 'g')) AS t FROM benchmark), c AS (SELECT cite_id, lower(replace(t, '"', '')) AS folded FROM q),
p AS (SELECT doc_id AS page, lower(replace(trim(regexp_replace(strip_accents(text), '[[:space:]]+', ' ', 'g')), '"', '')) AS folded FROM documents)
SELECT cite_id, min(page) AS page FROM c JOIN p ON length(c.folded) >= 25 AND contains(p.folded, c.folded) GROUP BY cite_id""")
def citation_locate(spark, sf_dir):
    """First document that holds a whole passage."""
    cites = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cite_id"), fold_citation(F.col("text")).alias("fragment")).where(F.length("fragment") >= 25)
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), fold_citation(F.col("text")).alias("folded"))
    return citations.anywhere(cites, pages).groupBy("cite_id").agg(F.min("page").alias("page"))


_FOLD = "lower(replace(trim(regexp_replace(strip_accents({0}), '[[:space:]]+', ' ', 'g')), '\"', ''))"


@book.query(f"""
WITH c AS (SELECT conv_id * 100 + turn AS cite_id, conv_id AS document_id, turn AS own, {_FOLD.format("CASE WHEN turn % 2 = 0 THEN text ELSE left(text, 70) || ' and then quite another ending of it' END")} AS f FROM conversations),
p AS (SELECT conv_id AS document_id, turn AS page, {_FOLD.format("text")} AS folded FROM conversations),
l AS (SELECT cite_id, page, CASE WHEN length(f) >= 25 AND contains(folded, f) THEN length(f) {" ".join(f"WHEN length(f) > {n} AND contains(folded, left(f, {n})) THEN {n}" for n in (400, 200, 120, 60, 40))} END AS size, f, folded FROM c JOIN p USING (document_id) WHERE length(f) >= 25),
h AS (SELECT cite_id, page, size, strpos(folded, left(f, size)) AS position FROM l WHERE size IS NOT NULL)
SELECT cite_id, arg_min(page, page) AS page, arg_min(position, page)::INT AS position, arg_min(size, page)::INT AS length FROM h GROUP BY cite_id""")
def citation_pages(spark, sf_dir):
    """Each turn cited within its own conversation, in full or with another ending."""
    turns = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.left("text", F.lit(70)), F.lit(" and then quite another ending of it")))
    cites = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("cite_id"), F.col("conv_id").alias("document_id"), said.alias("citation"))
    pages = turns.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), fold_citation(F.col("text")).alias("folded"))
    return citations.locate(cites, pages).select("cite_id", "page", "position", "length")


@book.query("""
WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages)
SELECT folder, count(*) AS n_files FROM (SELECT unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS folder FROM p) GROUP BY folder""")
def tree_rollup(spark, sf_dir):
    return reports.tree_rollup(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "path")


@book.query(f"""
WITH c AS (SELECT d.dossier, d.doc_id, length(d.text) AS size, CASE WHEN quality = 1 THEN 'summary' WHEN quality = 0 THEN 'empty' ELSE 'raw' END AS kind FROM {SIGNALS_SQL} d LEFT JOIN labels USING (doc_id)),
l AS (SELECT doc_id, 'D' || row_number() OVER (PARTITION BY dossier ORDER BY doc_id) AS label FROM c WHERE kind = 'summary'),
b AS (SELECT dossier, list(doc_id ORDER BY doc_id) AS ids, list_reduce(list(least(size, 3000)::INT ORDER BY doc_id), lambda a, x: {{'rest': a.rest - least(x, a.rest), 'given': list_append(a.given, least(x, a.rest))}}, {{'rest': 9000::INT, 'given': []::INT[]}}) AS f FROM c WHERE kind = 'raw' GROUP BY dossier),
g AS (SELECT unnest(ids) AS doc_id, unnest(f.given) AS given FROM b)
SELECT dossier, doc_id, kind, label, given::INT AS given FROM c LEFT JOIN l USING (doc_id) LEFT JOIN g USING (doc_id)""")
def findings_context(spark, sf_dir):
    docs = signals(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select("dossier", "doc_id", F.length("text").alias("size"), F.when(F.col("quality") == 1, "summary").when(F.col("quality") == 0, "empty").otherwise("raw").alias("kind"))
    return planning.findings_context(docs, "dossier", "doc_id", total=9000, each=3000).drop("size")


@book.query(f"""SELECT dossier, sha256(string_agg('- ' || filename || ' (' || category || ')', chr(10) ORDER BY category, doc_id)) AS report, count(*) AS n_lines FROM {SIGNALS_SQL} GROUP BY dossier""")
def report_lines(spark, sf_dir):
    line = F.concat(F.lit("- "), "filename", F.lit(" ("), "category", F.lit(")"))
    body = reports.lines_by(signals(spark, sf_dir), "dossier", ["category", "doc_id"], line)
    return body.select("dossier", F.sha2("body", 256).alias("report"), F.size(F.split("body", "\n")).cast("long").alias("n_lines"))


_REPORT = "'# r' || chr(10) || '## Theme ' || conv_id || chr(10) || text || chr(10) || CASE WHEN turn % 2 = 0 THEN '**Divergence** : a' || chr(10) ELSE '' END || 'non précisé, Non fourni' || chr(10) || '## Other' || chr(10) || 'x'"


@book.query(f"""
SELECT conv_id, turn, title, sha256(body) AS body, divergences, absences FROM (
  SELECT conv_id, turn, 'Theme ' || conv_id AS title, regexp_replace(regexp_replace(text || chr(10) || 'non précisé, Non fourni', '^[[:space:]]+', ''), '[[:space:]]+$', '') AS body, (turn % 2 = 0)::INT AS divergences, 2 AS absences FROM conversations
  UNION ALL SELECT conv_id, turn, 'Other', 'x', 0, 0 FROM conversations)""")
def synthese_parse(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    made = F.concat(F.lit("# r\n## Theme "), F.col("conv_id").cast("string"), F.lit("\n"), "text", F.lit("\n"), F.when(F.col("turn") % 2 == 0, "**Divergence** : a\n").otherwise(""), F.lit("non précisé, Non fourni\n## Other\nx"))
    return t.select("conv_id", "turn", F.inline(reports.narrative_topics(made))).select("conv_id", "turn", "title", F.sha2("body", 256).alias("body"), F.size("divergences").alias("divergences"), "absences")


@book.query(f"""SELECT dossier, sha256(to_json(list({{'doc_id': doc_id, 'category': category, 'filename': filename}} ORDER BY category, doc_id))::VARCHAR) AS report FROM {SIGNALS_SQL} GROUP BY dossier""")
def report_json(spark, sf_dir):
    """The frozen JSON form of a dossier's report."""
    frozen = reports.frozen_json(signals(spark, sf_dir), "dossier", ["category", "doc_id"], "doc_id", "category", "filename")
    return frozen.select("dossier", F.sha2("report", 256).alias("report"))


@book.query(f"""
SELECT dossier, lot AS phase, sha256('## ' || lot || chr(10) || chr(10) || '| File | Category | Confidence |' || chr(10) || '|---|---|---|' || chr(10)
  || string_agg('| ' || filename || ' | ' || category || ' | ' || (doc_id % 100) || ' % |', chr(10) ORDER BY category, doc_id)) AS body, count(*) AS n_files FROM {SIGNALS_SQL} GROUP BY dossier, lot""")
def report_markdown(spark, sf_dir):
    """The markdown form of a dossier's report, a table for each phase."""
    row = F.struct(F.col("filename").alias("c0"), F.col("category").alias("c1"), F.concat((F.col("doc_id") % 100).cast("string"), F.lit(" %")).alias("c2"))
    phases = signals(spark, sf_dir).groupBy("dossier", F.col("lot").alias("phase")).agg(F.array_sort(F.collect_list(F.struct("category", "doc_id", row.alias("row")))).alias("rows"), F.count("*").alias("n_files"))
    body = F.concat(F.lit("## "), "phase", F.lit("\n\n"), reports.markdown_table(["File", "Category", "Confidence"], F.transform("rows", lambda r: r["row"])))
    return phases.select("dossier", "phase", F.sha2(body, 256).alias("body"), "n_files")


@book.query("SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS n_divergences, 2 * count(*) AS n_absences FROM conversations GROUP BY conv_id")
def topic_totals(spark, sf_dir):
    """Divergences and absences over the topics of all reports of a conversation."""
    turns = table(spark, sf_dir, "conversations")
    told = F.concat(F.lit("# r\n## Theme\n"), "text", F.lit("\n"), F.when(F.col("turn") % 2 == 0, "**Divergence** : a\n").otherwise(""), F.lit("non précisé, Non fourni"))
    return reports.topic_totals(turns.select("conv_id", F.inline(reports.narrative_topics(told))), "conv_id")
