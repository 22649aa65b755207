"""Catalogs, results, report joins and result filters over documents, labels, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import filters, planning, reports, results, retrieval, scoring, vector_cache
from quillframe.plans.book import SIGNALS_SQL, Book, signals
from quillframe.plans.resolution import REFERENCES, REFERENCES_SQL
from quillframe.plans.scoring import CATALOG, _scores_sql
from quillframe.sources import catalogs
from quillframe.sources.tables import table

book = Book()

TAXONOMY = {
    "fallback_category": "OTHER",
    "categories": [
        {"path": "CAT/EN", "label": "English", "content_patterns": ["(?i)tion", "(?i)ther"], "doc_type": "NOTE", "lot_aware": True},
        {"path": "CAT/FR", "label": "French", "content_patterns": ["é", "(?i)ment"], "is_pivot": True},
        {"path": "OTHER", "label": "Other", "content_patterns": ["@"]},
    ],
}
CHECKLIST = {"pieces": [{"id": f"p{i}", "label": f"Piece {i}", "phase": phase, "required": i % 2 == 0} for i, phase in enumerate(("tender", "tender", "works", "handover"))]}
FIELDS = {
    "sections": [{"id": "who", "label": "Who"}, {"id": "what", "label": "What"}, {"id": "unused", "label": "Unused"}],
    "fields": [{"id": f"f{i}", "label": f"Field {i}", "section": "who" if i < 2 else "what", "expected": "text" if i % 2 else None, "patterns": [r"\bown(er)?\b", "[a-z]?name", r"\d+ ?kg"][:i]} for i in range(4)],
}
TOPICS = {
    "topics": [
        {"id": "a", "title": "Theme A", "format": "list", "source": "documents", "pivots": ["CAT/FR", "CAT/EN"], "instructions": "read"},
        {"id": "b", "title": "Theme B", "format": "text", "source": "documents", "pivots": ["CAT/EN"], "instructions": "read"},
        {"id": "c", "title": "Theme C", "format": "text", "source": "extraction_fields", "fields": ["f1"]},
    ]
}


@book.query(f"""
SELECT doc_id, f AS final_category, CASE f WHEN 'CAT/EN' THEN 'English' WHEN 'CAT/FR' THEN 'French' ELSE 'Other' END AS label, CASE f WHEN 'CAT/EN' THEN 'NOTE' ELSE 'AUTRES' END AS doc_type, f = 'CAT/EN' AS lot_aware
FROM (SELECT doc_id, CASE WHEN category IN ('CAT/EN', 'CAT/FR') THEN category ELSE 'OTHER' END AS f FROM {SIGNALS_SQL})""")
def category_rows(spark, sf_dir):
    return catalogs.with_category(signals(spark, sf_dir), catalogs.categories(spark, TAXONOMY), "category").select("doc_id", "final_category", "label", "doc_type", "lot_aware")


@book.query(f"""
SELECT doc_id, name, score::INT AS score FROM (SELECT doc_id, name, count(*) AS score FROM {SIGNALS_SQL} d
  JOIN (VALUES ('CAT/EN', '(?i)tion'), ('CAT/EN', '(?i)ther'), ('CAT/FR', 'é'), ('CAT/FR', '(?i)ment'), ('OTHER', '@')) c(name, pattern) ON regexp_matches(text, pattern) GROUP BY ALL)""")
def catalog_scores(spark, sf_dir):
    entries = catalogs.entries(catalogs.categories(spark, TAXONOMY), "path", "content_patterns")
    return scoring.score_rows(signals(spark, sf_dir), entries, F.col("text"), "doc_id").select("doc_id", "name", "score")


_CHECKS_SQL = "(SELECT doc_id AS check_id, 'p' || (doc_id % 6) AS piece, toxic = 1 AS selected, [doc_id + 3, doc_id, doc_id + 100000000] AS matched FROM labels)"


@book.query(f"""
WITH p AS (SELECT * FROM (VALUES ('p0', 'Piece 0', 'tender'), ('p1', 'Piece 1', 'tender'), ('p2', 'Piece 2', 'works'), ('p3', 'Piece 3', 'handover')) t(piece, label, phase)),
m AS (SELECT check_id, unnest(matched) AS doc_id, generate_subscripts(matched, 1) AS pos FROM {_CHECKS_SQL})
SELECT c.check_id, c.piece, p.label, p.phase, coalesce(string_agg(d.doc_id || ':' || d.source, ',' ORDER BY pos), '') AS files
FROM {_CHECKS_SQL} c JOIN p USING (piece) LEFT JOIN (SELECT m.*, source FROM m JOIN documents USING (doc_id)) d ON d.check_id = c.check_id GROUP BY ALL""")
def completeness_rows(spark, sf_dir):
    d = F.col("doc_id")
    checks = table(spark, sf_dir, "labels").select(d.alias("check_id"), F.concat(F.lit("p"), (d % 6).cast("string")).alias("piece"), (F.col("toxic") == 1).alias("selected"), F.array(d + 3, d, d + 100000000).alias("matched"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), F.col("source").alias("relative_path"))
    found = results.completeness_rows(checks, catalogs.pieces(spark, CHECKLIST).select("piece", "label", "phase"), docs, ["check_id"])
    return found.select("check_id", "piece", "label", "phase", F.array_join(F.transform("documents", lambda f: F.concat(f["doc_id"].cast("string"), F.lit(":"), f["filename"])), ",").alias("files"))


@book.query("""
WITH r AS (SELECT doc_id AS result_id, 'f' || (doc_id % 6) AS field, [doc_id, doc_id + 100000000] AS ids FROM labels),
s AS (SELECT result_id, field, unnest(ids) AS document_id, generate_subscripts(ids, 1) AS pos FROM r WHERE field IN ('f0', 'f1', 'f2', 'f3'))
SELECT result_id, field, CASE WHEN field IN ('f0', 'f1') THEN 'Who' ELSE 'What' END AS section_label, string_agg(document_id || ':' || coalesce(source, '?'), ',' ORDER BY pos) AS sources FROM s LEFT JOIN documents ON doc_id = document_id GROUP BY ALL""")
def extraction_rows(spark, sf_dir):
    d = F.col("doc_id")
    found = table(spark, sf_dir, "labels").select(d.alias("result_id"), F.concat(F.lit("f"), (d % 6).cast("string")).alias("field"), F.array(F.struct(d.alias("document_id")), F.struct((d + 100000000).alias("document_id"))).alias("sources"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("relative_path"))
    rows = results.extraction_rows(found, catalogs.fields(spark, FIELDS).select("field", "section_label"), docs, ["result_id"])
    return rows.select("result_id", "field", "section_label", F.array_join(F.transform("sources", lambda s: F.concat(s["document_id"].cast("string"), F.lit(":"), F.coalesce(s["relative_path"], F.lit("?")))), ",").alias("sources"))


@book.query("""
SELECT source, CASE source WHEN 'src2' THEN '000001' WHEN 'src1' THEN '000002' ELSE '~' || coalesce(source, '') END AS section_place, count(*) AS n FROM documents GROUP BY source""")
def sections_in_order(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return results.sections_in_order(counted, "source", ["src2", "src1", "never"]).select("source", "section_place", "n")


@book.query(f"""
SELECT field, doc_id, doc_id AS rank FROM {SIGNALS_SQL} d, (SELECT DISTINCT field FROM {REFERENCES_SQL}) f WHERE length(text) > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def manual_scope(spark, sf_dir):
    docs = signals(spark, sf_dir)
    chosen = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return filters.manual_scope(docs.limit(0), docs, chosen, [f for f, _, _ in REFERENCES], "doc_id")


@book.query("""
SELECT o_orderkey, o_orderstatus = 'F' OR NOT coalesce(v, '') <> '' AS absent_or_f, coalesce(c = 'coherent', false) AS coherent, coalesce(c = 'incoherent', false) AS incoherent
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'v' END AS v, CASE o_orderkey % 4 WHEN 0 THEN 'coherent' WHEN 1 THEN 'incoherent' END AS c FROM orders)""")
def field_filters(spark, sf_dir):
    k = F.col("o_orderkey")
    value, check = F.when(k % 3 == 0, "").when(k % 3 == 1, "v"), F.when(k % 4 == 0, "coherent").when(k % 4 == 1, "incoherent")
    tests = {n: filters.field_filter(value, check, n) for n in ("absent", "coherent", "incoherent")}
    return table(spark, sf_dir, "orders").where(filters.field_filter(value, check, "all")).select("o_orderkey", ((F.col("o_orderstatus") == "F") | tests["absent"]).alias("absent_or_f"), tests["coherent"].alias("coherent"), tests["incoherent"].alias("incoherent"))


@book.query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND contains(lower(o_orderpriority), 'ur') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def dossier_filters(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    risks = filters.risk_filter(F.col("o_orderstatus"), F.col("o_orderpriority"), ["F", "P"], [])
    return orders.where(risks & filters.dossier_search(F.col("o_orderpriority"), F.col("o_orderpriority"), " UR ", ["1-URGENT", "2-HIGH"])).select("o_orderkey")


_TOPIC = "'## Theme ' || conv_id || ' (part' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'Divergences : x' || chr(10) ELSE '' END || text"


@book.query("SELECT conv_id, turn, 'theme-' || turn || '-theme-' || conv_id || '-part' AS anchor, 'Theme ' || conv_id AS short FROM conversations WHERE turn % 3 = 0")
def divergent_topics(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    made = F.concat(F.lit("## Theme "), F.col("conv_id").cast("string"), F.lit(" (part\n"), F.when(F.col("turn") % 3 == 0, "Divergences : x\n").otherwise(""), F.translate("text", "#*", ""))
    topics = filters.divergent(t.select("conv_id", "turn", F.inline(reports.narrative_topics(made))))
    return topics.select("conv_id", "turn", reports.anchor(F.col("title"), F.col("turn")).alias("anchor"), reports.short_title(F.col("title")).alias("short"))


@book.query(f"""
SELECT doc_id, array_to_string(list(name ORDER BY score DESC, ord)[1:2], ',') AS matches FROM {_scores_sql(CATALOG, "text")} GROUP BY doc_id""")
def top_matches(spark, sf_dir):
    rows = scoring.score_rows(signals(spark, sf_dir), CATALOG, F.col("text"), "doc_id")
    return results.top_matches(rows, "doc_id", "name", 2).select("doc_id", F.array_join("matches", ",").alias("matches"))


@book.query(f"""
SELECT doc_id, topic, pos FROM {SIGNALS_SQL} d JOIN (VALUES ('a', 0, 'CAT/FR'), ('a', 1, 'CAT/EN'), ('b', 0, 'CAT/EN')) t(topic, pos, category) USING (category) WHERE length(text) > 0""")
def topic_documents(spark, sf_dir):
    return results.topics_for_documents(signals(spark, sf_dir), catalogs.topics(spark, TOPICS), "doc_id")


@book.query(f"SELECT doc_id FROM {SIGNALS_SQL} WHERE category IN ('CAT/EN', 'CAT/FR')")
def pivot_documents(spark, sf_dir):
    return results.pivot_documents(signals(spark, sf_dir), catalogs.topics(spark, TOPICS)).select("doc_id")


@book.query("""
WITH a AS (SELECT DISTINCT doc_id % 10 AS dossier, 'f' || (doc_id % 3) AS id FROM labels WHERE toxic = 1), g AS (SELECT DISTINCT doc_id % 10 AS dossier FROM labels)
SELECT dossier, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(['f2', 'f1', 'f0', 'f7']) AS x) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.dossier = g.dossier AND a.id = x)), '') AS missing FROM g""")
def uncovered_fields(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("dossier", F.col("doc_id") % 10)
    requests = labels.select("dossier").distinct().withColumn("ids", F.array(*map(F.lit, ["f2", "f1", "f0", "f7"])))
    answers = labels.where("toxic = 1").select("dossier", F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("id"))
    return results.uncovered(requests, answers, "dossier", "ids").select("dossier", F.array_join("missing", ",").alias("missing"))


@book.query("SELECT doc_id, lang AS proposed_category, lang AS final_category, source AS proposed_lot, source AS final_lot, CASE WHEN n_chars > 3000 THEN 'error' ELSE 'proposed' END AS status FROM documents")
def result_proposals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.col("source").alias("lot"), F.when(F.col("n_chars") > 3000, "too long").otherwise("").alias("error"))
    return results.proposed(docs, "category", "lot").drop("error")


@book.query("""
SELECT doc_id, lang AS detected_title, left(text, 1000) AS preview_text, CASE WHEN contains(text, '@') THEN '{"mail":["@"]}' END AS key_mentions,
  CASE WHEN n_chars > 3000 THEN 'error' ELSE 'text_extracted' END AS stage, CASE WHEN n_chars > 3000 THEN 'too long' END AS stage_error FROM documents""")
def document_results(spark, sf_dir):
    mentions = F.when(F.contains("text", F.lit("@")), F.create_map(F.lit("mail"), F.array(F.lit("@")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return results.text_result(table(spark, sf_dir, "documents"), F.col("text"), F.col("lang"), mentions, F.when(F.col("n_chars") > 3000, "too long"), "doc_id")


_VECTORS_SQL = "(SELECT vec_id // 3 AS sha, vec_id % 3 AS chunk_no, CASE WHEN vec_id % 11 = 0 THEN 1 ELSE len(embedding) END AS dim, CASE WHEN vec_id % 13 = 0 THEN 'old' ELSE 'm' END AS model FROM embeddings)"


@book.query(f"""
WITH c AS (SELECT sha, chunk_no FROM {_VECTORS_SQL} v WHERE model = 'm' AND NOT EXISTS (SELECT 1 FROM {_VECTORS_SQL} w WHERE w.sha = v.sha AND w.model = 'm' AND w.dim <> 64))
SELECT DISTINCT sha::VARCHAR AS text_sha, chunk_no FROM {_VECTORS_SQL} v WHERE EXISTS (SELECT 1 FROM {_VECTORS_SQL} w WHERE w.sha = v.sha AND NOT EXISTS (SELECT 1 FROM c WHERE c.sha = w.sha AND c.chunk_no = w.chunk_no))""")
def missing_vectors(spark, sf_dir):
    """Every embedding as a cached chunk, some made by an older model or cut short."""
    v = table(spark, sf_dir, "embeddings").select(F.expr("CAST(vec_id div 3 AS string)").alias("text_sha"), (F.col("vec_id") % 3).alias("chunk_no"), F.when(F.col("vec_id") % 13 == 0, "old").otherwise("m").alias("model"), F.lit(800).alias("chunk_max"), F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 1)).otherwise(F.col("embedding")).alias("vector"))
    return vector_cache.missing(v.select("text_sha", "chunk_no"), vector_cache.usable(v, model="m", chunk_max=800, dimension=64))


@book.query("""
SELECT query_id, vec_id AS label, NOT EXISTS (SELECT 1 FROM embeddings k WHERE k.vec_id = query_id AND k.label = s.label) AS semantic_only
FROM (SELECT vec_id - vec_id % 50 AS query_id, vec_id, label FROM embeddings) s""")
def semantic_only_flag(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    semantic = v.select((F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), "vec_id", F.col("label").alias("doc"))
    keyword = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("doc"))
    return retrieval.semantic_only(keyword, semantic, "query_id", "doc").select("query_id", F.col("vec_id").alias("label"), "semantic_only")


_BATCHES_SQL = "list_reduce(list(length(text) ORDER BY turn), lambda acc, x: CASE WHEN acc.n > 0 AND (acc.n >= 3 OR acc.sum + x > 600) THEN {'batch': acc.batch + 1, 'n': 1, 'sum': x, 'out': list_append(acc.out, acc.batch + 1)} ELSE {'batch': acc.batch, 'n': acc.n + 1, 'sum': acc.sum + x, 'out': list_append(acc.out, acc.batch)} END, {'batch': 0, 'n': 0, 'sum': 0::BIGINT, 'out': []::INT[]})"


@book.query(f"SELECT conv_id, array_to_string(r.out, ',') AS batches FROM (SELECT conv_id, {_BATCHES_SQL} AS r FROM conversations GROUP BY conv_id)")
def sequential_batches(spark, sf_dir):
    """Turns of a conversation packed in order into calls."""
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("t"))
    return listed.select("conv_id", F.array_join(planning.sequential_batches(F.transform("t", lambda x: x["size"]), 3, 600), ",").alias("batches"))


@book.query("""
WITH r AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, CASE WHEN conv_id % 7 <> 0 THEN 'v' END AS value, CASE WHEN conv_id % 3 <> 0 THEN 'because' END AS why FROM conversations GROUP BY conv_id),
m AS (SELECT *, list_filter(turns, lambda t: t % 3 = 1 AND conv_id % 2 = 0) AS found FROM r)
SELECT conv_id, CASE WHEN value IS NOT NULL AND len(found) > 0 THEN '[semantic] ' || coalesce(why, '') ELSE why END AS justification,
  array_to_string(list_transform(turns, lambda t: CASE WHEN value IS NOT NULL AND list_contains(found, t) THEN t || ':semantic' ELSE t || ':keyword' END), ',') AS sources FROM m""")
def semantic_origin(spark, sf_dir):
    """Turns as a value's sources, some of them found by the semantic search alone."""
    turn = F.struct(F.col("turn").alias("document_id"), F.lit("keyword").alias("selection"))
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("sources"))
    ids = F.transform("sources", lambda s: s["document_id"])
    results = each.select(
        "conv_id", "sources", F.when(F.col("conv_id") % 7 != 0, "v").alias("value"), F.when(F.col("conv_id") % 3 != 0, "because").alias("justification"),
        F.filter(ids, lambda t: (t % 3 == 1) & (F.col("conv_id") % 2 == 0)).alias("semantic_only"),
    )
    found = retrieval.mark_semantic_origin(results, "[semantic] ")
    return found.select("conv_id", "justification", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["document_id"].cast("string"), s["selection"])), ",").alias("sources"))


@book.query("""
SELECT n_name, n.n_nationkey AS ord, n_suppliers FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def schema_rows(spark, sf_dir):
    """Every entry of a schema, with its result or none."""
    schema = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("ord"))
    suppliers = table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    named = suppliers.join(schema, F.col("k") == F.col("ord")).select("n_name", "n_suppliers")
    return reports.with_missing(schema, named, "n_name").select("n_name", "ord", "n_suppliers")
