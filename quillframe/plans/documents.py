"""Content addressing, text functions and file plans over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.functions.parsers import chunks
from quillframe.operators import planning, reports, state
from quillframe.plans.book import SIGNALS_SQL, Book, signals
from quillframe.sources import office
from quillframe.sources.inventory import classify_extension
from quillframe.sources.shared import new_folder
from quillframe.sources.tables import table
from quillframe.sources.text_cache import TextCache

book = Book()


@book.query("SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS leader, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def dedup_leaders(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return planning.leaders(docs, "digest", "doc_id")


@book.query("SELECT sha256(text) AS content_hash, min(n_chars) AS char_count, count(*) AS n_documents, CASE WHEN min(n_chars) > 0 THEN 'done' ELSE 'failed' END AS status FROM documents GROUP BY 1")
def text_cache_view(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("n_chars").alias("char_count"), F.count("*").alias("n_documents"))
    return docs.withColumn("status", F.when(F.col("char_count") > 0, "done").otherwise("failed"))


@book.query("SELECT doc_id, lag(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS duplicate_of FROM documents")
def duplicate_of_latest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return planning.latest_before(docs, "digest", "doc_id", "duplicate_of").select("doc_id", "duplicate_of")


@book.query("SELECT content_hash FROM (SELECT sha256(text) AS content_hash, bool_and(source IN ('src0', 'src1')) AS gone FROM documents GROUP BY 1) WHERE gone")
def orphan_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("content_hash"))
    return state.orphans(docs.select("content_hash").distinct(), docs, F.col("source").isin("src0", "src1"), "content_hash")


@book.query("SELECT doc_id, sha256(strip_accents(text)) AS folded, sha256(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS terms FROM documents")
def normalize_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(tx.fold_accents(F.col("text")), 256).alias("folded"), F.sha2(tx.fold_terms(F.col("text")), 256).alias("terms"))


@book.query(r"SELECT doc_id, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\s#*-]+', ''), '\s+$', '')), lambda x: x <> '' AND NOT starts_with(x, '<!--'))[1], 200) AS title FROM documents")
def first_line_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_line(F.col("text")).alias("title"))


WORDS = ["token", "license", "ment"]
_PARTS_SQL = r"(SELECT doc_id, i - 1 AS pos, p[i] AS part FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents), range(1, len(p) + 1) t(i))"
_SCORE_SQL = "regexp_matches(part, '(?i)tion')::INT + regexp_matches(part, '(?i)the')::INT" + "".join(f" + ((length(part) - length(replace(lower(part), '{w}', ''))) // {len(w)})::INT" for w in WORDS)


@book.query(f"SELECT doc_id, pos::INT AS pos, ({_SCORE_SQL})::INT AS score FROM {_PARTS_SQL}")
def paragraph_scores(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.paragraphs(F.col("text"), "\n")).alias("pos", "part"))
    return parts.select("doc_id", "pos", tx.paragraph_score(F.col("part"), ["(?i)tion", "(?i)the"], WORDS).alias("score"))


@book.query(f"""
WITH p AS (SELECT doc_id, list({{'s': -({_SCORE_SQL})::INT, 'pos': pos::INT, 'part': part}} ORDER BY -({_SCORE_SQL}), pos) AS ranked FROM {_PARTS_SQL} GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(ranked, lambda acc, x: CASE WHEN NOT acc.any_taken OR (acc.rest > 0 AND length(x.part) <= acc.rest)
    THEN {{'rest': acc.rest - length(x.part), 'any_taken': true, 'taken': list_append(acc.taken, x)}} ELSE acc END,
    {{'rest': 1500::BIGINT, 'any_taken': false, 'taken': ranked[1:0]}}) AS r FROM p)
SELECT doc_id, sha256(left(array_to_string(list_transform(list_sort(list_transform(r.taken, lambda x: {{'pos': x.pos, 'part': x.part}})), lambda x: x.part), chr(10) || chr(10)), 1500)) AS excerpt FROM f""")
def excerpt_select(spark, sf_dir):
    parts = tx.paragraphs(F.col("text"), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.array(parts)).alias("parts")).where(F.size("parts") > 0)  # split once
    scored = F.transform("parts", lambda p, i: F.struct(tx.paragraph_score(p, ["(?i)tion", "(?i)the"], WORDS).alias("score"), i.alias("pos"), p.alias("part")))
    once = docs.select("doc_id", F.explode_outer(F.array(scored)).alias("scored"))
    return once.select("doc_id", F.sha2(planning.packed_excerpt(F.col("scored"), 1500), 256).alias("excerpt"))


@book.query(r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
pieces AS (SELECT doc_id, flatten(list_transform(ps, lambda p: list_transform(range(0, (length(p) - 1) // 800 + 1), lambda i: {'part': substr(p, (i * 800 + 1)::BIGINT, 800), 'whole': i < (length(p) - 1) // 800}))) AS xs FROM p WHERE len(ps) > 0),
packed AS (SELECT doc_id, list_reduce(xs, lambda acc, x: CASE
    WHEN x.whole THEN {'done': list_concat(CASE WHEN acc.held = '' THEN acc.done ELSE list_append(acc.done, acc.held) END, [x.part]), 'held': '', 'size': 0::BIGINT}
    WHEN acc.held <> '' AND acc.size + length(x.part) <= 800 THEN {'done': acc.done, 'held': acc.held || chr(10) || chr(10) || x.part, 'size': acc.size + length(x.part) + 2}
    ELSE {'done': CASE WHEN acc.held = '' THEN acc.done ELSE list_append(acc.done, acc.held) END, 'held': x.part, 'size': length(x.part) + 2} END,
    {'done': []::VARCHAR[], 'held': '', 'size': 0::BIGINT}) AS r FROM pieces),
chunked AS (SELECT doc_id, CASE WHEN r.held = '' THEN r.done ELSE list_append(r.done, r.held) END AS c FROM packed)
SELECT doc_id, (i - 1)::INT AS chunk_no, length(c[i])::INT AS size, sha256(c[i]) AS digest FROM chunked, range(1, len(c) + 1) t(i)""")
def chunk_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", chunks(F.col("text"), 800).alias("chunks"))
    return docs.select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("digest"))


MENTIONS = {"license": "licen[sc]e", "mail": "[a-z0-9.]+@[a-z0-9.]+", "card": "([0-9]{4})[0-9]{12}", "phone": r"[+]1 [(]([0-9]{3})[)]"}


def _mention_sql(key: str, pattern: str) -> str:
    group = int("(" in pattern.replace("[(]", ""))
    found = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '{pattern}', {group}), lambda v: v <> '')))[1:10]"
    return f"SELECT doc_id, '{key}' AS mention, array_to_string({found}, '|') AS captured FROM documents WHERE regexp_matches(lower(text), '{pattern}')"


@book.query(" UNION ALL ".join(_mention_sql(k, p) for k, p in MENTIONS.items()))
def key_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.key_mentions(F.col("text"), MENTIONS).alias("found"))
    return docs.select("doc_id", F.explode("found").alias("mention", "values")).select("doc_id", "mention", F.array_join("values", "|").alias("captured"))


@book.query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract('Lot ' || (page_id % 7) || ', ' || (page_id % 5) || ' et 3 - ' || url, '(?i)lot[^a-z0-9]{0,3}([0-9]+(?:\s*(?:,|/|&|-|et)\s*[0-9]+)*)', 1), '\s+', ' ', 'g')), '') AS lot FROM pages")
def lot_signal(spark, sf_dir):
    name = F.concat(F.lit("Lot "), (F.col("page_id") % 7).cast("string"), F.lit(", "), (F.col("page_id") % 5).cast("string"), F.lit(" et 3 - "), "url")
    return table(spark, sf_dir, "pages").select("page_id", tx.lot_signal(name).alias("lot"))


_SLUG = "trim(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'), '-')"


@book.query(f"""
WITH n AS (SELECT doc_id, lot, dossier, 'CAT_LOT' || upper(lot) || '_NOTE_' || upper({_SLUG.format("regexp_replace(filename, '[0-9]+[.]pdf$', '')")}) || '.pdf' AS name FROM {SIGNALS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY dossier, name ORDER BY doc_id) AS k FROM n)
SELECT doc_id, dossier, name, CASE WHEN k = 1 THEN name ELSE replace(name, '.pdf', '-' || k || '.pdf') END AS target FROM r""")
def slug_filename(spark, sf_dir):
    docs = signals(spark, sf_dir).withColumn("short", F.regexp_replace("filename", r"[0-9]+\.pdf$", ".pdf"))
    named = docs.select("doc_id", "dossier", tx.normalized_filename(F.col("category"), F.col("lot"), F.lit("NOTE"), F.col("short")).alias("name"))
    return reports.distinct_targets(named, "dossier", "name", "doc_id").select("doc_id", "dossier", "name", "target")


@book.query(r"""
WITH p AS (SELECT page_id // 3 AS doc, page_id % 3 AS page, length(regexp_replace(left(html, 100 * (page_id % 7)::INT), '^\s+|\s+$', '', 'g')) AS size FROM pages),
s AS (SELECT *, avg(size) OVER (PARTITION BY doc) AS mean_chars, sum(size) OVER (PARTITION BY doc) AS chars FROM p)
SELECT doc, page, CASE WHEN doc % 5 = 0 THEN CASE WHEN chars = 0 THEN 'deferred' ELSE 'native' END WHEN mean_chars < 50 THEN 'recognise' WHEN size < 200 THEN 'recognise' ELSE 'native' END AS route FROM s""")
def page_density_route(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.expr("page_id div 3").alias("doc"), (F.col("page_id") % 3).alias("page"), F.left("html", (100 * (F.col("page_id") % 7)).cast("int")).alias("native_text"))
    return office.page_routes(pages, "doc", allow=F.col("doc") % 5 != 0).select("doc", "page", "route")


@book.query(r"""
WITH p AS (SELECT page_id // 3 AS doc, page_id % 3 AS page, left(html, 40) AS native, CASE WHEN page_id % 2 = 0 THEN 'ocr ' || page_id END AS ocr, CASE WHEN page_id % 2 = 0 THEN (page_id % 10) / 10.0::DOUBLE END AS conf FROM pages),
s AS (SELECT *, length(trim(native)) AS size, avg(length(regexp_replace(native, '^\s+|\s+$', '', 'g'))) OVER (PARTITION BY doc) AS mean_chars FROM p)
SELECT doc, sha256(string_agg(coalesce(ocr, native), chr(10) ORDER BY page)) AS digest, round(avg(conf), 6) AS ocr_confidence, count(*) AS n_recognised FROM s WHERE true GROUP BY doc""")
def page_splice(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 3").alias("doc"), (F.col("page_id") % 3).alias("page"), F.left("html", F.lit(40)).alias("native_text"))
    answers = pages.where("page_id % 2 = 0").select("doc", "page", F.concat(F.lit("ocr "), F.col("page_id").cast("string")).alias("ocr_text"), ((F.col("page_id") % 10) / F.lit(10.0)).alias("ocr_confidence"))
    found = office.spliced(office.page_routes(pages.drop("page_id"), "doc"), answers, "doc")
    return found.select("doc", F.sha2("text", 256).alias("digest"), F.round("ocr_confidence", 6).alias("ocr_confidence"), "n_recognised")


@book.query("""
SELECT page_id, CASE ext WHEN '.pdf' THEN 'pdf' WHEN '.zip' THEN 'archive' WHEN '.xml' THEN 'dematerialised' WHEN '.png' THEN 'image' ELSE 'other' END AS kind,
  ext IN ('.pdf', '.png') AS analyzable, ext NOT IN ('.pdf', '.zip', '.xml', '.png', '.dwg') AS at_risk
FROM (SELECT page_id, ['.pdf', '.zip', '.xml', '.png', '.dwg', '.foo', ''][(page_id % 7 + 1)::INT] AS ext FROM pages)""")
def doc_type_lookup(spark, sf_dir):
    exts = F.array(*map(F.lit, [".pdf", ".zip", ".xml", ".png", ".dwg", ".foo", ""]))
    found = classify_extension(F.get(exts, (F.col("page_id") % 7).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("c")).select("page_id", "c.kind", "c.analyzable", "c.at_risk")


@book.query("""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, text, source FROM documents),
c AS (SELECT h, bool_or(source < 'src2') AS early FROM d GROUP BY h)
SELECT doc_id, h AS digest, length(coalesce(d.text, ''))::INT AS char_count, CASE WHEN length(coalesce(d.text, '')) = 0 THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN early AND NOT length(coalesce(d.text, '')) BETWEEN 1 AND 999 THEN 1 ELSE 2 END AS pass FROM d JOIN c USING (h)""")
def text_cache_refresh(spark, sf_dir):
    """Two refreshes: of some sources, deferring short texts, then of all. ``pass`` tells which one settled a content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    named = docs.withColumn("content_hash", F.sha2("text", 256))
    cache = TextCache(new_folder(spark, "text-cache"))

    def extract(number):
        size = F.length("text")
        status = F.when(size == 0, "failed").when(F.lit(number == 1) & (size < 1000), "deferred").otherwise("done")
        return lambda pending: pending.select("content_hash", F.concat(F.lit(f"{number}"), "text").alias("text"), status.alias("status"))

    cache.refresh(named.where("source < 'src2'"), extract(1))
    cache.refresh(named, extract(2))
    cache.refresh(named, extract(3))
    found = cache.texts(named.select("doc_id", F.col("content_hash").alias("digest")), "digest")
    return found.select("doc_id", "digest", (F.col("char_count") - 1).alias("char_count"), "status", F.left("text", F.lit(1)).cast("int").alias("pass"))


@book.query("""
WITH p AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, list_filter(string_split(regexp_replace(url, '^https?://[^/]*', ''), '/'), lambda x: x <> '') AS parts FROM pages),
q AS (SELECT * FROM p WHERE len(parts) > 0),
f AS (SELECT host, unnest(list_transform(range(1, len(parts)), lambda i: parts[1:i])) AS loc FROM q WHERE len(parts) > 1),
n AS (SELECT host, loc, count(*) AS n, 0 AS file FROM f GROUP BY ALL UNION ALL SELECT host, parts, count(*), 1 FROM q GROUP BY ALL),
l AS (SELECT host, list_transform(loc, lambda x, i: {'folder': CASE WHEN i = len(loc) AND file = 1 THEN 0 ELSE 1 END, 'name': x}) AS o,
  repeat('  ', len(loc) - 1) || '- ' || CASE WHEN file = 1 THEN loc[-1] || CASE WHEN n > 1 THEN ' x' || n ELSE '' END ELSE '**' || loc[-1] || '/** (' || n || ')' END AS line FROM n)
SELECT host, sha256(string_agg(line, chr(10) ORDER BY o)) AS report, count(*) AS n_lines FROM l GROUP BY host""")
def folder_report(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.regexp_replace("url", "^https?://[^/]*", "").alias("path"))
    body = reports.composite(pages, "host", "path")
    return body.select("host", F.sha2("body", 256).alias("report"), F.size(F.split("body", "\n")).cast("long").alias("n_lines"))
