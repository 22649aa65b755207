"""Notice matching, merging, upsert and order: pages and orders stand for notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions.text import fold_terms
from quillframe.operators import filters
from quillframe.operators import notices as op
from quillframe.plans.book import Book
from quillframe.sources.notice_pages import register
from quillframe.sources.shared import new_folder
from quillframe.sources.tables import table
from quillframe.streaming.upsert import UpsertTable

book = Book()
REQUIRED, EXCLUDED = ["the", "cookie policy", "des"], ["subscribe", "und der"]
_FOLDED = "trim(regexp_replace(strip_accents(lower(html)), '[^a-z0-9]+', ' ', 'g'))"


def _holds(term: str) -> str:
    return f"contains(' ' || folded || ' ', ' {term} ')"


_MATCH_SQL = f"""(SELECT *, coalesce({', '.join(f"CASE WHEN {_holds(t)} THEN '{t}' END" for t in EXCLUDED)}) AS excluded_by,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_holds(t)} THEN '{t}' END" for t in REQUIRED)}], lambda x: x IS NOT NULL), ',') AS terms
  FROM (SELECT page_id, url, html, {_FOLDED} AS folded FROM pages))"""


def _matched(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("folded", fold_terms(F.col("html")))
    terms, out = op.match(F.col("folded"), REQUIRED, EXCLUDED)
    return pages.withColumn("terms", terms).withColumn("excluded_by", out)


@book.query(f"SELECT page_id, excluded_by IS NULL AND terms <> '' AS retained, CASE WHEN excluded_by IS NULL THEN terms ELSE '' END AS terms, excluded_by FROM {_MATCH_SQL}")
def notice_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("page_id", (F.size("terms") > 0).alias("retained"), F.array_join("terms", ",").alias("terms"), "excluded_by")


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_NOTICE_SQL = f"""(SELECT page_id AS source_id, CASE WHEN page_id % 3 = 0 THEN 'ted' ELSE 'boamp' END AS source, url AS dce_url, url LIKE '%1%' AS automatable,
  CASE WHEN page_id % 11 = 0 THEN 'own#' || CASE WHEN page_id % 3 = 0 THEN 'ted' ELSE 'boamp' END || '#' || page_id
    ELSE trim(regexp_replace(lower({_HOST}), '[^a-z0-9]+', ' ', 'g')) || '|' || strftime(DATE '2024-01-01' + (page_id % 4)::INT, '%Y-%m-%d') END AS merge_key FROM pages)"""


def _as_notices(pages):
    day = F.when(F.col("page_id") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 4).cast("int")))
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    made = {"source_id": F.col("page_id"), "source": F.when(F.col("page_id") % 3 == 0, "ted").otherwise("boamp"), "dce_url": F.col("url"), "automatable": F.contains("url", F.lit("1"))}
    return pages.withColumns(made | {"fingerprint": op.fingerprint(host, day)})


def _notices(spark, sf_dir):
    return _as_notices(table(spark, sf_dir, "pages")).select("source_id", "source", "dce_url", "automatable", "fingerprint")


_MERGE_SQL = f"""(SELECT merge_key, arg_min(source, (source <> 'ted')::INT * 100000000 + source_id) AS source, arg_min(source_id, (source <> 'ted')::INT * 100000000 + source_id) AS source_id, (count(*) - 1)::INT AS n_duplicates,
  coalesce(arg_min(dce_url, (source <> 'ted')::INT * 100000000 + source_id) FILTER (automatable), arg_min(dce_url, (source <> 'ted')::INT * 100000000 + source_id)) AS best_url FROM {_NOTICE_SQL} GROUP BY merge_key)"""


@book.query(f"SELECT merge_key, source, source_id, n_duplicates FROM {_MERGE_SQL}")
def notice_merge(spark, sf_dir):
    return op.merge(_notices(spark, sf_dir), preferred="ted").drop("best_url")


@book.query(f"SELECT merge_key, best_url FROM {_MERGE_SQL}")
def best_link(spark, sf_dir):
    return op.merge(_notices(spark, sf_dir), preferred="ted").select("merge_key", "best_url")


@book.query(f"""
SELECT page_id, CASE WHEN h = 'manual' THEN 'manual' WHEN h = 'platform' THEN 'platform' WHEN regexp_matches(link, '(?i)[.](zip|7z|rar)([?]|$)') THEN 'direct' ELSE 'manual' END AS plan
FROM (SELECT page_id, link, CASE WHEN page_id % 4 = 0 THEN 'manual' WHEN page_id % 4 = 1 THEN 'platform' ELSE 'other' END AS h
  FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.ZIP?x=1' WHEN 1 THEN '.7z' ELSE '' END AS link FROM pages))""")
def retrieval_plan(spark, sf_dir):
    """Pages below hosts of either kind: a host itself, a host below a listed one, and hosts that only end alike."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+(.*)$", 1)
    host = F.element_at(F.array(*map(F.lit, ["www.captcha.invalid", "platform.invalid", "notcaptcha.invalid", "xplatform.invalid"])), (F.col("page_id") % 4 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, [".ZIP?x=1", ".7z", ""])), (F.col("page_id") % 3 + 1).cast("int"))
    link = F.concat(F.lit("https://"), host, path, ending)
    return table(spark, sf_dir, "pages").select("page_id", op.retrieval_plan(link, ["captcha.invalid"], ["platform.invalid"]).alias("plan"))


@book.query("""
WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS title, o_orderpriority AS status FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT o_orderkey AS k, 'new ' || o_orderstatus AS title, 'new' AS status FROM orders WHERE o_orderkey % 2 = 0)
SELECT k AS source_id, coalesce(f.title, s.title) AS title, coalesce(s.status, f.status) AS status, s.k IS NULL AS is_new FROM s FULL JOIN f USING (k)""")
def notice_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stored = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("status"))
    fresh = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), F.concat(F.lit("new "), "o_orderstatus").alias("title"), F.lit("new").alias("status"))
    return op.upsert(stored, fresh, ["source_id"], ["title"], ["status"])


@book.query("""
SELECT o_orderkey, deadline, bucket FROM (SELECT o_orderkey, d AS deadline, CASE WHEN d IS NULL THEN 1 WHEN d < TIMESTAMP '1996-06-01' THEN 2 ELSE 0 END AS bucket, o_totalprice
  FROM (SELECT *, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::TIMESTAMP END AS d FROM orders)) ORDER BY bucket, deadline NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 200""")
def urgency_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("deadline"))
    return op.by_urgency(orders, F.lit("1996-06-01").cast("timestamp_ntz"), "deadline", "o_totalprice", "o_orderkey").select("o_orderkey", "deadline", "bucket")


@book.query(f"""
SELECT (SELECT count(*) FROM pages) AS n_seen, (SELECT count(*) FROM {_MATCH_SQL} WHERE excluded_by IS NULL AND terms <> '') AS n_matched, (SELECT count(*) FROM {_MATCH_SQL} WHERE excluded_by IS NOT NULL) AS n_excluded,
  (SELECT count(*) FROM {_MERGE_SQL}) AS n_merged, (SELECT sum(n_duplicates)::BIGINT FROM {_MERGE_SQL}) AS n_duplicates""")
def scan_report(spark, sf_dir):
    seen = {"n_seen": F.count("*"), "n_matched": F.count_if(F.size("terms") > 0), "n_excluded": F.count_if(F.col("excluded_by").isNotNull())}
    return op.scan_report(_as_notices(_matched(spark, sf_dir)), preferred="ted", seen=seen)


_RECORDS = {"one": ("page_id % 2 = 0", "ref", "name", "day"), "two": ("page_id % 2 = 1", "no", "subject", "date")}


@book.query("""
SELECT CASE WHEN page_id % 2 = 0 THEN 'one' ELSE 'two' END AS source, page_id::VARCHAR AS source_id, 'T' || page_id AS title, CASE WHEN page_id % 9 <> 0 THEN DATE '2024-01-01' + (page_id % 60)::INT END AS published_at FROM pages WHERE page_id % 7 <> 0""")
def notice_records(spark, sf_dir):
    """Two sources with keys of their own, some records unreadable, some days unreadable."""
    return _two_sources(spark, sf_dir)[0]


def _two_sources(spark, sf_dir):
    found = []
    for name, (own, number, title, day) in _RECORDS.items():
        pages = table(spark, sf_dir, "pages").where(own)
        made = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd'T'00:00")
        record = F.to_json(F.struct(F.col("page_id").cast("string").alias(number), F.concat(F.lit("T"), F.col("page_id").cast("string")).alias(title), F.when(F.col("page_id") % 9 == 0, "soon").otherwise(made).alias(day)))
        found.append(op.records(pages.select(F.when(F.col("page_id") % 7 == 0, F.left(record, F.lit(9))).otherwise(record).alias("record")), name, id_key=number, title_key=title, published_key=day))
    return op.all_sources(*found)


@book.query("SELECT CASE WHEN page_id % 2 = 0 THEN 'one' ELSE 'two' END AS source, 'no readable record' AS error, count(*) AS n FROM pages WHERE page_id % 7 = 0 GROUP BY 1")
def source_errors(spark, sf_dir):
    return _two_sources(spark, sf_dir)[1]


@book.query("""
WITH n AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'one' ELSE 'two' END AS source, page_id::VARCHAR AS source_id, 'T' || page_id AS title, CASE WHEN page_id % 9 <> 0 THEN DATE '2024-01-01' + (page_id % 60)::INT END AS d, page_id FROM pages WHERE page_id % 7 <> 0),
s AS (SELECT source, source_id, 'old' AS title, 'seen' AS status FROM n WHERE page_id % 5 = 0), f AS (SELECT source, source_id, title, 'new' AS status FROM n WHERE d >= DATE '2024-02-20' - 30)
SELECT source, source_id, coalesce(f.title, s.title) AS title, coalesce(s.status, f.status) AS status, s.source_id IS NULL AS is_new FROM s FULL JOIN f USING (source, source_id)""")
def notice_scan(spark, sf_dir):
    notices = _two_sources(spark, sf_dir)[0].withColumn("status", F.lit("new"))
    stored = notices.where("CAST(source_id AS bigint) % 5 = 0").select("source", "source_id", F.lit("old").alias("title"), F.lit("seen").alias("status"))
    return op.scan(stored, notices, today=F.lit("2024-02-20").cast("date"), key=["source", "source_id"], editorial=["title"], protected=["status"])


@book.query("""
SELECT page_id::VARCHAR AS source_id, 'P' || page_id AS title, DATE '2024-01-01' + (page_id % 60)::INT AS published_at, sha256(html) AS body FROM pages WHERE page_id % 60 >= 20 AND page_id % 13 <> 0""")
def notice_poll(spark, sf_dir):
    """Pages as a service's answers, polled twice into a table: the second poll finds a page published again."""
    register(spark)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd")
    record = F.struct(F.when(F.col("page_id") % 13 != 0, F.col("page_id")).alias("id"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("title"), day.alias("published_at"), "html")
    answers = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 100)).agg(F.to_json(F.struct(F.collect_list(record).alias("records"))).alias("value")).select("value")
    feed, state = new_folder(spark, "notices"), new_folder(spark, "notices-state")
    stored = UpsertTable(new_folder(spark, "polled"), ["source", "source_id"], ["title", "published_at", "body"])
    polled = spark.readStream.format("notice_pages").options(path=feed, source="pages", lookbackDays="30", today="2024-02-20", maxPages="1000000").load()
    found = polled.where("error IS NULL AND published_at >= DATE '2024-01-21'")
    for again in (answers, answers.limit(1)):
        again.write.mode("append").text(feed)
        stored.sink(found, state)
    kept = stored.read(spark, found.select("source", "source_id", "title", "published_at", "body").schema)
    return kept.select("source_id", "title", "published_at", F.sha2(F.get_json_object("body", "$.html"), 256).alias("body"))


@book.query("""
SELECT page_id FROM pages WHERE upper('nature ' || (page_id % 3)) NOT IN ('NATURE 1') AND NOT starts_with('type' || (page_id % 20), 'type1') AND CASE page_id % 4 WHEN 0 THEN 'dismissed' ELSE 'new' END <> 'dismissed'""")
def notice_filters(spark, sf_dir):
    n = lambda m: (F.col("page_id") % m).cast("string")
    nature, kind, status = F.concat(F.lit("nature "), n(3)), F.concat(F.lit("type"), n(20)), F.when(F.col("page_id") % 4 == 0, "dismissed").otherwise("new")
    return table(spark, sf_dir, "pages").where(filters.allowed_nature(nature, ["Nature 1"]) & filters.allowed_type(kind, ["type1"]) & filters.allowed_type(kind, []) & filters.shown_status(status, [])).select("page_id")
