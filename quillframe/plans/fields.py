"""Text and field functions over pages, events, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import notice_fields as nf
from quillframe.functions import text as tx
from quillframe.functions.parsers import marks_as_files
from quillframe.operators import citations, logs, reports, resolve, retries
from quillframe.plans.book import Book
from quillframe.sources.tables import table

book = Book()


def _n(column: str, m: int):
    return (F.col(column) % m).cast("string")


@book.query(r"""
SELECT conv_id, turn, regexp_replace(text, '\r?\n', ' ', 'g') || ' a\|b  c' AS cell, regexp_replace(text, '^\s+|\s+$', '', 'g') AS item,
  CASE WHEN turn % 2 = 0 THEN 'kept' ELSE '(seen) kept' END AS label, CASE WHEN turn % 5 < 1 THEN '5 s' WHEN turn % 5 < 2 THEN '1 min 05 s' ELSE '2 h 03 min' END AS shown, '****' || lpad((turn % 10)::VARCHAR, 4, '0') AS hidden FROM (SELECT conv_id, turn, replace(text, '|', '') AS text FROM conversations)""")
def text_marks(spark, sf_dir):
    """Table cells, list items, citation labels, durations and masked keys."""
    t = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("|"), F.lit("")))
    seconds = F.when(F.col("turn") % 5 < 1, 5).when(F.col("turn") % 5 < 2, 65).otherwise(7385)
    cell = tx.table_cell(F.concat("text", F.lit(" a|b \nc")))
    item = F.concat(F.element_at(F.array(*map(F.lit, ["- ", "1. ", "• "])), (F.col("turn") % 3 + 1).cast("int")), tx.strip_space(F.col("text")))
    label = F.when(F.col("turn") % 2 == 0, F.lit("kept [D1.2, D3]")).otherwise(F.lit("(seen) kept (D4)"))
    return t.select(
        "conv_id", "turn", cell.alias("cell"), tx.clean_item(item).alias("item"), tx.strip_labels(label).alias("label"), tx.duration(seconds).alias("shown"),
        tx.masked(F.concat(F.lit("key#"), F.lpad(_n("turn", 10), 4, "0"))).alias("hidden"),
    )


@book.query("""
SELECT event_id, CASE WHEN v < 0.5 THEN 'to_verify' WHEN (event_id % 3 = 0 OR event_id % 3 = 1) AND v >= 0.75 THEN 'certain' ELSE 'probable' END AS certainty, greatest(0.0, least(1.0, value / 100))::DOUBLE AS clamped,
  CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN 'certain' ELSE 'probable' END AS absence FROM (SELECT *, (event_id % 100) / 100.0::DOUBLE AS v FROM events)""")
def certainties(spark, sf_dir):
    """Certainty of an answer by its own confidence and that of the recognised text (unknown, good or poor)."""
    e = F.col("event_id")
    ocr = F.when(e % 3 == 1, 0.9).when(e % 3 == 2, 0.4)
    return table(spark, sf_dir, "events").select("event_id", tx.answer_certainty((e % 100) / F.lit(100.0), ocr).alias("certainty"), tx.clamp(F.col("value") / 100).alias("clamped"), resolve.absent_certainty(F.when(e % 2 == 0, "own"), e % 5 == 0).alias("absence"))


@book.query("""
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN DATE '2024-01-01' + (page_id % 50)::INT END AS day, CASE WHEN page_id % 3 <> 0 THEN least(DATE '2024-01-01' + (page_id % 50)::INT, DATE '2024-01-20') ELSE DATE '2024-01-20' END AS first_day,
  array_to_string(list_sort(list_distinct(['45' || (page_id % 4), '452', '45' || (page_id % 3)])), ',') AS codes, url AS first_url, CASE WHEN page_id % 2 = 0 THEN url END AS below,
  'long part' || chr(10) || 'p' || (page_id % 100 + 100) AS said FROM pages""")
def notice_values(spark, sf_dir):
    """Dates, codes, links and descriptions of notices."""
    pages = table(spark, sf_dir, "pages")
    made = F.when(F.col("page_id") % 3 != 0, F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 50).cast("int")), "yyyy-MM-dd"), F.lit("T10:00Z"))).otherwise("soon")
    links = F.array(F.struct(F.lit("Title").alias("k"), F.lit("http://no").alias("v")), F.struct(F.when(F.col("page_id") % 2 == 0, "someURLkey").otherwise("other").alias("k"), F.col("url").alias("v")))
    return pages.select(
        "page_id", nf.iso_date(made).alias("day"), nf.earliest(F.array(made, F.lit("2024-01-20"), F.lit("?"))).alias("first_day"), F.array_join(nf.codes(F.array(F.concat(F.lit(" 45"), _n("page_id", 4)), F.lit("452 "), F.lit(""), F.concat(F.lit("45"), _n("page_id", 3)))), ",").alias("codes"),
        nf.first_url(F.array(F.lit("ftp://x"), F.concat(F.lit(" "), "url"))).alias("first_url"), nf.first_under(links, "urlkey").alias("below"), nf.description(F.array(F.lit(" long part "), F.lit("abc"), F.concat(F.lit("p"), (F.col("page_id") % 100 + 100).cast("string")), F.lit("long part"))).alias("said"),
    )


@book.query("""
SELECT page_id, 'file ' || page_id || '.zip' AS filename, page_id % 2 = 0 AS archive, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/index.php?page=Entreprise.EntrepriseDemandeTelechargementDce&id=' || page_id || '&orgAcronyme=abc' AS request,
  CASE WHEN page_id % 24 < 9 THEN (9 - page_id % 24) * 3600 ELSE (33 - page_id % 24) * 3600 END AS wait, 'f$x$name' || (page_id % 3) AS field, 'v&' || page_id AS hidden FROM pages""")
def download_fields(spark, sf_dir):
    """File names, archives, request links, schedules and form fields of a retrieval."""
    p = F.col("page_id")
    header = F.when(p % 2 == 0, F.concat(F.lit("attachment; filename*=UTF-8''dir%2Ffile%20"), p.cast("string"), F.lit(".zip"))).otherwise(F.concat(F.lit('attachment; filename="C:\\dir\\file '), p.cast("string"), F.lit('.zip"')))
    content = F.when(p % 2 == 0, F.lit("PK\x03\x04rest")).otherwise(F.lit("%PDF")).cast("binary")
    link = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/x?refConsultation="), p.cast("string"), F.lit("&orgAcronyme=abc"))
    clock = F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (p % 24).cast("int"))
    html = F.concat(F.lit('<p><INPUT type="hidden" name="f$x$name'), _n("page_id", 3), F.lit('" value="v&'), p.cast("string"), F.lit('"><input name="other" value="o">'))
    inputs = nf.form_inputs(html)
    return table(spark, sf_dir, "pages").select(
        "page_id", nf.header_filename(header).alias("filename"), nf.is_archive(content).alias("archive"), nf.request_url(link).alias("request"), nf.seconds_until(clock, 9).alias("wait"),
        F.coalesce(*(nf.field_name(inputs, f"name{i}") for i in range(3))).alias("field"), F.coalesce(*(nf.hidden_value(inputs, f"f$x$name{i}") for i in range(3))).alias("hidden"),
    )


@book.query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a, b, c et 1 autres' WHEN 1 THEN '| a' WHEN 2 THEN 'said (b)' ELSE 'said ' END AS body FROM conversations""")
def marks_as_names(spark, sf_dir):
    """Runs of citation marks as file names: at the start, in a cell, in prose, and unknown ones."""
    made = F.element_at(F.array(*map(F.lit, ["⟦cite:c1⟧⟦cite:c2⟧⟦cite:c1⟧⟦cite:c3⟧⟦cite:c4⟧", "| ⟦cite:c1⟧", "said⟦cite:c2⟧⟦cite:c9⟧", "said ⟦cite:c9⟧"])), (F.col("turn") % 4 + 1).cast("int"))
    names = F.create_map(*(F.lit(x) for k, v in zip(["c1", "c2", "c3", "c4"], "abcd", strict=True) for x in (k, v)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", marks_as_files(made, names).alias("body"))


@book.query("""
SELECT o_orderkey, 'Label ' || (o_orderkey % 5) || CASE WHEN o_orderkey % 2 = 0 THEN ' — text' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' — Termes associés : own er, name' ELSE '' END AS query FROM orders""")
def field_queries(spark, sf_dir):
    k = F.col("o_orderkey")
    patterns = F.when(k % 3 == 0, F.array(*map(F.lit, [r"\bown(er)?\b", "[a-z]?name", r"own\s(er)", r"\d"])))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.field_query(F.concat(F.lit("Label "), _n("o_orderkey", 5)), F.when(k % 2 == 0, "text").otherwise(""), patterns).alias("query"))


_WORDS_SQL = "(SELECT conv_id * 100 + turn AS page, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[[:space:]]+', ' ', 'g')), ' ') AS w FROM conversations))"


@book.query(f"""
SELECT page, pos::BIGINT AS pos FROM {_WORDS_SQL} WHERE pos BETWEEN 3 AND 9 AND page IN (SELECT page FROM {_WORDS_SQL} GROUP BY page HAVING count(*) > 12 AND length(string_agg(word, ' ' ORDER BY pos) FILTER (pos BETWEEN 3 AND 9)) >= 25)""")
def word_hits(spark, sf_dir):
    """The third to ninth word of each long turn as a fragment, found again among its words."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("page"), F.split(tx.squeeze(F.col("text")), " ").alias("w")).where(F.size("w") > 12)
    words = turns.select("page", F.posexplode("w").alias("pos", "text")).withColumn("pos", (F.col("pos") + 1).cast("long"))
    fragments = turns.select("page", tx.fold_citation(F.array_join(F.slice("w", 3, 7), " ")).alias("fragment")).where(F.length("fragment") >= 25)
    return citations.word_hits(words, fragments)


@book.query("SELECT page_id % 7 AS page, min(page_id) AS x0, min(page_id % 100)::BIGINT AS top, max(page_id + 5) AS x1, max(page_id % 100 + 9) AS bottom FROM pages GROUP BY page_id % 7, round_even((page_id % 100) / 2.0, 0)")
def line_boxes(spark, sf_dir):
    p = F.col("page_id")
    words = table(spark, sf_dir, "pages").select((p % 7).alias("page"), p.alias("x0"), (p % 100).alias("top"), (p + 5).alias("x1"), (p % 100 + 9).alias("bottom"))
    return citations.line_boxes(words).drop("line")


@book.query("SELECT o_orderstatus AS grp, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS models FROM orders GROUP BY 1")
def contributing_models(spark, sf_dir):
    return reports.contributing_models(table(spark, sf_dir, "orders").withColumn("grp", F.col("o_orderstatus")), "grp", "o_orderpriority")


@book.query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def risk_counts(spark, sf_dir):
    return reports.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus").withColumnRenamed("o_orderstatus", "status")


@book.query("SELECT user_id, sum(event_id)::BIGINT AS total_tokens, count(*) AS n_calls FROM events GROUP BY user_id")
def token_usage(spark, sf_dir):
    return logs.usage(table(spark, sf_dir, "events").withColumn("total_tokens", F.col("event_id")), "user_id")


@book.query("SELECT 'text' AS limit_name, length(text) AS original_chars, 1500 AS kept_chars FROM documents WHERE length(text) > 1500")
def truncations(spark, sf_dir):
    found = logs.truncations(table(spark, sf_dir, "documents"), "text", 1500, "text")
    return found.withColumn("original_chars", F.col("original_chars").cast("long"))


@book.query("""
WITH p AS (SELECT doc_id % 20 AS grp, doc_id AS part, CASE WHEN quality = 1 THEN NULL ELSE 'e' || toxic END AS error, 'new' AS body FROM labels), f AS (SELECT grp, bool_and(error IS NOT NULL) AS failed FROM p GROUP BY grp)
SELECT grp, part, CASE WHEN failed THEN 'old' ELSE CASE WHEN error IS NULL THEN 'new' ELSE 'failed: ' || error END END AS body FROM p JOIN f USING (grp)""")
def kept_reports(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("grp", F.col("doc_id") % 20)
    bad = F.coalesce(F.col("quality") != 1, F.lit(True))
    parts = labels.select("grp", F.col("doc_id").alias("part"), F.when(~bad, "new").alias("body"), F.when(bad, F.concat(F.lit("e"), F.col("toxic").cast("string"))).alias("error"))
    return logs.kept_report(parts, parts.select("grp", "part", F.lit("old").alias("body")), "grp")


@book.query("""
WITH RECURSIVE t AS (SELECT conv_id, list(length(coalesce(text, '')) ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id),
r AS (
  SELECT conv_id, sizes, 0 AS lo, len(sizes) AS hi, 1 AS attempt,
    CASE WHEN list_sum(sizes) > 1500 THEN 'refused' WHEN (conv_id + len(sizes) + 1) % 3 = 0 OR (len(sizes) = 1 AND conv_id % 10 = 0) THEN 'failed' ELSE 'ok' END AS status FROM t
  UNION ALL
  SELECT conv_id, sizes, x.lo, x.hi, x.attempt,
    CASE WHEN list_sum(sizes[x.lo + 1 : x.hi]) > 1500 THEN 'refused' WHEN (conv_id + x.lo * 7 + x.hi + x.attempt) % 3 = 0 OR (x.hi - x.lo = 1 AND conv_id % 10 = 0) THEN 'failed' ELSE 'ok' END
  FROM (SELECT conv_id, sizes, unnest(CASE WHEN status = 'refused' AND hi - lo > 1 THEN [{'lo': lo, 'hi': (lo + hi) // 2, 'attempt': 1}, {'lo': (lo + hi) // 2, 'hi': hi, 'attempt': 1}]
    WHEN status = 'failed' AND attempt < 3 THEN [{'lo': lo, 'hi': hi, 'attempt': attempt + 1}] ELSE [] END) AS x FROM r))
SELECT conv_id, lo::INT AS lo, hi::INT AS hi, attempt::INT AS attempt, status, CASE WHEN status = 'ok' THEN list_sum(sizes[lo + 1 : hi])::VARCHAR END AS answer FROM r
WHERE status = 'ok' OR (status = 'refused' AND hi - lo = 1) OR (status = 'failed' AND attempt = 3)""")
def settled_calls(spark, sf_dir):
    """Conversations as batches for a provider that refuses more than 1,500 characters and fails now and then."""
    size = F.length(F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", size.alias("size"))))
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["size"]).alias("sizes"))

    def provider(pending):
        total = F.aggregate(F.slice("sizes", F.col("lo") + 1, F.col("hi") - F.col("lo")), F.lit(0).cast("long"), lambda a, x: a + x)
        odd = (F.col("conv_id") + F.col("lo") * 7 + F.col("hi") + F.col("attempt")) % 3 == 0
        stuck = (F.col("hi") - F.col("lo") == 1) & (F.col("conv_id") % 10 == 0)
        status = F.when(total > 1500, "refused").when(odd | stuck, "failed").otherwise("ok")
        told = pending.join(lists, "conv_id").withColumn("status", status)
        return told.withColumn("answer", F.when(F.col("status") == "ok", total.cast("string")))

    return retries.settled(lists.select("conv_id", F.size("sizes").alias("size")), "conv_id", provider)
