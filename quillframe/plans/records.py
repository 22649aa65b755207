"""Free-form records and reports taken apart: JSON members of events and pages, markdown of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import json_tree, markdown
from quillframe.plans.book import Book
from quillframe.sources.tables import table

book = Book()


@book.query("SELECT event_id, j.key AS name, j.value ->> '$' AS value FROM events, json_tree(props) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')")
def props_members(spark, sf_dir):
    return json_tree.members(table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "name", "value")


_RECORD_SQL = """json_object('url', url, 'n', page_id, 'tags', json_array('loose', json_object('mark', '')),
  'lots', json_array(json_object('body', html, 'buyer', json_object('profil', url || '/p')), json_object('body', 'short', 'open', true)))"""


@book.query(f"""
WITH r AS (SELECT page_id, {_RECORD_SQL} AS record FROM pages), t AS (SELECT page_id, j.id, j.parent, j.key, j.type, j.value ->> '$' AS value FROM r, json_tree(record) j)
SELECT c.page_id, c.key AS name, sha256(c.value) AS value FROM t c JOIN t p ON p.page_id = c.page_id AND p.id = c.parent AND p.type = 'OBJECT' WHERE c.type = 'VARCHAR'""")
def record_strings(spark, sf_dir):
    """Nested records with a page's whole text in them; loose strings of an array have no key."""
    marked = F.to_json(F.struct(F.lit("").alias("mark")))
    lot = F.struct(F.col("html").alias("body"), F.struct(F.concat("url", F.lit("/p")).alias("profil")).alias("buyer"))
    lots = F.concat(F.lit("["), F.to_json(lot), F.lit(',{"body":"short","open":true}]'))
    url = F.to_json(F.struct("url", F.col("page_id").alias("n")))
    record = F.concat(F.regexp_replace(url, r"\}$", ""), F.lit(',"tags":["loose",'), marked, F.lit('],"lots":'), lots, F.lit("}"))
    found = json_tree.strings(table(spark, sf_dir, "pages").select("page_id", record.alias("record")), "page_id", "record")
    return found.select("page_id", "name", F.sha2("value", 256).alias("value"))


@book.query("""
WITH t AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations),
f AS (SELECT conv_id, text, min(turn) AS turn FROM t WHERE text <> '' GROUP BY ALL)
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id""")
def multilingual_turns(spark, sf_dir):
    """A conversation as a repeated multilingual value: the preferred language where it says something, else the first."""
    turns = table(spark, sf_dir, "conversations")
    shape = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("role").alias("eng"), F.array("text").alias("fra"))))
    shape = shape.when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.lit("").alias("fra"), F.lit(0).alias("x"), F.col("text").alias("deu"), F.col("role").alias("eng"))))
    values = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", shape.otherwise(F.to_json(F.array("text"))).alias("v")))).alias("v"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x["v"]), ","), F.lit("]"))
    return json_tree.multilingual(values.select("conv_id", joined.alias("value")), "conv_id", "value")


_LINE = "regexp_replace(text, '[[:space:]]+', ' ', 'g')"


def _reports(turns, line):
    """One text for each conversation, its turns' texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("report"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("said", F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))


@book.query(f"""
WITH t AS (SELECT conv_id, turn, role, {_LINE} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations)
SELECT conv_id, p * 11 AS n, 'heading' AS kind, 3 AS level, sha256('of ' || role) AS lines, 0 AS n_bold FROM t
UNION ALL SELECT conv_id, p * 11 + 2, 'paragraph', 0, sha256('said:' || chr(10) || trim('**' || role || '** x ' || said)), 1 FROM t
UNION ALL SELECT conv_id, p * 11 + 5, 'header', 0, sha256('turn' || chr(10) || 'who'), 0 FROM t
UNION ALL SELECT conv_id, p * 11 + 7, 'row', 0, sha256(turn || chr(10) || '**' || role || '**'), 1 FROM t
UNION ALL SELECT conv_id, p * 11 + 8, 'bullet', 0, sha256('one' || chr(10) || 'goes on'), 0 FROM t
UNION ALL SELECT conv_id, p * 11 + 10, 'sub-bullet', 0, sha256('two'), 0 FROM t""")
def report_blocks(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    lines = (F.concat(F.lit("### of "), "role"), F.lit(""), F.lit("said:"), F.concat(F.lit("**"), "role", F.lit("** x "), "said"), F.lit(""), F.lit("| turn | who |"), F.lit("|---|:--|"),
             F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | **"), "role", F.lit("** |")), F.lit("- one"), F.lit("  goes on"), F.lit("  - two"))
    found = markdown.blocks(_reports(turns, F.concat_ws("\n", *lines)), "conv_id", "report")
    bold = F.size(F.filter(F.flatten(F.transform("lines", markdown.runs)), lambda r: r["bold"]))
    return found.select("conv_id", F.col("n").cast("long").alias("n"), "kind", "level", F.sha2(F.array_join("lines", "\n"), 256).alias("lines"), bold.alias("n_bold"))


@book.query(f"""
WITH t AS (SELECT conv_id, turn, role, trim({_LINE}) AS said FROM conversations)
SELECT conv_id, 'Section ' || turn AS section, CASE WHEN turn % 2 = 0 THEN '🔴' ELSE '🟢' END AS status, role AS element, 'Sol' AS risk, CASE WHEN turn % 3 = 0 THEN 'Eau' ELSE '' END AS hazard,
  sha256('seen ' || said) AS situation, CASE WHEN turn % 2 = 0 THEN 'first rest|second' ELSE '' END AS analysis, '' AS impact, CASE WHEN turn % 3 = 0 THEN 'look|look again' ELSE 'only text' END AS advice
FROM t WHERE turn % 5 <> 4""")
def report_risks(spark, sf_dir):
    """Audit reports with sections without a risk, parts without text, placeholders, bullets and plain advice."""
    status = F.when(F.col("turn") % 5 == 4, "_none_").otherwise(F.concat(F.lit("[STATUT : "), F.when(F.col("turn") % 2 == 0, "🔴").otherwise("🟢"), F.lit("] | ["), "role", F.lit("] | [Sol"), F.when(F.col("turn") % 3 == 0, " / Eau").otherwise(""), F.lit("]")))
    situation, analysis, _, advice = markdown.LABELS.values()
    lines = (F.concat(F.lit("### Section "), F.col("turn").cast("string")), status, F.concat(F.lit(f"{situation} seen "), "said"), F.lit(""), F.lit(analysis),
             F.when(F.col("turn") % 2 == 0, "first\n rest\n\nsecond").otherwise("_nothing_"), F.lit(advice), F.when(F.col("turn") % 3 == 0, "text\n- look\n- look again").otherwise("only text"), F.lit("---"))
    reports = _reports(_turns(spark, sf_dir), F.concat_ws("\n", *lines)).withColumn("report", F.concat(F.lit(f"# Report\n## {markdown.DETAILED}\n"), "report", F.lit("\n## End\n### Section of no part\n")))
    found = markdown.audit_risks(reports, "conv_id", "report")
    return found.select("conv_id", "section", "status", "element", "risk", "hazard", F.sha2("situation", 256).alias("situation"), F.array_join("analysis", "|").alias("analysis"), "impact", F.array_join("advice", "|").alias("advice"))
