"""Markdown reports as rows, by line automata in window functions: a line's state is the block that it opens or goes on.

Lines are exploded with their number; what a line belongs to follows from the last line before it that opens something.
Everything is expressions and windows over a document's lines, so there is no Python and no growing state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed forms of lines.
HEADING, BULLET, NUMBER = r"^(#{1,6})\s+(.*)$", r"^[-*]\s+(.*)$", r"^\d+\.\s+(.*)$"
RULE = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def runs(text: Column) -> Column:
    """array<struct<text, bold>>: what stands between double asterisks is bold."""
    pieces = F.regexp_extract_all(text, F.lit(r"\*\*[^*]+\*\*|(?:(?!\*\*[^*]+\*\*)[\s\S])+"), F.lit(0))
    bold = lambda p: F.regexp_like(p, F.lit(r"^\*\*[^*]+\*\*$"))
    return F.transform(pieces, lambda p: F.struct(F.when(bold(p), F.substr(p, F.lit(3), F.length(p) - 4)).otherwise(p).alias("text"), bold(p).alias("bold")))


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|"), strip)


def numbered_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line): the lines of each text, without blanks at their ends."""
    split = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")
    return documents.select(key, F.posexplode(split).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))


def blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, kind, level, lines): headings, table headers and rows, bullets, numbers, sub-bullets and paragraphs.

    ``n`` is the line that a block starts at. A heading, item, row or header is one line, an item's indented lines and a
    paragraph's go on in ``lines``; an indented bullet below an item is a sub-bullet of its own. A line of cells is a table's
    header if a rule follows; the rule vanishes, and lines of cells after it are rows up to the first other line. Cells
    without such a header are a paragraph. ``lines`` has the cells of headers and rows. ``key`` must be unique.
    """
    here = Window.partitionBy(key).orderBy("n")
    line = F.col("line")
    is_ = lambda form: F.regexp_like(line, F.lit(form))
    piped = F.startswith(strip(line), F.lit("|"))
    form = (
        F.when(line == "", "blank").when(is_(HEADING), "heading").when(is_(BULLET), "bullet").when(is_(NUMBER), "number").when(is_(r"^\s"), "indented").otherwise("plain")
    )
    seen = numbered_lines(documents, key, text).withColumns({"form": form, "piped": piped, "rule": F.regexp_like(strip(line), F.lit(RULE))})
    owner = F.last(F.when(F.col("form") != "indented", F.col("form")), ignorenulls=True).over(here)
    owned = seen.withColumn("goes_on", (F.col("form") == "indented") & F.coalesce(owner, F.lit("")).isin("bullet", "number"))
    cell_line = F.col("piped") & ~F.col("goes_on") & F.col("form").isin("plain", "indented")
    ruled = owned.withColumns({"cell": cell_line, "next_rule": F.coalesce(F.lead("rule").over(here), F.lit(False)), "was_cell": F.coalesce(F.lag(cell_line).over(here), F.lit(False))})
    below_rule = ruled.withColumn("sep", F.col("rule") & F.col("was_cell"))
    inside = below_rule.withColumn("run", F.count_if(~(F.col("cell") | F.col("sep"))).over(here))
    opens = F.col("cell") & F.col("next_rule")
    first = F.min(F.when(opens, F.col("n"))).over(Window.partitionBy(key, "run"))
    kind = (
        F.when(F.col("form") == "blank", None)
        .when(F.col("form").isin("heading", "bullet", "number"), F.col("form"))
        .when(F.col("goes_on"), F.when(F.regexp_like(strip(line), F.lit(BULLET)), "sub-bullet").otherwise("more"))
        .when(F.col("cell") & (F.col("n") == first), "header")
        .when(F.col("sep") & (F.col("n") == first + 1), None)
        .when(F.col("cell") & (F.col("n") > first), "row")
        .otherwise("paragraph")
    )
    told = inside.withColumn("first", first).withColumn("kind", kind)
    before = F.lag(F.coalesce("kind", F.lit(""))).over(here)
    starts = F.col("kind").isNotNull() & (F.col("kind") != "more") & ~((F.col("kind") == "paragraph") & F.coalesce(before == "paragraph", F.lit(False)))
    placed = told.withColumn("_starts", starts).where("kind IS NOT NULL").withColumn("at", F.max(F.when(F.col("_starts"), F.col("n"))).over(here))
    body = F.when(F.col("kind") == "heading", F.regexp_extract("line", HEADING, 2)).when(F.col("kind") == "number", F.regexp_extract("line", NUMBER, 1)).when(F.col("kind").isin("bullet", "sub-bullet"), F.regexp_extract(strip(line), BULLET, 1)).otherwise(strip(line))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    parts = F.when(F.col("kind").isin("header", "row"), cells(line)).otherwise(F.array(body))
    ordered = F.array_sort(F.collect_list(F.struct("n", "kind", level.alias("level"), parts.alias("parts"))))
    grouped = placed.groupBy(key, "at").agg(ordered.alias("all"))
    return grouped.select(key, F.col("at").alias("n"), F.col("all")[0]["kind"].alias("kind"), F.col("all")[0]["level"].alias("level"), F.flatten(F.transform("all", lambda x: x["parts"])).alias("lines"))


#: Fixed forms of an audit report.
RISK = r"^\[STATUT\s*:\s*(🔴|🟠|🟡|🟢)\]\s*\|\s*\[([^\]]*)\]\s*\|\s*\[([^\]]*)\]\s*$"
LABELS = {
    "situation": "**Exposé de la situation :**",
    "analysis": "**Analyse de l'Expert & Référentiel :**",
    "impact": "**Impact Assurabilité :**",
    "advice": "**Recommandation de levée de doute :**",
}
DETAILED = "Analyse détaillée"


def audit_risks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, section, status, element, risk, hazard, situation, analysis, impact, advice): the risks of an audit report.

    A risk opens at its status line, below a third-level heading of the detailed part, and ends at the next heading or
    rule; a section has one risk. A label opens one of its four parts. Lines of a part up to a blank one are a paragraph;
    situation and impact join theirs, analysis and advice list them. If advice has bullets, those are its list. Entries
    that are one placeholder in underscores are left out of lists.
    """
    here = Window.partitionBy(key).orderBy("n")
    line = F.col("line")
    heading = F.regexp_like(line, F.lit(r"^##\s+"))
    title = F.when(heading, strip(F.regexp_replace("line", r"^##\s+", "")))
    lines = numbered_lines(documents, key, text).withColumn("_part", F.last(title, ignorenulls=True).over(here))
    below = F.regexp_like(line, F.lit(r"^###\s+")) & F.startswith(F.coalesce("_part", F.lit("")), F.lit(DETAILED))
    ends = heading | below | F.regexp_like(strip(line), F.lit(r"^-{3,}$"))
    opened = lines.withColumns({"_below": below, "_stretch": F.count_if(ends).over(here), "_chapter": F.count_if(heading | below).over(here)})
    named = F.first(F.when(F.col("_below"), strip(F.regexp_replace("line", r"^###\s+", ""))), ignorenulls=True).over(Window.partitionBy(key, "_chapter"))
    risky = F.min(F.when(F.regexp_like(line, F.lit(RISK)), F.col("n"))).over(Window.partitionBy(key, "_stretch"))
    inside = opened.withColumns({"section": named, "_risk": risky}).where("section IS NOT NULL AND n >= _risk")
    label = F.coalesce(*(F.when(F.startswith(line, F.lit(form)), F.lit(name)) for name, form in LABELS.items()))
    rest = F.coalesce(*(F.when(F.startswith(line, F.lit(form)), strip(F.substr(line, F.lit(len(form) + 1)))) for form in LABELS.values()), line)
    within = Window.partitionBy(key, "_risk").orderBy("n")
    parts = inside.withColumns({"_label": F.last(label, ignorenulls=True).over(within), "_opens": label.isNotNull(), "_rest": rest})
    marked = parts.withColumns({"_gap": F.count_if((strip(F.col("_rest")) == "") | F.col("_opens")).over(within), "_bullet": F.regexp_like("_rest", F.lit(BULLET))})
    body = marked.where("_label IS NOT NULL AND trim(_rest) <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", strip(F.col("_rest")).alias("t")))), lambda x: x["t"]), " ")
    paragraphs = body.groupBy(key, "_risk", "_label", "_gap").agg(joined.alias("t"), F.min("n").alias("n"))
    points = body.where("_bullet AND _label = 'advice'").select(key, "_risk", F.lit("points").alias("_label"), "_gap", strip(F.regexp_extract("_rest", BULLET, 1)).alias("t"), "n")
    said = paragraphs.unionByName(points).groupBy(key, "_risk").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("_label") == p, F.struct("n", "t")))), lambda x: x["t"]).alias(p) for p in (*LABELS, "points")))
    heads = inside.where("n = _risk").select(key, "_risk", "section", *(F.regexp_extract("line", RISK, i + 1).alias(c) for i, c in enumerate(("status", "element", "_title"))))
    whole = heads.join(said, [key, "_risk"], "left")
    listed = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~F.regexp_like(x, F.lit("^_[^_]*_$")))
    split = F.split("_title", " / ", 2)
    return whole.select(
        key, F.col("_risk").alias("n"), "section", "status", strip(F.col("element")).alias("element"), strip(split[0]).alias("risk"), strip(F.coalesce(F.get(split, F.lit(1)), F.lit(""))).alias("hazard"),
        F.coalesce(F.array_join("situation", "\n\n"), F.lit("")).alias("situation"), listed(F.col("analysis")).alias("analysis"), F.coalesce(F.array_join("impact", "\n\n"), F.lit("")).alias("impact"),
        listed(F.when(F.size("points") > 0, F.col("points")).otherwise(F.col("advice"))).alias("advice"),
    )
