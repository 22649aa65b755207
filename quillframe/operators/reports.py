"""Report tables: category counts, folder trees, markdown blocks, frozen JSON and parsed narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import fold_accents, strip_space, table_cell
from quillframe.operators.planning import sums_before


def cartography(docs: DataFrame, category: str, pivots: list[str]) -> DataFrame:
    """Documents per category, pivots first, then by number and name."""
    counted = docs.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    return counted.withColumn("is_pivot", F.coalesce(F.col("category").isin(*pivots), F.lit(False))).orderBy(F.desc("is_pivot"), F.desc("n"), "category")


def tree_rollup(paths: DataFrame, path: str) -> DataFrame:
    """Number of files below every folder, at any depth."""
    parts = F.split(path, "/")
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"), F.size(parts).alias("_n"))
    return prefixes.where("_n > 1").groupBy("folder").agg(F.count("*").alias("n_files"))


def markdown_table(header: list[str], rows: Column) -> Column:
    """A markdown table of an array of structs whose fields are strings in the header's order."""
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header)
    return F.concat_ws("\n", F.lit(head), F.transform(rows, lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *(table_cell(F.coalesce(r[f"c{i}"], F.lit(""))) for i in range(len(header)))), F.lit(" |"))))


def lines_by(rows: DataFrame, group: str, order: list[str], line: Column) -> DataFrame:
    """The group's lines in order, joined by newlines."""
    made = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(made, lambda s: s["line"]), "\n").alias("body"))


def frozen_json(rows: DataFrame, group: str, order: list[str], *columns: str) -> DataFrame:
    """One JSON document per group: its rows as an ordered list of objects."""
    return rows.groupBy(group).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("row")))), lambda s: s["row"])).alias("report"))


def distinct_targets(plan: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Target names made distinct within their folder: the first keeps its name, others get the next of -2, -3, ... that
    no name of the folder has already. Equal names, however many, are counted in ranges of their order."""
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^./]+$", ""), F.regexp_extract(name, r"(?<=.)(\.[^./]+)$", 1)
    numbered = sums_before(plan, [folder, name], order, _nth=F.lit(1)).withColumns({"_stem": stem, "_ext": ext})
    number = F.expr("try_cast(regexp_extract(_stem, '^(.*)-([1-9][0-9]*)$', 2) AS int)")
    suffixed = numbered.select(F.col(folder).alias("_folder"), F.regexp_extract("_stem", r"^(.*)-(\d+)$", 1).alias("_base"), F.col("_ext").alias("_kind"), number.alias("_taken"))
    used = suffixed.where("_taken >= 2").groupBy("_folder", "_base", "_kind").agg(F.array_sort(F.collect_set("_taken")).alias("_used"))
    same = F.col(folder).eqNullSafe(F.col("_folder")) & (F.col("_stem") == F.col("_base")) & (F.col("_ext") == F.col("_kind"))
    joined = numbered.join(used, same, "left")
    free_below = F.transform("_used", lambda u, i: u - 2 - i)  # free suffixes below a taken one
    passed = F.when(F.col("_used").isNull(), 0).otherwise(F.size(F.filter(free_below, lambda f: f < F.col("_nth"))))
    suffix = (F.col("_nth") + 1 + passed).cast("string")
    target = F.when(F.col("_nth") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("-"), suffix, "_ext"))
    return joined.withColumn("target", target).drop("_nth", "_stem", "_ext", "_used", "_folder", "_base", "_kind")


def composite(files: DataFrame, group: str, path: str, *, indent: str = "  ") -> DataFrame:
    """(group, body): one markdown report for each group: its folder tree in depth-first order, each folder with the number
    of files below it at any depth and each file in its place, indented by depth.

    The order is that of the paths as lists of names, files of a folder before its folders. Nodes are counted by partial
    aggregates, so a hot folder is one row; a group's lines meet in its report, which is its result.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    named = files.select(group, parts.alias("_parts")).where(F.size("_parts") > 0)
    folders = named.where(F.size("_parts") > 1).select(group, F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: F.slice("_parts", F.lit(1), i))).alias("_at"))
    kept = folders.groupBy(group, "_at").agg(F.count("*").alias("_n")).withColumn("_file", F.lit(False))
    leaves = named.groupBy(group, F.col("_parts").alias("_at")).agg(F.count("*").alias("_n")).withColumn("_file", F.lit(True))
    nodes = kept.unionByName(leaves)
    name, depth = F.element_at("_at", -1), F.size("_at") - 1
    shown = F.when(F.col("_file"), F.concat(name, F.when(F.col("_n") > 1, F.concat(F.lit(" x"), F.col("_n").cast("string"))).otherwise(""))).otherwise(F.concat(F.lit("**"), name, F.lit("/** ("), F.col("_n").cast("string"), F.lit(")")))
    line = F.concat(F.repeat(F.lit(indent), depth), F.lit("- "), shown)
    last = F.size("_at")
    step = F.transform("_at", lambda p, i: F.struct((~((i == last - 1) & F.col("_file"))).cast("int").alias("folder"), p.alias("name")))
    return lines_by(nodes.withColumn("_order", step), group, ["_order"], line)


#: Fixed forms of narrative reports.
DIVERGENCE = r"(?i)^\s*(?:\*\*)?\s*(?:⚠️\s*)?Divergences?\b[^:*\n]{0,40}(?:\*\*)?\s*:"
ABSENCE = r"(?iu)non précisé|non renseigné|absent des documents|non disponible|non fourni"


def narrative_topics(markdown: Column) -> Column:
    """array<struct<title, body, divergences, absences>> of the report's second-level headings."""
    clean = F.replace(markdown, F.lit("\r\n"), F.lit("\n"))
    split = F.split(F.concat(F.lit("\n"), clean), r"\n## +", -1)
    parts = F.slice(split, F.lit(2), F.size(split))

    def topic(part):
        lines = F.filter(F.split(part, "\n"), lambda x: ~F.regexp_like(strip_space(x), F.lit(r"^```\w*\s*$")))
        inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        rest = strip_space(F.array_join(F.filter(inner, lambda x: ~F.regexp_like(x, F.lit(DIVERGENCE))), "\n"))
        body = strip_space(F.regexp_replace(rest, r"(^|\n)_\(?Sources?\b[^\n]*_$", ""))
        return F.struct(strip_space(F.get(lines, F.lit(0))).alias("title"), body.alias("body"), F.transform(F.filter(inner, lambda x: F.regexp_like(x, F.lit(DIVERGENCE))), strip_space).alias("divergences"), F.regexp_count(body, F.lit(ABSENCE)).alias("absences"))

    return F.transform(parts, topic)


#: Fixed forms of a topic's entry in an index.
TITLE_CUT, SHORT, ANCHOR = r"\s+[—–-]\s+|\s*[(,]", 30, 40


def short_title(title: Column) -> Column:
    """A title up to its first separator; a longer one is cut after a whole word, in its second half, with an ellipsis."""
    head = F.coalesce(F.nullif(strip_space(F.get(F.split(title, TITLE_CUT), F.lit(0))), F.lit("")), title)
    cut = F.left(head, F.lit(SHORT))
    word = F.regexp_extract(cut, "^(.*) [^ ]*$", 1)
    return F.when(F.length(head) <= SHORT, head).otherwise(F.concat(F.regexp_replace(F.when(F.length(word) > SHORT / 2, word).otherwise(cut), r"\s+$", ""), F.lit("…")))


def anchor(title: Column, place: Column) -> Column:
    """theme-<place>-<slug of at most 40 characters>."""
    base = F.regexp_replace(F.regexp_replace(fold_accents(F.lower(title)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.lit("theme-"), place.cast("string"), F.lit("-"), F.left(base, F.lit(ANCHOR)))


def status_counts(risks: DataFrame, status: str = "status") -> DataFrame:
    return risks.groupBy(status).agg(F.count("*").alias("n"))


def topic_totals(topics: DataFrame, group: str) -> DataFrame:
    """Divergences and absences over a report's topics."""
    return topics.groupBy(group).agg(F.sum(F.size("divergences")).alias("n_divergences"), F.sum("absences").alias("n_absences"))


def contributing_models(rows: DataFrame, group: str, model: str = "model") -> DataFrame:
    """Sorted distinct model names of each group, comma-joined."""
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(model)), ", ").alias("models"))


def hazard_lines(report: Column, labels: dict[str, str]) -> Column:
    """Label and value lines of a hazard map, in the labels' order; unknown values are left out."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.element_at(report, k), F.lit("")) != "", F.concat(F.lit(f"- {label} : "), F.element_at(report, k))) for k, label in labels.items()))), "\n")


def reorganisation(docs: DataFrame, dossier: str, order: str) -> DataFrame:
    """source -> target of every document in the sorted copy. docs: category, lot, name (the wished one)."""
    lot = F.when(F.coalesce("lot", F.lit("")) != "", F.concat(F.lit("/LOT "), F.translate("lot", "/\\", "--"))).otherwise("")
    placed = docs.withColumn("folder", F.concat(dossier, F.lit("/"), "category", lot))
    return distinct_targets(placed, "folder", "name", order).withColumn("target_path", F.concat_ws("/", "folder", "target"))


def with_missing(schema: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every schema entry in its order, with its row or nulls. schema: key, ord."""
    return schema.join(rows, key, "left").orderBy(F.asc_nulls_last("ord"), key)
