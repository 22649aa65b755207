"""Citation labels: resolving, numbering, and finding the cited passage on its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import LABEL, LABEL_GROUP, fold_citation, found_at, fragments
from quillframe.operators.planning import numbered


def label_rows(texts: DataFrame) -> DataFrame:
    """(scope, pos, group_no, label_no, grp, label): every label of every group. texts: scope, pos, text."""
    groups = texts.select("scope", "pos", F.posexplode(F.regexp_extract_all("text", F.lit(LABEL_GROUP), F.lit(0))).alias("group_no", "grp"))
    return groups.select("*", F.posexplode(F.regexp_extract_all("grp", F.lit(LABEL), F.lit(1))).alias("label_no", "label"))


def registry(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """Known labels numbered c1, c2, ... by first appearance of their (document, scope, excerpt).

    refs: scope, label, document_id, filename, excerpt. Unknown labels have no row. The numbering is global and runs by
    ranges of the order.
    """
    known = label_rows(texts).join(refs, ["scope", "label"]).withColumn("at", F.struct("pos", "group_no", "label_no"))
    first = known.groupBy("document_id", "scope", "excerpt").agg(F.min("at").alias("first"), F.min("filename").alias("filename"))
    placed = numbered(first, "n", "first", "scope", "document_id", "excerpt")
    return placed.select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("key"), "document_id", "scope", "filename", "excerpt")


def resolved(text: Column, keys: Column) -> Column:
    """text with each label group replaced by the markers of its known labels. keys: map of label -> cN. A group without
    a known label disappears in brackets and stays in parentheses."""
    found = F.regexp_extract_all(text, F.lit(LABEL_GROUP), F.lit(0))
    between = F.split(text, LABEL_GROUP, -1)

    def one(group):
        marks = F.array_join(F.transform(F.filter(F.regexp_extract_all(group, F.lit(LABEL), F.lit(1)), lambda x: F.map_contains_key(keys, x)), lambda x: F.concat(F.lit("⟦cite:"), F.element_at(keys, x), F.lit("⟧"))), "")
        return F.when((marks == "") & F.startswith(group, F.lit("(")), group).otherwise(marks)

    rows = F.zip_with(between, F.transform(found, one), lambda b, m: F.concat(F.coalesce(b, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.regexp_replace(F.array_join(rows, ""), r"^\s+|\s+$", "")


def locate(citations: DataFrame, pages: DataFrame, *, least: int = 25) -> DataFrame:
    """Per citation the first page on which its first findable fragment stands.

    citations: cite_id, document_id, citation; pages: document_id, page, folded. Fragments are tried in order, prefixes
    after the whole; an exact page hit never competes with a later fragment's.
    """
    parts = citations.select("cite_id", "document_id", F.posexplode(fragments(F.col("citation"), least)).alias("fragment_no", "fragment"))
    hits = parts.join(pages, "document_id").withColumn("hit", found_at(F.col("folded"), F.col("fragment"), least)).where("hit IS NOT NULL")
    best = hits.groupBy("cite_id").agg(F.min(F.struct("fragment_no", "page", F.col("hit.position").alias("position"), F.col("hit.length").alias("length"))).alias("b"))
    return best.select("cite_id", "b.fragment_no", "b.page", "b.position", "b.length")


#: Passages, and bytes of them, up to which they are broadcast to the pages, after they were counted; more meet them by a
#: shuffle.
MOST_PASSAGES, MOST_BYTES = 100_000, 64_000_000


def anywhere(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """(cite_id, page): pages on which a whole folded passage stands. passages: cite_id, fragment; pages: page, folded.

    A passage's longest word that is whole on both sides of it is its key, and pages meet it by their distinct words, so
    only pages with that word are compared. Counted passages of a bounded number come to the pages, whose words then never
    leave their row; more of them are joined by a shuffle of the words that are wanted. Passages of fewer than three words
    have no word that must be whole: they share one key, the empty word, with all pages.
    """
    inner = F.expr("slice(split(fragment, ' '), 2, greatest(size(split(fragment, ' ')) - 2, 0))")
    longest = F.coalesce(F.reduce(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)), F.lit(""))
    keyed = passages.withColumn("word", longest)
    n, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("fragment")), F.lit(0))).first()
    few = n <= MOST_PASSAGES and size <= MOST_BYTES
    own = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split("folded", " ")))).alias("word")
    if few:
        met = pages.select("page", "folded", own).join(F.broadcast(keyed), "word")
        return met.where(F.contains("folded", F.col("fragment"))).select("cite_id", "page")
    wanted = pages.select("page", own).join(keyed.select("word").distinct(), "word", "left_semi")
    pairs = wanted.join(keyed, "word").select("page", "cite_id", "fragment")
    return pairs.join(pages, "page").where(F.contains("folded", F.col("fragment"))).select("cite_id", "page")


def word_hits(words: DataFrame, fragments_of: DataFrame) -> DataFrame:
    """(page, pos): the words of a page that a fragment covers. words: page, pos, text; fragments_of: page, fragment (folded).

    The page's text is its folded words with one space between; a word that folds to nothing has no place in it.
    """
    token = fold_citation(F.col("text"))
    placed = words.withColumn("token", token).where("token <> ''").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["token"]), " ")
    start = F.struct(F.lit(1).alias("at"), F.expr("CAST(array() AS array<struct<pos:bigint,start:int,stop:int>>)").alias("out"))

    def add(acc, x):
        stop = acc["at"] + F.length(x["token"])
        return F.struct((stop + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), acc["at"].alias("start"), stop.alias("stop")))).alias("out"))

    spans = placed.select("page", text.alias("folded"), F.aggregate("w", start, add, lambda acc: acc["out"]).alias("spans"))
    hits = spans.join(fragments_of, "page").withColumn("hit", found_at(F.col("folded"), F.col("fragment"))).where("hit IS NOT NULL")
    covered = F.filter("spans", lambda s: (s["start"] < F.col("hit.position") + F.col("hit.length")) & (s["stop"] > F.col("hit.position")))
    return hits.select("page", F.explode(covered).alias("s")).select("page", "s.pos").distinct()


def line_boxes(words: DataFrame) -> DataFrame:
    """One box per line of hit words. words: page, x0, top, x1, bottom."""
    return words.groupBy("page", F.bround(F.col("top") / 2).alias("line")).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
