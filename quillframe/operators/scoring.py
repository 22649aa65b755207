"""Pattern scores of texts against a catalog, rule classification and ranked candidates.

A catalog is a short list known to the driver, so scoring is a projection of each text, never a join: one score for each
entry, with the entry's ordinal as the tie-break. A text is folded once and each pattern runs once over it: the scores
pass through a one-row generator, below which no filter on them is pushed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import ascii_lower


@dataclass(frozen=True)
class Entry:
    """A category, piece or field: its patterns each count once however often they occur."""

    name: str
    patterns: tuple[str, ...]


def _hit(text: Column, lower: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text. A case-blind literal is looked for in the lowered text; where a pattern
    has a literal between word bounds, the literal is looked for first."""
    if plain := re.fullmatch(r"\(\?i\)([A-Za-z0-9 ]+)", pattern):
        return F.contains(lower, F.lit(plain[1].lower()))
    if word := re.fullmatch(r"\(\?i\)\(\?<!\[A-Za-z0-9\]\)([A-Za-z0-9 ]+)\(\?!\[A-Za-z0-9\]\)", pattern):
        return F.contains(lower, F.lit(word[1].lower())) & F.regexp_like(lower, F.lit(pattern.removeprefix("(?i)").replace(word[1], word[1].lower())))
    return F.regexp_like(text, F.lit(pattern))


def _scored(docs: DataFrame, catalog: list[Entry], text: Column, *keep: str) -> DataFrame:
    """The kept columns and one score for each entry, s0, s1, ..."""
    once = docs.select(*keep, F.explode_outer(F.array(text)).alias("_text"))
    once = once.select(*keep, "_text", F.explode_outer(F.array(ascii_lower(F.col("_text")))).alias("_lower"))
    each = [sum((F.coalesce(_hit(F.col("_text"), F.col("_lower"), p), F.lit(False)).cast("int") for p in e.patterns), F.lit(0)).alias(f"s{i}") for i, e in enumerate(catalog)]
    return once.select(*keep, F.inline_outer(F.array(F.struct(*each))))


def score_rows(docs: DataFrame, catalog: list[Entry], text: Column, *keep: str) -> DataFrame:
    """One row per document and entry that scores."""
    rows = F.array(*(F.struct(F.lit(e.name).alias("name"), F.lit(i).alias("ord"), F.col(f"s{i}").alias("score")) for i, e in enumerate(catalog)))
    return _scored(docs, catalog, text, *keep).select(*keep, F.inline_outer(rows)).where("score > 0")


def _decided(scored: DataFrame, catalog: list[Entry], keep: tuple[str, ...], least: int, lead: int) -> DataFrame:
    """The decision from the scores s0, s1, ... of rows; rows that score nothing are left out."""
    each = [F.col(f"s{i}") for i in range(len(catalog))]
    best = scored.withColumn("score", F.greatest(*each, F.lit(0))).where("score > 0")
    top = F.coalesce(*(F.when(s == F.col("score"), i) for i, s in enumerate(each)))
    placed = best.withColumn("_top", top)
    gap = F.col("score") - F.greatest(F.lit(0), F.lit(0), *(F.when(F.col("_top") != i, s) for i, s in enumerate(each)))
    name = F.element_at(F.array(*(F.lit(e.name) for e in catalog)), F.col("_top") + 1)
    return placed.select(*keep, F.when((F.col("score") >= least) & (gap >= lead), name).alias("category"), "score", gap.alias("gap"))


def classify(docs: DataFrame, catalog: list[Entry], text: Column, *keep: str, least: int = 2, lead: int = 1) -> DataFrame:
    """The category of highest score if it is high and leads clearly, else null; ``score`` and ``gap`` tell why."""
    return _decided(_scored(docs, catalog, text, *keep), catalog, keep, least, lead)


def classify_files(files: DataFrame, catalog: list[Entry], stem: Column, text: Column, *keep: str, least: int = 2, lead: int = 1) -> DataFrame:
    """As classify, over the scores of a file's name and of its text together; a name that says nothing does not count.
    stem: the name without its extension. One projection for both, so nothing is joined."""
    told = F.when(says_nothing(stem), "").otherwise(stem)
    named = _scored(files.withColumns({"_stem": told, "_body": text}), catalog, F.col("_stem"), *keep, "_body")
    names = {f"s{i}": f"n{i}" for i in range(len(catalog))}
    both = _scored(named.withColumnsRenamed(names), catalog, F.col("_body"), *keep, *names.values())
    summed = {s: F.coalesce(s, F.lit(0)) + F.coalesce(n, F.lit(0)) for s, n in names.items()}
    return _decided(both.withColumns(summed), catalog, keep, least, lead)


def combined(file_scores: DataFrame, text_scores: DataFrame, *key: str) -> DataFrame:
    """Scores of file name and content added per document and category."""
    return file_scores.unionByName(text_scores).groupBy(*key, "name", "ord").agg(F.sum("score").alias("score"))


#: Fixed: names that say nothing: scans, images, untitled documents.
GENERIC_NAME = r"(?iu)^(scan\s*\d*|img[_-]?\d*|image\s*\d*|document\s*\(\d+\)|sans[ _]?titre|untitled|dsc\d*)$"


def auto_route(kind: Column, reason: Column, fixed: str, fallback: str, noise: tuple[str, ...]) -> Column:
    """struct(category, confidence) of files that need no scoring, else null."""
    made = lambda category, confidence: F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
    return F.when(kind == "dematerialised", made(fixed, 1.0)).when(kind == "archive", made(fallback, 1.0)).when(reason.isin(*noise), made(fallback, 0.3))


def says_nothing(stem: Column) -> Column:
    """Whether a file's name without its extension tells nothing of its content, so that only the content is scored."""
    return F.regexp_like(F.regexp_replace(stem, r"^\s+|\s+$", ""), F.lit(GENERIC_NAME))


def top_candidates(rows: DataFrame, group: str, tie: str, most: int = 3, score: str = "score") -> DataFrame:
    """The best ``most`` rows of each group with their ``rank``."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
