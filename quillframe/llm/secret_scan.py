"""Secret scans with a trigram inverted index, by DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived: every match must contain, for each clause, all
trigrams of one of the clause's alternatives. The index lists, for each trigram that some query uses, the texts that
contain it (A-Z lower-cased). Intersecting these postings gives each rule's candidate texts, which the rule then scans;
a rule without mandatory trigrams scans every text.

Nulls count as empty texts, which hold no secret. Repeated rows are scanned each; other columns pass through whatever
their names (``find_secrets`` replaces a column ``secrets``); an empty table gives an empty table.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.decontaminate import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the length that ``group`` of a match needs, shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed forms of well-known secrets; the first three are the base kinds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed node matches, if these are few and finite."""
    kind, value = node
    if kind is C.LITERAL:
        return {chr(value).lower()}
    if kind is C.IN and all(k is C.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if kind is C.SUBPATTERN:
        return _joined(list(value[3]))
    if kind is C.BRANCH:
        parts = [_joined(list(p)) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is C.MAX_REPEAT and value[1] != C.MAXREPEAT and value[1] <= 4:
        one = _joined(list(value[2]))
        return None if one is None else {"".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)}
    return None


def _joined(nodes: list) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses of alternatives of trigrams: a match holds, for each clause, all trigrams of some alternative."""
    clauses: list[list[frozenset[str]]] = []

    def close(found: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in found}
        if frozenset() not in sets:  # a string under three letters demands nothing
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    run = {""}
    for node in parser.parse(pattern):
        more = _strings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        close(run)
        run = more if more is not None and len(more) <= MOST_STRINGS else {""}
        if node[0] is C.MAX_REPEAT and node[1][0] >= 1 and (inner := _joined(list(node[1][2]))) is not None:
            close(inner)
    close(run)
    return clauses


def trigram_index(docs: DataFrame, trigrams: list[str], *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, id, text_hash) of the given trigrams."""
    lowered = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("text_hash"), F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).alias("t"))
    held = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in trigrams)))
    return lowered.select(F.explode(held).alias("trigram"), "_id", "text_hash")


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """(id, text_hash, rules): for each text the rules whose trigram query its postings satisfy."""
    spark: SparkSession = index.sparkSession
    rows = [(kind, i, j, g, len(alternative), len(clauses)) for kind, clauses in queries.items() for i, clause in enumerate(clauses) for j, alternative in enumerate(clause) for g in sorted(alternative)]
    wanted = spark.createDataFrame(rows, "rule string, clause int, alternative int, gram string, need long, clauses long")
    met = index.join(F.broadcast(wanted), F.col("trigram") == F.col("gram")).groupBy("_id", "text_hash", "rule", "clause", "alternative", "need", "clauses").agg(F.count_distinct("trigram").alias("n"))  # the rules' own table
    met = met.where("n = need").groupBy("_id", "text_hash", "rule", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return met.groupBy("_id", "text_hash").agg(F.collect_set("rule").alias("rules"))


def _matches(rule: Rule, text: Column) -> Column:
    """array<struct<start, stop>> of the rule's matches in code points, leftmost and not overlapping."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(found.alias("m"), group.alias("g"), F.slice(between, 1, F.greatest(F.size(found), F.lit(0))).alias("b"))
    empty = F.expr("struct(0 AS at, CAST(array() AS array<struct<start:int,stop:int>>) AS out)")

    def add(acc, x):
        start = acc["at"] + F.length(x["b"])
        stop = start + F.length(x["m"])
        kept = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], kept)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, empty, add, lambda acc: acc["out"])


#: A cheaper equivalent for runs of one class: only runs that are long enough match.
def scanned(rule: Rule) -> Rule:
    return Rule(rule.kind, rule.pattern.removesuffix("+") + f"{{{rule.least},}}", 0, rule.least) if rule.pattern in ("[0-9a-f]+",) else rule


def _named(spans: Column, place: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("ord"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def _scanned_rows(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text: str) -> DataFrame:
    """(row, found): each row of docs as a struct, and its spans."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for alternative in clause for g in alternative})
    chosen = candidates(trigram_index(docs, grams, id_col=id_col, text=text), queries)
    whole_rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own_id, own_text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text}`")
    joined = whole_rows.join(chosen, own_id.eqNullSafe(F.col("_id")) & (F.xxhash64(own_text) == F.col("text_hash")), "left")
    whole = F.coalesce(own_text, F.lit(""))
    none = F.expr("CAST(array() AS array<struct<start:int,stop:int>>)")
    parts = []
    for place, rule in enumerate(map(scanned, rules)):
        gate = F.array_contains(F.col("rules"), rule.kind) if rule.kind in queries else F.regexp_like(whole, F.lit(rule.pattern))
        spans = F.when(gate, _matches(rule, whole)).otherwise(none)
        parts.append(_named(spans, place, rule.kind))
    return joined.select("row", F.array_sort(F.concat(*parts)).alias("found"))


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``secrets``: array of (start, ord, kind, stop), sorted; ord is the rule's place in ``rules``."""
    found = _scanned_rows(docs, rules, id_col, text)
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "secrets"), F.col("found").alias("secrets"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of the text that secrets cover replaced by ``mask``; all columns and all other texts stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    own = F.col(f"row.`{text}`")

    def add(acc, s):
        between = F.substring(own, acc["at"] + 1, s["start"] - acc["at"])
        grown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), grown.alias("out"))

    masked = F.aggregate("found", start, add, lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))))
    clean = F.when(F.size("found") > 0, masked).otherwise(own)
    return _scanned_rows(docs, rules, id_col, text).select(*(clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
