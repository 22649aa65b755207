"""Text functions as Spark columns. Accents fold by a fixed letter table, so no Python runs on rows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: typographic mark -> plain mark; marks that disappear.
TYPOGRAPHIC, SIMPLE, DROPPED = "’‘‚‹›–—‑−   ﻿", "'''''----    ", "“”„«»\""


def _bare(c: str) -> str:
    """A character's compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: By rule from the Unicode tables: characters up to U+214F that lose their marks, combining marks, and Latin ligatures,
#: fractions and dots that are spelt out.
_SINGLE = {chr(c): _bare(chr(c)) for c in range(0x80, 0x2150) if len(_bare(chr(c))) == 1 and _bare(chr(c)) != chr(c)}
_MARKS = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
_SEVERAL = {chr(c): _bare(chr(c)) for c in [*range(0xBC, 0xBF), *range(0x132, 0x250), 0x2026, *range(0xFB00, 0xFB07)] if len(_bare(chr(c))) > 1}


def fold_accents(text: Column) -> Column:
    """text without accents: letters with marks become plain letters, combining marks vanish, ligatures are spelt out.

    One pass takes the single letters. What is ASCII then has no ligature; the text is computed once for both questions.
    """

    def spelt(plain: Column) -> Column:
        out = plain
        for c, several in _SEVERAL.items():
            out = F.replace(out, F.lit(c), F.lit(several))
        return F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(out)

    plain = F.translate(text, "".join(_SINGLE) + _MARKS, "".join(_SINGLE.values()))
    return F.get(F.transform(F.array(plain), spelt), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """text with A to Z as a to z; all other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip_space(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_terms(text: Column) -> Column:
    """Lower case, no accents, anything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(text)), "[^a-z0-9]+", " "))


def holds_term(folded: Column, term: Column) -> Column:
    """Whether a folded text holds a term on word boundaries; an empty term is in no text."""
    inner = fold_terms(term)
    return (inner != "") & F.contains(F.concat(F.lit(" "), folded, F.lit(" ")), F.concat(F.lit(" "), inner, F.lit(" ")))


def fold_citation(text: Column) -> Column:
    """Typographic marks unified, double quotes dropped, accents folded, spaces squeezed, lower case."""
    return F.lower(squeeze(fold_accents(F.translate(text, TYPOGRAPHIC + DROPPED, SIMPLE))))


def bounded(pattern: str) -> str:
    """The pattern with its outer word boundaries also at underscores."""
    if pattern.startswith(r"\b"):
        pattern = "(?<![A-Za-z0-9])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + "(?![A-Za-z0-9])"
    return pattern


def slug(text: Column, most: int = 60) -> Column:
    """Letters and digits joined by dashes, cut at a dash within ``most`` characters; DOCUMENT if nothing is left."""
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(fold_accents(text), r"[^\x00-\x7F]", ""), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    head = F.left(joined, F.lit(most))
    back = F.regexp_extract(head, "^(.+)-[^-]*$", 1)
    cut = F.when(F.length(joined) <= most, joined).when(back != "", back).otherwise(head)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^-+|-+$", ""), F.lit("")), F.lit("DOCUMENT"))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty if the name has none or starts with its only dot."""
    return F.lower(F.regexp_extract(name, r"^.*[^/](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def normalized_filename(category: Column, lot: Column, doc_type: Column, name: Column) -> Column:
    """CATEGORY[_LOTn]_TYPE_LABEL.ext from slugs of at most 20 and 80 characters."""
    lot_part = F.when(F.coalesce(lot, F.lit("")) != "", F.upper(slug(F.concat(F.lit("LOT"), lot), 20)))
    return F.concat(F.concat_ws("_", F.upper(slug(F.substring_index(category, "/", 1), 20)), lot_part, F.upper(slug(doc_type, 20)), F.upper(slug(stem(name), 80))), extension(name))


def lot_folder(lot: Column) -> Column:
    return F.concat(F.lit("LOT "), F.translate(lot, "/\\", "--"))


#: Fixed form of a list of lot numbers.
LOTS = r"(?i)lot[^a-z0-9]{0,3}(\d+(?:\s*(?:,|/|&|-|et)\s*\d+)*)"


def lot_signal(text: Column) -> Column:
    """The first list of lot numbers after the word lot; null if there is none."""
    found = F.regexp_extract(text, LOTS, 1)
    return F.nullif(squeeze(found), F.lit(""))


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    """Stripped non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(text, separator), strip_space), lambda p: p != "")


def label_words(label: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit("([a-zàâäéèêëïîôöùûüç]{4,})"), F.lit(1)))


def distinct_hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in the text; each counts once."""
    return sum((F.regexp_like(text, F.lit(p)).cast("int") for p in patterns), F.lit(0))


def occurrences(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def paragraph_score(paragraph: Column, patterns: list[str], words: list[str]) -> Column:
    """Patterns that occur plus all occurrences of the label words in the lower-cased paragraph."""
    return distinct_hits(paragraph, patterns) + sum((occurrences(F.lower(paragraph), w) for w in words), F.lit(0))


def first_line(text: Column, most: int = 200) -> Column:
    """First line with content after its heading or list marks, no HTML comment; null if there is none."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: strip_space(F.regexp_replace(strip_space(x), r"^[#\-* ]+", "")))
    return F.left(F.get(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("<!--"))), F.lit(0)), F.lit(most))


def clean_item(item: Column) -> Column:
    """An item without one leading bullet or number."""
    return strip_space(F.regexp_replace(strip_space(item), r"^(?:[-*•]|\d+[.)])\s+", ""))


#: Fixed form of a group of citation labels such as [D1.2] or (D1, D5).
LABEL_GROUP = r"[\[(]\s*(D\d+(?:\.\d+)?(?:\s*[,;/]\s*D\d+(?:\.\d+)?)*)\s*[\])]"
LABEL = r"(D\d+(?:\.\d+)?)"


def strip_labels(text: Column) -> Column:
    return strip_space(F.replace(F.regexp_replace(text, LABEL_GROUP, ""), F.lit("  "), F.lit(" ")))


def table_cell(text: Column) -> Column:
    """Pipes escaped, line breaks as spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\r?\n", " ")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def answer_certainty(answer: Column, ocr: Column, doubtful: float = 0.5, readable: float = 0.8, sure: float = 0.75) -> Column:
    return F.when(answer < doubtful, "to_verify").when((ocr.isNull() | (ocr >= readable)) & (answer >= sure), "certain").otherwise("probable")


def duration(seconds: Column) -> Column:
    """h/min/s rendering of whole seconds."""
    s = F.floor(seconds)
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min %02d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d h %02d min", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def quarantine_seconds(status: Column, failures: Column) -> Column:
    """Base by error class (300, 30, or 60 from the third failure on) times the failures, at most ten."""
    base = F.when(status.isin(401, 402, 403), 300).when(status == 429, 30).when(failures >= 3, 60).otherwise(0)
    return base * F.least(failures, F.lit(10))


def masked(secret: Column) -> Column:
    """All but the last four characters hidden."""
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(secret) - 4, F.lit(0))), F.right(secret, F.lit(4)))


#: Fixed: regular-expression syntax that carries no meaning for a query text.
PATTERN_NOISE = r"\(\?[^)]*\)|\[[^\]]*\]\?|\.\{[^}]*\}|\\b|\\[dswDSW]|[\\\[\]{}()|^$*+?]"
#: Fixed forms of a query text.
QUERY_JOIN, QUERY_TERMS = " — ", "Termes associés : "


def field_query(label: Column, expected: Column, patterns: Column) -> Column:
    """The query text of a catalog row for a vector model: label, expected form (if any) and the distinct words that are
    left of the patterns (if any). patterns: array of regular expressions."""
    words = F.array_distinct(F.filter(F.transform(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: squeeze(F.regexp_replace(p, PATTERN_NOISE, " "))), lambda w: w != ""))
    terms = F.when(F.size(words) > 0, F.concat(F.lit(QUERY_TERMS), F.array_join(words, ", ")))
    return F.concat_ws(QUERY_JOIN, label, F.nullif(expected, F.lit("")), terms)


#: Fixed: the least length of a fragment worth looking for, and the lengths its prefixes are cut to.
LEAST_FRAGMENT, PREFIXES = 25, (400, 200, 120, 60, 40)


def fragments(citation: Column, least: int = LEAST_FRAGMENT) -> Column:
    """Folded parts to look for: quoted ones, the whole, then the parts between ellipses and slashes."""
    quoted = F.regexp_extract_all(citation, F.lit("«([^»]+)»"), F.lit(1))
    parts = F.split(citation, r"\[\s*\.\.\.\s*\]|\[\s*…\s*\]|\.\.\.|…|\s/\s")
    return F.array_distinct(F.filter(F.transform(F.concat(quoted, F.array(citation), parts), fold_citation), lambda f: F.length(f) >= least))


def found_at(page: Column, fragment: Column, least: int = LEAST_FRAGMENT, prefixes: tuple[int, ...] = PREFIXES) -> Column:
    """struct(position from 1, length) of the fragment or of its longest found prefix; null if nothing is found."""
    whole = F.when((F.length(fragment) >= least) & (F.position(fragment, page) > 0), F.struct(F.position(fragment, page).alias("position"), F.length(fragment).alias("length")))
    shorter = [F.when((F.length(fragment) > n) & (F.position(F.left(fragment, F.lit(n)), page) > 0), F.struct(F.position(F.left(fragment, F.lit(n)), page).alias("position"), F.lit(n).alias("length"))) for n in prefixes]
    return F.coalesce(whole, *shorter)


def key_mentions(text: Column, patterns: dict[str, str], most: int = 10) -> Column:
    """map of mention -> sorted distinct captures (at most ``most``); without a capture, the matched words."""
    lower = F.lower(text)
    entries = []
    for key, pattern in patterns.items():
        group = 1 if "(" in pattern.replace("(?", "") else 0
        hits = F.slice(F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(lower, F.lit("(?U)" + pattern), F.lit(group)), lambda v: v != ""))), 1, most)
        entries.append(F.struct(F.lit(key).alias("key"), F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("présent"))).alias("value"), F.regexp_like(lower, F.lit("(?U)" + pattern)).alias("hit")))
    kept = F.filter(F.array(*entries), lambda e: e["hit"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))
