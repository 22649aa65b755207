"""Tolerant readers of notice fields: dates, codes, links, descriptions, download headers, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """The date that a text starts with; null if it starts with none."""
    return F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def earliest(texts: Column) -> Column:
    """Least of the dates in a list of texts; unreadable ones are left out."""
    return F.array_min(F.array_compact(F.transform(texts, iso_date)))


def codes(texts: Column) -> Column:
    """Sorted distinct non-empty codes."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda c: c != "")))


def description(parts: Column, most: int = 8000) -> Column:
    """Distinct parts of more than three characters in order, one a line, cut at ``most``."""
    said = F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 3))
    return F.left(F.array_join(said, "\n"), F.lit(most))


def first_url(texts: Column) -> Column:
    return F.get(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: F.startswith(t, F.lit("http"))), F.lit(0))


def first_under(pairs: Column, key_part: str) -> Column:
    """The first link that stands under a key with ``key_part``. pairs: array of (k, v)."""
    return F.get(F.filter(pairs, lambda p: F.contains(F.lower(p["k"]), F.lit(key_part)) & F.startswith(p["v"], F.lit("http"))), F.lit(0))["v"]


def header_filename(header: Column) -> Column:
    """File name of a content-disposition header: the encoded form before the plain one, without folders."""
    encoded = F.try_url_decode(F.nullif(F.regexp_extract(header, r"(?i)filename\*=(?:UTF-8|utf-8)''([^;]+)", 1), F.lit("")))
    plain = F.nullif(F.regexp_extract(header, r'(?i)filename="?([^";]+)"?', 1), F.lit(""))
    return F.regexp_extract(F.trim(F.coalesce(encoded, plain)), r"([^/\\]+)$", 1)


def is_archive(content: Column) -> Column:
    """Whether the bytes start like a zip, 7z or rar file."""
    head = F.hex(F.substring(content, 1, 4))
    return F.startswith(head, F.lit("504B")) | (head == "377ABCAF") | (head == "52617221")


def request_url(url: Column) -> Column:
    """A platform's consultation link as its download-request link; null without an id."""
    found = F.regexp_extract(url, r"[?&](?:id|refConsultation)=(\d+)", 1)
    base = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    organisation = F.regexp_extract(url, r"[?&]orgAcronyme=([^&#]+)", 1)
    made = F.concat(base, F.lit("/index.php?page=Entreprise.EntrepriseDemandeTelechargementDce&id="), found, F.when(organisation != "", F.concat(F.lit("&orgAcronyme="), organisation)).otherwise(""))
    return F.when(found != "", made)


def seconds_until(now: Column, hour: int) -> Column:
    """Seconds to the next time the clock shows ``hour``; a full day if it does just now."""
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), F.lit(hour))
    following = F.when(today > now, today).otherwise(today + F.make_dt_interval(F.lit(1)))
    return (F.unix_timestamp(following) - F.unix_timestamp(now)).cast("long")


def form_inputs(html: Column) -> Column:
    """The input tags of a page, each as a map of its attributes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<input\b[^>]*>"), F.lit(0))
    pair = r'([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*"([^"]*)"'

    def attributes(tag):
        keys, values = (F.regexp_extract_all(tag, F.lit(pair), F.lit(g)) for g in (1, 2))
        first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.lit(True))
        distinct = F.filter(first, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
        return F.map_from_entries(F.transform(distinct, lambda x: F.struct(F.lower(x["k"]), x["v"])))

    return F.transform(tags, attributes)


def field_name(inputs: Column, suffix: str) -> Column:
    """The full name of the first field whose name ends in $suffix, or is it."""
    return F.get(F.filter(F.transform(inputs, lambda m: F.element_at(m, F.lit("name"))), lambda n: F.substring_index(n, "$", -1) == suffix), F.lit(0))


def hidden_value(inputs: Column, name: str) -> Column:
    return F.get(F.filter(inputs, lambda m: F.element_at(m, F.lit("name")) == name), F.lit(0))["value"]
