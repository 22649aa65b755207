"""Free-form JSON as rows: its strings with their keys, and multilingual values as text. All of it stays in the JVM.

A document is taken apart level by level: an object's members by ``from_json`` to a map, in the order they stand, an
array's by ``from_json`` to an array, each once as text and once as VARIANT, which tells a string from a nested value.
A level is a written table, so the plan does not grow with the depth, and rounds end with the deepest document; one huge
document is many rows from the second level on.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.sources.shared import new_folder

#: A member of an object or array: its key (null in an array), its JSON text (a string without quotes) and its kind.
MEMBER = "array<struct<key: string, raw: string, kind: string>>"


def _kind(value: Column) -> Column:
    """STRING, OBJECT, ARRAY, VOID, BOOLEAN or a number's type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _members(raw: Column, kind: Column) -> Column:
    texts, values = F.from_json(raw, "map<string,string>"), F.from_json(raw, "map<string,variant>")
    inside = F.arrays_zip(F.map_keys(texts).alias("key"), F.map_values(texts).alias("raw"), F.transform(F.map_values(values), _kind).alias("kind"))
    items, typed = F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>")
    listed = F.transform(items, lambda x, i: F.struct(F.lit(None).cast("string").alias("key"), x.alias("raw"), _kind(F.get(typed, i)).alias("kind")))
    return F.when(kind == "OBJECT", inside.cast(MEMBER)).when(kind == "ARRAY", listed.cast(MEMBER))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def levels(documents: DataFrame, key: str, column: str) -> list[DataFrame]:
    """(key, at, name, raw, kind, parent) of every value, a table for each depth; ``at`` is the path of places, ``name``
    the nearest key above the value or its own, ``parent`` the kind of what holds it. A malformed document has no rows."""
    value = F.try_parse_json(F.col(column))
    kind = _kind(value)
    raw = F.when(kind == "STRING", F.variant_get(value, "$", "string")).otherwise(F.col(column))
    root = documents.select(
        F.col(key), F.array().cast("array<int>").alias("at"), F.lit("").alias("name"), raw.alias("raw"), kind.alias("kind"), F.lit(None).cast("string").alias("parent")
    ).where(F.col("kind").isNotNull())
    found = [_written(root, "json")]
    while True:
        nested = found[-1].where(F.col("kind").isin("OBJECT", "ARRAY"))
        inner = nested.select(key, "at", "name", F.col("kind").alias("parent"), F.posexplode(_members(F.col("raw"), F.col("kind"))).alias("pos", "m"))
        below = _written(inner.select(
            key, F.concat("at", F.array("pos")).alias("at"), F.coalesce(F.col("m")["key"], F.col("name")).alias("name"), F.col("m")["raw"].alias("raw"), F.col("m")["kind"].alias("kind"), "parent"
        ), "json")
        if below.isEmpty():
            return found
        found.append(below)


def _gathered(levels_found: list[DataFrame], pick) -> DataFrame:
    out = None
    for level in levels_found:
        own = pick(level)
        out = own if out is None else out.unionByName(own)
    return out


def members(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, name, value, kind): every plain member of an object: strings, numbers, booleans and nulls, as text."""
    plain = "parent = 'OBJECT' AND kind NOT IN ('OBJECT', 'ARRAY')"
    return _gathered(levels(documents, key, column), lambda x: x.where(plain).select(key, "at", "name", F.col("raw").alias("value"), "kind"))


def strings(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, name, value): every string that is a member of an object, under its key, wherever it stands. Strings in
    an array have no key and are left out. Order by ``at`` for the document's own order."""
    return members(documents, key, column).where("kind = 'STRING'").drop("kind")


def unescape(text: Column) -> Column:
    """HTML character references, named and numbered, as characters. Only those that end in a semicolon are read; unknown
    ones stay. The named ones are the standard library's table."""
    names = {n[:-1]: c for n, c in sorted(html.entities.html5.items()) if n.endswith(";")}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # a constant of the plan

    def numbered(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def character(ref: Column) -> Column:
        name = F.substr(ref, F.lit(2), F.length(ref) - 2)
        code = F.when(F.regexp_like(name, F.lit("^#[xX][0-9a-fA-F]{1,6}$")), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(F.regexp_like(name, F.lit("^#[0-9]{1,7}$")), F.substr(name, F.lit(2)))
        number = code.cast("long")
        sound = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(sound, numbered(number)), F.try_element_at(table, name), ref)

    reference = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
    refs = F.transform(F.regexp_extract_all(text, F.lit(reference), F.lit(0)), character)
    between = F.split(text, reference, -1)
    joined = F.array_join(F.flatten(F.transform(between, lambda b, i: F.array(b, F.coalesce(F.get(refs, i), F.lit(""))))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def _says(raw: Column, kind: Column) -> Column:
    """Whether a value is more than null, false, zero or empty."""
    filled = F.when(kind == "STRING", raw != "").when(kind == "OBJECT", ~F.regexp_like(raw, F.lit(r"^\s*\{\s*\}\s*$"))).when(kind == "ARRAY", ~F.regexp_like(raw, F.lit(r"^\s*\[\s*\]\s*$")))
    return F.coalesce(filled.when(kind == "BOOLEAN", raw == "true").when(kind == "VOID", F.lit(False)).otherwise(F.expr("try_cast(raw AS double)") != 0), F.lit(False))


def multilingual(documents: DataFrame, key: str, column: str, language: str = "fra") -> DataFrame:
    """(key, text): a multilingual or repeated value as one text, null if it says nothing.

    Of an object the preferred language's member counts, if it says something, else the first that does; of an array the
    distinct texts, a line each; a string is unescaped and stripped; other values say nothing. Values are chosen on the
    way down and joined on the way up, a level at a time. ``key`` must be unique.
    """
    taken, depths = None, []
    for level in levels(documents, key, column):
        if taken is not None:  # only members of values that are taken themselves
            up = taken.where("kind IN ('OBJECT', 'ARRAY')").select(F.col(key).alias("_k"), F.col("at").alias("_up"))
            above = F.slice("at", F.lit(1), F.size("at") - 1)
            level = level.join(up, (F.col(key) == F.col("_k")) & (above == F.col("_up")), "left_semi")
            says = _says(F.col("raw"), F.col("kind"))
            rank = F.struct((~says).alias("silent"), (F.col("name") != language).alias("other"), "at")
            best = level.where(says & (F.col("parent") == "OBJECT")).groupBy(F.col(key).alias("_k"), above.alias("_up")).agg(F.min(rank)["at"].alias("_best"))
            chosen = level.where("parent = 'OBJECT'").join(best, (F.col(key) == F.col("_k")) & (F.col("at") == F.col("_best")), "left_semi")
            level = _written(level.where("parent = 'ARRAY'").unionByName(chosen), "json-taken")
        taken = level
        depths.append(level)
    own = F.nullif(F.trim(F.regexp_replace(unescape(F.col("raw")), r"^[\s ]+|[\s ]+$", "")), F.lit(""))
    texts = None
    for level in reversed(depths):
        said = level.where("kind = 'STRING'").select(key, "at", own.alias("text"))
        texts = said if texts is None else said.unionByName(texts)
        if level is not depths[0]:
            line = F.when(F.col("text").isNotNull(), F.struct("at", "text"))
            ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["text"]))
            up = texts.groupBy(F.col(key), F.slice("at", F.lit(1), F.size("at") - 1).alias("at")).agg(ordered.alias("lines"))
            texts = _written(up.select(key, "at", F.nullif(F.array_join("lines", "\n"), F.lit("")).alias("text")), "json-text")
    return documents.select(key).join(texts.select(key, "text"), key, "left")
