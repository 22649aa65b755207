"""Benchmark decontamination: windows of benchmark words found in documents, by DataFrame operations only.

Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. A benchmark item's windows are
its runs of ``window`` words; an item with fewer words is one window. The distinct windows form the hash set that is
broadcast, and the benchmark's vocabulary tells which windows of a document may be in it: only those without any foreign
word are looked up, and the look-up compares the words themselves.

Bounds: the window table is broadcast and the vocabulary becomes a literal set only up to ``most_broadcast`` windows
and words, counted first; a larger benchmark is joined by a shuffle with every window of the documents.

Hits are folded by id and text, so a row that is read again after a lost executor falls into the same group.

Null and empty texts have no words, so they are clean and hit nothing. Items without an id hit words but count as no
item. Repeated rows are judged each; other columns pass through whatever their names; an empty table gives an empty
table; an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, *, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, width, items): each distinct window of the items, its words joined by a space."""
    worded = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    placed = worded.withColumn("width", F.least(F.size("w"), F.lit(window))).withColumn("at", F.explode(F.expr("sequence(1, size(w) - width + 1)")))
    return placed.groupBy(F.array_join(F.expr("slice(w, at, width)"), " ").alias("gram"), "width").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, most_broadcast: int = 100_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, ``text_hash`` (xxhash64 of the text), ``n_words``, ``hits`` (sorted word ranges),
    ``n_hit`` and ``items`` (sorted ids of the items with occurring windows)."""
    windows = benchmark_windows(items, window=window).withColumnRenamed("gram", "_gram")
    n_windows = windows.count()
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # at most ``window`` numbers
    vocabulary = windows.select(F.explode(F.split("_gram", " ")).alias("word")).distinct()
    small = n_windows <= most_broadcast and vocabulary.count() <= most_broadcast
    worded = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("w"))
    if small and n_windows:
        listed = ", ".join(f"'{r[0]}'" for r in vocabulary.orderBy("word").collect())
        worded = worded.withColumn("known", F.expr(f"transform(w, x -> x IN ({listed}))"))
        possible = "known[i - 1] AND known[i + {0} - 2] AND forall(slice(known, i, {0}), x -> x)"
    else:
        possible = "true"
    starts = [f"transform(filter(CASE WHEN size(w) >= {n} THEN sequence(1, size(w) - {n} + 1) ELSE array() END, i -> {possible.format(n)}), i -> struct(i AS at, {n} AS width, array_join(slice(w, i, {n}), ' ') AS gram))" for n in widths]
    own = "array(struct(0 AS at, 0 AS width, CAST(NULL AS string) AS gram))"  # each row stands for itself once
    found = worded.select("_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.explode(F.expr(f"concat({', '.join([own, *starts])})")).alias("c"))
    table = windows.drop("width")
    hit = found.join(F.broadcast(table) if small else table, F.col("c.gram") == F.col("_gram"), "left")
    rows = hit.groupBy("_id", "text_hash", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("_gram").isNotNull(), F.struct(F.col("c.at").alias("start"), (F.col("c.at") + F.col("c.width") - 1).alias("stop"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("c.at") == 0).alias("repeats"),
    )
    covered = "size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.stop)))))"
    return rows.select(F.explode(F.sequence(F.lit(1).cast("long"), "repeats")), F.col("_id").alias(id_col), "text_hash", "n_words", "hits", F.expr(covered).cast("long").alias("n_hit"), "items").drop("col")


def decontaminate(docs: DataFrame, items: DataFrame, *, remove: str = "documents", id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without contaminated documents, or (``remove="spans"``) with texts reduced to the words that no window hit,
    joined by a space. Columns stay the same; a clean document stays as it is."""
    hit = contamination(docs, items, id_col=id_col, text=text, **options).where("n_hit > 0").select(F.col(id_col).alias("_id"), "text_hash", "hits").dropDuplicates(["_id", "text_hash"])
    if remove == "documents":
        return docs.join(hit, docs[id_col].eqNullSafe(hit["_id"]) & (F.xxhash64(docs[text]) == hit["text_hash"]), "left_anti")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(hit, F.col(f"row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(f"row.`{text}`") == F.col("text_hash")), "left")
    kept = F.expr("filter(transform(w, (x, i) -> CASE WHEN NOT exists(hits, h -> i + 1 BETWEEN h.start AND h.stop) THEN x END), x -> x IS NOT NULL)")
    reduced = joined.withColumn("w", words_of(F.col(f"row.`{text}`"))).withColumn("reduced", F.when(F.col("hits").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(kept, " ")))
    return reduced.select(*(F.col("reduced").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
