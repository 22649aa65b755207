"""Plans of provider calls: candidates in order, batches, missing rows, budgets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import fold_accents
from quillframe.sources.shared import new_folder


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``_range``, the number of their range in the order (nulls first), and ``_tie``, a number of its own for
    each row, so that equal rows, however many, are dealt to several ranges as well.

    The ranges are Spark's own, from a sample of the order, so columns of any orderable type serve. They are fixed by
    writing the dealt rows: what is counted by range and what is read again agree even when executors are lost.
    """
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "ranges")
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*(F.col(f"`{c}`").asc_nulls_first() for c in order), F.col("_tie"))
    placed = dealt.withColumn("_range", F.spark_partition_id())
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _same(pairs) -> Column:
    """All pairs of columns are equal, nulls included."""
    return functools.reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs))


def _ordered(order: list[str]) -> list[Column]:
    return [*(F.col(f"`{c}`").asc_nulls_first() for c in order), F.col("_tie").asc()]


def sums_before(rows: DataFrame, group: list[str], order: str | list[str], **values: Column) -> DataFrame:
    """rows with, for each named value, its sum over the group's rows before (0 for the first), nulls of ``order`` first.

    The sums run in two levels, so a group of a third of all rows is spread over many tasks: within the ranges of (group,
    order), and over a group's ranges. Only a group that goes on from the range before has an offset there, so the
    offsets that are broadcast are no more than the ranges.
    """
    order = [order] if isinstance(order, str) else order
    ranged = in_ranges(rows.withColumns({f"_v_{n}": v for n, v in values.items()}), *group, *order)
    totals = ranged.groupBy(*group, "_range").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
        F.col("_range").alias("_of"),
        F.count("*").over(earlier).alias("_ahead"),
        *(F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values),
    ).where("_ahead > 0")
    inner = Window.partitionBy(*group, "_range").orderBy(*_ordered(order)).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)) for n in values})
    same = _same([("_range", "_of"), *((g, f"_g{i}") for i, g in enumerate(group))])
    sums = ((F.col(f"_b_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in values)
    return own.join(F.broadcast(offsets), same, "left").select(*(F.col(f"`{c}`") for c in rows.columns), *sums)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place from 1 in the order of the whole table, without a task that sees all of them: each range of
    the order starts after the rows of those before it."""
    ranged = in_ranges(rows, *order)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*_ordered(list(order)))) + F.col("_before")
    return ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_of")).withColumn(name, place).select(*rows.columns, name)


def reference_candidates(fields: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """(field, doc, rank): documents whose category the field lists, in the list's order, then by document.

    fields: field, categories (array); docs: doc, category, text. Documents without text are no candidates.
    """
    listed = fields.select("field", F.posexplode("categories").alias("pos", "category"))
    joined = listed.join(docs.where(F.length("text") > 0).select(doc, "category"), "category")
    within = sums_before(joined, ["field", "pos"], doc, nth=F.lit(1))
    sizes = joined.groupBy("field", "pos").agg(F.count("*").alias("n"))
    ahead = sizes.select(F.col("field").alias("_field"), F.col("pos").alias("_pos"), F.coalesce(F.sum("n").over(Window.partitionBy("field").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    found = within.join(F.broadcast(ahead), (F.col("field") == F.col("_field")) & (F.col("pos") == F.col("_pos")))  # a row for each entry of the catalog
    return found.select("field", doc, (F.col("nth") + F.col("ahead") + 1).cast("int").alias("rank"))


def section_documents(sections: DataFrame, docs: DataFrame, doc: str, filtered: list[str]) -> DataFrame:
    """(section, doc, pos): documents of a section's pivot categories with the category's place. In the ``filtered``
    categories a section's keywords (if it has any) must stand in the folded file name or lot. sections: section, pivots,
    keywords; docs: doc, category, filename, lot."""
    listed = sections.select("section", "keywords", F.posexplode("pivots").alias("pos", "category"))
    name = fold_accents(F.lower(F.concat_ws(" ", "filename", F.coalesce("lot", F.lit("")))))
    named = docs.select(doc, "category", name.alias("_name"))
    passes = ~F.col("category").isin(*filtered) | (F.size("keywords") == 0) | F.exists("keywords", lambda k: F.contains(F.col("_name"), fold_accents(F.lower(k))))
    return named.join(F.broadcast(listed), "category").where(passes).select("section", doc, "pos")  # the catalog's own table


def findings_context(docs: DataFrame, group: str, doc: str, *, total: int, each: int) -> DataFrame:
    """docs with ``label`` (D1, D2, ... of the group's summaries) and ``given`` (characters of the raw ones: at most
    ``each``, as long as ``total`` lasts), in the documents' order. docs: group, doc, kind (summary, raw or other), size."""
    share = F.least(F.col("size").cast("long"), F.lit(each).cast("long"))
    placed = sums_before(docs, [group], doc, _nth=(F.col("kind") == "summary").cast("long"), _spent=F.when(F.col("kind") == "raw", share).otherwise(0))
    label = F.when(F.col("kind") == "summary", F.concat(F.lit("D"), (F.col("_nth") + 1).cast("string")))
    given = F.when(F.col("kind") == "raw", F.greatest(F.least(share, F.lit(total).cast("long") - F.col("_spent")), F.lit(0)))
    return placed.select(*docs.columns, label.alias("label"), given.cast("int").alias("given"))


def call_batches(fields: DataFrame, docs: DataFrame, doc: str, *, size: int = 12) -> DataFrame:
    """(doc, batch, fields): the inverse plan, one call per document and ``size`` fields. fields: field, ord, categories."""
    wanted = fields.select("field", "ord", F.explode("categories").alias("category")).distinct()
    placed = docs.select(doc, "category").join(wanted, "category").withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(doc).orderBy("ord")) - 1) / size))
    return placed.groupBy(doc, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda s: s["field"]), ",").alias("fields"))


def missing(wanted: DataFrame, present: DataFrame, *key: str) -> DataFrame:
    """Rows of ``wanted`` that ``present`` lacks; adding them is idempotent."""
    return wanted.join(present.select(*key).distinct(), list(key), "left_anti")


def leaders(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """Each row with its content's ``leader``, the first row of the same digest; only leaders need work. The minimum is
    partially aggregated, so a digest that many rows share stays cheap."""
    first = rows.groupBy(digest).agg(F.min(order).alias("leader"), F.count("*").alias("copies"))
    return rows.join(first, digest)


def latest_before(rows: DataFrame, digest: str, order: str, name: str, *, value: str | None = None) -> DataFrame:
    """Each row with the latest earlier row of the same digest in column ``name``: its ``value``, or its place in the
    order where none is named. Any orderable column serves, a creation time or a path too; nulls come first, and of rows
    at one place the later ones see the earlier.

    A digest's rows are cut into ranges of the order, so a digest of a third of all rows is spread over many tasks: within
    a range the row before is found by a window, and the first row of a range takes the last row of the digest's range
    before. Only digests that go on from the range before have one, no more than the ranges.
    """
    seen = F.struct(F.col(value or order).alias("v"))
    ranged = in_ranges(rows, digest, order).withColumn("_seen", seen)
    last = ranged.groupBy(digest, "_range").agg(F.max_by("_seen", F.struct(F.col(order), F.col("_tie"))).alias("_last"))
    earlier = Window.partitionBy(digest).orderBy("_range").rowsBetween(-1, -1)
    carried = last.select(F.col(digest).alias("_g0"), F.col("_range").alias("_of"), F.max("_last").over(earlier).alias("_carried"))
    own = ranged.withColumn("_own", F.lag("_seen").over(Window.partitionBy(digest, "_range").orderBy(*_ordered([order]))))
    joined = own.join(F.broadcast(carried.where("_carried IS NOT NULL")), _same([(digest, "_g0"), ("_range", "_of")]), "left")
    return joined.select(*rows.columns, F.coalesce("_own", "_carried")["v"].alias(name))


def packed_excerpt(parts: Column, budget: int) -> Column:
    """Greedy choice of array<struct<score, pos, part>>: best first, the first always, later ones only if they still fit;
    shown in text order with blank lines between, then cut at the budget."""
    ranked = F.array_sort(F.transform(parts, lambda p: F.struct((-p["score"]).alias("neg"), p["pos"].alias("pos"), p["part"].alias("part"))))
    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("any"), F.filter(ranked, lambda p: F.lit(False)).alias("taken"))

    def add(acc, p):
        fits = ~acc["any"] | ((acc["left"] > 0) & (F.length(p["part"]) <= acc["left"]))
        return F.struct(F.when(fits, acc["left"] - F.length(p["part"])).otherwise(acc["left"]).alias("left"), F.lit(True).alias("any"), F.when(fits, F.concat(acc["taken"], F.array(p))).otherwise(acc["taken"]).alias("taken"))

    chosen = F.aggregate(ranked, start, add, lambda acc: acc["taken"])
    shown = F.transform(F.array_sort(F.transform(chosen, lambda p: F.struct(p["pos"].alias("pos"), p["part"].alias("part")))), lambda p: p["part"])
    return F.left(F.array_join(shown, "\n\n"), F.lit(budget))


def spent_budget(sizes: Column, total: int, each: int) -> Column:
    """How much of each size fits: at most ``each`` and what is left of ``total``; zero means dropped."""
    start = F.struct(F.lit(total).cast("long").alias("left"), F.expr("CAST(array() AS array<bigint>)").alias("given"))

    def add(acc, size):
        give = F.least(size.cast("long"), F.lit(each).cast("long"), acc["left"])
        return F.struct((acc["left"] - give).alias("left"), F.concat(acc["given"], F.array(give)).alias("given"))

    return F.aggregate(sizes, start, add, lambda acc: acc["given"])


def sequential_batches(sizes: Column, most: int = 128, limit: int = 60_000) -> Column:
    """Batch number of each size when packed in order, at most ``most`` items and ``limit`` in all per batch."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.expr("CAST(array() AS array<int>)").alias("out"))

    def add(acc, size):
        new = (acc["n"] > 0) & ((acc["n"] >= most) | (acc["sum"] + size > limit))
        batch = acc["batch"] + new.cast("int")
        return F.struct(batch.alias("batch"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, size.cast("long")).otherwise(acc["sum"] + size.cast("long")).alias("sum"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, add, lambda acc: acc["out"])
