"""Vector retrieval: a stated query set against all rows in blocks, and additive fusion with keyword candidates.

Queries and rows meet in a grid of blocks: a block of queries and a block of rows of one length are dealt into one cell,
whose task keeps each query's best only. No vector passes through the driver, and the plan is the same at every size.
Similarity is the cosine: vectors are scaled in their cell. Vectors of different lengths do not meet, and those that are
null, zero or hold null or non-finite components meet with nothing.

A cell holds its queries (at most 8,192 of them: 64 MB at 1,024 components) and their best, and takes rows in Arrow
batches against 256 queries at a time: 20 MB of similarities at 10,000 rows, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK, STRIP = 8192, 200_000, 256


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def _cells(vectors: DataFrame, key: str, every: int, id_col: str, vector: str) -> DataFrame:
    """(dim, qb, rb, is_row, key, id, v): queries and rows dealt into cells, the queries of a cell first, then the rows by
    key."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.where(F.col(id_col).isNotNull() & sound).select(F.size(vector).alias("dim"), F.col(id_col).cast("long").alias("id"), F.col(key).cast("long").alias("key"), v.alias("v"))
    n, asked = base.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    width, height = 1 + asked // QUERY_BLOCK, max(1 + n // ROW_BLOCK, min(64, n // 500))
    block = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = base.where(F.col("id") % every == 0).select("dim", block(width, 1).alias("qb"), each(height).alias("rb"), F.lit(False).alias("is_row"), "key", "id", "v")
    rows = base.select("dim", each(width).alias("qb"), block(height, 2).alias("rb"), F.lit(True).alias("is_row"), "key", "id", "v")
    cell = ("dim", "qb", "rb")
    return queries.unionByName(rows).repartition(*cell).sortWithinPartitions(*cell, "is_row", "key", "id")


def _in_cells(batches, opened: Callable[[np.ndarray, np.ndarray], _Cell]) -> Iterator[pa.RecordBatch]:
    """Runs each cell: ``opened(query ids, query matrix)``, then its ``add(batch of rows)`` and ``end()``."""
    key, ids, parts, cell = None, [], [], None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "qb", "rb", "is_row")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, now = batch.slice(a, b - a), tuple(keys[a, :3])
            if now != key:
                if cell is not None:
                    yield from cell.end()
                key, ids, parts, cell = now, [], [], None
            if not keys[a, 3]:
                ids.append(part.column("id").to_numpy())
                parts.append(_units(part))
            elif parts:
                if cell is None:
                    cell = opened(np.concatenate(ids), np.concatenate(parts))
                yield from cell.add(part)
    if cell is not None:
        yield from cell.end()


def _units(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, which have one length, over their norms; scaled first, so that squares stay finite."""
    m = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class _Cell:
    """What a cell keeps of its queries' similarities."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray):
        self.ids, self.queries = ids, queries

    def strips(self, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for i in range(0, len(self.ids), STRIP):
            yield slice(i, i + STRIP), np.clip(self.queries[i : i + STRIP] @ rows.T, -1.0, 1.0)


class _Nearest(_Cell):
    """Each query's k best rows so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        super().__init__(ids, queries)
        self.sims = np.full((len(ids), k), -np.inf)
        self.names = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, k = rows.column("id").to_numpy(), self.sims.shape[1]
        for at, found in self.strips(_units(rows)):
            found = np.round(found, 6)
            found[self.ids[at, None] == own[None, :]] = -np.inf
            sims = np.hstack([self.sims[at], found])
            names = np.hstack([self.names[at], np.broadcast_to(own, found.shape)])
            least = np.partition(sims, -k, axis=1)[:, -k]  # all that reach the k-th best stay, so ties are settled by id
            most = int((sims >= least[:, None]).sum(axis=1).max())
            some = np.argpartition(-sims, min(most, sims.shape[1] - 1), axis=1)[:, :most]
            sims, names = np.take_along_axis(sims, some, axis=1), np.take_along_axis(names, some, axis=1)
            order = np.lexsort((names, -sims), axis=1)[:, :k]
            self.sims[at], self.names[at] = np.take_along_axis(sims, order, axis=1), np.take_along_axis(names, order, axis=1)
        yield from ()

    def end(self) -> Iterator[pa.RecordBatch]:
        rows, columns = np.nonzero(np.isfinite(self.sims))
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.array(self.names[rows, columns]), pa.array(self.sims[rows, columns])], names=["query_id", "id", "similarity"])


class _Groups(_Cell):
    """Each query's best similarity to the group that is open; a group's rows follow each other."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: float):
        super().__init__(ids, queries)
        self.least, self.open, self.best = least, None, np.full(len(ids), -np.inf)

    def rows(self, ids: np.ndarray, groups: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, g = np.nonzero(np.round(best, 6) >= self.least)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(groups[g]), pa.array(best[q, g])], names=["query_id", "key", "similarity"])

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        groups, first = np.unique(rows.column("key").to_numpy(), return_index=True)
        carried, last = self.best.copy(), np.full(len(self.ids), -np.inf)
        if self.open is not None and self.open != groups[0]:
            yield from self.end()
            carried[:] = -np.inf
        for at, found in self.strips(_units(rows)):
            best = np.maximum.reduceat(found, first, axis=1)
            best[:, 0] = np.maximum(best[:, 0], carried[at])
            last[at] = best[:, -1]
            yield from self.rows(self.ids[at], groups[:-1], best[:, :-1])
        self.open, self.best = int(groups[-1]), last

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.rows(self.ids, np.array([self.open]), self.best[:, None])


def nearest(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the k rows of greatest cosine to each row whose id is a multiple of ``every``,
    itself left out; ties (at six places) go to the smaller id."""

    def run(batches):
        yield from _in_cells(batches, lambda ids, queries: _Nearest(ids, queries, k))

    found = _cells(vectors, id_col, every, id_col, vector).mapInArrow(run, "query_id long, id long, similarity double").withColumnRenamed("id", id_col)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_similarity(vectors: DataFrame, group: str, *, every: int = 50, least: float = -1.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, group, similarity): best cosine of any of the group's rows to each query, never their mean; only those
    of at least ``least``, which tasks leave out already, so with documents as groups name what the cut will be."""

    def run(batches):
        yield from _in_cells(batches, lambda ids, queries: _Groups(ids, queries, least))

    found = _cells(vectors.where(F.col(group).isNotNull()), group, every, id_col, vector).mapInArrow(run, "query_id long, key long, similarity double").withColumnRenamed("key", group)
    return found.groupBy("query_id", group).agg(F.round(F.max("similarity"), 6).alias("similarity"))


def semantic_only(keyword: DataFrame, semantic: DataFrame, group: str, doc: str) -> DataFrame:
    """semantic with ``semantic_only``: whether the whole keyword ranking lacks the document."""
    known = keyword.select(group, doc).distinct().withColumn("_known", F.lit(True))
    return semantic.join(known, [group, doc], "left").withColumn("semantic_only", F.col("_known").isNull()).drop("_known")


def mark_semantic_origin(results: DataFrame, note: str) -> DataFrame:
    """results in which a value owes something to documents that only the semantic search found: those sources get
    ``selection`` = semantic, and the justification starts with the note. Rows without a value or such a source stay.

    results: value, justification, sources (array of struct with document_id and selection), semantic_only (array of ids)."""
    known = F.coalesce(F.col("semantic_only"), F.array().cast(results.schema["semantic_only"].dataType))
    ours = lambda s: F.coalesce(F.array_contains(known, s["document_id"]), F.lit(False))
    marked = F.transform("sources", lambda s: s.withField("selection", F.when(ours(s), "semantic").otherwise(s["selection"])))
    owes = F.col("value").isNotNull() & (F.size(known) > 0) & F.exists(marked, lambda s: s["selection"] == "semantic")
    owes = F.coalesce(owes, F.lit(False))
    told = F.when(owes, F.concat(F.lit(note), F.coalesce("justification", F.lit("")))).otherwise(F.col("justification"))
    return results.withColumns({"justification": told, "sources": F.when(owes, marked).otherwise(F.col("sources"))})


def fuse(keyword: DataFrame, semantic: DataFrame, group: str, doc: str, *, head: int = 3, extra: int = 2) -> DataFrame:
    """Keyword candidates stay as they are; the best ``extra`` semantic ones that are not among them follow.

    Both inputs have ``rank`` within the group. The flag tells documents that the whole keyword ranking lacks.
    """
    first = keyword.where(F.col("rank") <= head).select(group, doc, F.col("rank").alias("place"), F.lit(False).alias("semantic_only"))
    rest = semantic.select(group, doc, F.col("rank").alias("_r")).join(first.select(group, doc), [group, doc], "left_anti")
    order = Window.partitionBy(group).orderBy("_r")
    rest = rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= extra)
    rest = semantic_only(keyword, rest, group, doc).select(group, doc, (F.col("place") + head).alias("place"), "semantic_only")
    return first.unionByName(rest)
