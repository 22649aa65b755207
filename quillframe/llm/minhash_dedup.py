"""Near-duplicate documents by BagMinHash signatures of word-shingle bags.

A document is the bag of its runs of ``shingle`` words (a shorter one has one run of all its words), a run's weight the
number of times it occurs. Each run owns Poisson processes over (weight, time): one for weights up to 1 and one for
each span (2^(k-1), 2^k] above, with the span's width as its rate. A point has a time, one of the signature's places and
a whole-numbered weight within its span, and counts for a document that holds the run at least that many times. A
place of the signature keeps the earliest point, so two places agree with a chance of the bags' weighted Jaccard
similarity. Spans above a run's weight are never opened, and a process ends once it is later than all places.

Documents with equal bags form a class with the least id as its representative. Representatives that agree in a band of
the signature share a bucket. A bucket proposes each member with one leader, drawn by hash; proposals are verified by
the overlap of the two bags, and verified links are joined into components. Buckets whose members are then not all in
one component are compared again: the members outside the bucket's largest component against all members, block by
block. Two members of different components whose signatures agree in at least ``least_agreement`` of the places are
suspects, and the suspects of a pair of blocks are verified against each other in its task, which yields only links that
join components. So every link that bands and signatures show counts in the components, yet a large group never emits
its pairs, and a stray member of a bucket costs one more pass over the bucket.

Memory: a block holds about ``block`` members and about ``BLOCK_SHINGLES`` shingles, whichever is fewer members.

Null and empty texts hold no run and are nobody's duplicate. Rows without an id get null results. Rows of one id count
as one document in the components; each gets the verdict of its own text. Repeated rows get the same result each. Other
columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillframe.llm.arrow import hash_spans, mix, raw, slices, words
from quillframe.llm.components import components
from quillframe.llm.storage import dealt_anew, written
from quillframe.llm.substring_dedup import _span_hash

BANDS, ROWS = 20, 5
PLACES = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_bags(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and weight of every distinct shingle, in that order."""
    data, offsets = raw(texts)
    starts, stops, doc = words(data, offsets)
    h = hash_spans(data, starts, stops)
    found = [np.zeros(0, np.uint64)]
    of = [np.zeros(0, np.int64)]
    if len(h) >= size:
        at = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
        found.append(mix(_span_hash(h, size)[at]))
        of.append(doc[at])
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(n):
                whole = mix(whole * GOLD + h[first[short] + j])
            found.append(whole)
            of.append(short)
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], found[at], np.diff(np.append(at, len(found)))


def signatures(doc: np.ndarray, run: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, PLACES) earliest times; infinite for documents without runs."""
    times = np.full((n_docs, PLACES), np.inf)
    flat = times.ravel()
    owner, seed, floor = [], [], []
    low = 0
    here = np.arange(len(run))
    while len(here):  # spans (0, 1], (1, 2], (2, 4], ... of the runs that reach into them
        owner.append(here)
        seed.append(mix(run[here] + np.uint64(int(GOLD) * (low + 1) % 2**64)))
        floor.append(np.full(len(here), low, np.int64))
        low = max(1, 2 * low)
        here = here[weight[here] > low]
    if not owner:
        return times
    owner, seed, floor = map(np.concatenate, (owner, seed, floor))
    width = np.maximum(floor, 1)
    of, most = doc[owner], weight[owner]
    now = np.zeros(len(owner))
    step = np.uint64(0)
    while len(of):
        block = int(np.clip(60_000 // len(of), 1, 64))
        j = step + np.arange(1, block + 1, dtype=np.uint64)
        step += np.uint64(block)
        one = mix(seed[:, None] + GOLD * j)
        two = mix(one ^ np.uint64(0xD6E8FEB86659FD93))
        when = now[:, None] + np.cumsum(-np.log(((one >> np.uint64(11)) + np.uint64(1)).astype(float) * 2.0**-53) / width[:, None], axis=1)
        place = ((two & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES)) >> np.uint64(32)
        level = floor[:, None] + 1 + (((two >> np.uint64(32)) * width[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = level <= most[:, None]
        np.minimum.at(flat, (of[:, None] * PLACES + place.astype(np.int64))[counts], when[counts])
        now = when[:, -1]
        live = now < times.max(axis=1)[of]
        of, seed, floor, width, most, now = of[live], seed[live], floor[live], width[live], most[live], now[live]
    return times


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    schema = T.StructType([docs.schema["_id"], docs.schema["text_hash"], T.StructField("n_shingles", T.LongType()), T.StructField("bag1", T.LongType()), T.StructField("bag2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", 4_000_000):
                doc, found, weight = shingle_bags(part.column("_text"), shingle)
                n = part.num_rows
                times = signatures(doc, found, weight, n).view(np.uint64)
                cell = found * GOLD + weight.astype(np.uint64)
                bags = []
                for salt in (1, 2):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, doc, mix(cell + np.uint64(int(GOLD) * salt % 2**64)))
                    bags.append(pa.array(total.view(np.int64)))
                keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
                for r in range(ROWS):
                    keys = mix(keys * GOLD + times[:, r::ROWS])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                small = (mix(times) >> np.uint64(48)).astype("<u2")
                signature = pa.array([row.tobytes() for row in small], pa.binary())
                count = pa.array(np.bincount(doc, weights=weight, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("text_hash"), count, *bags, bands.cast(target.field("bands").type), signature], schema=target)

    return docs.mapInArrow(run, schema)


def _bags(docs: DataFrame, shingle: int) -> DataFrame:
    schema = T.StructType([docs.schema["_id"], T.StructField("runs", T.BinaryType()), T.StructField("weights", T.BinaryType())])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                doc, found, weight = shingle_bags(part.column("_text"), shingle)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                runs, weights = found.astype("<u8").tobytes(), weight.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([runs[8 * a : 8 * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([weights[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], schema=target)

    return docs.mapInArrow(run, schema)


def overlap(runs_a: bytes, weights_a: bytes, runs_b: bytes, weights_b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    a, b = np.frombuffer(runs_a, "<u8"), np.frombuffer(runs_b, "<u8")
    u, v = np.frombuffer(weights_a, "<u4").astype(np.int64), np.frombuffer(weights_b, "<u4").astype(np.int64)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(u[i], v[j]).sum())
    return both / max(1, int(u.sum() + v.sum()) - both)


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    left = bags.select(F.col("_id").alias("ia"), F.col("runs").alias("ra"), F.col("weights").alias("wa"))
    right = bags.select(F.col("_id").alias("ib"), F.col("runs").alias("rb"), F.col("weights").alias("wb"))
    joined = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib")).select("a", "b", "ra", "wa", "rb", "wb")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ra", "wa", "rb", "wb")]
            linked = pa.array([overlap(*x) >= similarity for x in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(linked), batch.column("b").filter(linked)], schema=target)

    return joined.mapInArrow(run, schema)


def _cells(batches, columns: tuple[str, ...]):
    """(cell, rows) of consecutive rows with the same key, x and y, across batches."""
    cell, rows = None, []
    for batch in batches:
        for k, x, y, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y", *columns)), strict=True):
            if (k, x, y) != cell:
                if rows:
                    yield cell, rows
                cell, rows = (k, x, y), []
            rows.append(row)
    if rows:
        yield cell, rows


def _batched(rows, target: pa.Schema, size: int = 5000):
    """Record batches of row tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")


def _suspects(members: DataFrame, least_agreement: float, block: int) -> DataFrame:
    """Rows (key, x, y, minor, rep, comp): suspects of unresolved buckets, by pair of blocks. Block x is one of members
    outside the bucket's largest component (minor), block y one of all members. members: key, rep, comp, n_shingles,
    signature."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", "load", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("load").alias("load"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, load: F.greatest(F.ceil(n / block), F.ceil(load / BLOCK_SHINGLES))
    split = split.select(F.col("key").alias("bucket"), F.col("top.comp").alias("largest"), blocks(F.col("n") - F.col("top.n"), F.col("load") - F.col("top.load")).alias("nx"), blocks(F.col("n"), F.col("load")).alias("ny"))
    rows = members.join(dealt_anew(split, "bucket"), F.col("key") == F.col("bucket")).withColumn("draw", F.xxhash64("rep"))
    one, two = F.pmod("draw", "nx"), F.pmod("draw", "ny")
    place = lambda x, y, minor: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(minor).alias("minor"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1), lambda x: place(x, two, False))
    minors = F.when(F.col("comp") != F.col("largest"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1), lambda y: place(one, y, True)))
    cells = rows.select("key", F.inline(F.concat(every, F.coalesce(minors, F.slice(every, 1, 0)))), "rep", "comp", "signature")
    schema = T.StructType([f for f in cells.schema if f.name != "signature"])
    target = to_arrow_schema(schema)

    def compare(rows: list) -> np.ndarray:
        sign, codes = np.array([np.frombuffer(r[3], "<u2") for r in rows]), np.unique([r[2] for r in rows], return_inverse=True)[1]
        minor = np.array([r[0] for r in rows])
        theirs = np.flatnonzero(~minor)
        seen = np.zeros(len(rows), bool)
        for i in np.flatnonzero(minor).tolist():
            other = theirs[codes[theirs] != codes[i]]
            close = other[(sign[other] == sign[i]).sum(axis=1) >= least_agreement * PLACES]
            if len(close):
                seen[i] = True
                seen[close] = True
        return np.flatnonzero(seen)

    def run(batches):
        yield from _batched(((*cell, *rows[i][:3]) for cell, rows in _cells(batches, ("minor", "rep", "comp", "signature")) for i in compare(rows).tolist()), target)

    return _dealt(cells).mapInArrow(run, schema)


def _joining_links(suspects: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) between components of each cell's suspects: for each cell a forest of them."""
    right = bags.select(F.col("_id").alias("ib"), "runs", "weights")
    schema = T.StructType([T.StructField("a", suspects.schema["rep"].dataType), T.StructField("b", suspects.schema["rep"].dataType)])
    target = to_arrow_schema(schema)

    def links(rows: list):
        runs, weights = [np.frombuffer(r[3], "<u8") for r in rows], [np.frombuffer(r[4], "<u4").astype(np.int64) for r in rows]
        sizes, total = np.array([len(r) for r in runs]), np.array([w.sum() for w in weights])
        code = np.unique(np.concatenate(runs), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        owner, load = np.repeat(np.arange(len(rows)), sizes)[order], np.concatenate(weights)[order]
        first = np.searchsorted(code[order], np.arange(code.max() + 1))
        last = np.append(first[1:], len(code))
        ends = np.cumsum(sizes)
        group = np.unique([r[2] for r in rows], return_inverse=True)[1]
        for i in np.flatnonzero([r[0] for r in rows]).tolist():
            own = code[ends[i] - sizes[i] : ends[i]]
            n = last[own] - first[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], np.minimum(load[at], np.repeat(weights[i], n)), len(rows))
            for j in np.flatnonzero(both >= similarity * (total + total[i] - both)).tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    yield min(rows[i][1], rows[j][1]), max(rows[i][1], rows[j][1])

    def run(batches):
        yield from _batched((link for _, rows in _cells(batches, ("minor", "rep", "comp", "runs", "weights")) for link in links(rows)), target)

    return _dealt(suspects.join(right, F.col("rep") == F.col("ib")).drop("ib")).mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, least_agreement: float = 0.62, block: int = BLOCK, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, ``text_hash`` (xxhash64 of the text), ``n_shingles``, ``class_id`` (least id with an
    equal bag), ``component_id`` (least id reachable by links) and ``kept`` (whether the row's id is that id)."""
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    signed = written(_signed(texts, shingle), "signatures")
    present = signed.where("_id IS NOT NULL AND n_shingles > 0")
    classes = written(present.groupBy("bag1", "bag2").agg(F.min("_id").alias("rep"), F.min_by(F.struct("bands", "signature", "n_shingles"), "_id").alias("s")).select("bag1", "bag2", "rep", "s.bands", "s.signature", "s.n_shingles"), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("draw"), "rep")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("bucket"), F.col("first.rep").alias("leader"))
    members = written(banded.join(dealt_anew(leaders, "bucket"), F.col("key") == F.col("bucket")).select("key", "rep", "leader"), "buckets")
    involved = written(members.select(F.col("rep").alias("_rep")).distinct(), "involved")
    bags = written(_bags(texts.join(involved, F.col("_id") == F.col("_rep")).dropDuplicates(["_id", "text_hash"]).select("_id", "_text"), shingle), "bags")
    proposed = members.where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    links = written(_verified(proposed, bags, similarity), "links")
    first = written(components(links, "a", "b"), "components")
    signs = classes.join(first, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("_rep"), F.coalesce("component", "rep").alias("comp"), "n_shingles", "signature")
    unresolved = written(members.join(signs, F.col("rep") == F.col("_rep")).select("key", "rep", "comp", "n_shingles", "signature"), "members")
    more = written(_joining_links(written(_suspects(unresolved, least_agreement, block), "suspects"), bags, similarity), "links")
    final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    named = classes.select("bag1", "bag2", "rep").join(final, F.col("rep") == F.col("node"), "left").select(F.col("bag1").alias("n1"), F.col("bag2").alias("n2"), "rep", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("_id", "text_hash", "n_shingles", "bag1", "bag2")
    met = (F.col("bag1") == F.col("n1")) & (F.col("bag2") == F.col("n2")) & (F.col("n_shingles") > 0)
    has_id = F.col("_id").isNotNull()
    return rows.join(dealt_anew(named, "n1"), met, "left").select(
        F.col("_id").alias(id_col), "text_hash", "n_shingles", F.when(has_id, F.coalesce("rep", "_id")).alias("class_id"), F.when(has_id, F.coalesce("component", "_id")).alias("component_id")
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))
