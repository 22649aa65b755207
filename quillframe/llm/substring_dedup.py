"""Removal of passages that repeat across documents, by suffix automata of reference shards.

Every word that lies in a window of ``window`` words which also starts in a document with a smaller id is removed.

Two equal windows share the word gram of least hash within them, their anchor, at the same place. Anchors that more
than one document has name the shards: shard a holds, of each document, the words of the windows with anchor a. Its
task goes through the documents by ascending id. Each one streams through the shard's suffix automaton for its matching
statistics, and where they reach the window's length its words are marked; only then does it enter the automaton, as a
reference for those after it. Shards are distributed by a shuffle instead of broadcast, as the references of a corpus
grow with it and no bound of their size holds.

An anchor of more than ``largest_shard`` places (a passage that a large part of the corpus has) would put its shard
into one long task. Its windows are instead dealt by their own hash of 128 bits, and the least document id of each
window is taken by a partially aggregated minimum, which marks the same words. (Through one automaton, a passage of ten
thousand copies is one task of half a minute that no machine shortens; README gives the figures.) Words are compared by
a 64-bit hash.

Null and empty texts have no words. Rows without an id are kept whole. Rows of equal id do not affect each other;
repeated rows get the same result each. Other columns pass through whatever their names (``n_words``, ``n_removed`` and
``kept`` are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillframe.llm.arrow import BASE, BASE_INVERSE, hash_spans, mix, raw, slices, words
from quillframe.llm.storage import written

GRAM = 15


def _span_hash(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` neighbouring entries of h."""
    power, inverse = np.full(len(h), BASE, np.uint64), np.full(len(h), BASE_INVERSE, np.uint64)
    power[:1] = inverse[:1] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power, out=total[1:])
    return (total[size:] - total[:-size]) * inverse[: len(h) - size + 1]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least entry of each run of ``width`` entries."""
    at = np.arange(len(x))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        have += step
    return at


class _Words:
    """Word hashes, word bounds of texts and the anchor of every window, for a slice of texts."""

    def __init__(self, texts: pa.Array, window: int):
        data, offsets = raw(texts)
        starts, stops, doc = words(data, offsets)
        self.hash = hash_spans(data, starts, stops)
        self.count = np.bincount(doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        if len(self.hash) < window:
            self.at = self.anchor = self.windows = np.zeros(0, np.int64)
            return
        grams = mix(_span_hash(self.hash, GRAM))
        least = _least(grams, window - GRAM + 1)
        self.windows = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])  # within one text
        self.at = least[self.windows]
        self.doc = doc[self.windows]
        self.anchor = grams.view(np.int64)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    schema = T.StructType([T.StructField("anchor", T.LongType()), docs.schema["_id"], T.StructField("_txt", T.LongType())])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                w = _Words(part.column("_text"), window)
                if len(w.at):
                    keep = np.append(True, w.at[1:] != w.at[:-1])
                    rows = pa.array(w.doc[keep])
                    yield pa.RecordBatch.from_arrays([pa.array(w.anchor[w.at[keep]]), part.column("_id").take(rows), part.column("_txt").take(rows)], schema=target)

    return docs.mapInArrow(run, schema)


def _passages(marked: DataFrame, window: int) -> DataFrame:
    """Of each document's shared anchors: the words of their windows (small shards), or each window's hash (large)."""
    schema = T.StructType([T.StructField("large", T.BooleanType()), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), marked.schema["_id"], T.StructField("_txt", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("passage", T.BinaryType())])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                w = _Words(part.column("_text"), window)
                small, large = ({(i, a) for i, found in enumerate(part.column(c).to_pylist()) for a in found or ()} for c in ("small", "large"))
                if not len(w.at):
                    continue
                cut = np.append(0, np.flatnonzero(w.at[1:] != w.at[:-1]) + 1)  # runs of windows with one anchor
                end = np.append(cut[1:], len(w.at))
                keys = w.anchor[w.at[cut]]
                of = list(zip(w.doc[cut].tolist(), keys.tolist(), strict=True))
                pick = np.fromiter((x in small for x in of), bool, len(of))
                if pick.any():
                    lo, hi, doc = w.windows[cut[pick]], w.windows[end[pick] - 1] + window, w.doc[cut[pick]]
                    cells = w.hash.astype("<u8").tobytes()
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lo), bool)), pa.array(keys[pick]), pa.array(np.zeros(len(lo), np.int64)), part.column("_id").take(rows), part.column("_txt").take(rows), pa.array((lo - w.first[doc]).astype(np.int32)), pa.array([cells[8 * a : 8 * b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], schema=target)
                pick = np.fromiter((x in large for x in of), bool, len(of))
                if pick.any():
                    chosen = np.repeat(pick, end - cut)
                    at, doc = w.windows[chosen], w.doc[chosen]
                    one, two = mix(_span_hash(w.hash, window)), mix(_span_hash(mix(w.hash ^ np.uint64(0x5851F42D4C957F2D)), window))
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), pa.array(one.view(np.int64)[at]), pa.array(two.view(np.int64)[at]), part.column("_id").take(rows), part.column("_txt").take(rows), pa.array((at - w.first[doc]).astype(np.int32)), pa.nulls(len(at), pa.binary())], schema=target)

    return marked.mapInArrow(run, schema)


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            p, q = last, self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
                continue
            last = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[p] + 1)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)

    def matching(self, sequence: list[int]) -> list[int]:
        """For each place, the length of the longest substring of the added sequences that ends there."""
        at = length = 0
        found = []
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            to = self.next[at].get(c)
            if to is None:
                length = 0
            else:
                at, length = to, length + 1
            found.append(length)
        return found


def _spans(ends: list[int], window: int) -> list[tuple[int, int]]:
    """The union of the windows that end (inclusive) at the given ascending places."""
    spans: list[tuple[int, int]] = []
    for e in ends:
        if spans and e - window + 1 <= spans[-1][1]:
            spans[-1] = (spans[-1][0], e + 1)
        else:
            spans.append((e - window + 1, e + 1))
    return spans


def _match_shards(passages: DataFrame, window: int) -> DataFrame:
    """Marked word ranges by streaming each shard's documents, in ascending order, through its automaton."""
    schema = T.StructType([passages.schema["_id"], T.StructField("_txt", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    target = to_arrow_schema(schema)

    def run(batches):
        shard = document = automaton = None
        waiting: list[list[int]] = []
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("key", "_id", "_txt", "start", "passage"))
            for key, doc, txt, start, passage in zip(*columns, strict=True):
                if key != shard:
                    shard, document, automaton, waiting = key, doc, SuffixAutomaton(), []
                elif doc != document:
                    for x in waiting:
                        automaton.add(x)
                    document, waiting = doc, []
                sequence = np.frombuffer(passage, "<u8").tolist()
                if len(automaton.next) > 1:
                    statistics = automaton.matching(sequence)
                    ends = [i for i, n in enumerate(statistics) if n >= window]
                    out += [(doc, txt, start + a, start + b) for a, b in _spans(ends, window)]
                    if statistics[-1] == len(sequence):
                        continue  # wholly in the automaton
                waiting.append(sequence)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return passages.repartition("key").sortWithinPartitions("key", "_id", "_txt", "start").mapInArrow(run, schema)


def repeated_ranges(docs: DataFrame, *, window: int = 50, largest_shard: int = 128, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, xxhash64 of the text, ranges of words that repeat an earlier document)."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_txt"), F.col(text).alias("_text"))
    anchors = written(_anchors(texts, window), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = shared.select(F.col("anchor").alias("shared"), (F.col("n") > largest_shard).alias("large")).repartition(F.xxhash64("shared", F.lit(1)))  # so that Spark may split a hot anchor in the join
    marks = anchors.join(shared, F.col("anchor") == F.col("shared")).groupBy("_id", "_txt").agg(F.collect_set(F.when(~F.col("large"), F.col("anchor"))).alias("small"), F.collect_set(F.when(F.col("large"), F.col("anchor"))).alias("large"))
    passages = written(_passages(texts.join(marks, ["_id", "_txt"]), window), "passages")
    by_shard = _match_shards(passages.where(~F.col("large")).select("key", "_id", "_txt", "start", "passage"), window)
    hot = passages.where("large").select("key", "key2", "_id", "_txt", "start")
    first = hot.groupBy("key", "key2").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select(F.col("key").alias("k1"), F.col("key2").alias("k2"), "low").repartition(F.xxhash64("k1", F.lit(1)))
    by_window = hot.join(first, (F.col("key") == F.col("k1")) & (F.col("key2") == F.col("k2"))).where("_id > low").select("_id", "_txt", "start", (F.col("start") + window).cast("int").alias("stop"))
    return by_shard.unionByName(by_window).groupBy("_id", "_txt").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def _drop_ranges(text: bytes, ranges: list[dict]) -> tuple[int, int, bytes]:
    found = text.split()
    if not ranges:
        return len(found), 0, b" ".join(found)
    edge = np.zeros(len(found) + 1, np.int64)
    for r in ranges:
        edge[r["start"]] += 1
        edge[r["stop"]] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return len(found), int(len(found) - keep.sum()), b" ".join(w for w, k in zip(found, keep.tolist(), strict=True) if k)


def remove_repeats(docs: DataFrame, *, window: int = 50, largest_shard: int = 128, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space."""
    ranges = repeated_ranges(docs, window=window, largest_shard=largest_shard, id_col=id_col, text=text)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(ranges, (F.col(f"row.`{id_col}`") == F.col("_id")) & (F.xxhash64(f"row.`{text}`") == F.col("_txt")), "left").select("row", "ranges")
    new = ["n_words", "n_removed", "kept"]
    passed = [c for c in docs.columns if c not in new]
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = batch.column("row")
            flat = pa.RecordBatch.from_arrays([*rows.flatten(), batch.column("ranges")], names=[*(f.name for f in rows.type), ""])
            for part in slices(flat, text):
                texts, found = part.column(text).cast(pa.large_binary()).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                n, removed, kept = zip(*(_drop_ranges(t or b"", r or []) for t, r in zip(texts, found, strict=True)), strict=True)
                made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                columns = [part.column(c) for c in passed] + made
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(columns, target, strict=True)], schema=target)

    return joined.mapInArrow(run, schema)
