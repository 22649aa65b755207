"""Toxicity by two Kneser-Ney models of words, one of toxic and one of ordinary text.

Words are spelt by characters. Either class has its own interpolated Kneser-Ney model of orders 3 to ``ORDER`` over the
characters of a word, learnt from every word in that class's labelled texts: the longest grams by their occurrences, all
shorter ones by the number of different characters before them (at a word's start, where nothing differs, by their
occurrences). Each order and class has its own discount, n1 / (n1 + 2 n2) from its grams counted once and twice. Below
order 3 both classes back off to one shared model of continuation counts (in how many different contexts a character
follows), so that a rare expression which neither class knows says nothing. A word's evidence is the difference of its
two log-likelihoods. A text's evidence is the highest length-normalised difference of any run of ``WINDOW`` words, so a
short toxic passage counts in a long text; a logistic calibration with the text's length turns it into a chance.

Word counts cover all labelled rows outside the hold-out but those that the calibration is fitted on: at most
``per_class`` rows of each label, out of an eighth of the rows by hash. Grams are counted exactly, as the characters
they are, in written tables that grow with the labelled text. To score, the texts are encoded in blocks of about
``BLOCK_BYTES``; a block asks for each of its different longest grams once, in lists dealt by the last three characters
of the context. All shorter grams and contexts of a list share these, so one task finds every count of a list and sends
its evidences back to the block. No count passes through the driver or a broadcast.

Nulls count as empty texts; an empty text has no evidence and gets the calibrated score of that. Without rows of both
labels the score is 0. Repeated rows are scored each, other columns pass through (``score`` and ``predicted`` are
replaced), an empty table gives an empty table. Rows without an id or label are never learnt from.
"""

from __future__ import annotations

import functools
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quillframe.llm.arrow import hash_spans, raw, slices, words
from quillframe.llm.quality import in_hold_out, logistic
from quillframe.llm.storage import bucketed, lookup, written

ORDER, SHARED, WINDOW = 6, 2, 8
START = 2  # the character before a word
LEAST_LISTS, GRAMS_A_LIST = 1021, 200_000
BLOCK_BYTES, BLOCKS_A_PART = 8_000_000, 4096
ROWS_AT_ONCE, ASKED_AT_ONCE = 200_000, 2_000_000  # rows of whole lists, and packed bytes of one list's questions, in a task's memory
WORDS_A_TASK = 50_000
ONE, TWO = (1 << 21) - 1, (1 << 42) - 1  # one and two characters of 21 bits


def spell(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number of every character (with an end mark) and its longest gram: three characters in either number."""
    pad = "\x02" * (ORDER - 1)
    points = np.frombuffer("".join(f"{pad}{w}\x03" for w in found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + ORDER
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place >= ORDER - 1)
    hi, lo = (points[at - i - 2] << 42 | points[at - i - 1] << 21 | points[at - i] for i in (3, 0))
    return np.repeat(np.arange(len(found)), sizes)[at], hi, lo


def _cut(hi, k: int):
    """The first number of a gram cut to its last k + 1 characters; the second number stays, as k >= SHARED."""
    return hi & ((1 << 21 * (k - SHARED)) - 1)


def _list(hi, lo, lists: int):
    """The list of a gram out of ``lists``, by the three characters before its last; of numpy arrays or Spark columns alike."""
    if isinstance(hi, np.ndarray):
        before, last = lo >> 42, (lo >> 21) & ONE
        return ((hi & ONE) * 7919 + before * 104729 + last * 1299709) % lists
    before, last = F.shiftright(lo, 42), F.shiftright(lo, 21).bitwiseAND(ONE)
    return ((hi.bitwiseAND(ONE) * 7919 + before * 104729 + last * 1299709) % lists).cast("int")


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, equal for equal keys and in their order, and the first row of each number."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _longest(counts: DataFrame) -> DataFrame:
    """(hi, lo, occurrences in either class) of all grams of ``ORDER`` characters over all words."""
    schema = _parse_datatype_string("hi long, lo long, ordinary double, toxic double")
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            word, hi, lo = spell(batch.column("word").to_pylist())
            number, first = _numbered(hi, lo)
            weight = [np.bincount(number, batch.column(c).to_numpy()[word], len(first)) for c in ("ordinary", "toxic")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hi[first], lo[first], *weight)], schema=target)

    return counts.mapInArrow(run, schema).groupBy("hi", "lo").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _shorter(above: DataFrame, k: int) -> DataFrame:
    """Grams of k + 1 characters from those of one more: the different characters before each, or its occurrences at a
    word's start."""
    begin = F.shiftright("hi", 21 * (k - SHARED - 1)) if k > SHARED else F.shiftright("lo", 42)
    cut = above.select(F.col("hi").bitwiseAND((1 << 21 * (k - SHARED)) - 1).alias("hi"), "lo", "ordinary", "toxic")
    weight = lambda c: F.sum(F.when(begin == START, F.col(c)).otherwise((F.col(c) > 0).cast("double"))).alias(c)
    return cut.groupBy("hi", "lo").agg(weight("ordinary"), weight("toxic"))


def _grams(counts: DataFrame) -> DataFrame:
    """(hi, lo, weight in either class, k) of all grams of k + 1 characters; each length is a written table."""
    levels = [written(_longest(counts), "grams")]
    for k in range(ORDER - 2, SHARED - 1, -1):
        levels.append(written(_shorter(levels[-1], k), "grams"))
    named = [t.withColumn("k", F.lit(ORDER - 1 - i)) for i, t in enumerate(levels)]
    return functools.reduce(DataFrame.unionByName, named)


def _discount(once: int, twice: int) -> float:
    """Of an order's counts; 0.5 where they are too few to tell."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.5


def _pairs(grams: DataFrame) -> DataFrame:
    """(pair, follow): in how many different contexts each gram of two characters follows."""
    return grams.where(F.col("k") == SHARED).groupBy(F.col("lo").bitwiseAND(TWO).alias("pair")).agg(F.count("*").alias("follow"))


def discounts(grams: DataFrame) -> dict[int, tuple[float, ...]]:
    """k -> the discounts of the ordinary and the toxic model; SHARED - 1 -> that of the shared one."""
    count = [F.count_if(F.col(c) == n) for c in ("ordinary", "toxic") for n in (1, 2)]
    found = {r[0]: (_discount(r[1], r[2]), _discount(r[3], r[4])) for r in grams.groupBy("k").agg(*count).collect()}
    return found | {SHARED - 1: (_discount(*_pairs(grams).agg(*(F.count_if(F.col("follow") == n) for n in (1, 2))).first()),)}


@dataclass(frozen=True)
class Model:
    """The written tables of exact gram counts in both classes, their discounts, the number of lists they are dealt into
    (it grows with the grams), and the calibration."""

    grams: DataFrame
    discounts: dict[int, tuple[float, ...]]
    lists: int = LEAST_LISTS
    weights: tuple[float, ...] = ()


ROW = "block long, list int, data binary"
WHOLE, FOURS = -2, -1  # "lists" of a block's own row and of its different grams of four characters


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps([a.tobytes() for a in arrays], protocol=5), 3)


def _unpacked(data: bytes, *types) -> list[np.ndarray]:
    return [np.frombuffer(x, t) for x, t in zip(pickle.loads(zstandard.decompress(data)), types, strict=True)]


def _asked(found: list[str], lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word and number of every longest gram of the words; list and characters of each different one, by list."""
    word, hi, lo = spell(found)
    number, first = _numbered(_list(hi, lo, lists), hi, lo)
    return word, number, _list(hi, lo, lists)[first], hi[first], lo[first]


def _blocks(texts: DataFrame, lists: int) -> DataFrame:
    """Rows of each block of (_content, _text): itself, its grams of four characters, and its grams list by list."""
    schema = _parse_datatype_string(ROW)
    target = to_arrow_schema(schema)

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        index, contents, counts, tokens, held = {}, [], [], [], 0

        def ended():
            nonlocal index, contents, counts, tokens, held, made
            token, found = np.concatenate(tokens), list(index)
            order = np.argsort(-np.bincount(token, minlength=len(found)), kind="stable")  # frequent words first, their bytes apart: shorter when packed
            rank, found = np.argsort(order).astype("<u4"), [found[i] for i in order.tolist()]
            planes = rank[token].view(np.uint8).reshape(-1, 4).T.copy()
            block = [_packed(np.frombuffer(b"".join(contents), np.uint8), np.concatenate(counts).astype(np.int32), planes, np.frombuffer("\n".join(found).encode(), np.uint8))]
            _, _, name, hi, lo = _asked(found, lists)
            _, first = _numbered(_cut(hi, 3), lo)
            cuts = np.flatnonzero(np.diff(name, prepend=-1))
            parts = [_packed(h, x) for h, x in zip(np.split(hi, cuts[1:]), np.split(lo, cuts[1:]), strict=True)] if len(cuts) else []
            rows = [[WHOLE, FOURS, *name[cuts].tolist()], [*block, _packed(_cut(hi, 3)[first], lo[first]), *parts]]
            number = (task << 32) | made
            index, contents, counts, tokens, held, made = {}, [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([number] * len(rows[0]), pa.int64()), pa.array(rows[0], pa.int32()), pa.array(rows[1], target.field("data").type)], schema=target)

        for batch in batches:
            for part in slices(batch, "_text"):
                data, offsets = raw(pc.utf8_lower(part.column("_text").cast(pa.large_string())))
                starts, stops, doc = words(data, offsets)
                _, first, back = np.unique(hash_spans(data, starts, stops), return_index=True, return_inverse=True)
                text = data.tobytes()
                own = [index.setdefault(text[a:b].decode(), len(index)) for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
                contents += part.column("_content").to_pylist()
                counts.append(np.bincount(doc, minlength=part.num_rows))
                tokens.append(np.array(own, np.int64)[back])
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield ended()
        if contents:
            yield ended()

    return texts.mapInArrow(run, schema)


def _fours(blocks: DataFrame, model: Model) -> DataFrame:
    """(hi, lo, ordinary, toxic): either class's chance of the last three characters of each gram of four asked for."""
    schema = _parse_datatype_string("hi long, lo long")
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(data, np.int64, np.int64)], schema=target)

    asked = written(blocks.where(F.col("list") == FOURS).select("data").mapInArrow(run, schema).distinct(), "fours")
    grams, (own, other), (low,) = model.grams, model.discounts[SHARED], model.discounts[SHARED - 1]
    three = grams.where(F.col("k") == SHARED).select("lo", "ordinary", "toxic")
    above = three.groupBy(F.shiftright("lo", 21).alias("c")).agg(*(f(x).alias(f"{x[0]}{n}") for x in ("ordinary", "toxic") for n, f in (("n", F.sum), ("k", lambda x: F.sum((F.col(x) > 0).cast("double"))))))
    pairs = _pairs(grams)
    bases = pairs.groupBy(F.shiftright("pair", 21).alias("base")).agg(F.sum("follow").alias("total"), F.count("*").alias("kinds"))
    letters = max(1, pairs.count())
    need = asked.select("lo").distinct()
    joined = need.join(three.withColumnRenamed("lo", "g"), F.col("lo") == F.col("g"), "left").join(above, F.shiftright("lo", 21) == F.col("c"), "left")
    joined = joined.join(pairs, F.col("lo").bitwiseAND(TWO) == F.col("pair"), "left").join(bases, F.shiftright("lo", 21).bitwiseAND(ONE) == F.col("base"), "left")
    shared = (F.greatest(F.coalesce("follow", F.lit(0)) - low, F.lit(0.0)) + low * F.coalesce("kinds", F.lit(1)) / letters) / F.coalesce("total", F.lit(1))
    chance = lambda x, n, k, d: F.when(F.col(n) > 0, (F.greatest(F.coalesce(x, F.lit(0.0)) - d, F.lit(0.0)) + d * F.greatest(k, F.lit(1.0)) * F.col("p")) / F.greatest(n, F.lit(1.0))).otherwise(F.col("p"))
    chances = joined.withColumn("p", shared).select(F.col("lo").alias("_lo"), chance("ordinary", "on", "ok", own).alias("ordinary"), chance("toxic", "tn", "tk", other).alias("toxic"))
    return asked.join(chances, F.col("lo") == F.col("_lo")).select("hi", "lo", "ordinary", "toxic")


def _evidence(rows: dict[str, np.ndarray], hi: np.ndarray, lo: np.ndarray, discounts: dict[int, tuple[float, ...]]) -> np.ndarray:
    """log P(last character | toxic) - log P(last character | ordinary) of each gram, from its lists' counts."""
    def among(at, *pairs):
        known, asked = zip(*pairs, strict=True)
        number, _ = _numbered(*(np.concatenate([x[at], y]) for x, y in zip(known, asked, strict=True)))
        return number[: len(at)], number[len(at) :], len(number)

    at = np.flatnonzero(rows["k"] == SHARED)
    known, asked, n = among(at, (rows["hi"], _cut(hi, 3)), (rows["lo"], lo))
    p = [np.bincount(known, rows[c][at], n)[asked] for c in ("ordinary", "toxic")]
    for k in range(SHARED + 1, ORDER):
        at = np.flatnonzero(rows["k"] == k)
        known, asked, n = among(at, (rows["hi"], _cut(hi, k)), (rows["lo"], lo))
        above, base, _ = among(at, (rows["hi"], _cut(hi, k)), (rows["lo"] >> 21, lo >> 21))
        for y, c in enumerate(("ordinary", "toxic")):
            weight = rows[c][at]
            total, kinds = np.bincount(above, weight, n)[base], np.bincount(above, weight > 0, n)[base]
            d = discounts[k][y]
            own = np.maximum(np.bincount(known, weight, n)[asked] - d, 0) + d * np.maximum(kinds, 1) * p[y]
            p[y] = np.where(total > 0, own / np.maximum(total, 1), p[y])
    return np.log(p[1]) - np.log(p[0])


def _answers(blocks: DataFrame, model: Model, fours: DataFrame) -> DataFrame:
    """Rows of (block, list) with the evidence of each gram of the block's list, in its order. A list's questions are
    dealt into parts, each with the list's counts, which come first; the questions then stream past them."""
    schema = _parse_datatype_string(ROW)
    target, grams, by_order = to_arrow_schema(schema), model.grams, model.discounts

    def answered(known: list, asked: list):
        t, q = pa.Table.from_batches(known) if known else None, pa.Table.from_batches(asked)
        counts = {c: t.column(c).to_numpy() if t else np.zeros(0, np.int64) for c in ("k", "hi", "lo", "ordinary", "toxic")}
        lists = [_unpacked(x, np.int64, np.int64) for x in q.column("data").to_pylist()]
        number, first = _numbered(*(hi_lo := [np.concatenate(x) for x in zip(*lists, strict=True)]))
        each = _evidence(counts, *(x[first] for x in hi_lo), by_order).astype(np.float32)[number]
        ends = np.cumsum([len(x[0]) for x in lists])
        data = [zstandard.compress(x.tobytes(), 1) for x in np.split(each, ends[:-1])]
        for at in range(0, len(data), 1000):
            yield pa.RecordBatch.from_arrays([q.column("block").combine_chunks()[at : at + 1000], q.column("list").combine_chunks()[at : at + 1000], pa.array(data[at : at + 1000], target.field("data").type)], schema=target)

    def run(batches):
        known, asked, last, size, held = [], [], None, 0, 0
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("list", "part")] + [pc.is_valid(batch.column("data")).to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name, asks, piece = tuple(keys[a, :2]), keys[a, 2], batch.slice(a, b - a)
                if name != last and size >= ROWS_AT_ONCE:
                    if asked:
                        yield from answered(known, asked)
                    known, asked, size, held = [], [], 0, 0
                last, size = name, size + b - a
                (asked if asks else known).append(piece)
                held += piece.column("data").nbytes if asks else 0
                if held >= ASKED_AT_ONCE:  # this list's counts are all here
                    yield from answered(known, asked)
                    asked, held = [], 0
        if asked:
            yield from answered(known, asked)

    parts = 1 + blocks.where(F.col("list") == WHOLE).count() // BLOCKS_A_PART
    counts = grams.where(F.col("k") > SHARED).unionByName(fours.withColumn("k", F.lit(SHARED))).withColumn("list", _list(F.col("hi"), F.col("lo"), model.lists))
    counts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = blocks.where("list >= 0").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).unionByName(counts, allowMissingColumns=True)
    return dealt.repartition("list", "part").sortWithinPartitions("list", "part", F.col("data").isNotNull()).mapInArrow(run, schema)


def features(texts: DataFrame, model: Model) -> DataFrame:
    """(_content, evidence, length) of each different text: highest mean evidence of a window of words, log of words.

    The blocks are a table bucketed by block, so the texts in them are written once and never shuffled: only the evidences
    travel to them.
    """
    with bucketed(_blocks(texts, model.lists), "blocks", "block") as blocks:
        return _measured(blocks, model)


def _measured(blocks: DataFrame, model: Model) -> DataFrame:
    lists = model.lists
    answers = _answers(blocks, model, _fours(blocks, model)).groupBy("block").agg(F.collect_list(F.struct("list", "data")).alias("answers"))
    schema = _parse_datatype_string("_content binary, evidence double, length double")
    target = to_arrow_schema(schema)

    def of_block(data: bytes, answers: list[dict]) -> pa.RecordBatch:
        contents, count, planes, text = _unpacked(data, np.uint8, np.int32, np.uint8, np.uint8)
        token = planes.reshape(4, -1).T.copy().view("<u4").ravel()
        found = text.tobytes().decode().split("\n") if len(text) else []
        word, gram, *_ = _asked(found, lists)
        own = [np.frombuffer(zstandard.decompress(x["data"]), np.float32) for x in sorted(answers, key=lambda x: x["list"])]
        each = np.bincount(word, np.concatenate([*own, np.zeros(0, np.float32)])[gram], len(found))[token]
        best = np.where(count > 0, -np.inf, 0.0)
        if len(each):
            doc, ahead = np.repeat(np.arange(len(count)), count), np.cumsum(count)
            total, begin = np.append(0, np.cumsum(each)), np.arange(len(each))
            end = np.minimum(begin + WINDOW, ahead[doc])
            use = (end - begin == WINDOW) | (begin == ahead[doc] - count[doc])  # a shorter text is one window
            np.maximum.at(best, doc[use], ((total[end] - total[begin]) / (end - begin))[use])
        raw_contents = contents.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([raw_contents[i : i + 16] for i in range(0, len(raw_contents), 16)], target.field("_content").type), pa.array(best), pa.array(np.log1p(count))], schema=target)

    def run(batches):
        for batch in batches:
            for data, found in zip(batch.column("data"), batch.column("answers"), strict=True):
                yield of_block(data.as_py(), found.as_py() or [])

    dealt = blocks.where(F.col("list") == WHOLE).select("block", "data").join(answers, "block", "left").select("data", "answers").mapInArrow(run, schema)
    return written(dealt.groupBy("_content").agg(F.max("evidence").alias("evidence"), F.max("length").alias("length")), "features")


def _content(text: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def counted(known: DataFrame, picked: DataFrame, id_col: str) -> DataFrame:
    """The labelled rows to count: all that the calibration has not picked."""
    return known.join(F.broadcast(picked.select(id_col)), id_col, "left_anti")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 2000, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """The model from labelled rows outside the hold-out; None if a label is missing."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~in_hold_out(F.col(id_col))).groupBy(id_col).agg(F.max(label).alias("_label"))
    known = written(known.withColumn("_hash", F.xxhash64(id_col)), "known")
    aside = F.pmod("_hash", F.lit(8)) == 0  # so that a small table leaves most of its rows for the counts
    picked = [known.where(aside & (F.col("_label") == v)).orderBy("_hash", id_col).limit(per_class) for v in (0, 1)]
    picked = written(picked[0].unionByName(picked[1]), "picked")  # at most 2 * per_class rows
    texts = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    tokens = texts.join(lookup(counted(known, picked, id_col)), id_col).select("_label", F.explode(F.split(F.lower("_text"), r"[\x20\x09-\x0d]+")).alias("word")).where("word <> ''")
    counts = tokens.groupBy("word").agg(F.sum((F.col("_label") == 0).cast("double")).alias("ordinary"), F.sum((F.col("_label") == 1).cast("double")).alias("toxic"))
    counts = written(counts, "words")
    n = counts.count()
    if not n:
        return None
    grams = _grams(counts.coalesce(1 + n // WORDS_A_TASK))  # a task's grams repeat in every other's
    known_grams = Model(grams, discounts(grams), max(LEAST_LISTS, grams.count() // GRAMS_A_LIST))
    sample = texts.join(F.broadcast(picked), id_col).select("_label", "_hash", "_text", _content("_text").alias("_content"))
    sample = written(sample, "sample")
    found = features(sample.select("_content", "_text"), known_grams)
    rows = sample.select("_label", "_hash", "_content").join(found, "_content").select("_label", "_hash", "evidence", "length").toPandas().sort_values(["_hash", "_label"])
    if rows._label.nunique() < 2:
        return None
    x = np.column_stack([rows.evidence, rows.length, np.ones(len(rows))])
    return replace(known_grams, weights=tuple(logistic(x, rows._label.to_numpy(float)).tolist()))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: likelier toxic) and ``predicted``."""
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(int(threshold <= 0))})
    found = features(docs.select(_content(text).alias("_content"), F.coalesce(F.col(text), F.lit("")).alias("_text")), model)
    a, b, c = model.weights
    chance = 1 / (1 + F.exp(-F.greatest(F.least(F.col("evidence") * a + F.col("length") * b + c, F.lit(30.0)), F.lit(-30.0))))
    scored = found.select("_content", chance.alias("score"), (chance >= threshold).cast("int").alias("predicted"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    joined = docs.select(row, _content(text).alias("_of")).join(scored, F.col("_of") == F.col("_content"), "left")
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("score", "predicted")), "score", "predicted")
