"""Quality scores by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on a bounded sample of labelled rows, one from good texts and one from bad ones. A text is
compressed with either; the difference of the two sizes, divided by their sum, is the normalised compressed-size
difference. A logistic calibration turns it, with the compressed share of the text and the text's length, into the
chance that the text is good. The calibration is fitted on other rows of the sample.

Bounds: ``per_class`` rows of each label for the dictionaries and twice as many for the calibration, those of least hash
of the id. Of a row for the dictionaries at most ``pieces`` pieces of ``PIECE_BYTES`` bytes reach the driver, those of
least hash out of the whole text; the calibration's features are computed in tasks from whole texts, so a row sends six
numbers. Every document is scored over its whole text.

Nulls count as empty texts; empty texts get the calibrated score of no bytes. Without rows of both labels there is no
model: ``fit`` gives None, and ``score`` then gives 0.5 everywhere. Of an id with several texts the least one is learnt
from. Repeated rows are scored each, other columns pass through (``score`` and ``predicted`` are replaced), an empty
table gives an empty table. Rows without an id or label are never learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.arrow import add_columns, raw
from quillframe.llm.storage import written

DICTIONARY_BYTES = 1 << 16
PIECE_BYTES, FEATURES = 1024, 6


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def in_hold_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself serves
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def features(texts: pa.Array, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    data, offsets = raw(texts)
    data = memoryview(data)
    size = np.diff(offsets).astype(float)
    cut = [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    g, b = (np.array([len(c.compress(x)) for x in cut], float) for c in (good, bad))
    difference, share = (b - g) / (b + g + 1), g / (size + 1)
    return np.column_stack([difference, share, share**2, np.log1p(size), difference * share, np.ones_like(share)])


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    return [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge-stabilised logistic regression by Newton steps, halved until the likelihood grows. The last
    column of x is constant; the others are brought to unit spread first."""
    middle, spread = x.mean(axis=0), x.std(axis=0)
    middle[-1], spread = 0.0, np.where(spread > 0, spread, 1.0)
    z, w = (x - middle) / spread, np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        at = z @ w
        return float((np.logaddexp(0, at) - y * at).sum() + ridge * (w @ w) / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step, now = np.linalg.solve(hessian, z.T @ (y - p) - ridge * w), loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    w = w / spread
    w[-1] -= (w[:-1] * middle[:-1]).sum()
    return w


def _pieces(most: int) -> F.Column:
    """The pieces of _text, at most ``most``, those of least hash."""
    cut = F.expr(f"transform(sequence(0, greatest(octet_length(_text) - 1, 0) div {PIECE_BYTES}), i -> substring(CAST(_text AS binary), int(i) * {PIECE_BYTES} + 1, {PIECE_BYTES}))")
    return F.transform(F.slice(F.array_sort(F.transform(cut, lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p")))), 1, most), lambda x: x["p"])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 2000, pieces: int = 8, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """The model from labelled rows outside the hold-out; None if a label is missing."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~in_hold_out(F.col(id_col))).groupBy(id_col).agg(F.max(label).alias("_label"))
    parts = [known.where(F.col("_label") == v).withColumn("_hash", F.xxhash64(id_col)).orderBy("_hash", id_col).limit(3 * per_class) for v in (0, 1)]
    picked = parts[0].unionByName(parts[1]).withColumnRenamed(id_col, "_id")
    order = Window.partitionBy("_label").orderBy("_hash", "_id")
    met = F.col("_own") == F.col("_id")
    ids = docs.select(F.col(id_col).alias("_own")).join(F.broadcast(picked), met).select("_id", "_label", "_hash").distinct()  # at most 6 * per_class
    numbered = written(ids.withColumn("_nth", F.row_number().over(order) - 1), "numbered")  # ids alone, without their texts
    rows = docs.select(F.col(id_col).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(numbered), met)
    sample = written(rows.groupBy("_id", "_label", "_hash", "_nth").agg(F.min("_text").alias("_text")), "sample")
    taught = sample.where("_nth % 3 = 0").select("_label", "_nth", F.posexplode(_pieces(pieces)).alias("_at", "_piece")).toPandas().sort_values(["_label", "_nth", "_at"])
    parts = [[bytes(p) for p in taught[taught._label == v]._piece] for v in (0, 1)]
    if not parts[0] or not parts[1]:
        return None
    good, bad = _dictionary(parts[1]), _dictionary(parts[0])
    rest = sample.where("_nth % 3 <> 0") if sample.where("_nth % 3 <> 0").limit(1).count() else sample

    def make():
        pair = _compressors(good, bad)
        return lambda texts: [pa.array(x) for x in features(texts, *pair).T]

    measured = add_columns(rest.select("_label", "_nth", "_text"), "_text", ", ".join(f"f{i} double" for i in range(FEATURES)), make).drop("_text")
    x = measured.toPandas().sort_values(["_label", "_nth"], ignore_index=True)
    return Model(good, bad, tuple(logistic(x[[f"f{i}" for i in range(FEATURES)]].to_numpy(), x._label.to_numpy(float))))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: likelier good) and ``predicted``."""
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(int(threshold <= 0.5))})

    def make():
        pair, weights = _compressors(model.good, model.bad), np.array(model.weights)

        def compute(texts: pa.Array) -> list[pa.Array]:
            s = 1 / (1 + np.exp(-np.clip(features(texts, *pair) @ weights, -30, 30)))
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return compute

    return add_columns(docs, text, "score double, predicted int", make)
