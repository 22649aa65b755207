"""Helpers for operators that run numpy inside Arrow batches: slicing by bytes, adding columns, finding words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 2_000_000
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of a word up to which its blocks are folded in numpy; a longer one is hashed by BLAKE2b.
BLOCKS = 32
KEY = b"quillframe words"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text has no bytes."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes that are not separators, within each text."""
    inside = ~separator[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets < len(data))]
    before[edges] = False
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: its length, then its blocks of 8 bytes, each scrambled into what came before.

    Spans of up to 8 bytes and one length never collide. A polynomial of the bytes would not do: modulo 2^64 the Thue-Morse
    words collide at every odd base.
    """
    sizes = stops - starts
    h = mix(sizes.astype(np.uint64) + BASE)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left, done = np.flatnonzero((sizes > 0) & (sizes <= BLOCKS)), 0
    while len(left):
        rest = sizes[left] - done
        block = eight[starts[left] + done]
        short = rest < 8
        block[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        h[left] = mix((h[left] ^ block) * BASE)
        left, done = left[rest > 8], done + 8
    for i in np.flatnonzero(sizes > BLOCKS).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=8, key=KEY).digest(), "little")
    return h


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.diff(raw(batch.column(column))[1])
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def add_columns(docs: DataFrame, text: str, fields: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], limit: int = SLICE_BYTES) -> DataFrame:
    """docs with computed columns; ``make()`` runs once per task and returns texts -> arrays in the order of ``fields``; it
    gets about ``limit`` bytes of text at a time.

    A computed column replaces one of the same name; every other column passes through.
    """
    new = T._parse_datatype_string(fields)
    kept = [c for c in docs.columns if c not in new.names]
    schema = T.StructType([docs.schema[c] for c in kept] + new.fields)
    target = to_arrow_schema(schema)

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                arrays = compute(part.column(text))
                columns = [part.column(c) for c in kept] + list(arrays)
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(columns, target, strict=True)], schema=target)

    return docs.mapInArrow(run, schema)
