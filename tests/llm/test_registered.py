"""The registered queries' columns against plain versions, on the smallest tables."""

from __future__ import annotations

import struct
import sys
import zlib
from pathlib import Path

import helpers
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quillframe.llm import queries, secret_scan

SMALL = str(helpers.DATA / "sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def found(spark, name):
    rows = queries.QUERIES[name](spark, SMALL).collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op4_columns(spark, texts):
    rows = found(spark, "op4_token_counts")
    for i, n in zip(texts, brute.pieces(list(texts.values())), strict=True):
        assert tuple(rows[i]) == (i, len(texts[i].encode()), n, n > 4096)
    assert rows[next(iter(texts))].__fields__ == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_op5_columns(spark, texts):
    rows, library = found(spark, "op5_byte_bpe"), brute.byte_encoding()
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert tuple(rows[i]) == (i, len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(t))


def test_op8_columns(spark, texts):
    rows = found(spark, "op8_secret_scan")
    for i, t in texts.items():
        base = brute.base_secrets(t)
        assert rows[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))
        assert [rows[i][f"n_{k}"] for k in secret_scan.BASE] == [sum(s[2] == k for s in base) for k in secret_scan.BASE]
        assert {f"{k}:{a}:{b}" for a, _, k, b in base} <= set(rows[i].spans.split(",")) | {""}


@pytest.mark.parametrize("name, threshold", [("op6_toxicity", 0.3), ("op9_quality", 0.7)])
def test_scores(spark, texts, name, threshold):
    rows = found(spark, name)
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_op1_columns(spark, texts):
    rows, bags = found(spark, "op1_minhash_dedup"), {i: brute.bag(t) for i, t in texts.items()}
    first: dict = {}
    for i in sorted(texts):
        first.setdefault(frozenset(bags[i].items()), i)
    for i, group in brute.near_groups(list(texts.items())).items():
        own = first[frozenset(bags[i].items())] if bags[i] else i
        assert tuple(rows[i]) == (i, sum(bags[i].values()), own, group, group == i)


def test_op3_columns(spark, texts):
    rows = found(spark, "op3_substring_dedup")
    for i, n, removed, kept in brute.without_repeats(list(texts.items())):
        assert tuple(rows[i]) == (i, n, removed, brute.sha(kept))
