"""The queries with SQL against DuckDB, and the corpus pipeline against its plain version."""

from __future__ import annotations

import sys
from pathlib import Path

import helpers
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from quillframe.llm import quality, queries

SMALL = str(helpers.DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    helpers.compare(spark, queries.QUERIES[name], queries.ORACLES[name], SMALL)


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "secrets", "tokens"]


def test_pipeline_matches_its_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    good = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))).where("predicted = 1")
    rows = [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()]
    groups = brute.near_groups(rows)
    kept = [(i, t) for i, t in rows if groups[i] == i and not brute.contaminated(t, items)[1]]
    library = brute.byte_encoding()
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(found) == {i for i, _ in kept} and 0 < len(found) < len(rows)
    for i, t in kept:
        if not brute.base_secrets(t) and found[i].n_chars == len(t):
            assert np.frombuffer(found[i].ids, "<u4").tolist() == library.encode_ordinary(t) and found[i].round_trip
    assert all(r.round_trip for r in found.values())
