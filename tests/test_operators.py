"""Resolution, notices, state and streaming on small invented cases."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quillframe.operators import notices, resolve, retrieval, scoring, state
from quillframe.streaming import folds, streams


def test_first_match_skips_errors_and_absents(spark):
    candidates = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("q", "a", 1), ("r", "z", 1)], "piece string, doc string, rank int")
    decisions = spark.createDataFrame([("p", "a", "absent", 0.9, None), ("p", "b", None, None, "boom"), ("p", "c", "partial", 0.7, None), ("q", "a", None, None, "boom")], "piece string, doc string, presence string, confidence double, error string")
    found = {r.piece: (r.doc, r.presence, r.error, r.layer) for r in resolve.first_match(candidates, decisions, "piece", "doc").collect()}
    assert found == {"p": ("c", "partial", None, "llm"), "q": (None, "absent", "boom", "content"), "r": (None, "absent", None, "none")}


def test_cross_check_compares_the_first_two(spark):
    rows = [("x", 1, " A ", 0.5), ("x", 2, "a", 0.5), ("x", 3, "z", 0.9), ("y", 1, "1", 0.2), ("y", 2, "2", 0.8), ("z", 1, "STRASSE", 0.1), ("z", 2, "straße", 0.1), ("w", 1, "v", None)]
    found = {r.field: (r.status, r.value) for r in resolve.cross_check(spark.createDataFrame(rows, "field string, rank int, value string, confidence double"), "field").collect()}
    assert found == {"x": ("coherent", " A "), "y": ("incoherent", "2"), "z": ("coherent", "STRASSE"), "w": ("single_source", "v")}


def test_batches_merge_and_missing_answers_are_errors(spark):
    batches = spark.createDataFrame([("d", 0, {"a": "1"}, None), ("d", 1, None, "late"), ("d", 2, {"b": "2"}, "later")], "doc string, batch int, answers map<string,string>, error string")
    row = resolve.merged_answers(batches.where("answers is not null or error is not null").withColumn("answers", F.coalesce("answers", F.expr("map_from_arrays(array(), array())").cast("map<string,string>"))), "doc").first()
    assert row.answers == {"a": "1", "b": "2"} and row.error == "late"
    items, answers = spark.createDataFrame([(0, 0), (0, 1)], "batch int, idx int"), spark.createDataFrame([(0, 1, "x")], "batch int, idx int, answer string")
    assert [r.error for r in resolve.by_index(items, answers, "batch", "idx").orderBy("idx").collect()] == ["missing answer", None]


def test_unit_vectors_and_scores(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(retrieval.unit(F.col("a")).alias("u"), retrieval.unit(F.col("z")).alias("z")).first()
    assert row.u == [0.6, 0.8] and row.z == [0.0, 0.0]
    catalog = [scoring.Entry("A", ("x", "y")), scoring.Entry("B", ("z", "w"))]
    docs = spark.createDataFrame([(1, "x x x"), (2, "xy"), (3, "xyzw"), (4, "")], "id int, t string")
    found = {r.id: (r.category, r.score, r.gap) for r in scoring.classify(docs, catalog, F.col("t"), "id").collect()}
    assert found == {1: (None, 1, 1), 2: ("A", 2, 2), 3: (None, 2, 0)}
    routed = spark.createDataFrame([("archive", None), ("other", "noise"), ("pdf", None)], "k string, r string").select(scoring.auto_route(F.col("k"), F.col("r"), "D", "U", ("noise",)).alias("a")).collect()
    assert [r.a and (r.a.category, r.a.confidence) for r in routed] == [("U", 1.0), ("U", 0.3), None]


def test_notices_without_buyer_never_merge(spark):
    rows = [("boamp", 1, "Ville É", "2024-01-02", "http://x/1", False), ("ted", 2, "ville e", "2024-01-02", "http://x/2", False), ("boamp", 3, None, "2024-01-02", None, False), ("boamp", 4, None, "2024-01-02", "u4", True)]
    df = spark.createDataFrame(rows, "source string, source_id int, buyer string, day string, dce_url string, automatable boolean").withColumn("fingerprint", notices.fingerprint(F.col("buyer"), F.col("day").cast("date")))
    found = sorted((r.source, r.source_id, r.n_duplicates, r.best_url) for r in notices.merge(df, preferred="ted").collect())
    assert found == [("boamp", 3, 0, None), ("boamp", 4, 0, "u4"), ("ted", 2, 1, "http://x/2")]


def test_corrections_orphans_and_reopening(spark):
    proposals = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    fixed = state.with_corrections(proposals, spark.createDataFrame([(2, "c")], "id int, v string"), ["id"], "v").orderBy("id").collect()
    assert [(r.v, r.final_v, r.decision) for r in fixed] == [("a", "a", "proposed"), ("b", "c", "corrected")]
    tables = {
        "dossiers": spark.createDataFrame([("x", "extraction_review"), ("y", "uploaded")], "dossier_id string, status string"),
        "documents": spark.createDataFrame([("x", "h1"), ("x", "h2"), ("y", "h2")], "dossier_id string, content_hash string"),
        "text_cache": spark.createDataFrame([("h1",), ("h2",)], "content_hash string"),
        "checks": spark.createDataFrame([("x", 1), ("y", 2)], "dossier_id string, n int"),
        "results": spark.createDataFrame([("x", 1)], "dossier_id string, n int"),
    }
    again = state.reopened(tables, "x", "reorganization")
    assert again["checks"].count() == 1 and again["results"].count() == 0 and again["dossiers"].where("status = 'classified'").count() == 1
    assert state.reopened(tables, "x", "completeness")["results"].count() == 1
    rest = state.without_dossier(tables, "x")
    assert [r[0] for r in rest["text_cache"].collect()] == ["h2"] and rest["documents"].count() == 1
    assert state.migrated(proposals, proposals.withColumn("new", F.lit(1))).where("new is null").count() == 2


def test_lockout_outlives_its_lock(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    marks = "ffffffsfff"
    rows = [("ip", t + datetime.timedelta(minutes=10 * i), m == "f", m == "s") for i, m in enumerate(marks)]
    events = spark.createDataFrame(rows, "ip string, ts timestamp, failed boolean, succeeded boolean")
    found = folds.lockout(events, "ip", ["ts"], threshold=5).orderBy("ts").collect()
    assert [r.failures for r in found] == [1, 2, 3, 4, 5, 6, 0, 1, 2, 3] and [r.locks for r in found] == [False] * 4 + [True, True] + [False] * 4
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    locks = streams.drained(folds.lockout_stream(stream, "ip", threshold=5), "append").orderBy("ts").collect()
    assert [(r.failures, r.locked_until - r.ts) for r in locks] == [(5, datetime.timedelta(minutes=15)), (6, datetime.timedelta(minutes=15))]


def test_status_stream_only_moves_on(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("d", t + datetime.timedelta(minutes=i), s) for i, s in enumerate(["uploaded", "classified", "unzipping", "error", "reorganized"])]
    df = spark.createDataFrame(rows, "dossier string, ts timestamp, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    assert [r.status for r in streams.drained(folds.last_status_stream(stream, "dossier", state.STATUSES), "update").collect()] == ["reorganized"]
    log = str(tmp_path / "sent")

    def send(row):
        if row.status == "unzipping":
            raise OSError("gone")
        with open(log, "a") as f:
            f.write(f"{row.status}\n")

    streams.broadcast(stream, send, "dossier", str(tmp_path / "ck")).awaitTermination()
    with open(log) as f:
        assert f.read().split() == [r[2] for r in rows if r[2] != "unzipping"]


def test_nearest_is_a_cosine_among_vectors_of_one_length(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [3.0, 4.0]), (2, 2, [-2.0, 0.0]), (3, 2, [1.0]), (50, 3, [1e200, 1e200]), (4, 3, [1.0, 0.0, 5.0]), (5, 3, None), (6, 3, [0.0, 0.0]), (7, 3, [float("nan"), 1.0]), (8, 3, [float("inf"), 1.0]), (9, 4, [2.0, None]), (100, 4, [5.0]), (10, 4, [])]
    df = spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>")
    found = {(r.query_id, r.vec_id): (r.similarity, r.rank) for r in retrieval.nearest(df, k=2).collect()}
    assert found == {(0, 50): (0.707107, 1), (0, 1): (0.6, 2), (50, 1): (0.989949, 1), (50, 0): (0.707107, 2), (100, 3): (1.0, 1)}
    best = {(r.query_id, r.label): r.similarity for r in retrieval.group_similarity(df, "label", least=0.5).collect()}
    assert best == {(0, 1): 1.0, (0, 3): 0.707107, (50, 1): 0.989949, (50, 3): 1.0, (100, 2): 1.0, (100, 4): 1.0}


def test_nearest_in_strips_and_cells(spark, monkeypatch):
    """More queries than a strip, cells of several query blocks, groups across batches, ties by id."""
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    vectors = np.random.default_rng(5).integers(-2, 3, (700, 4)).astype(float)
    vectors[~vectors.any(axis=1)] = 1
    df = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(vectors)], "vec_id int, label int, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    found: dict = {}
    for r in retrieval.nearest(df, k=3, every=2).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.similarity - sims[r.query_id, r.vec_id]) < 2e-6
    for q in range(0, 700, 2):
        best = sorted((j for j in range(700) if j != q), key=lambda j: (-sims[q, j], j))[:3]
        assert found[q] == best
    groups = {(r.query_id, r.label): r.similarity for r in retrieval.group_similarity(df, "label", every=2).collect()}
    assert set(groups) == {(q, g) for q in range(0, 700, 2) for g in range(7)}
    assert all(abs(s - sims[q, g::7].max()) < 2e-6 for (q, g), s in groups.items())
