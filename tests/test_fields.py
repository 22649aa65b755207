"""Notice fields, report totals and logs on small invented cases."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quillframe.functions import notice_fields as nf
from quillframe.operators import logs, reports


def test_notice_fields(spark):
    row = spark.createDataFrame([(["2024-02-03T10:00", "x", "2024-01-05+01:00"], [" b", "a", "", "b"], ["n/a", "http://x"], 1)], "d array<string>, c array<string>, u array<string>, i int").select(
        nf.earliest(F.col("d")).alias("d"), nf.codes(F.col("c")).alias("c"), nf.first_url(F.col("u")).alias("u"), nf.description(F.array(F.lit(" long one "), F.lit("no"), F.lit("long one"), F.lit("second")), 12).alias("t"),
        nf.header_filename(F.lit("attachment; filename=\"a/b.zip\"; filename*=UTF-8''d%C3%A9.zip")).alias("f"), nf.header_filename(F.lit('attachment; filename="a/b.zip"')).alias("g"),
        nf.is_archive(F.lit("PK\x03\x04").cast("binary")).alias("z"), nf.is_archive(F.lit("html").cast("binary")).alias("h"),
        nf.request_url(F.lit("https://p.test/entreprise/consultation?id=12&orgAcronyme=a1")).alias("r"), nf.request_url(F.lit("https://p.test/entreprise")).alias("n"),
        nf.seconds_until(F.to_timestamp(F.lit("2024-01-01 06:30:00")), 7).alias("s"), nf.seconds_until(F.to_timestamp(F.lit("2024-01-01 07:00:00")), 7).alias("day"),
        nf.first_under(F.expr("array(named_struct('k', 'x', 'v', 'http://no'), named_struct('k', 'urlProfil', 'v', 'http://yes'))"), "profil").alias("p"),
    ).first()
    assert (row.d, row.c, row.u, row.t) == (datetime.date(2024, 1, 5), ["a", "b"], "http://x", "long one\nsec")
    assert (row.f, row.g, row.z, row.h, row.n, row.p) == ("dé.zip", "b.zip", True, False, None, "http://yes")
    assert row.r.endswith("&id=12&orgAcronyme=a1") and (row.s, row.day) == (1800, 86400)


def test_reports_and_logs(spark, tmp_path):
    parts = spark.createDataFrame([("a", 1, None, "e"), ("a", 2, "ok", None), ("b", 1, None, "e")], "r string, part int, body string, error string")
    old = spark.createDataFrame([("b", 1, "old"), ("a", 1, "old")], "r string, part int, body string")
    assert sorted(map(tuple, logs.kept_report(parts, old, "r").collect())) == [("a", 1, "failed: e"), ("a", 2, "ok"), ("b", 1, "old")]
    docs = spark.createDataFrame([("d", "A", "1/2", "x.pdf", 1), ("d", "A", "1/2", "x.pdf", 2), ("d", "B", None, "x.pdf", 3)], "dossier string, category string, lot string, name string, i int")
    assert [r.target_path for r in reports.reorganisation(docs, "dossier", "i").orderBy("i").collect()] == ["d/A/LOT 1-2/x.pdf", "d/A/LOT 1-2/x-2.pdf", "d/B/x.pdf"]
    lines = spark.range(1).select(reports.hazard_lines(F.create_map(F.lit("radon"), F.lit("3"), F.lit("clay"), F.lit("")), {"clay": "Clay", "radon": "Radon"}).alias("x")).first().x
    assert lines == "- Radon : 3"
    table = spark.range(1).select(reports.markdown_table(["a", "b"], F.array(F.struct(F.lit("x|y").alias("c0"), F.lit("1\n2").alias("c1")))).alias("x")).first().x
    assert table == "| a | b |\n|---|---|\n| x\\|y | 1 2 |"
    logs.append_calls(spark.createDataFrame([("m", 5)], "model string, total_tokens long"), str(tmp_path / "log"))
    logs.append_calls(spark.createDataFrame([("m", 7)], "model string, total_tokens long"), str(tmp_path / "log"))
    assert logs.usage(spark.read.json(str(tmp_path / "log")), "model").first().total_tokens == 12
    assert [(r.original_chars, r.kept_chars) for r in logs.truncations(spark.createDataFrame([("abcd",), ("a",)], "t string"), "t", 3, "cap").collect()] == [(4, 3)]
    frozen = reports.frozen_json(docs, "dossier", ["i"], "category", "name").first().report
    assert frozen.startswith('[{"category":"A","name":"x.pdf"}')
    cache = spark.createDataFrame([("h", "deferred"), ("g", "deferred"), ("k", "native")], "content_hash string, method string")
    assert [r.content_hash for r in logs.deferred_work(cache, spark.createDataFrame([("h",), ("k",)], "content_hash string")).collect()] == ["h"]
    topics = spark.createDataFrame([("r", ["a"], 2), ("r", [], 1)], "r string, divergences array<string>, absences int")
    assert tuple(reports.topic_totals(topics, "r").first()) == ("r", 1, 3)
    assert reports.contributing_models(spark.createDataFrame([("r", "b"), ("r", "a"), ("r", None)], "r string, model string"), "r").first().models == "a, b"
