"""JSON trees, markdown automata, settled calls, caches, upserts and timers on small cases against plain versions."""

from __future__ import annotations

import datetime
import html
import json

import pytest
from pyspark.sql import functions as F

from quillframe.functions import json_tree, markdown
from quillframe.operators import planning, reports, retries
from quillframe.sources.text_cache import TextCache
from quillframe.streaming import folds, streams
from quillframe.streaming.upsert import UpsertTable

# --- JSON -------------------------------------------------------------------------------------------------------------

DOCUMENTS = [
    '{"a": "x", "b": {"c": ["loose", {"d": "y", "a": ""}], "e": 3}, "f": [["in", {"g": "z"}]]}',
    '{"text": "{\\"no\\": \\"object\\"}", "list": "[1]", "é": " sp ", "n": null, "t": true}',
    '"alone"', "[]", "{}", "{broken", None, '[{"k": "1"}, {"k": "2"}, "3"]', "12",
]


def members(node, name=""):
    if isinstance(node, dict):
        for k, v in node.items():
            if isinstance(v, str):
                yield k, v
            else:
                yield from members(v, k)
    elif isinstance(node, list):
        for v in node:
            if not isinstance(v, str):
                yield from members(v, name)


def read(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def test_strings_of_objects_in_order(spark):
    rows = spark.createDataFrame(list(enumerate(DOCUMENTS)), "id int, j string")
    found = json_tree.strings(rows, "id", "j")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow"))
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.id, r.at)):
        got.setdefault(r.id, []).append((r.name, r.value))
    assert got == {i: x for i, d in enumerate(DOCUMENTS) if (x := list(members(read(d))))}
    assert json_tree.strings(rows.limit(0), "id", "j").collect() == []


MULTILINGUAL = [
    '{"fra": "a", "eng": "b"}', '{"eng": "", "deu": " b ", "ita": "c"}', '{"fra": "", "eng": 0, "spa": ["x", "x", "y"]}', '["p", {"fra": ["p", "q"]}, ["p", "q"], "p"]',
    '"caf&eacute; &amp;&#233;&#x41; &nope; &"', "3", "null", "{}", '{"fra": {"deu": "deep"}}', '{"a": 5, "b": "never"}', "broken{", None, '["", [], {}, null]', '{"z": "first", "a": "second"}',
]


def said(value):
    if isinstance(value, str):
        return html.unescape(value).strip() or None
    if isinstance(value, dict):
        return said(value.get("fra") or next((v for v in value.values() if v), None))
    if isinstance(value, list):
        return "\n".join(dict.fromkeys(t for t in map(said, value) if t)) or None
    return None


def test_multilingual_values(spark):
    rows = spark.createDataFrame(list(enumerate(MULTILINGUAL)), "id int, j string")
    found = {r.id: r.text for r in json_tree.multilingual(rows, "id", "j").collect()}
    assert found == {i: said(read(j)) for i, j in enumerate(MULTILINGUAL)}


# --- markdown ---------------------------------------------------------------------------------------------------------


def blocks(spark, text):
    rows = markdown.blocks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("n").collect()
    return [(r.kind, r.level, r.lines) for r in rows]


def test_blocks(spark):
    text = "# T\r\nplain\n line\n\n| a | b |\n|---|---|\n| 1 | x |\n| **2** |\nafter\n- item\n  goes on\n  - sub\n\n1. one\n* two\n## U\n| lone |\n\n  indented\n--- | ---"
    assert blocks(spark, text) == [
        ("heading", 1, ["T"]), ("paragraph", 0, ["plain", "line"]), ("header", 0, ["a", "b"]), ("row", 0, ["1", "x"]), ("row", 0, ["**2**"]), ("paragraph", 0, ["after"]),
        ("bullet", 0, ["item", "goes on"]), ("sub-bullet", 0, ["sub"]), ("number", 0, ["one"]), ("bullet", 0, ["two"]), ("heading", 2, ["U"]), ("paragraph", 0, ["| lone |"]), ("paragraph", 0, ["indented", "--- | ---"]),
    ]
    assert blocks(spark, "") == [] and blocks(spark, None) == []


@pytest.mark.parametrize(("text", "shown"), [("a **b** c", [("a ", False), ("b", True), (" c", False)]), ("**x****y**", [("x", True), ("y", True)]), ("** no", [("** no", False)]), ("", []), ("a\n**b\nc**", [("a\n", False), ("b\nc", True)])])
def test_bold_runs(spark, text, shown):
    found = spark.createDataFrame([(text,)], "t string").select(markdown.runs(F.col("t")).alias("r")).first().r
    assert [(x.text, x.bold) for x in found] == shown


def test_audit_risks(spark):
    report = (
        "# R\n## Analyse détaillée par section\n### Sols\nintro\n[STATUT : 🔴] | [Mur ] | [Fissure / Eau / Gel]\nlost\n**Exposé de la situation :** vu\nencore\n\nautre\n**Analyse de l'Expert & Référentiel :**\n\n_vide_\n\n un\n deux\n"
        "**Impact Assurabilité :**\n**Recommandation de levée de doute :** texte\n- voir\n* revoir\n---\n[STATUT : 🟢] | [x] | [y]\n### Vide\n_Aucun risque_\n### Toit\n[STATUT:🟡] | [T] | [seul]\n**Recommandation de levée de doute :**\nlire\ntout\n\n_rien_\n## Fin\n### Autre\n[STATUT : 🔴] | [a] | [b]\n"
    )
    rows = markdown.audit_risks(spark.createDataFrame([(1, report), (2, None), (3, "x")], "id int, t string"), "id", "t").orderBy("n").collect()
    shown = [(r.section, r.status, r.element, r.risk, r.hazard, r.situation, r.analysis, r.impact, r.advice) for r in rows]
    assert shown[0] == ("Sols", "🔴", "Mur", "Fissure", "Eau / Gel", "vu encore\n\nautre", ["un deux"], "", ["voir", "revoir"])
    assert shown[-1] == ("Toit", "🟡", "T", "seul", "", "", [], "", ["lire tout"])


# --- order ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["int", "string", "timestamp"])
def test_sums_and_places_before_in_any_order(spark, kind):
    made = {"int": lambda i: i, "string": lambda i: f"k{i:03d}", "timestamp": lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)}[kind]
    rows = [(g, None if i % 9 == 0 and i else made(i // 2), i) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, f"g string, o {kind}, v int").repartition(5)
    found = planning.sums_before(df, ["g"], "o", n=F.lit(1), s=F.col("v")).collect()
    assert len(found) == len(rows)
    for g in ("a", "b", None):
        mine = sorted((r for r in found if r.g == g), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(40)) and [r.s for r in mine] == [sum(x.v for x in mine[:i]) for i in range(40)]
        assert [r.o for r in mine] == sorted((r.o for r in mine), key=lambda o: (o is not None, o or made(0)))
    whole = planning.numbered(df, "place", "o").collect()
    assert sorted(r.place for r in whole) == list(range(1, len(rows) + 1))


def test_latest_before_by_time_and_name(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "x" if i % 3 else None, t + datetime.timedelta(days=7 - i)) for i in range(8)], "id int, digest string, at timestamp")
    found = {r.id: r.earlier for r in planning.latest_before(rows, "digest", "at", "earlier", value="id").collect()}
    assert found == {7: None, 5: 7, 4: 5, 2: 4, 1: 2, 6: None, 3: 6, 0: 3}


def test_findings_keep_rows_without_an_order(spark):
    docs = spark.createDataFrame([("d", None, "summary", 5), ("d", "b", "summary", 5), ("d", "a", "raw", 5)], "g string, doc string, kind string, size int")
    assert sorted((r.doc or "", r.label) for r in planning.findings_context(docs, "g", "doc", total=9, each=3).where("label is not null").collect()) == [("", "D1"), ("b", "D2")]


def test_many_equal_names(spark):
    names = spark.range(3000).select(F.lit("f").alias("folder"), F.when(F.col("id") % 500 == 7, F.concat(F.lit("a-"), (F.col("id") % 9 + 2).cast("string"), F.lit(".pdf"))).otherwise("a.pdf").alias("name"), "id")
    found = [r.target for r in reports.distinct_targets(names, "folder", "name", "id").select("target").collect()]
    assert len(found) == 3000 and len(set(found)) >= 2998  # two of the suffixed names are equal to others


# --- calls, caches, upserts -------------------------------------------------------------------------------------------


def test_calls_end_settled(spark):
    calls = spark.createDataFrame([("a", 5), ("b", 0), ("c", 1), ("d", 2)], "call string, size int")

    def provider(pending):
        status = F.when(F.col("hi") - F.col("lo") > 2, "refused").when((F.col("call") == "c") & (F.col("attempt") < 3), "busy").when(F.col("call") == "d", "down").otherwise("ok")
        return pending.where("NOT (call = 'a' AND lo = 4)").select("*", status.alias("status"), F.concat_ws("-", "lo", "hi").alias("answer"))

    found = sorted((r.call, r.lo, r.hi, r.attempt, r.status) for r in retries.settled(calls, "call", provider).collect())
    assert found == [("a", 0, 2, 1, "ok"), ("a", 2, 3, 1, "ok"), ("a", 3, 5, 1, "ok"), ("c", 0, 1, 3, "ok"), ("d", 0, 2, 3, "down")]


def files(root) -> dict:
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_upserts_count_once_and_protect(spark, tmp_path):
    table = UpsertTable(str(tmp_path / "t"), ["k"], ["v"], ["s"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, s string")
    assert table.apply(rows((1, "a", "new"), (2, "b", "new"), (None, "n", "new")), 0)
    assert table.apply(rows((1, "c", "other"), (3, "d", "new"), (3, "e", "new")), 1, order=["v"])
    before = files(tmp_path)
    assert not table.apply(rows((1, "lost", "lost")), 1) and not table.apply(rows((9, "lost", "lost")), 0) and files(tmp_path) == before
    schema = "k int, v string, s string"
    assert sorted(map(repr, (tuple(r) for r in table.read(spark, schema).collect()))) == ["(1, 'c', 'new')", "(2, 'b', 'new')", "(3, 'e', 'new')", "(None, 'n', 'new')"]
    (tmp_path / "t/rows/000000000002/_bucket=0").mkdir(parents=True)  # a batch that died before its manifest
    (tmp_path / "t/rows/000000000002/_bucket=0/part-0.parquet").write_bytes(b"half")
    assert table.apply(rows((2, "z", "x")), 2) and table.read(spark, schema).where("k = 2").first().v == "z"
    assert table.remove(rows((2, "", "")).select("k"), 3) and table.read(spark, schema).count() == 3
    assert not table.remove(rows((2, "", "")).select("k"), 4)


def test_cache_refreshes_what_is_deferred(spark, tmp_path):
    cache, asked = TextCache(str(tmp_path / "c")), []
    docs = spark.createDataFrame([(i, f"text {i % 6}" if i % 6 else "") for i in range(12)] + [(99, None)], "id int, text string").withColumn("content_hash", F.sha2("text", 256))

    def extract(status):
        def run(pending):
            asked.append(sorted(r.text for r in pending.collect()))
            return pending.select("content_hash", "text", F.when(F.col("text") == "text 1", status).otherwise("done").alias("status"))

        return run

    assert cache.refresh(docs.where("id < 3"), extract("deferred")) and cache.refresh(docs, extract("done"))
    before = files(tmp_path)
    assert not cache.refresh(docs, extract("done")) and files(tmp_path) == before
    assert asked == [["", "text 1", "text 2"], ["text 1", "text 3", "text 4", "text 5"]]
    assert {r.id: (r.char_count, r.status) for r in cache.texts(docs.select("id", F.col("content_hash").alias("h")), "h").collect()} == {i: (6 if i % 6 else 0, "done") for i in range(12)} | {99: (None, None)}
    one = docs.where("id = 1")
    plan = cache.cached(spark, one)._jdf.queryExecution().toString()
    assert "rows/" not in plan or len(cache.cached(spark, one).inputFiles()) == 1
    assert cache.forget(one) and cache.cached(spark).count() == 5


def test_folder_trees(spark):
    paths = spark.createDataFrame([("d", p) for p in ("b/x", "a/z/1", "a/z/2", "a/y", "top", "a/z/2", "")] + [("e", "/q//r")], "g string, p string")
    found = {r.g: r.body.split("\n") for r in reports.composite(paths, "g", "p").collect()}
    assert found["d"] == ["- top", "- **a/** (4)", "  - y", "  - **z/** (3)", "    - 1", "    - 2 x2", "- **b/** (1)", "  - x"]
    assert found["e"] == ["- **q/** (1)", "  - r"]


# --- timers -----------------------------------------------------------------------------------------------------------


def test_slots_rest_and_forget(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    steps = [(0, False, 500), (1, False, 500), (2, False, 500), (3, True, 200), (4, False, 401), (5, False, 429), (600, False, 500), (601, False, 402)]
    rows = [(s, i, t + datetime.timedelta(minutes=m), ok, status) for s in (1, 2) for i, (m, ok, status) in enumerate(steps)]
    kind = "slot long, event_id long, ts timestamp, ok boolean, status int"
    path = str(tmp_path / "e")
    for part in (rows[:4] + rows[8:11], rows[4:7] + rows[11:15], rows[7:8] + rows[15:]):  # later batches see the state of earlier ones
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    found = streams.drained(folds.quarantine_stream(stream, "slot"), "append", timers=True).collect()
    batch = folds.quarantine(spark.createDataFrame(rows, kind), "slot").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, batch), key=repr)
    at = {r.event_id: (r.failures, r.blocked_until and (r.blocked_until - t).total_seconds()) for r in batch if r.slot == 1}
    assert at == {0: (1, None), 1: (2, None), 2: (3, 300.0), 3: (0, None), 4: (1, 540.0), 5: (2, 360.0), 6: (1, None), 7: (2, 36660.0)}
