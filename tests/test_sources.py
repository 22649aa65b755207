"""Archives, inventory, office files, page routing, the notice source, providers and exports on generated files."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillframe.sources import archives, files, inventory, notice_pages, office, providers, shared


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_nest_and_never_escape(spark, tmp_path):
    inner = zipped({"b.txt": b"b", "deep.zip": zipped({"c.txt": b"c"})})
    (tmp_path / "a.zip").write_bytes(zipped({"x/": b"", "x/a.txt": b"a", "../evil.txt": b"!", "in.zip": inner, "bad.zip": b"no zip"}))
    (tmp_path / "broken.zip").write_bytes(b"PK but broken")
    rows = archives.archive_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    found = {r.path: r.error for r in rows if r.archive.endswith("a.zip")}
    assert set(found) == {"x/a.txt", "in.zip", "in__extrait/b.txt", "in__extrait/deep.zip", "in__extrait/deep__extrait/c.txt", "bad.zip"}
    assert found["bad.zip"] and not found["in.zip"]
    assert [(r.path, bool(r.error)) for r in rows if r.archive.endswith("broken.zip")] == [(None, True)]


def test_damaged_streams_are_rows(spark, tmp_path):
    """A flipped deflate stream, in the root and in a nested archive, fails no job."""

    def damaged(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, b"some text of a member " * 200)
        data = bytearray(out.getvalue())
        start = 30 + len(name)
        data[start : start + 20] = bytes(b ^ 0xFF for b in data[start : start + 20])
        return bytes(data)

    (tmp_path / "root.zip").write_bytes(damaged("m.txt"))
    (tmp_path / "outer.zip").write_bytes(zipped({"in.zip": damaged("m.txt"), "ok.txt": b"fine"}))
    rows = archives.archive_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    found = {(r.archive.rsplit("/", 1)[1], r.path): bool(r.error) for r in rows}
    assert found == {("root.zip", None): True, ("outer.zip", "in.zip"): True, ("outer.zip", "ok.txt"): False}


def test_quoted_cells_stay_whole():
    assert office.csv_text(b'name,"a, b",c\n"x ""y""",,\n,,\n') == 'name | a, b | c\nx "y"'
    assert office.csv_text('a;"b;\nc"'.encode()) == "a | b;\nc"


def test_archive_budget_is_for_the_whole_tree(spark, tmp_path):
    """An archive that does not fit is passed over; a later, smaller one still fits, and the root alone may be too much."""
    inner, small = zipped({"big.bin": b"x" * 900}), zipped({"s": b"z" * 10})
    (tmp_path / "a.zip").write_bytes(zipped({"in.zip": inner, "a": b"y" * 50, "late.zip": small}))
    zips = spark.read.format("binaryFile").load(str(tmp_path))
    left = len(inner) + len(small) + 50
    found = {r.path: bool(r.error) for r in archives.archive_files(zips, budget=left + 100).collect()}
    assert found == {"in.zip": True, "a": False, "late.zip": False, "late__extrait/s": False}
    assert [(r.path, r.error) for r in archives.archive_files(zips, budget=left - 1).collect()] == [(None, "over the size budget")]


def test_archives_go_by_ranges_and_large_members_by_files(spark, tmp_path):
    """Members of one archive are several tasks' work; a large one is a file, and nothing of the archive is lost."""
    members = {f"m{i:02d}": bytes([i]) * (i * 200) for i in range(20)} | {"deep.zip": zipped({"x": b"1", "x2": b""})}
    (tmp_path / "a b.zip").write_bytes(zipped(members))
    df = archives.archive_files(spark.read.format("binaryFile").load(str(tmp_path)).union(spark.read.format("binaryFile").load(str(tmp_path))), inline=3000, span=5000)
    rows = {r.path: r for r in df.collect()}
    assert df.count() == len(rows) == len(members) + 2
    for name, data in members.items():
        row = rows[name]
        assert row.size_bytes == len(data) and (row.content is None) == (len(data) > 3000)
        assert bytes(row.content) == data if row.content is not None else open(row.file, "rb").read() == data
    assert bytes(rows["deep__extrait/x"].content) == b"1" and bytes(rows["deep__extrait/x2"].content) == b""


def test_archive_depth_and_empty_tables(spark, tmp_path):
    data = zipped({"t": b"t"})
    for _ in range(3):
        data = zipped({"n.zip": data})
    (tmp_path / "a.zip").write_bytes(data)
    zips = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r.path for r in archives.archive_files(zips, depth=2).collect()) == ["n.zip", "n__extrait/n.zip", "n__extrait/n__extrait/n.zip"]
    assert archives.archive_files(zips.where("false")).count() == 0
    assert archives.archive_files(zips.select(F.lit(None).cast("string").alias("path"))).count() == 0


def writers(folder):
    """Tasks that wrote rows of each table below the folder; a table's name goes up to its last dash."""
    tasks = {}
    for p in folder.rglob("part-*.parquet"):
        tasks.setdefault(p.parent.name.rpartition("-")[0], []).append(pq.ParquetFile(p).metadata.num_rows)
    return {name: sum(n > 0 for n in rows) for name, rows in tasks.items()}


def test_archives_are_dealt_by_what_lies_in_them(spark, tmp_path, monkeypatch):
    """Rows that name archives are few bytes, which adaptive execution puts into one task, however many archives they name."""
    (tmp_path / "zips").mkdir()
    for i in range(60):
        (tmp_path / f"zips/{i}.zip").write_bytes(zipped({f"{m}.txt": bytes([i, m]) for m in range(5)} | {"in.zip": zipped({"x": bytes([i])})}))
    monkeypatch.setattr(archives, "new_folder", lambda spark, name: str(tmp_path / "shared"))
    monkeypatch.setattr(archives, "DIRECTORIES", 6)
    monkeypatch.setattr(archives, "UNPACKED", 20 * archives.OPENING)
    found = archives.archive_files(spark.read.format("binaryFile").load(str(tmp_path / "zips")))
    assert found.count() == 60 * 7
    split = writers(tmp_path / "shared")
    assert min(split["listed"], split["found"]) >= 6
    assert {(r.archive.rsplit("/", 1)[1], r.path, bytes(r.content)) for r in found.where("path NOT LIKE '%.zip'").collect()} == {(f"{i}.zip", *m) for i in range(60) for m in (*((f"{m}.txt", bytes([i, m])) for m in range(5)), ("in__extrait/x", bytes([i])))}


def test_tasks_follow_the_work(spark):
    assert [shared.tasks(spark, n, n, 100) for n in (0, 1, 3, 400, 3_000, 10**9)] == [1, 1, 3, 4, 30, shared.MOST_TASKS]
    assert shared.tasks(spark, 2, 1000, 100) == 10


def test_copies_are_rebuilt_and_failures_are_rows(spark, tmp_path):
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a/x.txt", "one"), ("b.txt", None), ("../up", "no"), (None, "no")], "p string, text string")
    assert {r.p: (r.n_bytes, bool(r.error)) for r in files.written_files(rows, root, "p", "text").collect()} == {"a/x.txt": (3, False), "b.txt": (0, False), "../up": (None, True), None: (None, True)}
    plan = spark.createDataFrame([("a/x.txt", "k/1.txt"), ("b.txt", "k/2.txt"), ("gone", "k/3.txt"), ("a/x.txt", "k/1.txt/below")], "source_path string, target_path string")
    for _ in range(2):
        found = {r.target_path: bool(r.error) for r in files.rebuilt_copy(plan.limit(3), root, target).collect()}
        assert found == {"k/1.txt": False, "k/2.txt": False, "k/3.txt": True}
        assert sorted(str(p.relative_to(target)) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["k/1.txt", "k/2.txt"]
        assert files.rebuilt_copy(plan.limit(1), root, str(tmp_path / "one")).first().sha256 == hashlib.sha256((tmp_path / "one/k/1.txt").read_bytes()).hexdigest()
    assert files.rebuilt_copy(plan.where("target_path = 'k/2.txt'"), root, target).count() == 1
    assert [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()] == ["2.txt"] and sorted(p.name for p in tmp_path.iterdir()) == ["in", "one", "out"]
    assert files.rebuilt_copy(plan.where("false"), root, target).count() == 0 and list((tmp_path / "out").iterdir()) == []


def test_member_names():
    info = zipfile.ZipInfo("é".encode("cp850").decode("cp437") + ".txt")
    assert archives.member_name(info) == "é.txt"
    info = zipfile.ZipInfo("N°1".encode("cp1252").decode("cp437"))
    assert archives.member_name(info) == "N°1"


def test_inventory(spark, tmp_path):
    for name, data in {"in.zip": b"z", "in__extrait/a.PDF": b"1", "in__extrait/._a.pdf": b"2", "plan RDC.pdf": b"3", "odd.foo": b"4", "noext": b"5", "x.db": b"6"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.relative_path: r for r in inventory.inventory(spark, str(tmp_path), plan_names="(?i)plan").collect()}
    assert rows.pop("in__extrait/._a.pdf").reason == "system metadata"
    assert len(rows) == 6 and rows["in__extrait/a.PDF"].parent_archive == "in.zip" and rows["in__extrait/a.PDF"].analyzable
    assert rows["plan RDC.pdf"].reason == "plan by name"
    assert [rows[n].at_risk for n in ("odd.foo", "noext", "x.db", "in.zip")] == [True, True, False, False]


def test_names_that_spark_hides_are_listed(spark, tmp_path):
    for name in ("_CCTP.pdf", ".hidden/deep.docx", "_x/_y.csv", "plain.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    rows = {r.relative_path: r for r in inventory.inventory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"_CCTP.pdf", ".hidden/deep.docx", "_x/_y.csv", "plain.pdf"} and rows["_CCTP.pdf"].analyzable
    assert all(r.size_bytes == len(n) and r.sha256 == hashlib.sha256(n.encode()).hexdigest() for n, r in rows.items())


def test_office_files(spark):
    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if v else "<c/>"
    body = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in [("left", "right"), ("a", "1 | 2"), ("", "x &amp; y"), ("", "")])
    book = zipped({"xl/workbook.xml": f'<workbook xmlns="{sheet}"><sheets><sheet name="report"/></sheets></workbook>'.encode(), "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{sheet}"><sheetData>{body}</sheetData></worksheet>'.encode()})
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    doc = zipped({"word/document.xml": f'<w:document xmlns:w="{word}"><w:body>{para("Title")}{para("text &amp; more")}{para("")}<w:tbl><w:tr><w:tc>{para("a")}</w:tc><w:tc>{para("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'.encode()})
    files = spark.createDataFrame([("w", "xlsx", bytearray(book)), ("d", "docx", bytearray(doc)), ("c", "csv", bytearray("é;b\n;\n1;2".encode("cp1252"))), ("e", "docx", bytearray(b"junk"))], "path string, kind string, content binary")
    found = {r.path: r for r in office.office_text(files).collect()}
    assert found["w"].text.split("\n") == ["## report", "left | right", "a | 1 | 2", "x & y"]
    assert found["d"].text.split("\n") == ["Title", "text & more", "a", "b"]
    assert found["c"].text == "é | b\n1 | 2" and found["e"].text is None and found["e"].error


def test_sheets_are_found_by_their_relationship():
    sheet, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    page = lambda v: f'<worksheet xmlns="{sheet}"><sheetData><row><c t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'.encode()
    book = zipped({
        "xl/workbook.xml": f'<workbook xmlns="{sheet}" xmlns:r="{rel}"><sheets><sheet name="first" r:id="r2"/><sheet name="second" r:id="r1"/></sheets></workbook>'.encode(),
        "xl/_rels/workbook.xml.rels": b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet9.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": page("b"), "xl/worksheets/sheet9.xml": page("a"),
    })
    assert office.xlsx_text(book) == "## first\na\n## second\nb"


def test_page_routing(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 300), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, None), ("c", 1, "w" * 400)], "doc string, page int, native_text string")
    routes = {(r.doc, r.page): r.route for r in office.page_routes(pages, "doc").collect()}
    assert routes == {("a", 1): "native", ("a", 2): "recognise", ("b", 1): "recognise", ("b", 2): "recognise", ("c", 1): "native"}
    ocr = spark.createDataFrame([("a", 2, "two", 0.8), ("b", 1, "one", None)], "doc string, page int, ocr_text string, ocr_confidence double")
    out = {r.doc: r for r in office.spliced(office.page_routes(pages, "doc"), ocr, "doc").collect()}
    assert out["a"].text == "x" * 300 + "\ntwo" and out["a"].ocr_confidence == 0.8 and out["b"].text == "one\n"
    assert {r.route for r in office.page_routes(pages.where("doc = 'd' or doc = 'c'"), "doc", allow=False).collect()} == {"native"}


def test_notice_source(spark, tmp_path):
    records = [{"id": i, "title": f"t{i}", "published_at": f"2024-01-{10 + i:02d}T08:00"} for i in range(4)]
    (tmp_path / "p1.json").write_text(json.dumps({"records": records}))
    records[3]["published_at"] = "soon"
    (tmp_path / "p1.json").write_text(json.dumps({"records": records}))
    (tmp_path / "p2.json").write_text("broken")
    notice_pages.register(spark)
    df = spark.read.format("notice_pages").option("source", "ted").option("path", str(tmp_path)).load()
    assert df.where("published_at >= date'2024-01-12'").count() == 1 and df.where("published_at is null and error is null").count() == 1
    assert df.where("error is not null").count() == 1 and df.count() == 5
    assert notice_pages.full_text_query(['a "b"'], "2024-01-01", codes=["45"]) == 'published >= 2024-01-01 AND text IN ("a \\"b\\"") AND cpv IN (45)'


def test_notices_without_an_id_are_rows(spark, tmp_path):
    (tmp_path / "p3.json").write_text(json.dumps({"records": [{"id": 1}, {"title": "none"}, "text", {"id": 2, "title": 5}]}))
    (tmp_path / "p2.json").write_text('{"records": 5}\n')
    (tmp_path / "p1.json").write_text('{"records": [{"id": 7}]}\n{"records": [{"id": 8}]}\n')
    notice_pages.register(spark)
    read = lambda **o: spark.read.format("notice_pages").options(path=str(tmp_path), **o).load()
    rows = read().collect()
    assert sorted(r.source_id for r in rows if not r.error) == ["1", "2", "7", "8"] and sum(bool(r.error) for r in rows) == 3
    assert read(maxPages="1").count() == 4 and read(maxRecords="2", pageSize="2").count() == 2
    asked = read(terms="mur, sol", countries="FRA").where("published_at IS NULL OR published_at >= DATE '2024-01-02'").first().request
    assert asked == 'text IN ("mur" OR "sol") AND country IN (FRA)'
    assert read(source="ted").where("source = 'other'").count() == 0
    (tmp_path / "p4.json").write_text(json.dumps({"records": [{"id": 9, "published_at": "2024-02-01"}]}))
    newer = read().where("published_at >= DATE '2024-01-02'")
    assert [r.request for r in newer.collect()] == ["published >= 2024-01-02"]


def test_a_poll_with_nothing_new_asks_nothing(spark, tmp_path):
    notice_pages.register(spark)
    feed, state, out = tmp_path / "feed", str(tmp_path / "state"), []
    feed.mkdir()
    (feed / "p1.json").write_text(json.dumps({"records": [{"id": 1, "published_at": "2024-01-10"}, {"id": 2, "published_at": "2023-01-10"}]}))

    def poll():
        stream = spark.readStream.format("notice_pages").options(path=str(feed), today="2024-01-20", lookbackDays="15").load()
        stream.writeStream.foreachBatch(lambda b, n: out.append(sorted(r.source_id for r in b.collect()))).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    poll()
    poll()
    (feed / "p2.json").write_text(json.dumps({"records": [{"id": 3, "published_at": "2024-01-12"}]}))
    poll()
    assert [x for x in out if x] == [["1"], ["1", "3"]]


def test_table_provider_asks_each_content_once(spark):
    calls = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3)], "digest string, doc int")
    answers = spark.createDataFrame([("h1", "text")], "digest string, answer string")
    rows = {r.doc: (r.answer, r.error) for r in providers.once_per_content(calls, "digest", providers.TableProvider(answers, "digest")).collect()}
    assert rows == {1: ("text", None), 2: ("text", None), 3: (None, "no answer")}
    assert calls.select(F.col("digest")).distinct().count() == 2
