"""Text of office files and pages: docx, xlsx and csv by their own formats, page routing for recognised text."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

csv.field_size_limit(2**31 - 1)  # a cell may be as long as its file

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(content: bytes) -> str:
    """Non-blank body paragraphs, then non-blank table cells, one a line."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = root.find(f"{W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t")).strip()
    lines = [said(p) for p in body.findall(f"{W}p")] + [said(c) for c in body.iter(f"{W}tc")]
    return "\n".join(filter(None, lines))


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, by the workbook's relationships; by position where it has none."""
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")
    found = [(s.get("name"), targets.get(s.get(f"{R}id"), f"worksheets/sheet{i}.xml")) for i, s in enumerate(sheets, 1)]
    return [(name, part.lstrip("/") if part.startswith("/") else f"xl/{part}") for name, part in found]


def xlsx_text(content: bytes) -> str:
    """Each sheet's name, then its rows, cells joined by a spaced pipe; blanks left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    lines = []
    for name, part in _sheets(z):
        lines.append(f"## {name}")
        for row in ElementTree.fromstring(z.read(part)).iter(f"{S}row"):
            cells = []
            for c in row.iter(f"{S}c"):
                value = c.findtext(f"{S}v") or "".join(t.text or "" for t in c.iter(f"{S}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(x.strip() for x in cells if x):
                lines.append(" | ".join(x.strip() for x in cells if x and x.strip()))
    return "\n".join(lines)


def csv_text(content: bytes) -> str:
    """Rows of a comma or semicolon table in the first encoding that fits; marks and line ends in quotes are text."""
    for encoding in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    mark = ";" if text.count(";") > text.count(",") else ","
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=mark)
    return "\n".join(filter(None, (" | ".join(c.strip() for c in row if c.strip()) for row in rows)))


READERS = {"docx": docx_text, "xlsx": xlsx_text, "csv": csv_text}


def office_text(files: DataFrame) -> DataFrame:
    """files (path, kind, content) with ``text`` and ``error``; a broken file is an error, never a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    text = READERS[row.kind](bytes(row.content))
                    out.append((row.path, row.kind, text, None if text else "no text found"))
                except Exception as e:  # broken input is data here
                    out.append((row.path, row.kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "error"])

    return files.select("path", "kind", "content").mapInPandas(run, "path string, kind string, text string, error string")


def page_routes(pages: DataFrame, doc: str, *, least_page: int = 200, least_mean: int = 50, allow: Column | bool = True) -> DataFrame:
    """Pages with ``route``: all pages of a thin document go to recognition, else only its thin pages; without leave a
    document of no characters is deferred, any other stays native. pages: doc, page, native_text."""
    size = F.length(F.regexp_replace(F.coalesce("native_text", F.lit("")), r"^\s+|\s+$", ""))
    stats = pages.groupBy(doc).agg(F.avg(size).alias("mean_chars"), F.sum(size).alias("chars"))
    may = allow if isinstance(allow, Column) else F.lit(allow)
    route = F.when(~may, F.when(F.col("chars") == 0, "deferred").otherwise("native")).when(F.col("mean_chars") < least_mean, "recognise").when(size < least_page, "recognise").otherwise("native")
    return pages.join(stats, doc).withColumn("route", route)


def spliced(pages: DataFrame, recognised: DataFrame, doc: str) -> DataFrame:
    """Document texts with recognised pages in place of the routed ones; mean of the known page confidences.

    recognised: doc, page, ocr_text, ocr_confidence.
    """
    joined = pages.join(recognised, [doc, "page"], "left").withColumn("text", F.when(F.col("route") == "recognise", F.coalesce("ocr_text", "native_text")).otherwise(F.col("native_text")))
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return joined.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"), F.avg("ocr_confidence").alias("ocr_confidence"), F.count_if(F.col("route") == "recognise").alias("n_recognised"))
