"""Archives and sorted copies: files are made of the documents' whole texts, then read back or copied."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from quillframe.operators import reports
from quillframe.plans.book import Book
from quillframe.sources.archives import archive_files
from quillframe.sources.files import rebuilt_copy, written_files
from quillframe.sources.shared import new_folder
from quillframe.sources.tables import table

book = Book()
PACKED = 100  # documents of an archive


def _zip(members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """An archive with every third text in a nested archive, which is cut short in every fourth pack."""
    pack, frame = frame.pack.iloc[0], frame.sort_values("doc_id")
    named = [(f"{s}/{d}.txt", (t or "").encode()) for s, d, t in zip(frame.source, frame.doc_id, frame.text, strict=True)]
    inner = _zip([m for m, d in zip(named, frame.doc_id, strict=True) if d % 3 == 0])
    kept = [m for m, d in zip(named, frame.doc_id, strict=True) if d % 3]
    return pd.DataFrame({"path": [f"{pack}.zip"], "content": [_zip([*kept, ("more.zip", inner[: len(inner) // 2] if pack % 4 == 3 else inner)])]})


@book.query(f"""
WITH d AS (SELECT doc_id // {PACKED} AS pack, doc_id % 3 = 0 AS nested, source || '/' || doc_id || '.txt' AS name, coalesce(text, '') AS t FROM documents)
SELECT pack::VARCHAR AS archive, CASE WHEN nested THEN 'more__extrait/' ELSE '' END || name AS path, sha256(t) AS digest, false AS failed FROM d WHERE NOT nested OR pack % 4 <> 3
UNION ALL SELECT pack::VARCHAR, 'more.zip', NULL, pack % 4 = 3 FROM d GROUP BY pack""")
def archived_texts(spark, sf_dir):
    """Texts packed into archives, damaged nested ones among them, and unpacked again."""
    root = new_folder(spark, "packed")
    docs = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {PACKED}").alias("pack"), "doc_id", "source", "text")
    packs = docs.groupBy("pack").applyInPandas(_pack, "path string, content binary")
    made = written_files(packs, root, "path", "content").where("error IS NULL").select(F.concat(F.lit(f"{root}/"), "path").alias("path"))
    found = archive_files(made)
    digest = F.when(F.col("path") != "more.zip", F.sha2("content", 256))
    return found.select(F.regexp_extract("archive", "([0-9]+)[.]zip$", 1).alias("archive"), "path", digest.alias("digest"), F.col("error").isNotNull().alias("failed"))


@book.query("""
WITH n AS (SELECT doc_id, text, lang || CASE WHEN doc_id % 5 = 0 THEN '/LOT ' || (doc_id % 2) ELSE '' END AS folder, 'note' || (doc_id % 50) || '.txt' AS name FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) AS k FROM n)
SELECT doc_id, 'sorted/' || folder || '/' || CASE WHEN k = 1 THEN name ELSE replace(name, '.txt', '-' || k || '.txt') END AS target_path, doc_id % 17 = 0 AS failed, CASE WHEN doc_id % 17 <> 0 THEN sha256(coalesce(text, '')) END AS digest FROM r""")
def sorted_copies(spark, sf_dir):
    """Texts written as files, some missing, and copied to their places by category and lot; their digests are taken while they are copied."""
    root, target = new_folder(spark, "originals"), new_folder(spark, "copies")
    docs = table(spark, sf_dir, "documents").withColumn("source_path", F.concat(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"), F.col("doc_id").cast("string")))
    written_files(docs.where("doc_id % 17 <> 0").select("source_path", "text"), root, "source_path", "text")
    lot = F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 2).cast("string"))
    named = docs.select("doc_id", "source_path", F.col("lang").alias("category"), lot.alias("lot"), F.format_string("note%d.txt", F.col("doc_id") % 50).alias("name"), F.lit("sorted").alias("dossier"))
    plan = reports.reorganisation(named, "dossier", "doc_id").select("doc_id", "source_path", "target_path")
    done = rebuilt_copy(plan, root, target)
    return done.select("doc_id", "target_path", F.col("error").isNotNull().alias("failed"), F.col("sha256").alias("digest"))
