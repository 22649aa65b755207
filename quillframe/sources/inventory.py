"""File inventory: one row per file of a tree, from Spark's binary reader."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.text import extension

#: Fixed extension groups.
DEMATERIALISED = [".cle", ".cry", ".iv", ".pli", ".xml", ".pde", ".pdp"]
IMAGES = [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".gif", ".webp"]
SHEETS = [".xlsx", ".xls", ".csv"]
DRAWINGS = [".dwg", ".dxf"]
NOISE = [".db", ".ini", ".ds_store"]


def classify_extension(ext: Column) -> Column:
    """struct(kind, analyzable, reason, at_risk) of a lower-case extension. Unknown and missing extensions are at risk,
    known noise is not."""
    ext = F.lower(F.coalesce(ext, F.lit("")))

    def made(kind, analyzable, reason=None, at_risk=False):
        return F.struct(F.lit(kind).alias("kind"), F.lit(analyzable).alias("analyzable"), F.lit(reason).cast("string").alias("reason"), F.lit(at_risk).alias("at_risk"))

    out = F.when(ext.isin(*DEMATERIALISED), made("dematerialised", False, "dematerialised deposit"))
    for kind in ("pdf", "docx", "doc"):
        out = out.when(ext == f".{kind}", made(kind, True))
    out = out.when(ext.isin(*IMAGES), made("image", True)).when(ext.isin(*SHEETS), made("spreadsheet", True)).when(ext == ".zip", made("archive", False))
    out = out.when(ext.isin(*DRAWINGS), made("other", False, "drawing")).when(ext.isin(*NOISE), made("other", False, "system file"))
    return out.when(ext == "", made("other", False, "unknown extension", True)).otherwise(made("other", False, "unsupported extension", True))


def hidden(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of the files below root that Spark's reader does not see. The driver lists names; contents are
    read in tasks, a mebibyte at a time."""
    remote = "://" in root
    store, at = fs.FileSystem.from_uri(root) if remote else (fs.LocalFileSystem(), root.rstrip("/"))
    listed = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    unseen = lambda path: any(p[:1] == "." or p[:1] == "_" and "=" not in p for p in path[len(at) :].split("/"))
    names = [(f.path, f.size) for f in listed if f.is_file and unseen(f.path)]

    def read(frames):
        for frame in frames:
            out = []
            for path in frame.path:
                digest = hashlib.sha256()
                with (fs.FileSystem.from_uri(root)[0] if remote else fs.LocalFileSystem()).open_input_stream(path) as f:
                    while part := f.read(1 << 20):
                        digest.update(part)
                out.append(digest.hexdigest())
            yield pd.DataFrame({"path": frame.path, "length": frame.length, "sha256": out})

    found = spark.createDataFrame(names, "path string, length long")
    prefix = root[: root.index(at)] if remote and at in root else ""
    return found.mapInPandas(read, "path string, length long, sha256 string").withColumn("path", F.concat(F.lit(prefix), "path"))


def inventory(spark: SparkSession, root: str, *, plan_names: str | None = None) -> DataFrame:
    """(relative_path, filename, extension, size_bytes, sha256, kind, analyzable, reason, at_risk, parent_archive).

    Names that start with a dot or an underscore, which Spark's reader leaves out, are listed and read beside it. A file
    below <name>__extrait belongs to the archive <name>.zip beside that folder, if it exists; the shallowest one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.sha2("content", 256).alias("sha256"))
    files = files.unionByName(hidden(spark, root))
    base = F.regexp_replace("path", r"^file:/+", "/")
    rows = files.select(F.substring(base, F.lit(len(root.rstrip("/")) + 2), F.length(base)).alias("relative_path"), F.col("length").alias("size_bytes"), "sha256")
    name = F.element_at(F.split("relative_path", "/"), -1)
    found = rows.withColumn("filename", name).withColumn("extension", extension(name)).withColumn("c", classify_extension(extension(name)))
    junk = F.startswith("filename", F.lit("._")) | (F.lower("filename") == ".ds_store")
    plan = F.regexp_like("filename", F.lit(plan_names)) & F.col("c.kind").isin("pdf", "image") if plan_names else F.lit(False)
    reason = F.when(junk, "system metadata").when(plan, "plan by name").otherwise(F.col("c.reason"))
    parts = F.split("relative_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    owner = F.transform(F.filter(folders, lambda d: F.endswith(d, F.lit("__extrait"))), lambda d: F.concat(F.regexp_replace(d, "__extrait$", ""), F.lit(".zip")))
    owners = found.select("relative_path", F.posexplode(owner).alias("depth", "archive"))
    archives = rows.select(F.col("relative_path").alias("archive"))
    parents = owners.join(archives, "archive").groupBy("relative_path").agg(F.min_by("archive", "depth").alias("parent_archive"))
    return found.join(parents, "relative_path", "left").select("relative_path", "filename", "extension", "size_bytes", "sha256", F.col("c.kind").alias("kind"), (F.col("c.analyzable") & ~junk & ~plan).alias("analyzable"), reason.alias("reason"), (F.col("c.at_risk") & ~junk).alias("at_risk"), "parent_archive")
