"""Archive expansion: zip members, nested to a bounded depth, as rows of (archive, path, size_bytes, content, file, error).

Archives are opened where they lie; the binary reader's content is not read. A round opens the archives of one level: their
directories are read, charged to the root's budget, and the members dealt to tasks by ranges of their bytes, so a large
archive is the work of many tasks. The number of tasks follows the archives and the members' bytes, not the bytes of the
rows that name them. A task holds one member of at most INLINE bytes and a batch of as many; a larger member is streamed
into a file of the shared folder and named in ``file``, and so is a nested archive, which the next round opens. Members wait
in a written table until their archive is known to be whole.

An unreadable or over-budget archive stays a plain file with an error and has no members. Directory entries and members
that would leave their folder are skipped; of members with one name the last one stays. A root's budget is charged level by
level, within a level by path; an archive that does not fit is passed over, and a later one may still fit.
"""

from __future__ import annotations

import hashlib
import re
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.sources.files import pieces, put, store
from quillframe.sources.shared import new_folder, tasks

MOST_BYTES, DEPTH = 2 << 30, 8
#: Bytes of a member up to which it travels as a value, bytes of members in a task's range, and directory rows in a batch.
INLINE, RANGE, ROWS = 32 << 20, 64 << 20, 10_000
#: Directories that a task reads, and bytes that it unpacks, about; a member counts as so many bytes besides its own.
DIRECTORIES, UNPACKED, OPENING = 100, 16 << 20, 4 << 10
#: What a damaged, encrypted or unsupported archive raises, from its directory or from a member's stream.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError)
#: Fixed: box-drawing, block and replacement characters never stand in a real file name.
BROKEN = re.compile("[─-▟�]")


def member_name(info: zipfile.ZipInfo) -> str:
    """The member's name; without the UTF-8 flag its bytes are read as cp850, cp1252, UTF-8 or Latin-1, the first that
    gives no broken characters."""
    if info.flag_bits & 0x800:
        return info.filename
    raw, first = info.filename.encode("cp437", "replace"), None
    for encoding in ("cp850", "cp1252", "utf-8", "latin-1"):
        try:
            name = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        first = first or name
        if not BROKEN.search(name):
            return name
    return first or info.filename


def _safe(name: str) -> str | None:
    path = PurePosixPath(name.replace("\\", "/"))
    return None if path.is_absolute() or ".." in path.parts or not path.parts else str(path)


OPENED = "archive string, owner string, at string"
LISTED = f"{OPENED}, total long, error string, place int, path string, size_bytes long, part long"
FOUND = "archive string, owner string, path string, size_bytes long, content binary, file string, error string"


def _directory(span: int):
    """The members of each archive, with the range they fall into; one row without a member for the archive itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for frame in frames:
            for row in frame.itertuples(index=False):
                try:
                    system, path = store(row.at)
                    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        infos = z.infolist()
                except UNREADABLE as e:
                    rows.append((*row, None, f"{type(e).__name__}: {e}"[:500], None, None, None, None))
                    continue
                last = {p: i for i, m in enumerate(infos) if not m.is_dir() and (p := _safe(member_name(m)))}
                rows.append((*row, sum(m.file_size for m in infos), None, None, None, None, None))
                ahead = 0
                for path, i in sorted(last.items(), key=lambda x: x[1]):
                    rows.append((*row, None, None, i, path, infos[i].file_size, ahead // span))
                    ahead += infos[i].file_size
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=_names(LISTED))
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_names(LISTED))

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _charge(budget: int):
    """(archive, owner, charged, error) of archives sorted by archive and owner: what is left is all that is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, left = None, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.archive != root:
                    root, left = row.archive, budget - int(row.spent)
                fits = row.total <= left
                left -= int(row.total) if fits else 0
                out.append((row.archive, row.owner, int(row.total) if fits else 0, None if fits else "over the size budget"))
            yield pd.DataFrame(out, columns=["archive", "owner", "charged", "error"])

    return run


def _member(at: zipfile.ZipFile, row, folder: str, nests: bool, inline: int) -> tuple:
    """(content, file) of a member: large ones and nested archives are streamed into a file named by what they are."""
    info, large = at.infolist()[row.place], row.size_bytes > inline
    file = None
    if large or nests:
        file = f"{folder}/{hashlib.sha256(f'{row.archive}:{row.owner}:{row.path}'.encode()).hexdigest()}"
        with at.open(info) as f:
            put(file, pieces(f))
    return (None if large else at.read(info)), file


def _extract(folder: str, nests: bool, inline: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_at, file, z = None, None, None
        rows, held = [], 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                full = f"{row.owner[:-4]}__extrait/{row.path}" if row.owner else row.path
                try:
                    if row.at != open_at:
                        open_at, z = None, None
                        if file is not None:
                            file.close()
                        system, path = store(row.at)
                        file = system.open_input_file(path)
                        z, open_at = zipfile.ZipFile(file), row.at
                    content, kept = _member(z, row, folder, nests and row.path.lower().endswith(".zip"), inline)
                    rows.append((row.archive, row.owner, full, row.size_bytes, content, kept, None))
                    held += len(content or b"")
                except UNREADABLE as e:
                    rows.append((row.archive, row.owner, full, row.size_bytes, None, None, f"{type(e).__name__}: {e}"[:500]))
                if held >= inline or len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=_names(FOUND))
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_names(FOUND))
        if file is not None:
            file.close()

    return run


def archive_files(archives: DataFrame, budget: int = MOST_BYTES, depth: int = DEPTH, *, inline: int = INLINE, span: int = RANGE) -> DataFrame:
    """(archive, path, size_bytes, content, file, error) of every file below the archives, which are rows with a path; one
    row without a path for an archive that cannot be opened. A null path is no archive; a repeated one is opened once."""
    spark = archives.sparkSession
    folder = new_folder(spark, "archives")

    def written(df: DataFrame, name: str, level: int) -> DataFrame:
        df.write.parquet(f"{folder}/{name}-{level}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}-{level}")

    opened = archives.select(F.col("path").alias("archive"), F.lit("").alias("owner"), F.col("path").alias("at")).where("path IS NOT NULL").distinct()
    spent, whole, refused = None, [], []
    for level in range(depth + 1):  # at most nine rounds
        opened = written(opened, "opened", level)
        n = opened.count()
        if level and not n:
            break
        listed = written(opened.repartition(tasks(spark, n, n, DIRECTORIES), "at").mapInPandas(_directory(span), LISTED), "listed", level)
        tops = listed.where("place IS NULL")
        asked = tops.where("error IS NULL").select("archive", "owner", "total")
        asked = asked.withColumn("spent", F.lit(0).cast("long")) if spent is None else asked.join(spent, "archive", "left").na.fill(0, ["spent"])
        charged = asked.repartition("archive").sortWithinPartitions("archive", "owner")
        charged = written(charged.mapInPandas(_charge(budget), "archive string, owner string, charged long, error string"), "charged", level)
        members = listed.where("place IS NOT NULL").join(charged.where("error IS NULL").select("archive", "owner"), ["archive", "owner"])
        n, held = members.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
        dealt = members.repartition(tasks(spark, n, held + n * OPENING, UNPACKED), "at", "part").sortWithinPartitions("at", "place").select(*_names(LISTED))
        found = written(dealt.mapInPandas(_extract(f"{folder}/files", level < depth, inline), FOUND), "found", level)
        damaged = found.where("error IS NOT NULL").groupBy("archive", "owner").agg(F.min_by("error", "path").alias("error"))
        bad = tops.where("error IS NOT NULL").select("archive", "owner", "error").unionByName(charged.where("error IS NOT NULL").drop("charged")).unionByName(damaged)
        refused.append(written(bad, "refused", level))
        whole.append(found.join(refused[-1].select("archive", "owner"), ["archive", "owner"], "left_anti").drop("owner", "error"))
        opened = whole[-1].where(F.lit(level < depth) & F.lower("path").endswith(".zip")).select("archive", F.col("path").alias("owner"), F.col("file").alias("at"))
        costs = charged.groupBy("archive").agg(F.sum("charged").alias("spent"))
        spent = costs if spent is None else spent.unionByName(costs).groupBy("archive").agg(F.sum("spent").alias("spent"))
    rows, failed = whole[0], refused[0]
    for more, bad in zip(whole[1:], refused[1:], strict=True):
        rows, failed = rows.unionByName(more), failed.unionByName(bad)
    nested = failed.where("owner <> ''").withColumnRenamed("owner", "path")
    roots = failed.where("owner = ''").select("archive", *(F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("size_bytes", "long"), ("content", "binary"), ("file", "string"))), "error")
    return rows.join(nested, ["archive", "path"], "left").unionByName(roots)
