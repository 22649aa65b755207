"""Files that tasks read and write on any store that Arrow opens: rows out as files, and a planned copy of a folder.

A file is written under a name of its own and then moved into place, so a task that is lost or run twice leaves either the
whole file or none, and both runs leave the same one. Contents pass in pieces of a mebibyte.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.sources.shared import new_folder

PIECE = 1 << 20
MADE = ["n_bytes", "sha256", "error"]


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    local = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&")) if "://" in local else (fs.LocalFileSystem(), local)


def put(path: str, pieces: Iterator[bytes]) -> tuple[int, str]:
    """Writes the pieces as the file ``path``, in place of any file there; the number of bytes and their SHA-256."""
    system, at = store(path)
    folder, _, name = at.rpartition("/")
    system.create_dir(folder, recursive=True)
    part, size, digest = f"{folder}/.part-{uuid.uuid4().hex}", 0, hashlib.sha256()
    try:
        with system.open_output_stream(part) as out:
            for piece in pieces:
                out.write(piece)
                size += len(piece)
                digest.update(piece)
        system.move(part, f"{folder}/{name}")
    except OSError:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)
        raise
    return size, digest.hexdigest()


def pieces(file) -> Iterator[bytes]:
    while piece := file.read(PIECE):
        yield piece


def _copy(source: str, target: str) -> tuple[int, str]:
    system, at = store(source)
    with system.open_input_stream(at) as f:
        return put(target, pieces(f))


def _outcomes(df: DataFrame, name: str, act) -> DataFrame:
    """df with n_bytes, sha256 and error of ``act`` on each of its rows (two strings or binaries), done once and written down."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for one, two in zip(frame._one, frame._two, strict=True):
                try:
                    done.append((*act(one, two), None))
                except (OSError, ValueError) as e:  # a row's file, not the job
                    done.append((None, None, f"{type(e).__name__}: {e}"[:500]))
            frame[MADE] = pd.DataFrame(done, columns=MADE, index=frame.index).astype({"n_bytes": "Int64"})
            yield frame.drop(columns=["_one", "_two"])

    kept = [f for f in df.schema if f.name not in ("_one", "_two")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_bytes long", "sha256 string", "error string"])
    path = new_folder(df.sparkSession, name)
    df.mapInPandas(run, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def written_files(rows: DataFrame, root: str, path: str, content: str) -> DataFrame:
    """Writes each row's content (string or binary; null: none) as a file below root and returns the other columns with
    n_bytes, sha256 and error. A path must stay below root; of rows with one path any one's file stays."""

    def act(at: str, data: bytes | None) -> tuple[int, str]:
        if not at or ".." in at.split("/"):
            raise ValueError("no path below the root")
        return put(f"{root}/{at}", iter([bytes(data or b"")]))

    named = rows.withColumns({"_one": F.col(path), "_two": F.col(content).cast("binary")}).drop(content)
    return _outcomes(named, "written-files", act)


def rebuilt_copy(plan: DataFrame, source_root: str, target_root: str, *, source: str = "source_path", target: str = "target_path") -> DataFrame:
    """Builds target_root anew from a plan of relative paths and returns the plan with n_bytes, sha256 and error of
    what was copied.

    Tasks copy into a folder beside the target, which then takes the target's place: the earlier copy stays until the new
    one is whole, nothing of it is left afterwards, and a rerun gives the same tree. A source that is missing, or a target
    that cannot be written, is a row with its error.
    """
    fresh = f"{target_root.rstrip('/')}.next-{uuid.uuid4().hex}"

    def act(one: str, two: str) -> tuple[int, str]:
        if not one or not two or ".." in one.split("/") or ".." in two.split("/"):
            raise ValueError("no path below the root")
        return _copy(f"{source_root}/{one}", f"{fresh}/{two}")

    found = _outcomes(plan.withColumns({"_one": F.col(source), "_two": F.col(target)}), "copied-files", act)
    system, at = store(fresh)
    system.create_dir(at, recursive=True)  # an empty plan leaves an empty folder
    place = store(target_root.rstrip("/"))[1]
    if system.get_file_info(place).type != fs.FileType.NotFound:
        old = f"{place}.old-{uuid.uuid4().hex}"
        system.move(place, old)
        system.move(at, place)
        system.delete_dir(old)
    else:
        system.move(at, place)
    return found
