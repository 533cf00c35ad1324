"""Admission and integrity audits over file tables (path or name, content bytes) and over real files of any size."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cutline.session import written
from cutline.sources.file_heads import local_path, open_file

# --- fixed values: accepted extension -> MIME type and leading bytes ----------------------
EXTENSION_MIME = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
}
LEADING_HEX = {
    "application/pdf": "255044462D",
    "image/png": "89504E470D0A1A0A",
    "image/jpeg": "FFD8FF",
}
NAME_LENGTH_MAX = 255
HEAD_LENGTH = 12
PIECE = 1 << 20
LISTED_AT_ONCE = 10_000


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def safe_name(name: Column) -> Column:
    """Last path component, unprintable characters replaced; NULL when unusable."""
    tidy = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"[\x00-\x1f\x7f]", "_")
    tidy = F.regexp_replace(tidy, "/+$", "")
    last = F.trim(F.element_at(F.split(tidy, "/"), -1))
    return F.when((F.length(last) > 0) & (F.length(last) <= NAME_LENGTH_MAX), last)


def audit_uploads(files: DataFrame, max_bytes: int) -> DataFrame:
    """(name, content, declared_type) rows -> safe name, MIME type, status, reason. Only the first 12
    bytes are looked at as text."""
    facts = files.withColumns({"__head": F.substring("content", 1, HEAD_LENGTH), "__size": F.length("content")}).drop("content")
    return _audited(facts, F.col("__head"), F.col("__size"), max_bytes).drop("__head", "__size")


def audit_files(files: DataFrame, max_bytes: int) -> DataFrame:
    """The same over ``file_facts`` rows with columns name and declared_type added."""
    return _audited(files, F.col("head"), F.col("length"), max_bytes)


def _audited(files: DataFrame, first_bytes: Column, size: Column, max_bytes: int) -> DataFrame:
    """Checks in order: name, emptiness, size, extension, declared type, leading bytes."""
    head = F.hex(first_bytes)
    name = safe_name(F.col("name"))
    extension = F.lower(F.regexp_extract(F.col("safe_name"), r"[^.](\.[^.]+)$", 1))
    expected = None
    for ext, mime in EXTENSION_MIME.items():
        hit = extension == ext
        expected = F.when(hit, mime) if expected is None else expected.when(hit, mime)
    declared = F.lower(F.trim(F.element_at(F.split(F.coalesce("declared_type", F.lit("")), ";"), 1)))
    mime = F.col("mime_type")
    magic = (head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250") & (mime == "image/webp"))
    for m, lead in LEADING_HEX.items():
        magic = magic | ((mime == m) & head.startswith(lead))
    reason = (
        F.when(F.col("safe_name").isNull(), "invalid_name").when(size.isNull() | (size == 0), "empty")
        .when(size > max_bytes, "too_large").when(mime.isNull(), "unsupported_extension")
        .when(F.col("declared") != mime, "declared_type_mismatch").when(~magic, "signature_mismatch")
    )
    return (
        files.withColumn("safe_name", name).withColumns({"mime_type": expected, "declared": declared})
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
        .drop("declared")
    )


def _facts(path: str) -> tuple[int | None, bytes | None, str | None]:
    digest, length, head = hashlib.sha256(), 0, b""
    try:
        with open_file(path) as stream:
            while piece := stream.read(PIECE):
                head = head or piece[:HEAD_LENGTH]
                length += len(piece)
                digest.update(piece)
    except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
        return None, None, None
    return length, head, digest.hexdigest()


def _read_facts(batches: Iterator) -> Iterator:
    for rows in batches:
        found = [_facts(p) for p in rows["path"]]
        yield rows[["path"]].assign(
            length=[n for n, _, _ in found], head=[h for _, h, _ in found], actual_sha256=[d for _, _, d in found]).astype({"length": "Int64"})


def file_facts(paths: DataFrame) -> DataFrame:
    """(path, length, head, actual_sha256) of every distinct path: files are spread over tasks and read in pieces of
    1 MB with a running digest, so a file may be larger than memory (or than the 2 GB a binary cell
    holds). A path without a file has NULLs, an empty file has length 0."""
    return paths.select("path").where(F.col("path").isNotNull()).distinct().repartition("path").mapInPandas(
        _read_facts, "path string, length bigint, head binary, actual_sha256 string")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    begins = (name.startswith("_") and "=" not in name) or name.startswith(".")
    return (begins and not name.startswith(("_common_metadata", "_metadata"))) or name.endswith("._COPYING_")


def _children(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, is it a folder) of the folders and the files with content right below ``folder``; a local folder is read as it comes."""
    if local := local_path(folder):
        with os.scandir(local) as entries:
            for e in entries:
                if not _hidden(e.name) and (e.is_dir() or e.stat().st_size):
                    yield f"{folder}/{e.name}", e.is_dir()
        return
    from pyarrow.fs import FileSelector, FileSystem, FileType

    system, inner = FileSystem.from_uri(re.sub("^s3a:", "s3:", folder))
    for e in system.get_file_info(FileSelector(inner)):
        if not _hidden(e.base_name) and (e.type == FileType.Directory or e.size):
            yield f"{folder}/{e.base_name}", e.type == FileType.Directory


def _list(batches: Iterator) -> Iterator:
    import pandas as pd

    for rows in batches:
        for folder in rows["path"]:
            entries = _children(folder)
            while some := list(islice(entries, LISTED_AT_ONCE)):
                yield pd.DataFrame(some, columns=["path", "folder"])


def _root(folder: str) -> str:
    root = folder.rstrip("/") if ":" in folder.split("/")[0] else f"file:{folder.rstrip('/')}"
    return re.sub("^file:/+", "file:/", root)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all files below ``folder`` but empty and hidden ones; no file is opened. Tasks list folders, a level at a
    time, and paths go to a stored table: nothing of them reaches the driver."""
    folders, out = spark.createDataFrame([(_root(folder),)], "path string"), None
    while True:
        found = written(folders.repartition("path").mapInPandas(_list, "path string, folder boolean"), "listing")
        files, folders = found.where("not folder").select("path"), found.where("folder").select("path")
        out = files if out is None else out.unionByName(files)
        if folders.isEmpty():
            return out


def audit_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Manifest (name, sha256) against the real files of ``folder``: ok, mismatch, missing, unlisted."""
    root = _root(folder)
    wanted = manifest.select(F.concat(F.lit(f"{root}/"), "name").alias("path"), F.lower("sha256").alias("expected_sha256"))
    facts = file_facts(wanted.select("path").unionByName(listed(spark, folder)))
    both = facts.join(wanted, "path", "left")
    return both.withColumns({"status": _integrity(), "name": F.substr("path", F.lit(len(root) + 2))})


def _write_rows(folder: str):
    def run(batches: Iterator) -> Iterator:
        from pyarrow.fs import FileSystem, LocalFileSystem

        local = local_path(folder)
        system, root = (LocalFileSystem(), local) if local else FileSystem.from_uri(re.sub("^s3a:", "s3:", folder))
        system.create_dir(root, recursive=True)
        for rows in batches:
            for name, content in zip(rows["name"], rows["content"]):
                # a task that runs twice leaves one whole file
                part = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{root}/{name}")
            yield rows[["name"]]
    return run


def write_files(files: DataFrame, folder: str) -> int:
    """One file per (name, content) row, written by the tasks into a folder of an openable scheme that
    all of them share; returns their number. Names are plain file names."""
    return files.select("name", "content").mapInPandas(_write_rows(folder), "name string").count()


def audit_integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest (path, sha256) against files (path, content): ok, mismatch, missing, unlisted."""
    actual = files.select("path", F.sha2("content", 256).alias("actual_sha256"))
    wanted = manifest.select("path", F.lower("sha256").alias("expected_sha256"))
    both = actual.join(wanted, "path", "full_outer")
    return both.withColumn("status", _integrity())


def _integrity() -> Column:
    a, e = F.col("actual_sha256"), F.col("expected_sha256")
    return F.when(a.isNull(), "missing").when(e.isNull(), "unlisted").when(a == e, "ok").otherwise("mismatch")
