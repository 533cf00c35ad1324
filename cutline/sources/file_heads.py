"""Heads of files: the first line of each is read, however long the file is."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

HEAD_BYTES = 4096
# schemes that tasks can open by themselves; files of any other scheme are read as text by Spark
OPENABLE = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def local_path(path: str) -> str | None:
    """The plain path of a local or mounted file, None for other schemes."""
    found = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    return found.group(1) if found else None


def open_file(path: str):
    """A readable binary stream of ``path`` (a plain path or a URI of an openable scheme)."""
    if local := local_path(path):
        return open(local, "rb")
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return system.open_input_stream(inner)


def first_line(path: str, step: int = HEAD_BYTES) -> tuple[str, int]:
    """(first line, bytes read). Reading goes on in steps until a line ends or the file does."""
    got = b""
    with open_file(path) as stream:
        while b"\n" not in got:
            more = stream.read(step)
            if not more:
                break
            got += more
    return got.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r"), len(got)


def _read_heads(batches: Iterator) -> Iterator:
    for rows in batches:
        found = [first_line(p) for p in rows["path"]]
        yield rows[["path"]].assign(header=[h for h, _ in found], bytes_read=[n for _, n in found])


def headers(files: DataFrame) -> DataFrame:
    """(path, header, width, bytes_read) of a table of paths. ``width`` is the number of comma-separated
    names; an empty file has the header '' and width 1. ``bytes_read`` is NULL where Spark read the file."""
    spark, paths = files.sparkSession, files.select("path")
    scheme = F.regexp_extract("path", "^([a-zA-Z0-9]+):", 1)
    ours = scheme.isin("", *OPENABLE)
    schema = "path string, header string, bytes_read bigint"
    # spread by path: the listing itself is one small partition
    found = paths.where(ours).repartition("path").mapInPandas(_read_heads, schema)
    others = [r["path"] for r in paths.where(~ours).collect()]
    if others:
        lines = spark.read.text(others).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
        ).where(F.col("start") == 0).withColumn("n", F.monotonically_increasing_id())
        found = found.unionByName(lines.groupBy("path").agg(
            F.min_by("value", "n").alias("header"), F.lit(None).cast("bigint").alias("bytes_read")))
    return found.select("path", "header", F.size(F.split("header", ",")).cast("bigint").alias("width"), "bytes_read")
