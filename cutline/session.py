"""Session helpers: sensible defaults for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "cutline", cpus: str | int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    cpus = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Settings the queries profit from, left alone where the session chose its own.

    HotSpot does not compile methods above 8000 bytes of bytecode. Wide text-cleaning stages
    exceed that as one generated method and would run interpreted; with this limit Spark
    evaluates such a stage in smaller compiled pieces (three times faster here).
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Small Arrow batches where the session left them at their defaults, and workers of local sessions that can
    import this package wherever the driver was started (a cluster gets it with ``--py-files`` or installed)."""
    # texts are long: a batch holds a tenth of the rows of the default
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[1])
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves local sessions (tests, bench). Any other master
    has executors on several machines, so a missing setting is an error rather than a guess.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cutline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; all such paths of an application have one parent."""
    return f"{shared_folder(spark)}/cutline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote to the shared folder."""
    parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/cutline-{spark.sparkContext.applicationId}")
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, keeps column
    pruning, and a lost executor costs a re-read only."""
    path, schema = scratch_folder(df.sparkSession, name), df.schema
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(schema).parquet(path).select(*schema.names)
    table.written_to = path
    return table


def broadcast_if_small(df: DataFrame, name: str, limit: int = 16 << 20) -> DataFrame:
    """``df`` stored, and marked for broadcast only if its values as JSON text take at most ``limit`` bytes."""
    table = written(df, name.replace(" ", "-"))
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def delete_written(table: DataFrame) -> None:
    """Delete a table of ``written`` (the very frame it returned) that no later step reads."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's reliable checkpoint folder (see ``shared_folder``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
