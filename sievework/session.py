"""Session settings and durable staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are designed around.  ``forceOptimizeSkewedJoin`` lets
#: AQE split a hot join key even when that costs one more exchange.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "sievework", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **RECOMMENDED,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; in local mode, one of our own if unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has used yet, in this application's own part of the shared folder.

    Whoever owns the shared folder clears ``sievework/<application id>`` after the run.
    """
    run = spark.sparkContext.applicationId
    return os.path.join(shared_dir(spark), "sievework", run, f"{label}-{uuid.uuid4().hex}")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Functions that run in workers are pickled by reference, so a worker must be able to
    import the package whatever folder the driver was started in.
    """
    context = spark.sparkContext
    if getattr(context, "_sievework_shipped", False):
        return
    package = Path(__file__).resolve().parent
    # The driver serves the archive to executors from here as long as the context lives.
    folder = os.path.join(SparkFiles.getRootDirectory(), "shipped")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, "sievework.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._sievework_shipped = True


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage, survives the loss of executors, prunes columns on every later
    read, and gives the planner real sizes: a later join broadcasts the table only
    if its files are under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
    it otherwise.  ``compression`` is Parquet's, the session's if not given.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
