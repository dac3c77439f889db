"""Session helpers: where intermediate tables go, and what may be broadcast."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of a parameter table that may be broadcast by hint. Larger tables are joined by shuffle.
BROADCAST_ROW_LIMIT = 200_000


def local_session(cpus: str | int = "*", app: str = "sensorloom", folder: str | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own. `folder` holds its intermediate tables."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="sensorloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_roots: dict[str, str] = {}


def spool_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, inside the session's checkpoint folder.

    A session on one machine that names none gets a folder of its own; any other must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    app = spark.sparkContext.applicationId
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="sensorloom-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/run-{app}"


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no DataFrame made from them is needed."""
    _delete(spark, spool_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that does not have it installed."""
    top = pathlib.Path(__file__).resolve().parent
    base = pathlib.Path(tempfile.mkdtemp(prefix="sensorloom-ship-")) / "sensorloom"
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", top.parent, top.name))


def spool(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Fixes values that must not change between two jobs (range-partition numbers), cuts the
    lineage, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{spool_root(spark)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that `spool` made and that nothing reads any more."""
    files = table.inputFiles()
    if files:
        _delete(table.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of each query go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
