"""Session settings used by the tests, the benchmark and local runs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "almanac") -> SparkSession:
    """A local session; on a cluster use the session the cluster hands you instead.

    Its shared folder is ``ALMANAC_SHARED``, else a new temporary one; a local session has one machine.
    """
    shared = os.environ.get("ALMANAC_SHARED") or tempfile.mkdtemp(prefix="almanac-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, also where it is installed on the driver alone.

    The sources go to the executors as one zip file, once per application.  Not needed where the
    package is installed or handed over with ``--py-files``, and harmless there.
    """
    context, folder = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_almanac_shipped", False) or not folder.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="almanac-code-")) / "almanac.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(folder.rglob("*.py")):
            z.write(f, f.relative_to(folder.parent))
    context.addPyFile(str(target))
    context._almanac_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; chosen here only for bare local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="almanac-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/almanac/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a reduced table to the shared folder and read it back.

    Used where a small aggregate of the facts feeds several branches of a plan: the facts are
    scanned once, the table survives the loss of executors, and its size is known to the planner.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
