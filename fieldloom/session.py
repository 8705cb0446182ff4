"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def get_spark(app: str = "fieldloom", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers of the session, once, wherever and whenever the session was made."""
    context = spark.sparkContext
    path = os.path.join(SparkFiles.getRootDirectory(), f"{os.path.basename(PACKAGE)}-{os.getpid()}.zip")
    if path not in context._python_includes and not os.path.exists(path):
        packed = path + ".part.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(PACKAGE):
                for name in names:
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        out.write(whole, os.path.relpath(whole, os.path.dirname(PACKAGE)))
        os.replace(packed, path)
        context.addPyFile(path)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names.

    Only a local master (tests) may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="fieldloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def reliable(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read on from there: lineage ends, columns stay prunable."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
