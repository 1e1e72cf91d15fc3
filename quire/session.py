"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of the engine wants; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quire")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; on a single machine one of our own where it is unset. Raises ValueError on a cluster without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"quire-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before us
        pass


def written(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """`df` written as a table in the shared folder and read again: the lineage ends there and a lost executor costs nothing.

    The table is removed when the process ends, or by `dropped`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quire_path = path
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Remove tables of `written` that nothing reads any more; anything else is left alone."""
    for df in tables:
        if path := getattr(df, "_quire_path", None):
            _remove(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the session's workers, once, so that they can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quire-")
    path = os.path.join(folder, "quire-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for base, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)
    context._quire_shipped = True
