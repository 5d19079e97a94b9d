"""What a job shares between driver and executors: the folder that lineage is cut in, and this package itself."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is named, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='eventloom-')}")
    return path.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once an application, so that they need no install of their own."""
    app, root = spark.sparkContext.applicationId, Path(__file__).parent
    if app in _SHIPPED or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="eventloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(app)


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/eventloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes what this application has written there; its results that still read from it must be written before."""
    fs, path = filesystem(spark, work_dir(spark))
    fs.delete(path, True)


def filesystem(spark: SparkSession, folder: str):
    """The file system of a path in any store that Spark reads, and the path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. A lost executor can't take these rows away.

    Most such tables are small beside their source, so that two files a core, or one for eight shuffle partitions if that
    is more, are written at most. wide: as many as there are partitions, for tables that follow the corpus and work that is
    heavy itself, such as reading whole texts.
    """
    if not wide:
        spark = df.sparkSession
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
