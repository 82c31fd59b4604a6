"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def local_session(cpus: int | str = 8, name: str = "panelcast", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; in local mode a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; name a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="panelcast-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder for one written intermediate."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialise(df, label: str):
    """Cut the lineage by a written table in the shared folder, so a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reaches holds `path`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under `path`; none where it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(target) if f.isDirectory()) if store.exists(target) else []


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library has written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(df) -> None:
    """Removes the folder of a frame that `materialise` returned; nothing may read it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)
