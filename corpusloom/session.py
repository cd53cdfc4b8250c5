"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: tempfile.TemporaryDirectory | None = None


def _shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a temporary one in local mode only."""
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="corpusloom-", ignore_cleanup_errors=True)
    return _own_folder.name


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a run: from here on the session's intermediate tables go below it, so that a caller can
    drop all of them at once, by `drop_folder`, when the results have been written elsewhere."""
    path = scratch_path(spark, name)
    spark.conf.set("corpusloom.run.folder", path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, on whichever file system it is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if spark.conf.get("corpusloom.run.folder", None) == path:
        spark.conf.unset("corpusloom.run.folder")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the run's folder, or below the shared one."""
    root = spark.conf.get("corpusloom.run.folder", None) or _shared_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write `df` once to the shared folder and read it from there.

    Several passes then read the same rows, also after an executor is lost; being Parquet, each pass reads only the
    columns it needs, and the planner knows the size. `options` are the writer's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote, once nothing will read it any more."""
    files = df.inputFiles()
    if files:
        drop_folder(df.sparkSession, files[0].rsplit("/", 1)[0])
