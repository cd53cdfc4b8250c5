"""Work per micro-batch, and results that are replaced as a whole: both may be repeated after a failure without a trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_stream(
    df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, available_now: bool = True,
) -> StreamingQuery:
    """Write `work(micro-batch)` as the partition `batch` = its number of the table at `path`.

    For work that takes jobs of its own, such as `fill_missing` and model calls. A micro-batch that is run again overwrites its
    partition, so each row's result stands once. `checkpoint` belongs in shared storage, and to this table alone.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(df, write, checkpoint, "append", available_now)


def replace_stream(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Write the whole result of an aggregation at each micro-batch as a new version below `path`, then note that it is
    finished; `read_newest` reads the last such one."""

    def write(whole: DataFrame, number: int) -> None:
        whole.write.mode("overwrite").parquet(f"{path}/version={number}")
        spark = whole.sparkSession
        spark.range(1).select(F.lit(number).cast("long").alias("version")).write.mode("append").parquet(f"{path}/finished")

    return _start(df, write, checkpoint, "complete", available_now)


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The last version that `replace_stream` has finished; an error where there is none yet."""
    newest = spark.read.schema("version long").parquet(f"{path}/finished").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={newest}")
