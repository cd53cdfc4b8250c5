"""Streams whose micro-batches are run again, and versions that are not finished."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusloom.streaming.batches import batch_stream, read_newest, replace_stream


def arriving(spark, folder, n):
    for i in range(n):
        spark.createDataFrame([(i, f"c{i % 2}")], "id long, code string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id long, code string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_batch_run_again_leaves_one_result(spark, tmp_path):
    stream, fails = arriving(spark, f"{tmp_path}/in", 3), [True]

    def work(batch):
        if fails and batch.where("id = 1").count():
            # The partition is there in part when the run ends.
            batch.write.parquet(f"{tmp_path}/out/batch=1")
            fails.clear()
            raise RuntimeError("lost")
        return batch.select("id", F.upper("code").alias("code"))

    run = lambda: batch_stream(stream, work, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    seen_first = []
    try:
        run()
    except Exception as e:  # noqa: BLE001 - the stream's own error wraps ours
        seen_first.append(str(e))
    assert seen_first and not fails
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").select("id", "code").collect()
    assert sorted(map(tuple, rows)) == [(0, "C0"), (1, "C1"), (2, "C0")]


def test_the_newest_finished_version_counts(spark, tmp_path):
    counts = arriving(spark, f"{tmp_path}/in", 3).groupBy("code").count()
    replace_stream(counts, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "out" / "version=9").mkdir()
    assert sorted(map(tuple, read_newest(spark, f"{tmp_path}/out").collect())) == [("c0", 2), ("c1", 1)]
    with pytest.raises(AnalysisException):
        read_newest(spark, f"{tmp_path}/in")
