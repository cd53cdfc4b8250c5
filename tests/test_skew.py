"""Joins with a key in most rows: the same rows as a plain join, in small pieces."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.skew import frequent_keys, join_hot


def tables(spark):
    many = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 900).cast("long").alias("key"),
        F.col("id").alias("row"),
    )
    few = spark.range(0, 950, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value")).unionAll(
        spark.createDataFrame([(7, 70), (None, -1)], "key long, value long")
    )
    return many.repartition(5), few


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_same_rows_as_a_plain_join(spark, how, null_safe):
    many, few = tables(spark)
    right = few.withColumnsRenamed({"key": "k"})
    plain = many.join(right, many["key"].eqNullSafe(right["k"]) if null_safe else many["key"] == right["k"], how).drop("k")
    found = join_hot(many, few, ["key"], ["row"], how, null_safe)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_empty_tables_and_even_keys(spark):
    many, few = tables(spark)
    assert frequent_keys(many.limit(0), ["key"]) == {}
    assert join_hot(many.limit(0), few, ["key"], ["row"]).collect() == []
    assert join_hot(many, few.limit(0), ["key"], ["row"]).collect() == []
    assert frequent_keys(spark.range(5000), ["id"]) == {}


def test_a_hot_key_is_dealt_to_all_tasks(spark):
    many, few = tables(spark)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c in before:
            spark.conf.set(c, "-1" if "Threshold" in c else "false")
        joined = join_hot(many, few, ["key"], ["row"], "left")
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        sizes.sort()
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plain = many.join(few, "key", "left").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
        assert max(r["n"] for r in plain) > 2 * sizes[-1]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
