"""What tells rows apart whose keys do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.alignment import renumber
from corpusloom.session import materialise


def told_apart(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """`df` with the long column `name`: 0 where the key, null among them, stands in one row only, else a number of key and
    text, in the order of a digest. It is the same for copies of a repeated row and differs for other texts under the same
    key, in every evaluation. Building it writes the keys of several rows, as a rule few, which the planner may broadcast."""
    several = df.groupBy(F.col(key).alias("__twin")).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    twins = materialise(several.select("__twin"), "twins")
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    pairs = df.join(twins, F.col(key).eqNullSafe(F.col("__twin")), "left_semi").select(F.col(key).alias("__twin"), digest.alias("__text"))
    numbers = materialise(renumber(pairs.distinct(), ["__twin", "__text"], "__number"), "told_apart")
    equal = F.col(key).eqNullSafe(F.col("__twin")) & (digest == F.col("__text"))
    return df.join(numbers, equal, "left").withColumn(name, F.coalesce("__number", F.lit(0).cast("long"))).drop("__twin", "__text", "__number")


def place(key: str, part: str) -> Column:
    """Key and number as one value whose order is that of the keys, a null key last."""
    return F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col(part).alias("part"))


def same(key: str, part: str, other_key: str, other_part: str) -> Column:
    return F.col(key).eqNullSafe(F.col(other_key)) & (F.col(part) == F.col(other_part))
