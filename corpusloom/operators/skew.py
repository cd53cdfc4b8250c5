"""Joins whose keys may be held by a large part of all rows."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than one in SHARE rows, and more than LEAST, is dealt out; the sketch that finds such keys follows
# TRACKED of them.
SHARE = 512
LEAST = 64
TRACKED = 4096


def frequent_keys(df: DataFrame, on: list[str], share: int = SHARE) -> dict[int, int]:
    """{hash of key: pieces} of the keys that hold more than one in `share` rows (and `LEAST`), at most `share` of them.

    Found by a sketch of frequent items: one pass, a sketch of fixed size per task, merged without a shuffle of the
    keys. A key of n rows gets as many pieces as leave about rows / share in each. Runs one job.
    """
    hashed = df.select(F.xxhash64(*on).alias("h"))
    found = hashed.agg(F.expr(f"approx_top_k(h, {share}, {max(TRACKED, 4 * share)})").alias("top"), F.count(F.lit(1)).alias("n"))
    row = found.first()
    piece = max(row["n"] / share, LEAST)
    return {r["item"]: ceil(r["count"] / piece) for r in row["top"] or [] if r["count"] > piece}


def join_hot(
    many: DataFrame, few: DataFrame, on: list[str], spread: list[str], how: str = "inner", null_safe: bool = False, share: int = SHARE
) -> DataFrame:
    """`many.join(few, on, how)` for keys of which a few may hold most rows of `many`; `few` has about one row per key.

    The rows of a frequent key are dealt over pieces by the hash of the columns `spread`, the row of `few` stands once
    in each piece, and key and piece are joined; all other keys are joined as ever. So no task gets more than a small
    share of `many`, whether or not a side is broadcast. how: inner, left, left_semi or left_anti. With `null_safe` a null
    key equals a null key. `many` is read twice; building the result runs one job.
    """
    hot = frequent_keys(many, on, share)
    names = {c: f"__few_{c}" for c in on}
    few = few.withColumnsRenamed(names)
    equal: list[Column] = [F.col(c).eqNullSafe(F.col(n)) if null_safe else F.col(c) == F.col(n) for c, n in names.items()]
    if hot:
        # At most `share` rows.
        pieces = F.broadcast(many.sparkSession.createDataFrame(list(hot.items()), "__hash long, __pieces int"))
        many = many.withColumn("__hash", F.xxhash64(*on)).join(pieces, "__hash", "left").withColumn(
            "__piece", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__pieces")), F.lit(0).cast("long"))
        ).drop("__hash", "__pieces")
        few = few.withColumn("__hash", F.xxhash64(*names.values())).join(pieces, "__hash", "left").withColumn(
            "__few_piece", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("__pieces", F.lit(1)) - 1).cast("long")))
        ).drop("__hash", "__pieces")
        equal.append(F.col("__piece") == F.col("__few_piece"))
    joined = many.join(few, reduce(lambda a, b: a & b, equal), how)
    return joined.drop(*names.values(), "__piece", "__few_piece")
