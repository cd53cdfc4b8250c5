"""Proportional stratified interleaving: every shard gets the mixture of the whole table.

Rows are shuffled within their stratum by a seeded hash and ranked; the rank divided by the stratum's size places a
row between 0 and 1. Sorted by this fraction, the strata run through the table in proportion, so equal cuts hold the
same mixture. Only DataFrame functions; two range sorts of narrow rows, no window over a stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.alignment import renumber
from corpusloom.session import materialise


def seeded_order(key: Column | str, seed: str) -> Column:
    """Hex digest that shuffles rows by seed and key; a null key counts as an empty one."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def interleave(df: DataFrame, shards: int, strata: Column | str, key: Column | str, payload: dict[str, Column], seed: str = "0") -> DataFrame:
    """The payload columns of every row, with `shard` (0 … shards-1) and `slot` (gapless from 0 in each shard).

    Row counts of two shards differ by one at most, and for each stratum a shard's share differs from the whole table's
    by rounding only. A null stratum is a stratum of its own. Rows that repeat key and stratum are told apart by the
    payload, wholly equal ones are interchangeable. An empty table gives an empty result; with fewer rows than shards
    some shards stay empty. Other columns of `df` are not read, so their names cannot clash.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    strata = F.col(strata) if isinstance(strata, str) else strata
    key = F.col(key) if isinstance(key, str) else key
    names = list(payload)
    narrow = df.select(
        F.struct(*[c.alias(n) for n, c in payload.items()]).alias("__payload"), strata.alias("__stratum"),
        key.alias("__key"), seeded_order(key, seed).alias("__shuffle"),
    )
    # Written once: the two sorts and the counts then read a few dozen bytes a row, not the texts.
    narrow = materialise(narrow, "shards")
    ties = ["__key", "__payload"]
    ranked = renumber(narrow, ["__stratum", "__shuffle", *ties], "__at")
    strata_sizes = ranked.groupBy(F.col("__stratum").alias("__s")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size")
    )
    spread = ranked.join(strata_sizes, F.col("__stratum").eqNullSafe(F.col("__s"))).select(
        "__payload", "__stratum", "__key",
        ((F.col("__at") - F.col("__first") + F.lit(0.5)) / F.col("__size")).alias("__fraction"),
    )
    rows = narrow.count()
    mixed = renumber(spread, ["__fraction", "__stratum", *ties], "__rank", start=0)
    shard = F.expr(f"(__rank * {shards}) div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return mixed.withColumn("shard", shard.cast("long")).select(
        *[F.col("__payload")[n].alias(n) for n in names], F.col("shard").cast("int").alias("shard"),
        (F.col("__rank") - first).cast("long").alias("slot"),
    )
