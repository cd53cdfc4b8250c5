"""Keyed tables kept in step: numbering, synchronised filtering, lookups, joins and key audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null, coalesce_text, flag_bad, is_blank
from corpusloom.session import materialise


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns are matched by name and absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def renumber(df: DataFrame, order: list[Column | str], num: str = "num", start: int = 1) -> DataFrame:
    """`num` = start, start+1, … in the given order, which must be a key of `df`.

    A range sort spreads the rows; each row takes its place within its range plus the sizes of the ranges before.
    The sorted rows are written first: a second evaluation could cut the ranges elsewhere. Only the list of range
    sizes, one row per task, passes through a single window.
    """
    place = F.monotonically_increasing_id()
    placed = materialise(df.orderBy(*order).withColumn("__place", place), "numbered")
    # The upper bits of the place are the partition, the lower 33 the row within it.
    placed = placed.withColumn("__range", F.shiftright("__place", 33)).withColumn(
        "__place", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    numbered = placed.join(F.broadcast(offsets), "__range")
    return numbered.withColumn(num, F.col("__offset") + F.col("__place") + F.lit(start)).drop(
        "__range", "__place", "__offset"
    )


def running_total(df: DataFrame, order: list[Column], amount: str, total: str) -> DataFrame:
    """`total` = the sum of `amount` over all rows up to and with this one in the given order.

    As in `renumber`, a range sort spreads the rows and is written; each row's sum runs within its range only, and the
    sums of the ranges, one row per task, pass through a single window.
    """
    placed = materialise(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "totals")
    placed = placed.withColumn("__range", F.shiftright("__place", 33))
    sums = placed.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__range"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("__inside", F.sum(amount).over(inside)).join(F.broadcast(offsets), "__range")
    return summed.withColumn(total, F.col("__offset") + F.col("__inside")).drop("__range", "__place", "__offset", "__inside")


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns in which a null equals a null; the columns are the left side's."""
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    condition = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__right_{c}"]) for c in on], F.lit(True))
    return left.join(renamed, condition, how).drop(*[f"__right_{c}" for c in on])


def renumber_all(tables: dict[str, DataFrame], key: str, order: list[str] | None = None) -> dict[str, DataFrame]:
    """Number the common keys once and give every table the same new numbers."""
    first = next(iter(tables.values()))
    columns = list(dict.fromkeys([*(order or []), key]))
    keys = renumber(first.select(*columns).distinct(), columns, "__new").select(key, "__new")
    return {
        name: df.join(keys, key).withColumn(key, F.col("__new")).drop("__new") for name, df in tables.items()
    }


# Tables per mask column: bits of a long without its sign.
MASK_BITS = 62


def _presence(tables: dict[str, DataFrame], key: str, bad: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: a bit per table that holds it, in as many mask columns as the tables need, and whether any
    table calls it bad."""
    words = -(-len(tables) // MASK_BITS)
    parts = []
    for i, (name, df) in enumerate(tables.items()):
        flag = (bad or {}).get(name, F.lit(False))
        bits = [F.lit(1 << i % MASK_BITS if i // MASK_BITS == w else 0).cast("long").alias(f"bit{w}") for w in range(words)]
        parts.append(
            df.where(F.col(key).isNotNull()).select(
                F.col(key).alias("key"), *bits, F.coalesce(flag, F.lit(False)).alias("bad")
            )
        )
    masks = [F.bit_or(f"bit{w}").alias(f"mask{w}") for w in range(words)]
    return reduce(DataFrame.unionAll, parts).groupBy("key").agg(*masks, F.max("bad").alias("bad"))


def common_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys every table holds."""
    full = F.lit(True)
    for w in range(-(-len(tables) // MASK_BITS)):
        here = min(MASK_BITS, len(tables) - w * MASK_BITS)
        full = full & (F.col(f"mask{w}") == F.lit((1 << here) - 1))
    return _presence(tables, key).where(full).select(F.col("key").alias(key))


def except_keys(keys: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Keys without the removed ones."""
    return keys.join(removed.select(key), key, "left_anti")


def kept_keys(tables: dict[str, DataFrame], key: str, bad: dict[str, Column] | None = None) -> DataFrame:
    """Keys held by every non-empty table and bad in none. Without `bad`, the placeholder mark decides."""
    if bad is None:
        bad = {name: flag_bad(*df.columns) for name, df in tables.items()}
    seen = _presence(tables, key, bad)
    held = ~F.col("bad")
    for mask in [c for c in seen.columns if c.startswith("mask")]:
        held = held & (F.col(mask) == seen.agg(F.bit_or(mask)).scalar())
    return seen.where(held).select(F.col("key").alias(key))


def sync_filter(
    tables: dict[str, DataFrame], key: str, bad: dict[str, Column] | None = None
) -> dict[str, DataFrame]:
    """Every table reduced to the kept keys: one aggregate over the keys, written once, and a semi join per table."""
    keep = materialise(kept_keys(tables, key, bad), "kept")
    return {name: df.join(keep, key, "left_semi") for name, df in tables.items()}


def truncate_common(tables: dict[str, DataFrame], num: str = "num") -> dict[str, DataFrame]:
    """Densely numbered tables cut to the shortest one."""
    sizes = [df.agg(F.count(F.lit(1))).scalar() for df in tables.values()]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    return {name: df.where(F.col(num) <= shortest) for name, df in tables.items()}


def check_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per table: rows, null keys, distinct keys, duplicated keys, contiguous 1..N, same keys everywhere.

    All tables are counted by key together, in one shuffle; the report is a single pass over those counts.
    """
    names = list(tables)
    parts = [df.select(F.lit(i).alias("t"), F.col(key).cast("long").alias("key")) for i, df in enumerate(tables.values())]
    counts = [F.count(F.when(F.col("t") == i, 1)).alias(f"c{i}") for i in range(len(names))]
    per_key = reduce(DataFrame.unionAll, parts).groupBy("key").agg(*counts)
    valid = F.col("key").isNotNull()
    everywhere = valid
    for i in range(len(names)):
        everywhere = everywhere & (F.col(f"c{i}") > 0)
    stats = [F.count(F.when(everywhere, 1)).alias("everywhere")]
    for i in range(len(names)):
        c, here = F.col(f"c{i}"), valid & (F.col(f"c{i}") > 0)
        stats.append(
            F.struct(
                F.lit(names[i]).alias("table"),
                F.coalesce(F.sum(c), F.lit(0)).alias("n_rows"),
                F.coalesce(F.sum(F.when(~valid, c)), F.lit(0)).alias("n_null"),
                F.count(F.when(here, 1)).alias("n_distinct"),
                F.count(F.when(here & (c > 1), 1)).alias("n_duplicated"),
                F.min(F.when(here, F.col("key"))).alias("min_key"),
                F.max(F.when(here, F.col("key"))).alias("max_key"),
            ).alias(f"s{i}")
        )
    report = per_key.agg(*stats).select("everywhere", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))
    contiguous = (
        (F.col("n_null") == 0) & (F.col("n_duplicated") == 0)
        & (F.col("min_key") == 1) & (F.col("max_key") == F.col("n_distinct"))
    )
    return report.select(
        "table", "n_rows", "n_null", "n_distinct", "n_duplicated", "min_key", "max_key",
        F.coalesce(contiguous, F.lit(False)).alias("contiguous"),
        (F.col("n_distinct") == F.col("everywhere")).alias("same_keys"),
    )


def same_key_lists(tables: dict[str, DataFrame], key: str, order: str) -> DataFrame:
    """(table, n_rows, same_list): whether a table has the first table's keys in the same order, row by row.

    `order` numbers the rows of each table densely from 1 (`renumber`). Rows are compared at their number, all tables
    in one shuffle; repeated and null keys count like any others.
    """
    names = list(tables)
    parts = [
        df.select(F.lit(i).alias("t"), F.col(order).cast("long").alias("at"), F.col(key).cast("string").alias("key"))
        for i, df in enumerate(tables.values())
    ]
    here = [F.max(F.when(F.col("t") == i, F.struct(F.lit(True).alias("there"), F.col("key").alias("key")))).alias(f"k{i}") for i in range(len(names))]
    rows = reduce(DataFrame.unionAll, parts).groupBy("at").agg(*here)
    cells = [
        F.struct(
            F.lit(name).alias("table"), F.count(f"k{i}").alias("n_rows"),
            F.coalesce(F.every(F.col(f"k{i}").eqNullSafe(F.col("k0"))), F.lit(True)).alias("same_list"),
        ).alias(f"s{i}")
        for i, name in enumerate(names)
    ]
    return rows.agg(*cells).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows) of every key that stands on several rows; a null is a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assemble_corpus(
    advice: DataFrame, mapping: DataFrame, corpus: DataFrame, variant: DataFrame | None = None, key: str = "num"
) -> DataFrame:
    """Advice with codes, neutral text and the body to print: variant text, else neutral text, else ''."""
    base = advice.join(mapping, key, "left").join(corpus.select(key, "text"), key, "left")
    if variant is None:
        return base.withColumn("body", F.coalesce("text", F.lit("")))
    joined = base.join(variant.select(key, "generated_text"), key, "left")
    return joined.withColumn("body", coalesce_text("generated_text", "text"))


def corpus_with_advice(texts: DataFrame | None, advice: DataFrame, key: str = "num") -> DataFrame:
    """Corpus rows with their advice ('' when none); without texts the advice itself is the text."""
    if texts is None:
        texts = advice.select(key, F.col("advice").alias("text"))
    joined = texts.select(key, "text").join(advice.select(key, "advice"), key, "left")
    return joined.select(
        key, "text", F.coalesce("advice", F.lit("")).alias("advice"), F.lit("").alias("chapter")
    )


def lookup_codes(df: DataFrame, code: str, reference: DataFrame, default: str, attributes: list[str]) -> DataFrame:
    """Attributes of each code from its reference table; an unknown code becomes the default and gets its attributes."""
    ref = reference.select(F.col("code").alias("__code"), *[F.col(a).alias(f"__{a}") for a in attributes])
    fallback = reference.where(F.col("code") == default)
    known = F.col("__code").isNotNull()
    joined = df.join(ref, F.col(code) == F.col("__code"), "left")
    out = joined.withColumn(code, F.when(known, F.col(code)).otherwise(F.lit(default)))
    for a in attributes:
        value = fallback.agg(F.max(a)).scalar()
        out = out.withColumn(f"{code}_{a}", F.when(known, F.col(f"__{a}")).otherwise(value))
    return out.drop("__code", *[f"__{a}" for a in attributes])


def align_rows(mapping: DataFrame, others: dict[str, DataFrame], key: str = "num") -> DataFrame:
    """All mapping rows with the columns of the other tables, and `missing_<table>` where a table lacks the number."""
    out = mapping
    for name, df in others.items():
        flagged = df.withColumn(f"__has_{name}", F.lit(True))
        out = out.join(flagged, key, "left").withColumn(f"missing_{name}", F.col(f"__has_{name}").isNull())
        out = out.drop(f"__has_{name}")
    return out


def check_aligned(mapping: DataFrame, others: dict[str, DataFrame], key: str = "num", shown: int = 20) -> None:
    """ValueError, with the number of missing rows per table and the first `shown` numbers, unless every mapping row has its
    row in every other table. Runs a job."""
    missing = missing_keys(mapping, others, key)
    counts = {r["table"]: r["n"] for r in missing.groupBy("table").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        some = [r[key] for r in missing.orderBy(key).limit(shown).collect()]
        raise ValueError(f"rows missing by table: {counts}; the first numbers are {some}")


def missing_keys(mapping: DataFrame, others: dict[str, DataFrame], key: str = "num") -> DataFrame:
    """(table, key) of every mapping row another table lacks; empty when the tables are aligned."""
    parts = [
        mapping.join(df, key, "left_anti").select(F.lit(name).alias("table"), F.col(key))
        for name, df in others.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def validate_codes(
    df: DataFrame, rules: dict[str, tuple[DataFrame, str]], *, mode: str = "repair"
) -> DataFrame:
    """Check code columns against reference tables with a `code` column.

    "repair": unknown codes become the default and `<column>_invalid` tells which; "reject": rows with an
    unknown code are dropped; "flag": codes stay, only the flags are added.
    """
    out = df
    for column, (reference, default) in rules.items():
        # Written, so that the planner knows its size: a short list spares the rows a shuffle by code.
        known = materialise(reference.select(F.col("code").alias("__code")).distinct(), "codes")
        out = out.join(known, F.col(column) == F.col("__code"), "left")
        out = out.withColumn(f"{column}_invalid", F.col("__code").isNull()).drop("__code")
        if mode == "repair":
            out = out.withColumn(column, F.when(F.col(f"{column}_invalid"), default).otherwise(F.col(column)))
        elif mode == "reject":
            out = out.where(~F.col(f"{column}_invalid")).drop(f"{column}_invalid")
    return out


def invalid_counts(flagged: DataFrame, columns: list[str]) -> DataFrame:
    """Number of invalid codes per column, in one pass."""
    return flagged.agg(
        *[F.count(F.when(F.col(f"{c}_invalid"), 1)).alias(f"n_invalid_{c}") for c in columns]
    )


def missing_rows(corpus: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """Corpus rows without a non-blank generated text: what is still to be done."""
    done = variant.where(~is_blank("generated_text")).select(*keys)
    return corpus.join(done, keys, "left_anti")


def remap_text(base: DataFrame, texts: DataFrame, keys: list[str], text: str = "generated_text") -> DataFrame:
    """The base rows with their text from `texts`, '' where there is none."""
    return base.join(texts.select(*keys, text), keys, "left").withColumn(text, F.coalesce(blank_to_null(text), F.lit("")))


def neutral_variant(corpus: DataFrame, name: str = "neutral") -> DataFrame:
    """The neutral corpus in the shape of a variant."""
    return corpus.select(F.lit(name).alias("variant"), "num", F.col("text").alias("generated_text"))


def align_slots(slots: dict[str, DataFrame], ordinal: str = "ordinal") -> DataFrame:
    """Long form of up to N corpora side by side: (ordinal, slot, …)."""
    return union_tables([df.withColumn("slot", F.lit(name)) for name, df in slots.items()])


def slot_sizes(aligned: DataFrame) -> DataFrame:
    """Rows per slot, and whether all slots are equally long."""
    sizes = aligned.groupBy("slot").agg(F.count(F.lit(1)).alias("n_rows"))
    spread = sizes.agg(F.min("n_rows") == F.max("n_rows")).scalar()
    return sizes.withColumn("aligned", spread)


def slots_wide(aligned: DataFrame, slots: list[str], columns: list[str], key: list[str]) -> DataFrame:
    """One row per ordinal, a column per slot and value; null where a slot ends early."""
    cells = [
        F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{s}_{c}") for s in slots for c in columns
    ]
    return aligned.groupBy(*key).agg(*cells)


def best_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The latest non-blank text of several attempts per key, '' when all are blank."""
    usable = ~is_blank("text")
    best = F.max_by(F.when(usable, F.col("text")), F.when(usable, F.col("attempt")))
    return attempts.groupBy(*keys).agg(F.coalesce(best, F.lit("")).alias("text"))
