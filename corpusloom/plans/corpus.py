"""From raw answers to aligned, numbered tables, and from those to narratives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import alignment as al
from corpusloom.operators import generation as gn
from corpusloom.operators import parsing as ps
from corpusloom.session import materialise


@dataclass(frozen=True)
class RawTable:
    """Raw answers (batch_id, raw) of one table, its field names (the first is the number) and its code columns."""

    raw: DataFrame
    fields: list[str]
    codes: dict[str, tuple[DataFrame, str]] | None = None


def repaired_table(table: RawTable, batch: str = "batch_id", sep: str = ";") -> DataFrame:
    """All rows of all batches, malformed ones with placeholders, codes checked and replaced by their defaults."""
    rows = ps.drop_header_rows(ps.repair_rows(table.raw, "raw", [batch], table.fields, sep), table.fields)
    rows = rows.withColumn(table.fields[0], F.col(table.fields[0]).try_cast("long")).drop("raw_line")
    return al.validate_codes(rows, table.codes) if table.codes else rows


def aligned_tables(tables: dict[str, RawTable], key: str = "num", sep: str = ";") -> dict[str, DataFrame]:
    """The tables reduced to the numbers that all of them hold and that are bad in none, numbered 1..N alike."""
    rows = {name: materialise(repaired_table(t, sep=sep), name) for name, t in tables.items()}
    kept = al.sync_filter({name: df.select(*tables[name].fields) for name, df in rows.items()}, key)
    return al.renumber_all(kept, key)


def narrate(
    tables: dict[str, DataFrame],
    block: Column,
    preamble: str,
    make_model: Callable[[], gn.Model],
    store: str,
    *,
    key: str = "num",
    batch_size: int = 5,
    tasks: int,
    **options,
) -> DataFrame:
    """(batch_id, row, text): the answer of every batch of rows (row 0), or a placeholder per row of a batch that got none. Answers in `store` count
    for the prompts they were given to, so that it may be used again after the tables changed."""
    names = list(tables)
    joined = tables[names[0]]
    for name in names[1:]:
        joined = joined.join(tables[name], key)
    planned = gn.plan_batches(joined, batch_size, key)
    prompts = gn.build_prompts(planned, block, preamble, num=key)
    answers = gn.generate_into(store, prompts, make_model, ["batch_id"], tasks=tasks, **options)
    good = answers.where("raw is not null").select("batch_id", F.lit(0).cast("long").alias("row"), F.col("raw").alias("text"))
    failed = gn.placeholder_failed(answers, gn.batch_bounds(planned, key), ["batch_id"])
    return good.unionByName(failed.select("batch_id", F.col("num").alias("row"), "text"))
