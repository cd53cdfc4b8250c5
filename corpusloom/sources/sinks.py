"""Writing tables, documents and ordered text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import filter_headers, strip
from corpusloom.operators.facets import selected_texts
from corpusloom.session import materialise


def write_table(
    df: DataFrame, path: str, *, partition_by: list[str] = (), format: str = "parquet", sep: str = ";",
    mode: str = "overwrite", rebalance: bool = False,
) -> None:
    """Write a table; with partition columns only the partitions at hand are replaced.

    `rebalance` gathers the rows of a partition in few files; a partition that holds most rows is split again.
    """
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if format == "csv":
        writer = writer.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option(
            "emptyValue", ""
        )
    writer.save(path)


def append_texts(df: DataFrame, path: str, header_style: str = "full") -> None:
    """Append the texts, filtered and stripped, each followed by a blank line, to the text files at `path`."""
    df.select(F.concat(strip(filter_headers("text", header_style)), F.lit("\n")).alias("value")).write.mode(
        "append"
    ).text(path)


def merged_lines(df: DataFrame, order: list[str], header_style: str = "full") -> DataFrame:
    """(order…, line_no, line) of the merged document: each text filtered and stripped, then a blank line."""
    text = strip(filter_headers("text", header_style))
    lines = F.concat(F.split(text, "\n"), F.array(F.lit("")))
    return df.select(*order, F.posexplode(lines).alias("line_no", "line"))


def _in_ranges(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    """The rows in global order: partitions are ranges of the order columns, sorted within.

    The ranges are cut on the keys alone, which are written for it; the other columns are evaluated and shuffled once.
    A row finds its range by halves among one key per range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = materialise(df.select(F.struct(*order).alias("key")), "keys")
    first = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("key"))
    bounds = materialise(first, "bounds").agg(F.sort_array(F.collect_list("key")).alias("__bounds"))
    # One row, as long as there are ranges.
    both = df.withColumn("__one", F.lit(1)).join(F.broadcast(bounds.withColumn("__one", F.lit(1))), "__one")
    key = F.struct(*order)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])
    at = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get("__bounds", i + step) <= key, i + step).otherwise(i))
    placed = both.withColumn("__range", at).drop("__one", "__bounds")
    return placed.repartitionById(n, F.col("__range")).sortWithinPartitions(*order).drop("__range")


def write_ordered_text(texts: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """Write the column `line`, which may hold several lines, in global order: the part files in name order are the
    document."""
    _in_ranges(texts, order, partitions).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def merge_texts(
    df: DataFrame, path: str, order: list[str], header_style: str = "full", partitions: int | None = None
) -> None:
    """Batch texts in numeric order as one ordered document; a text is one row until it is written."""
    text = F.concat(strip(filter_headers("text", header_style)), F.lit("\n"))
    write_ordered_text(df.select(*order, text.alias("line")), path, order, partitions)


def write_json_doc(df: DataFrame, path: str, columns: list[str]) -> None:
    """One JSON object per line."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def chapter_documents(members: DataFrame, block: int = 10_000) -> DataFrame:
    """(chapter_id, title, block, num_list): the chapters as JSON-ready rows. A chapter of any size is cut in blocks
    of the number range, so no list outgrows the block."""
    cut = members.withColumn("block", F.floor(F.col("num") / block))
    return cut.groupBy("chapter_id", "title", "block").agg(F.sort_array(F.collect_set("num")).alias("num_list"))


def export_selection(
    aligned: DataFrame, selection: DataFrame, path: str, key: list[str], partitions: int | None = None
) -> None:
    """The selected headers, and per slot the selected texts in key order."""
    chosen = selected_texts(aligned, selection, key)
    first = F.min(F.struct("slot", "header")).alias("h")
    headers = chosen.groupBy(*key).agg(first).select(*key, F.col("h.header").alias("line"))
    write_ordered_text(headers, f"{path}/headers", key, partitions)
    order = ["slot", *key]
    _in_ranges(chosen, order, partitions).select(
        "slot", F.concat("content", F.lit("\n")).alias("value")
    ).write.mode("overwrite").partitionBy("slot").text(f"{path}/texts")
