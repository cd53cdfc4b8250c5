"""Text files of any size, read in splits: blocks, sections and segments that run on over the borders of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank, strip
from corpusloom.operators.parsing import MARKER, SECTION_NAME, TEXT_HEAD, WS, block_parts, section_parts
from corpusloom.session import materialise
from corpusloom.sources.tables import _newlines, _positions, _text_lines

# What all sections' heads begin with: files are cut there for reading.
SECTION_START = "\\sub"
_SECTION_REST = SECTION_NAME.removeprefix("sub")


def _lines(spark: SparkSession, path: str | list[str], line_end: str | None = None, folders: bool = False) -> DataFrame:
    """(path, block, row, line), written; all lines of a file are Latin-1 when one of them is no valid UTF-8."""
    raw = materialise(_text_lines(spark, path, line_end, folders).withColumn("valid", F.is_valid_utf8("line")), "lines")
    # Written, so that the planner sees that it is small and moves no line to its path.
    latin = materialise(raw.where("not valid").select("path").distinct(), "latin").withColumn("latin", F.lit(True))
    text = F.when(F.col("latin"), F.decode(F.col("line").cast("binary"), "ISO-8859-1")).otherwise(F.col("line"))
    return raw.join(latin, "path", "left").select("path", "block", "row", _newlines(text).alias("line"))


def _parts(lines: DataFrame, joiner: str) -> DataFrame:
    """(path, num, part): the lines from each head up to the next mark, joined; num counts the heads of a file from 1.

    `lines` has (path, block, row, line) and the flags `blank`, `mark` (something begins here), `head` (a mark that opens a
    part) and `bare` (a head that takes the next line that is not blank with it, whatever that is). A first pass, over the
    flags alone, gives one row per split: its marks, if the line before took the first one with it and if not, and how it
    ends. These rows are summed up along each file; a second pass numbers the lines from there. No task holds more than a
    split, but for a part that is itself longer.
    """
    inside = Window.partitionBy("path", "block").orderBy("row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # Of heads that follow each other directly, each but the last one bare, every second one is only the line after a head.
    seen = lines.withColumn("place", F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(so_far))
    seen = seen.withColumn("fence", F.when(~F.col("blank") & ~F.col("bare"), F.col("place")))
    seen = seen.withColumn("last_fence", F.last("fence", True).over(earlier))
    run = F.col("place") - 1 - F.coalesce("last_fence", F.lit(0))
    longer = run + F.when(F.col("last_fence").isNull(), 1).otherwise(0)
    seen = seen.withColumn("even", F.col("mark") & (run % 2 == 0)).withColumn("odd", F.col("mark") & (longer % 2 == 0))

    splits = seen.groupBy("path", "block").agg(
        F.max("place").alias("places"), F.max("fence").alias("fence"),
        F.count_if("even").alias("even_marks"), F.count_if(F.col("even") & F.col("head")).alias("even_heads"),
        F.count_if("odd").alias("odd_marks"), F.count_if(F.col("odd") & F.col("head")).alias("odd_heads"),
    )
    previous = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(previous), F.lit(0))

    splits = splits.withColumn("tails", before(F.col("places") - F.coalesce("fence", F.lit(0))))
    fenced = F.last(F.when(F.col("fence").isNotNull(), F.col("tails")), True).over(previous)
    splits = splits.withColumn("is_odd", (F.col("tails") - F.coalesce(fenced, F.lit(0))) % 2 == 1)
    splits = splits.select(
        "path", "block", "is_odd",
        before(F.when(F.col("is_odd"), F.col("odd_marks")).otherwise(F.col("even_marks"))).alias("marks_before"),
        before(F.when(F.col("is_odd"), F.col("odd_heads")).otherwise(F.col("even_heads"))).alias("heads_before"),
    )

    begins = F.when(F.col("is_odd"), F.col("odd")).otherwise(F.col("even"))
    placed = seen.join(splits, ["path", "block"]).withColumn("begins", begins)

    def count(flag: Column) -> Column:
        return F.sum(F.when(flag, 1).otherwise(0)).over(so_far)

    placed = placed.select(
        "path", "block", "row", "line", (F.col("begins") & ~F.col("head")).alias("ends"),
        (F.col("marks_before") + count(F.col("begins"))).alias("mark_no"),
        (F.col("heads_before") + count(F.col("begins") & F.col("head"))).alias("num"),
    ).where("mark_no > 0")
    # A split's lines stand together already; only its pieces move again, to where a part goes on.
    rows = F.sort_array(F.collect_list(F.struct("row", "line")))
    pieces = placed.groupBy("path", "block", "mark_no").agg(
        F.max("num").alias("num"), F.bool_or("ends").alias("ends"), F.array_join(F.transform(rows, lambda r: r["line"]), joiner).alias("piece")
    )
    whole = F.sort_array(F.collect_list(F.struct("block", "piece")))
    parts = pieces.groupBy("path", "mark_no").agg(
        F.max("num").alias("num"), F.bool_or("ends").alias("ends"), F.array_join(F.transform(whole, lambda p: p["piece"]), joiner).alias("part")
    )
    return parts.where("not ends").select("path", "num", "part")


def read_text_blocks(spark: SparkSession, path: str | list[str], *, folders: bool = False) -> DataFrame:
    """(path, num, header, text) of `Text N – …` blocks in files of any size, as `parse_text_blocks` reads a whole file.

    Files are split for reading, and a block runs on over the borders of splits. A head stands in one line; a byte order
    mark is skipped. With `folders` a folder's part files, in name order, are one file; lines end with their part, blocks
    run on. Writes the lines.
    """
    head = F.col("line").rlike(rf"(?i)\A{TEXT_HEAD}")
    bare = F.col("line").rlike(rf"(?i)\A{TEXT_HEAD}{WS}*\z")
    lines = _lines(spark, path, folders=folders).select("*", is_blank("line").alias("blank"), head.alias("mark"), head.alias("head"), bare.alias("bare"))
    return _parts(lines, "\n").select("path", "num", F.inline(F.array(block_parts(F.col("part")))))


def read_sections(spark: SparkSession, path: str | list[str], *, folders: bool = False) -> DataFrame:
    """(path, num, header, text) of the LaTeX sub(sub)sections with a body, in files of any size; numbers count all sections.

    Files are split before `\\sub`, and as in `parse_sections` a section ends where the next section command begins. A
    head's braces close before the next `\\sub`. With `folders` a folder's part files, in name order, are one file; a `\\sub`
    lies within a part, sections run on. Writes the pieces.
    """
    line = F.col("line")
    # The first piece of a file has no `\sub` in front.
    is_first = (F.col("block.start") == 0) & F.lag("row").over(Window.partitionBy("path", "block").orderBy("row")).isNull()
    command = ~F.col("is_first") & line.rlike(rf"\A{_SECTION_REST}")
    head = ~F.col("is_first") & line.rlike(rf"\A{_SECTION_REST}\*?\{{[^}}]*\}}")
    no = F.lit(False)
    lines = _lines(spark, path, SECTION_START, folders).withColumn("is_first", is_first)
    whole = F.when(F.col("is_first"), line).otherwise(F.concat(F.lit(SECTION_START), line)).alias("line")
    lines = lines.select("path", "block", "row", whole, no.alias("blank"), command.alias("mark"), head.alias("head"), no.alias("bare"))
    rows = _parts(lines, "").select("path", "num", F.inline(F.array(section_parts(F.col("part")))))
    return rows.where("text <> ''")


def read_segments(spark: SparkSession, path: str | list[str], marker: str = MARKER, *, folders: bool = False) -> DataFrame:
    """(path, X, segment): the pieces between markers in files of any size, those that are not blank counted from 1.

    Files are split at the marker. With `folders` a folder's part files, in name order, are one file; a segment ends with
    its part. Writes the pieces.
    """
    pieces = _lines(spark, path, marker, folders).withColumn("segment", strip("line")).where("segment <> ''").drop("line")
    return _positions(materialise(pieces, "segments")).select("path", F.col("position").alias("X"), "segment")
