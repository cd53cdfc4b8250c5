"""Reading tables, answers and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import SPACES, let, strip
from corpusloom.operators.alignment import renumber
from corpusloom.operators.parsing import (
    JSON_FACETS, XML_FACETS, corpus_rows, json_lines, json_record, placed_texts, xml_nodes, xml_record,
)
from corpusloom.schemas import check_names
from corpusloom.session import materialise


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *, sep: str = ";", multi_line: bool = False,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Delimited text with a header, every column a string unless `types` casts it (null when it cannot be cast).

    Lines that do not fit keep what could be read and their raw form in `_corrupt`. `multi_line` allows quoted line
    breaks but makes a file one task. A byte order mark in front of the header is ignored.
    """
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    full = T.StructType([*strings.fields, T.StructField("_corrupt", T.StringType())])
    df = (
        spark.read.schema(full).option("sep", sep).option("header", True).option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("quote", '"')
        .option("escape", '"').option("enforceSchema", True).option("multiLine", multi_line).csv(path)
    )
    casts = {name: F.col(name).try_cast(kind) for name, kind in (types or {}).items()}
    return df.withColumns(casts) if casts else df


def read_header(spark: SparkSession, path: str, sep: str = ";") -> list[str]:
    """The column names of a delimited file, byte order mark and outer blanks removed; one line is read."""
    first = spark.read.text(path).limit(1).first()
    line = "" if first is None else first[0]
    return [name.strip().strip('"').strip(SPACES) for name in line.lstrip("﻿").split(sep)]


def check_header(spark: SparkSession, path: str, expected: list[str], sep: str = ";") -> None:
    """ValueError unless the file's header is the expected one."""
    check_names(read_header(spark, path, sep), expected)


def union_batches(
    spark: SparkSession, folder: str, prefix: str, schema: T.StructType, *, sep: str = ";"
) -> DataFrame:
    """All `<prefix>*.csv` files below a folder, with `batch` (the file's name) as order column."""
    df = read_table(spark, f"{folder.rstrip('/')}/{prefix}*.csv", schema, sep=sep)
    return df.withColumn("batch", F.col("_metadata.file_name"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): raw answers, one file each, with newlines as line ends."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), _newlines(F.col("value")).alias("raw"))


def _newlines(text: Column) -> Column:
    """The line ends of a text file as newlines, as reading it in text mode gives them."""
    folded = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(text.contains("\r"), folded).otherwise(text)


def decode_text(content: Column | str) -> Column:
    """Bytes as UTF-8, as Latin-1 when they are no valid UTF-8; line ends become newlines."""
    c = F.col(content) if isinstance(content, str) else content
    text = c.cast("string")
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(F.decode(c, "ISO-8859-1"))
    return let(decoded, _newlines)


def read_text_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, num, header, text, sn_codes, de_codes) of corpus files in any known shape. A file is one task's work;
    large JSON lines belong into `read_json_lines`, large XML into `read_xml_texts`."""
    files = spark.read.format("binaryFile").load(path).select("path", decode_text("content").alias("content"))
    name = F.substring_index("path", "/", -1)
    return files.select("path", F.inline(corpus_rows("content", name)))


def _text_lines(spark: SparkSession, path: str | list[str], line_end: str | None = None, folders: bool = False) -> DataFrame:
    """(path, block, row, line) of text files that are split for reading; (block, row) is the order within a file. With
    `folders` a folder's part files, in name order, are one file, whose path is the folder's."""
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    lines = reader.text(path).where("value is not null")
    whole, part = F.col("_metadata.file_path"), F.lit("")
    if folders:
        whole, part = F.regexp_extract(whole, "^(.*)/", 1), F.col("_metadata.file_name")
    return lines.select(
        whole.alias("path"), F.struct(part.alias("part"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"),
    )


def _positions(records: DataFrame) -> DataFrame:
    """The records with `position`, from 1 in each file; only their keys are sorted."""
    places = renumber(records.select("path", "block", "row"), ["path", "block", "row"], "position")
    first = materialise(places.groupBy("path").agg(F.min("position").alias("first")), "first")
    numbered = places.join(first, "path").select("row", (F.col("position") - F.col("first") + 1).alias("position"))
    return records.join(numbered, "row")


def read_ordered_text(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, path, line): the lines of an ordered document, numbered from 0 through its part files in name order."""
    lines = materialise(_text_lines(spark, path), "lines")
    places = renumber(lines.select("path", "block", "row"), ["path", "block", "row"], "line_no", start=0)
    return lines.join(places.select("row", "line_no"), "row").select("line_no", "path", "line")


def _json_lines(spark: SparkSession, path: str | list[str], folders: bool) -> DataFrame:
    return json_lines(_text_lines(spark, path, folders=folders), "line")


def read_json_lines(
    spark: SparkSession, path: str | list[str], facets: dict[str, tuple[str, ...]] | None = None, *, folders: bool = False,
) -> DataFrame:
    """(path, num, header, text, codes…) of JSON lines files of any size; a line is a record, a comma may follow it.

    Fields are spelled and completed as in `parse_json_texts`: a record's position among the objects of its file stands
    in for number and header. Lines that hold no object are rows of `read_json_lines_rejects`. With `folders` a
    folder's part files, in name order, are one file. Writes the records.
    """
    records = materialise(_json_lines(spark, path, folders).where("record is not null").drop("line"), "records")
    row = json_record(F.col("record"), F.col("position"), facets)
    return placed_texts(_positions(records), row, facets or JSON_FACETS, ["path"])


def read_json_lines_rejects(spark: SparkSession, path: str | list[str], *, folders: bool = False) -> DataFrame:
    """(path, line) of the lines that are not blank and hold no JSON object; with `folders` the path is the folder's."""
    return _json_lines(spark, path, folders).where("record is null").select("path", "line")


def read_xml_texts(
    spark: SparkSession, path: str | list[str], facets: dict[str, tuple[str, ...]] | None = None, *, folders: bool = False,
) -> DataFrame:
    """(path, num, header, text, codes…) of large XML files, which are split behind their `</text>` tags.

    Each `<text>` element is read as `parse_xml_texts` reads it, inner elements included; its position among the readable
    elements of its file stands in for number and header. An element within another one is read alone. With `folders` a
    folder's part files, in name order, are one file; no element crosses them. Writes the elements.
    """
    lines = _text_lines(spark, path, "</text>", folders)
    element = F.regexp_extract("line", r"(?s)\A.*(<text(?=[\s>]).*)", 1)
    whole = lines.withColumn("line", F.when(element != "", F.concat(element, F.lit("</text>")))).where("line is not null")
    nodes = whole.withColumn("node", F.get(xml_nodes("line"), F.lit(0))).where("node is not null").drop("line")
    row = xml_record(F.col("node"), F.col("position"), facets)
    return placed_texts(_positions(materialise(nodes, "elements")), row, facets or XML_FACETS, ["path"])


def read_json_document(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(path, doc): themes, assignments or chapters documents."""
    return parse_documents(read_responses(spark, path), "raw", ["path"], schema)


def parse_documents(df: DataFrame, raw: str, keys: list[str], schema: str) -> DataFrame:
    """(keys, doc) of JSON documents in a column."""
    return df.select(*keys, F.from_json(raw, schema).alias("doc"))


def catalogue_rows(documents: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, seq, name, description, keywords) of parsed themes documents; themes without name are skipped."""
    rows = documents.select(*keys, F.posexplode_outer("doc.themes").alias("seq", "t")).where("seq is not null")
    named = rows.select(*keys, "seq", strip("t.name").alias("name"), strip("t.description").alias("description"), "t.keywords")
    return named.where("name <> ''")


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, modified, length) of files; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def latest(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The value with the greatest order key per group; combined before the shuffle."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_file(spark: SparkSession, path: str | list[str]) -> str:
    """The most recently modified of the matching files; FileNotFoundError without any."""
    found = list_files(spark, path).agg(F.max_by("path", F.struct("modified", "path")).alias("path")).first()
    if found is None or found["path"] is None:
        raise FileNotFoundError(f"no file matches {path}")
    return found["path"]


def run_index(name: Column | str) -> Column:
    """The trailing number of `<slug>_<k>`, null without one."""
    c = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.regexp_extract(c, r"_(\d+)$", 1), F.lit("")).try_cast("long")


def latest_run(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, latest, next_index): the run with the highest number per family, and the number of the next one."""
    index = run_index(name)
    runs = df.where(index.isNotNull())
    return runs.groupBy(*by).agg(
        F.max_by(name, F.struct(index, F.col(name))).alias("latest"), (F.max(index) + 1).alias("next_index")
    )
