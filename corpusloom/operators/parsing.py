"""One text in, many rows out: native array expressions, exploded last."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.codes import coerce_code_list, coerce_codes, resolve_codes
from corpusloom.functions.requests import extract_json_object
from corpusloom.functions.text import WS, _col, blank_to_null, excerpt_end, excerpt_start, is_blank, let, split_lines, strip
from corpusloom.schemas import ASSIGNMENTS_JSON

# The marker between segments, sentences per segment, and where a sentence ends.
MARKER = ">||<"
MAX_SENTENCES = 7
SENTENCE_BREAK = rf"(?<=[.!?]){WS}+(?=[A-ZÀ-ÖØ-Þ0-9])"
PARAGRAPH_BREAK = rf"\n{WS}*\n"

# The block shapes of generated texts. A block runs to the next head of its kind or to the end; its
# body is read in long stretches that stop only at the character a head begins with.
REWRITE_HEAD = r"\[REWRITE[^\]]*?\]"
REWRITE_NUMBER = r"(?i)Num\s*=\s*(\d+)"
REWRITE_BLOCK = rf"(?is){REWRITE_HEAD}\s*.[^\[]*+(?:\[(?!REWRITE[^\]]*?\])[^\[]*+)*+"
SECTION_NAME = r"sub(?:sub)?section"
SECTION_HEAD = rf"\\{SECTION_NAME}\*?\{{([^}}]*)\}}"
SECTION_BLOCK = rf"{SECTION_HEAD}[^\\]*+(?:\\(?!{SECTION_NAME})[^\\]*+)*+"
SECTION_ANY_CASE = rf"(?i){SECTION_HEAD}[^\\]*+(?:\\(?!{SECTION_NAME}\*?\{{[^}}]*\}})[^\\]*+)*+"
TEXT_HEAD = rf"{WS}*Text{WS}+\d+{WS}*[–-]"
TEXT_BLOCK = rf"(?i)(?:\A|\n){TEXT_HEAD}{WS}*[^\n]*+(?:\n(?!{TEXT_HEAD})[^\n]*+)*+"

# The keys under which a header or a number may stand.
HEADER_KEYS = ("header", "title", "topic", "advice", "name")


def _strip_all(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def _unix_breaks(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _pieces(c: Column, marker: str) -> Column:
    return _strip_all(F.split(c, "\\Q" + marker + "\\E"))


def segments(c: Column | str, marker: str = MARKER, max_sentences: int = MAX_SENTENCES) -> Column:
    """Groups of sentences of a text: marked pieces, then paragraphs, then runs of sentences."""

    def in_groups(sentences: Column) -> Column:
        last = ((F.size(sentences) - 1) / max_sentences).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(sentences, i * max_sentences + 1, max_sentences), " "),
        )

    pieces = _pieces(_unix_breaks(F.coalesce(_col(c), F.lit(""))), marker)
    paragraphs = _strip_all(F.flatten(F.transform(pieces, lambda p: F.split(p, PARAGRAPH_BREAK))))
    return F.flatten(
        F.transform(paragraphs, lambda p: let(_strip_all(F.split(p, SENTENCE_BREAK)), in_groups))
    )


def segment_text(df: DataFrame, text: str, keys: list[str], **options) -> DataFrame:
    """(keys, seq, segment), seq from 1."""
    return df.select(*keys, F.posexplode(segments(text, **options)).alias("pos", "segment")).select(
        *keys, (F.col("pos") + 1).alias("seq"), "segment"
    )


def mark_text(c: Column | str, marker: str = MARKER, **options) -> Column:
    """The text with a marker line between its segments."""
    return F.array_join(segments(c, marker, **options), f"\n{marker}\n")


def export_segments(df: DataFrame, text: str, keys: list[str], marker: str = MARKER) -> DataFrame:
    """The marked pieces as an annotation table with first and last characters and empty code columns."""
    rows = df.select(*keys, F.posexplode(_pieces(F.coalesce(F.col(text), F.lit("")), marker)).alias("pos", "piece"))
    segment = F.replace(F.col("piece"), F.lit("\r\n"), F.lit("\n"))
    empty = [F.lit("").alias(c) for c in ("name_SN", "struct_SN", "name_DE", "struct_DE")]
    return rows.select(
        *keys, (F.col("pos") + 1).alias("X"), segment.alias("segment"),
        excerpt_start(segment).alias("debut_extrait"), excerpt_end(segment).alias("fin_extrait"), *empty,
    )


def repair_rows(df: DataFrame, raw: str, keys: list[str], fields: list[str], sep: str = ";") -> DataFrame:
    """Raw answers to rows: (keys, line_no, fields…, raw_line, malformed).

    A line with another number of fields keeps its first one; the others read BAD_field2, BAD_field3, ….
    """
    lines = _strip_all(split_lines(strip(F.coalesce(F.col(raw), F.lit("")))))
    rows = df.select(*keys, F.posexplode(lines).alias("pos", "raw_line"))
    parts = F.split("raw_line", "\\Q" + sep + "\\E")
    rows = rows.withColumn("__parts", parts)
    wrong = F.size("__parts") != len(fields)
    filler = [F.lit(f"BAD_field{i}") for i in range(2, len(fields) + 1)]
    fixed = F.when(wrong, F.array(strip(F.col("__parts")[0]), *filler)).otherwise(F.col("__parts"))
    rows = rows.withColumn("__fixed", fixed)
    cells = [F.get(F.col("__fixed"), F.lit(i)).alias(name) for i, name in enumerate(fields)]
    return rows.select(*keys, (F.col("pos") + 1).alias("line_no"), *cells, "raw_line", wrong.alias("malformed"))


def drop_header_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that only repeat the column names are no data."""
    same = F.lit(True)
    for name in fields:
        same = same & (F.lower(strip(name)) == name.lower())
    return rows.where(~F.coalesce(same, F.lit(False)))


def rejected_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The log of malformed lines."""
    return rows.where("malformed").select(*keys, "line_no", "raw_line")


def parse_rewrites(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """(keys, num, text) of `[REWRITE k | Num=n]` blocks; blocks without number are skipped, the last of equals wins."""

    def parsed(block: Column) -> Column:
        head = F.regexp_extract(block, rf"(?i)\A{REWRITE_HEAD}", 0)
        return let(
            head,
            lambda h: F.struct(
                F.regexp_extract(h, REWRITE_NUMBER, 1).try_cast("long").alias("num"),
                strip(F.substr(block, F.length(h) + 1)).alias("text"),
            ),
        )

    def last_wins(blocks: Column) -> Column:
        # Within one answer: the blocks reversed, the first of each number kept.
        return let(
            F.transform(blocks, lambda b: b["num"]),
            lambda nums: F.filter(blocks, lambda b, i: F.array_position(nums, b["num"]) == i + 1),
        )

    blocks = F.transform(F.regexp_extract_all(F.coalesce(F.col(raw), F.lit("")), F.lit(REWRITE_BLOCK), F.lit(0)), parsed)
    numbered = F.reverse(F.filter(blocks, lambda b: b["num"].isNotNull()))
    return df.select(*keys, F.inline(let(numbered, last_wins)))


def section_parts(block: Column) -> Column:
    """struct(header, text) of one section."""
    head = rf"(?i)\A{SECTION_HEAD}"
    return F.struct(
        strip(F.regexp_extract(block, head, 1)).alias("header"),
        strip(F.substr(block, F.length(F.regexp_extract(block, head, 0)) + 1)).alias("text"),
    )


def section_blocks(c: Column | str, *, any_case: bool = False) -> Column:
    """array<struct(header, text)> of LaTeX sub(sub)sections."""
    pattern = SECTION_ANY_CASE if any_case else SECTION_BLOCK
    blocks = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), F.lit(0))

    return F.transform(blocks, section_parts)


def parse_sections(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """(keys, num, header, text) of the sections with a body; numbers count all sections."""
    rows = df.select(*keys, F.posexplode(section_blocks(raw)).alias("pos", "s"))
    return rows.where(F.col("s.text") != "").select(*keys, (F.col("pos") + 1).alias("num"), "s.header", "s.text")


def block_parts(block: Column) -> Column:
    """struct(header, text) of one `Text N – …` block: the first line, then the rest."""
    return let(
        split_lines(strip(block)),
        lambda lines: F.struct(
            strip(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).alias("header"),
            strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "\n")).alias("text"),
        ),
    )


def text_blocks(c: Column | str) -> Column:
    """array<struct(header, text)> of `Text N – …` blocks: the first line, then the rest."""
    blocks = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(TEXT_BLOCK), F.lit(0))

    return F.transform(blocks, block_parts)


def parse_text_blocks(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """(keys, num, header, text), numbered by position."""
    rows = df.select(*keys, F.posexplode(text_blocks(raw)).alias("pos", "s"))
    return rows.select(*keys, (F.col("pos") + 1).alias("num"), "s.header", "s.text")


# --- JSON ---------------------------------------------------------------------------------------------------------


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _is_string(v: Column) -> Column:
    return _kind(v) == "STRING"


def _string(v: Column) -> Column:
    return F.when(_is_string(v), F.try_variant_get(v, "$", "string"))


def _truthy(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "false", "0", "0.0", '""', "[]", "{}")


def _first_truthy(v: Column, *names: str) -> Column:
    """The first field that is not empty, false, zero or null; else null."""
    return F.get(F.filter(F.array(*[_field(v, n) for n in names]), _truthy), F.lit(0))


def _integer(v: Column) -> Column:
    kind = _kind(v)
    text = strip(F.try_variant_get(v, "$", "string"))
    from_text = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    number = F.try_variant_get(v, "$", "double").cast("long")
    return (
        F.when(kind == "STRING", from_text)
        .when(kind.startswith("BIGINT") | (kind == "LONG"), F.try_variant_get(v, "$", "long"))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), number)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long"))
    )


def _code_field(v: Column, names: tuple[str, ...]) -> Column:

    def strings(value: Column) -> Column:
        listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), _string)
        return F.when(_kind(value).startswith("ARRAY"), listed).otherwise(F.array(_string(value)))

    return coerce_code_list(let(_first_truthy(v, *names), strings))


def _json_value(text: Column) -> Column:
    """The text as one JSON value, null when it is none or when anything follows it.

    The parser stops after the first value, so the text is closed in an object whose end must be read too.
    """
    framed = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":1}')))
    return let(framed, lambda v: F.when(_field(v, "end").isNotNull(), _field(v, "value")))


def json_records(c: Column | str) -> Column:
    """array<variant> of the records of a JSON array, object with text, `{"items": […]}` or JSON lines; else null."""

    def from_whole(whole: Column) -> Column:
        has_text = _is_string(_field(whole, "text")) | _is_string(_field(whole, "Text"))
        items = F.try_variant_get(whole, "$.items", "array<variant>")
        single = _is_object(whole) & has_text
        return (
            F.when(_kind(whole).startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>"))
            .when(single, F.array(whole))
            .when(_is_object(whole), items)
        )

    def from_lines(text: Column) -> Column:
        candidates = F.filter(
            F.transform(split_lines(text), lambda line: F.rtrim(strip(line), F.lit(","))), lambda x: x != ""
        )
        return let(
            F.transform(candidates, _json_value),
            lambda rows: F.when(~F.exists(rows, lambda r: r.isNull()), rows),
        )

    def records(text: Column) -> Column:
        return let(
            _json_value(text),
            lambda whole: F.when(whole.isNotNull(), from_whole(whole)).when(text != "", from_lines(text)),
        )

    found = let(strip(F.coalesce(_col(c), F.lit(""))), records)
    return F.filter(found, _is_object)


def _resolved(row: Column, facets: dict[str, tuple[str, ...]]) -> Column:
    """The row with codes found in header and text wherever none were given."""
    codes = [
        resolve_codes(row[f"{name}_codes"], row["header"], row["text"], name.upper()).alias(f"{name}_codes")
        for name in facets
    ]
    return F.struct(row["num"].alias("num"), row["header"].alias("header"), row["text"].alias("text"), *codes)


JSON_FACETS = {"sn": ("sn", "SN", "sn_codes"), "de": ("de", "DE", "de_codes")}
XML_FACETS = {"sn": ("sn", "sn_codes"), "de": ("de", "de_codes")}


def json_record(record: Column, position: Column, facets: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(num, header, text, <facet>…) of one JSON object; its position, from 1, stands in for number and header."""
    headers = [blank_to_null(_string(_field(record, k))) for k in HEADER_KEYS]
    return F.struct(
        F.coalesce(_integer(_first_truthy(record, "num", "Num")), position.cast("long")).alias("num"),
        F.coalesce(*headers, F.concat(F.lit("Text "), position.cast("string"))).alias("header"),
        strip(_string(_first_truthy(record, "text", "Text"))).alias("text"),
        *[_code_field(record, keys).alias(f"{name}_codes") for name, keys in (facets or JSON_FACETS).items()],
    )


def json_texts(c: Column | str, facets: dict[str, tuple[str, ...]] | None = None) -> Column:
    """array<struct(num, header, text, <facet>…)> of JSON records with a non-blank text."""
    facets = facets or JSON_FACETS
    records = F.transform(json_records(c), lambda record, i: json_record(record, i + 1, facets))
    rows = F.filter(records, lambda r: ~is_blank(r["text"]))
    return F.transform(rows, lambda r: _resolved(r, facets))


def json_lines(lines: DataFrame, line: str) -> DataFrame:
    """The lines with `record`: their JSON object (variant), null for a line that holds none; a comma may follow it.
    Blank lines are dropped."""
    candidate = F.rtrim(strip(line), F.lit(","))
    parsed = lines.where(F.coalesce(candidate, F.lit("")) != "").withColumn("__value", _json_value(candidate))
    return parsed.withColumn("record", F.when(_is_object(F.col("__value")), F.col("__value"))).drop("__value")


def placed_texts(rows: DataFrame, row: Column, facets: dict[str, tuple[str, ...]], keys: list[str]) -> DataFrame:
    """(keys, num, header, text, codes…) from one record per row, those without text left out."""
    found = rows.select(*keys, row.alias("__row")).where(~is_blank("__row.text"))
    return found.select(*keys, _resolved(F.col("__row"), facets).alias("__row")).select(*keys, "__row.*")


def parse_json_texts(df: DataFrame, raw: str, keys: list[str], **options) -> DataFrame:
    """(keys, num, header, text, codes…)."""
    return df.select(*keys, F.inline(json_texts(raw, **options)))


# --- XML ----------------------------------------------------------------------------------------------------------

XML_NODES = "array<struct<body:string,attributes:map<string,string>>>"
# Rows whose nodes are in Python at a time.
XML_ROWS = 128


def _text_nodes(payload: str | None) -> list[dict] | None:
    stripped = (payload or "").strip()
    # A document type may define entities that grow without bound, so such documents are refused.
    if not stripped.startswith("<") or "<!doctype" in stripped.lower():
        return None
    root = None
    for candidate in (stripped, f"<root>{stripped}</root>"):
        try:
            root = ElementTree.fromstring(candidate)
            break
        except ElementTree.ParseError:
            continue
    if root is None:
        return None
    nodes = [root] if root.tag.lower() == "text" else list(root.iter("text"))
    return [{"body": "".join(n.itertext()), "attributes": dict(n.attrib)} for n in nodes] or None


def xml_nodes(c: Column | str) -> Column:
    """The `<text>` nodes at any depth of a document or fragment. Files of one record per `<text>` row read
    better through `sources.read_xml_texts`, which splits them."""

    @F.pandas_udf(XML_NODES)
    def nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Nodes take several times their texts' room in Python, so few are there at a time, whatever the batch.
        for payloads in batches:
            for start in range(0, len(payloads), XML_ROWS):
                yield payloads.iloc[start : start + XML_ROWS].map(_text_nodes)

    return nodes(_col(c))


def xml_record(node: Column, position: Column, facets: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(num, header, text, <facet>…) of one `<text>` node; its position, from 1, stands in for number and header."""
    attr = lambda name: F.try_element_at(node["attributes"], F.lit(name))
    number = strip(F.coalesce(F.nullif(attr("num"), F.lit("")), attr("id")))
    header = F.coalesce(
        *[blank_to_null(attr(k)) for k in HEADER_KEYS], F.concat(F.lit("Text "), position.cast("string"))
    )
    codes = [
        coerce_codes(F.coalesce(*[F.nullif(attr(k), F.lit("")) for k in keys])).alias(f"{name}_codes")
        for name, keys in (facets or XML_FACETS).items()
    ]
    num = F.coalesce(F.when(number.rlike(r"^[+-]?[0-9]+$"), number.try_cast("long")), position.cast("long"))
    return F.struct(num.alias("num"), header.alias("header"), strip(node["body"]).alias("text"), *codes)


def xml_rows(nodes: Column, facets: dict[str, tuple[str, ...]] | None = None) -> Column:
    facets = facets or XML_FACETS
    rows = F.filter(F.transform(nodes, lambda node, i: xml_record(node, i + 1, facets)), lambda r: r["text"] != "")
    return F.transform(rows, lambda r: _resolved(r, facets))


def parse_xml_texts(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """(keys, num, header, text, codes…) of `<text>` nodes."""
    nodes = df.select(*keys, xml_nodes(raw).alias("__nodes"))
    return nodes.select(*keys, F.inline(xml_rows(F.col("__nodes"))))


# --- theme assignments --------------------------------------------------------------------------------------------


def parse_answers(df: DataFrame, raw: str, keys: list[str], schema: str = ASSIGNMENTS_JSON) -> DataFrame:
    """The JSON object of every answer as a struct `doc`; `_corrupt` holds what could not be read."""
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    return df.select(*keys, F.from_json(extract_json_object(raw), schema, options).alias("doc"))


def _listed(answers: DataFrame, keys: list[str], field: str) -> DataFrame:
    # The outer form and a test afterwards: the plain form would test the parsed list beforehand and parse twice.
    readable = F.when(F.col("doc._corrupt").isNull(), F.col(f"doc.{field}"))
    return answers.select(*keys, F.posexplode_outer(readable).alias("pos", "item")).where("pos is not null")


def assignments(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, theme), both as text."""
    return _listed(answers, keys, "assignments").select(*keys, "item.id", "item.theme")


def new_themes(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, description) proposed on the way."""
    return _listed(answers, keys, "new_themes").select(*keys, "item.name", "item.description")


def rejected_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _corrupt) of the answers that are no JSON object."""
    return answers.where("doc is null or doc._corrupt is not null").select(*keys, "doc._corrupt")


# --- any text file ------------------------------------------------------------------------------------------------


def corpus_rows(c: Column | str, name: Column | str) -> Column:
    """array<struct(num, header, text, sn_codes, de_codes)> of a corpus in any known shape.

    The first shape that yields rows decides: JSON, XML, LaTeX sections, `Text N –` blocks, one text.
    """
    content = _col(c)

    def with_codes(rows: Column) -> Column:
        return F.transform(
            rows,
            lambda r, i: F.struct(
                (i + 1).cast("long").alias("num"), r["header"].alias("header"), r["text"].alias("text"),
                *[
                    resolve_codes(F.array().cast("array<string>"), r["header"], r["text"], p.upper()).alias(f"{p}_codes")
                    for p in ("sn", "de")
                ],
            ),
        )

    def one_text() -> Column:
        none = F.array().cast("array<string>")
        codes = [resolve_codes(none, F.lit(""), content, p.upper()).alias(f"{p}_codes") for p in ("sn", "de")]
        return F.array(
            F.struct(F.lit(1).cast("long").alias("num"), _col(name).alias("header"), strip(content).alias("text"), *codes)
        )

    from_json = json_texts(content)
    from_xml = xml_rows(xml_nodes(F.when(strip(content).startswith("<"), content)))
    filled = lambda rows: let(rows, lambda r: F.when(F.size(r) > 0, r))
    return F.coalesce(
        filled(from_json), filled(from_xml), filled(with_codes(section_blocks(content, any_case=True))),
        filled(with_codes(text_blocks(content))), one_text(),
    )
