"""Parsers, on raw texts that Spark puts together from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import parsing as ps
from corpusloom.registry.core import query, sql_lines, sql_punct, sql_strip, table, texts


def _documents(spark, sf):
    return texts(spark, sf, "documents")


def sql_non_blank(items: str) -> str:
    return f"list_filter(list_transform({items}, lambda x: {sql_strip('x')}), lambda x: x <> '')"


def sql_segments(x: str) -> str:
    """array of segments of a text expression."""
    pieces = sql_non_blank(f"string_split({x}, '>||<')")
    paragraphs = sql_non_blank(
        f"flatten(list_transform({pieces}, lambda p: regexp_split_to_array(p, '\\n\\s*\\n')))"
    )
    sentences = sql_non_blank(
        "string_split(regexp_replace(par, '([.!?])\\s+([A-ZÀ-ÖØ-Þ0-9])', '\\1' || chr(31) || '\\2', 'g'), chr(31))"
    )
    grouped = (
        f"list_transform(range(0, len({sentences}), 7), lambda i: array_to_string(({sentences})[i + 1:i + 7], ' '))"
    )
    return f"flatten(list_transform({paragraphs}, lambda par: {grouped}))"


SHAPED = """CASE lang WHEN 'fr' THEN replace(text, chr(10), chr(10) || ' ' || chr(10))
     WHEN 'de' THEN replace(text, chr(10), ' >||< ') ELSE text END"""


def _shaped():
    lang = F.col("lang")
    return (
        F.when(lang == "fr", F.replace("text", F.lit("\n"), F.lit("\n \n")))
        .when(lang == "de", F.replace("text", F.lit("\n"), F.lit(" >||< ")))
        .otherwise(F.col("text"))
    )


SEGMENTED = f"s AS (SELECT doc_id, {sql_segments('t')} AS g FROM (SELECT doc_id, {SHAPED} AS t FROM documents))"


@query(
    "segment_text",
    f"WITH {SEGMENTED} SELECT doc_id, unnest(range(1, len(g) + 1)) AS seq, unnest(g) AS segment FROM s",
)
def segment_text(spark, sf):
    return ps.segment_text(_documents(spark, sf).select("doc_id", _shaped().alias("t")), "t", ["doc_id"])


@query(
    "export_segments",
    f"""WITH {SEGMENTED}, r AS (SELECT doc_id, unnest(range(1, len(g) + 1)) AS X, unnest(g) AS segment FROM s)
        SELECT doc_id, "X", segment, left(segment, 15) AS debut_extrait, right(segment, 15) AS fin_extrait,
          '' AS name_SN, '' AS struct_SN, '' AS name_DE, '' AS struct_DE FROM r""",
)
def export_segments(spark, sf):
    marked = _documents(spark, sf).select("doc_id", ps.mark_text(_shaped()).alias("t"))
    return ps.export_segments(marked, "t", ["doc_id"])


SQL_ROWS = f"""l AS (SELECT doc_id, {sql_non_blank(sql_lines(sql_strip('text')))} AS ls FROM documents),
   r AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS raw_line FROM l),
   p AS (SELECT *, string_split(raw_line, ',') AS f FROM r)"""


@query(
    "repair_rows",
    f"""WITH {SQL_ROWS} SELECT doc_id, line_no, CASE WHEN len(f) = 3 THEN f[1] ELSE {sql_strip('f[1]')} END AS num,
          CASE WHEN len(f) = 3 THEN f[2] ELSE 'BAD_field2' END AS topic, CASE WHEN len(f) = 3 THEN f[3] ELSE 'BAD_field3' END AS advice,
          raw_line, len(f) <> 3 AS malformed FROM p""",
)
def repair_rows(spark, sf):
    return ps.repair_rows(_documents(spark, sf), "text", ["doc_id"], ["num", "topic", "advice"], ",")


@query("rejected_rows", f"WITH {SQL_ROWS} SELECT doc_id, line_no, raw_line FROM p WHERE len(f) <> 3")
def rejected_rows(spark, sf):
    return ps.rejected_rows(repair_rows(spark, sf), ["doc_id"])


@query(
    "parse_rewrites",
    f"""SELECT conv_id, turn AS num, CASE WHEN role = 'assistant' THEN 'again' ELSE {sql_strip('text')} END AS text FROM conversations""",
)
def parse_rewrites(spark, sf):
    number = F.col("turn").cast("string")
    once = F.concat(F.lit("[REWRITE 1 | Num="), number, F.lit("]\n"), "text", F.lit("\n"))
    again = F.when(
        F.col("role") == "assistant", F.concat(F.lit("[REWRITE] lost\n[rewrite 2 | num = "), number, F.lit("] again"))
    )
    raw = F.concat(F.lit("Here you are.\n"), once, F.coalesce(again, F.lit("")))
    answers = texts(spark, sf, "conversations").select("conv_id", raw.alias("raw"))
    return ps.parse_rewrites(answers, "raw", ["conv_id"])


@query(
    "parse_sections",
    f"""SELECT doc_id, 1 AS num, source AS header, {sql_strip('text')} AS text FROM documents
        UNION ALL SELECT doc_id, 3, lang, 'tail ' || doc_id FROM documents""",
)
def parse_sections(spark, sf):
    raw = F.concat(
        F.lit("% head\n\\subsubsection*{ "), "source", F.lit("}\n"), "text", F.lit("\n\\subsection{empty}\n \\subsection*{"),
        "lang", F.lit("}tail "), F.col("doc_id").cast("string"), F.lit("\n"),
    )
    return ps.parse_sections(_documents(spark, sf).select("doc_id", raw.alias("raw")), "raw", ["doc_id"])


@query(
    "parse_text_blocks",
    f"""SELECT doc_id, 1 AS num, 'Text 7 – ' || source AS header, {sql_strip('text')} AS text FROM documents
        UNION ALL SELECT doc_id, 2, 'text 12 - ' || lang, '' FROM documents""",
)
def parse_text_blocks(spark, sf):
    raw = F.concat(F.lit(" Text 7 – "), "source", F.lit("\n"), "text", F.lit("\n\n text 12 - "), "lang")
    return ps.parse_text_blocks(_documents(spark, sf).select("doc_id", raw.alias("raw")), "raw", ["doc_id"])


@query(
    "parse_json_texts",
    f"""SELECT doc_id, CASE lang WHEN 'en' THEN doc_id WHEN 'fr' THEN 2 ELSE 1 END AS num,
          CASE lang WHEN 'en' THEN source WHEN 'fr' THEN 'Text 2' WHEN 'de' THEN source ELSE 'Text 1' END AS header,
          {sql_strip('text')} AS text, CASE lang WHEN 'en' THEN 'SN3b' WHEN 'de' THEN 'SN2,SN4' ELSE '' END AS sn,
          CASE lang WHEN 'de' THEN 'DE1' ELSE '' END AS de
        FROM documents
        UNION ALL SELECT doc_id, 2, 'Text 2', 'SN9c and de4', 'SN9c', 'DE4' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')""",
)
def parse_json_texts(spark, sf):
    lang, source, text = F.col("lang"), F.col("source"), F.col("text")
    array = F.to_json(
        F.array(F.struct(text.alias("text"), source.alias("title"), F.col("doc_id").cast("string").alias("num"), F.lit("sn3B, ?").alias("sn")))
    )
    items = F.to_json(F.struct(F.array(F.struct(F.lit(" ").alias("Text")), F.struct(text.alias("Text"))).alias("items")))
    single = F.to_json(
        F.struct(text.alias("text"), source.alias("name"), F.array(F.lit("SN4 sn2")).alias("SN"), F.lit("de1").alias("de_codes"))
    )
    lines = F.concat(F.to_json(F.struct(text.alias("text"))), F.lit(',\n\n{"text": "SN9c and de4", "num": "x"},\n"no object"'))
    raw = F.when(lang == "en", array).when(lang == "fr", items).when(lang == "de", single).otherwise(lines)
    rows = ps.parse_json_texts(_documents(spark, sf).select("doc_id", raw.alias("raw")), "raw", ["doc_id"])
    return rows.select(
        "doc_id", "num", "header", "text", F.array_join("sn_codes", ",").alias("sn"), F.array_join("de_codes", ",").alias("de")
    )


def _xml(text):
    escaped = F.replace(tx.normalize_punct(text), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(escaped, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query(
    "parse_xml_texts",
    f"""SELECT doc_id, doc_id AS num, CASE WHEN lang = 'en' THEN source ELSE 'Text 1' END AS header,
          {sql_strip(sql_punct('text'))} AS text, 'SN5' AS sn, '' AS de FROM documents
        UNION ALL SELECT doc_id, 3, lang, 'inner DE2 tail', '', 'DE2' FROM documents""",
)
def parse_xml_texts(spark, sf):
    key = F.col("doc_id").cast("string")
    header = F.when(F.col("lang") == "en", F.concat(F.lit(' title="'), "source", F.lit('"'))).otherwise(F.lit(' title=" "'))
    body = F.concat(
        F.lit("<text id='"), key, F.lit("' sn='sn5'"), header, F.lit(">"), _xml("text"),
        F.lit("</text><text> </text><part><text name='"), "lang", F.lit("'>inner <b>DE2</b> tail</text></part>"),
    )
    raw = F.when(F.col("lang") == "fr", body).otherwise(F.concat(F.lit(" <corpus>"), body, F.lit("</corpus>")))
    rows = ps.parse_xml_texts(_documents(spark, sf).select("doc_id", raw.alias("raw")), "raw", ["doc_id"])
    return rows.select(
        "doc_id", "num", "header", "text", F.array_join("sn_codes", ",").alias("sn"), F.array_join("de_codes", ",").alias("de")
    )


def _answers(spark, sf):
    kind, key = F.col("event_type"), F.col("event_id")
    document = F.to_json(
        F.struct(
            F.array(F.struct(key.cast("string").alias("id"), kind.alias("theme")), F.struct(F.lit("x").alias("id"), F.lit("none").alias("theme"))).alias("assignments"),
            F.array(F.struct(F.concat(F.lit("new "), kind).alias("name"), F.col("props").alias("description"))).alias("new_themes"),
        )
    )
    raw = (
        F.when(kind == "error", F.concat(F.lit("{broken "), F.col("props")))
        .when(kind == "click", F.concat(F.lit("```JSON\n"), document, F.lit("\n```\n")))
        .otherwise(F.concat(F.lit("Sure! "), document))
    )
    return ps.parse_answers(table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw", ["event_id"])


@query(
    "parse_assignments",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS theme FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, 'x', 'none' FROM events WHERE event_type <> 'error'""",
)
def parse_assignments(spark, sf):
    return ps.assignments(_answers(spark, sf), ["event_id"])


@query(
    "parse_new_themes",
    "SELECT event_id, 'new ' || event_type AS name, props AS description FROM events WHERE event_type <> 'error'",
)
def parse_new_themes(spark, sf):
    return ps.new_themes(_answers(spark, sf), ["event_id"])


@query("rejected_answers", "SELECT event_id FROM events WHERE event_type = 'error'")
def rejected_answers(spark, sf):
    return ps.rejected_answers(_answers(spark, sf), ["event_id"]).select("event_id")
