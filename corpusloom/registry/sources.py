"""Sources and sinks: the tables are written in the format at hand and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.functions import text as tx
from corpusloom.operators import alignment as al
from corpusloom.operators import chapters as ch
from corpusloom.operators import facets as fc
from corpusloom.registry.columns import sql_clean_body, sql_title, sql_untag
from corpusloom.registry.core import query, sql_latex, sql_lines, sql_punct, sql_strip, table, texts
from corpusloom.schemas import THEMES_JSON
from corpusloom.session import scratch_path
from corpusloom.sources import large_texts, sinks, tables

_ORDERS = T.StructType([T.StructField(n, T.StringType()) for n in ("o_orderkey", "o_orderstatus", "o_orderpriority")])


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*_ORDERS.fieldNames())


@query("read_table", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def read_table(spark, sf):
    path = scratch_path(spark, "orders")
    sinks.write_table(_orders(spark, sf), path, format="csv")
    return tables.read_table(spark, path, _ORDERS, types={"o_orderkey": "long"}).drop("_corrupt")


_PAGES = T.StructType([T.StructField(n, T.StringType()) for n in ("page_id", "html")])


@query("read_table_multi_line", "SELECT page_id, html FROM pages")
def read_table_multi_line(spark, sf):
    path = scratch_path(spark, "pages")
    sinks.write_table(texts(spark, sf, "pages").select("page_id", "html"), path, format="csv")
    return tables.read_table(spark, path, _PAGES, multi_line=True, types={"page_id": "long"}).drop("_corrupt")


@query("union_batches", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def union_batches(spark, sf):
    path = scratch_path(spark, "batches")
    sinks.write_table(_orders(spark, sf).repartition("o_orderpriority"), path, format="csv")
    return tables.union_batches(spark, path, "part-", _ORDERS).select(
        F.col("o_orderkey").try_cast("long").alias("o_orderkey"), "o_orderstatus", "o_orderpriority"
    )


@query("read_responses", f"SELECT item_id, {sql_strip('text')} AS raw FROM benchmark")
def read_responses(spark, sf):
    path = scratch_path(spark, "responses")
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    found = tables.read_responses(spark, f"{path}/*/*.txt")
    return found.select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), tx.strip("raw").alias("raw")
    )


ITEMS = f"""i AS (SELECT item_id // 32 AS folder, item_id, 'item ' || item_id AS name, {sql_strip('text')} AS text,
     row_number() OVER (PARTITION BY item_id // 32 ORDER BY item_id) AS num FROM benchmark)"""


@query(
    "read_text_corpus",
    f"""WITH {ITEMS} SELECT folder, 'json' AS shape, num, name AS header, text FROM i
        UNION ALL SELECT folder, 'xml', num, name, text FROM i
        UNION ALL SELECT folder, 'tex', 2 * num - 1, name, text FROM i
        UNION ALL SELECT folder, 'tex', 2 * num, 'empty', '' FROM i
        UNION ALL SELECT folder, 'txt', num, 'Text 5 – ' || name, text FROM i
        UNION ALL SELECT item_id // 32, 'raw', 1, 'file', {sql_strip('string_agg(text, chr(10) ORDER BY item_id)')}
          FROM benchmark GROUP BY 1""",
)
def read_text_corpus(spark, sf):
    item = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    xml = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shapes = {
        "json": F.to_json(F.struct("text", item.alias("title"))),
        "xml": F.concat(F.lit('<text header="'), item, F.lit('">'), xml, F.lit("</text>")),
        "tex": F.concat(F.lit("\\SUBsection*{"), item, F.lit("}\n"), "text", F.lit("\n\\subsubsection{empty}")),
        "txt": F.concat(F.lit("Text 5 – "), item, F.lit("\n"), "text"),
        "raw": F.col("text"),
    }
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("shape"), c.alias("value")) for s, c in shapes.items()]))
    # A file holds the items of one range of ids, so its size does not grow with the table.
    items = table(spark, sf, "benchmark").withColumn("folder", F.floor(F.col("item_id") / 32))
    rows = items.select("folder", "item_id", cells.alias("f")).select("folder", "item_id", "f.*")
    path = scratch_path(spark, "corpus")
    placed = rows.repartition("shape", "folder").sortWithinPartitions("shape", "folder", "item_id")
    placed.drop("item_id").write.partitionBy("shape", "folder").text(path)
    found = tables.read_text_corpus(spark, f"{path}/*/*/*.txt")
    shape = F.regexp_extract("path", r"shape=(\w+)", 1)
    return found.select(
        F.regexp_extract("path", r"folder=(\d+)", 1).cast("long").alias("folder"), shape.alias("shape"), "num",
        F.when(shape == "raw", "file").otherwise(F.col("header")).alias("header"), "text",
    )


def _write_by_language(spark, sf, value, name):
    """A folder per language, its part files by name and the records in them ordered by id: written by ranges of ids, as one
    task per language would take in a large part of the table."""
    path = scratch_path(spark, name)
    rows = texts(spark, sf, "documents").select("lang", "doc_id", value.alias("value"))
    placed = rows.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    placed.drop("doc_id").write.partitionBy("lang").text(path)
    return f"{path}/*/*.txt"


def _written_lines(spark, sf):
    """A folder per language, ordered by id: English records by their own names, French ones spelled `Text` and followed by
    a comma, Spanish ones without number or header; German lines are cut off behind the text."""
    lang, text = F.col("lang"), F.col("text")
    whole = F.to_json(F.struct(F.col("doc_id").alias("num"), F.col("source").alias("title"), text.alias("text"), F.lit("sn3B").alias("sn")))
    french = F.concat(F.to_json(F.struct(text.alias("Text"), F.col("doc_id").cast("string").alias("Num"))), F.lit(","))
    cut = F.concat(F.lit("broken "), F.col("doc_id").cast("string"), F.lit(' {"text": "'))
    line = F.when(lang == "en", whole).when(lang == "fr", french).when(lang == "de", cut).otherwise(F.to_json(F.struct(text.alias("text"))))
    return _write_by_language(spark, sf, line, "lines")


@query(
    "read_json_lines",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents WHERE lang <> 'de')
        SELECT lang, CASE WHEN lang IN ('en', 'fr') THEN doc_id ELSE i END AS num,
          CASE lang WHEN 'en' THEN source ELSE 'Text ' || i END AS header, {sql_strip('text')} AS text,
          CASE lang WHEN 'en' THEN 'SN3b' ELSE '' END AS sn, '' AS de FROM p""",
)
def read_json_lines(spark, sf):
    rows = tables.read_json_lines(spark, _written_lines(spark, sf), folders=True)
    return rows.select(
        F.regexp_extract("path", r"lang=(\w+)", 1).alias("lang"), "num", "header", "text",
        F.array_join("sn_codes", ",").alias("sn"), F.array_join("de_codes", ",").alias("de"),
    )


@query("read_json_lines_rejects", """SELECT 'broken ' || doc_id || ' {"text": "' AS line FROM documents WHERE lang = 'de'""")
def read_json_lines_rejects(spark, sf):
    return tables.read_json_lines_rejects(spark, _written_lines(spark, sf), folders=True).select("line")


def _lang():
    return F.regexp_extract("path", r"lang=(\w+)", 1).alias("lang")


@query(
    "read_text_blocks",
    f"""SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS num, 'Text ' || doc_id || ' – ' || source AS header,
        {sql_strip('text')} AS text FROM documents""",
)
def read_text_blocks(spark, sf):
    value = F.concat(F.lit("\n Text "), F.col("doc_id").cast("string"), F.lit(" – "), "source", F.lit("\n"), "text")
    return large_texts.read_text_blocks(spark, _write_by_language(spark, sf, value, "files"), folders=True).select(_lang(), "num", "header", "text")


@query(
    "read_sections",
    f"""SELECT lang, 2 * row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS num, source AS header,
        {sql_strip('text')} || chr(10) || '\\subset ' || doc_id AS text FROM documents""",
)
def read_sections(spark, sf):
    value = F.concat(
        F.lit("\\subsubsection*{"), "source", F.lit("}"), tx.strip("text"), F.lit("\n\\subset "), F.col("doc_id").cast("string"),
        F.lit("\n\\subsection{empty}\n\\subsections are none"),
    )
    return large_texts.read_sections(spark, _write_by_language(spark, sf, value, "files"), folders=True).select(_lang(), "num", "header", "text")


@query(
    "read_segments",
    f"""SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS X, {sql_strip('text')} AS segment FROM documents""",
)
def read_segments(spark, sf):
    value = F.concat(F.lit(" >||< \n>||<"), "text", F.lit("\n"))
    return large_texts.read_segments(spark, _write_by_language(spark, sf, value, "files"), folders=True).select(_lang(), "X", "segment")


@query(
    "read_xml_texts",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents)
        SELECT lang, CASE lang WHEN 'en' THEN doc_id ELSE 2 * i - 1 END AS num, CASE lang WHEN 'en' THEN source ELSE 'Text ' || 2 * i - 1 END AS header,
          {sql_strip(sql_punct('text'))} AS text, 'SN5' AS sn, '' AS de FROM p
        UNION ALL SELECT lang, 2 * i, 'n' || doc_id, 'inner DE2 tail', '', 'DE2' FROM p""",
)
def read_xml_texts(spark, sf):
    plain = tx.normalize_punct("text")
    escaped = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    key = F.col("doc_id").cast("string")
    head = F.when(F.col("lang") == "en", F.concat(F.lit(" num='"), key, F.lit("' title='"), "source", F.lit("'"))).otherwise(F.lit(" title=' '"))
    value = F.concat(
        F.lit("<part><text sn='sn5'"), head, F.lit(">"), escaped, F.lit("</text></part>\n<text name='n"), key,
        F.lit("'>inner <b>DE2</b> tail</text>"),
    )
    found = tables.read_xml_texts(spark, _write_by_language(spark, sf, value, "xml"), folders=True)
    return found.select(
        F.regexp_extract("path", r"lang=(\w+)", 1).alias("lang"), "num", "header", "text",
        F.array_join("sn_codes", ",").alias("sn"), F.array_join("de_codes", ",").alias("de"),
    )


@query(
    "check_columns",
    """SELECT 'labels' AS "table", count(*) AS n_rows, 'missing title;extra quality;extra toxic' AS differences FROM labels
       UNION ALL SELECT 'pages', count(*), 'missing doc_id;extra page_id;extra url;extra html' FROM pages
       UNION ALL SELECT 'documents', count(*), '' FROM documents""",
)
def check_columns(spark, sf):
    """Rows of each table and how its header differs from an expected one."""
    expected = {"labels": ["doc_id", "title"], "pages": ["doc_id"], "documents": ["doc_id", "text", "lang", "source", "n_chars"]}
    found = []
    for name, columns in expected.items():
        df = table(spark, sf, name)
        differences = ";".join(schemas.check_columns(df, columns, "warn"))
        found.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.lit(differences).alias("differences")))
    return al.union_tables(found)


@query(
    "read_catalogue",
    "SELECT p_partkey, 0 AS seq, p_name AS name, p_type AS description, p_brand || ',' || p_size AS keywords FROM part",
)
def read_catalogue(spark, sf):
    theme = F.struct(
        F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_type").alias("description"),
        F.array("p_brand", F.col("p_size").cast("string")).alias("keywords"),
    )
    nameless = F.struct(F.lit(" ").alias("name"), F.lit("x").alias("description"), F.array(F.lit("y")).alias("keywords"))
    raw = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.array(theme, nameless).alias("themes"))).alias("raw"))
    parsed = tables.parse_documents(raw, "raw", ["p_partkey"], THEMES_JSON)
    rows = tables.catalogue_rows(parsed, ["p_partkey"])
    return rows.withColumn("keywords", F.array_join("keywords", ","))


@query(
    "latest_file",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
       FROM events) WHERE rn = 1""",
)
def latest_file(spark, sf):
    return tables.latest(table(spark, sf, "events"), ["user_id"], "event_id", ["ts", "event_id"])


@query(
    "latest_run",
    """SELECT p_name, 'run_' || max(p_size) AS latest, max(p_size) + 1 AS next_index FROM part WHERE p_type <> 'SMALL' GROUP BY 1""",
)
def latest_run(spark, sf):
    name = F.concat(F.lit("run_"), F.col("p_size").cast("string"), F.when(F.col("p_type") == "SMALL", "_x").otherwise(""))
    return tables.latest_run(table(spark, sf, "part").select("p_name", name.alias("run")), ["p_name"], "run")


@query(
    "write_table",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def write_table(spark, sf):
    path = scratch_path(spark, "orders")
    orders = _orders(spark, sf)
    sinks.write_table(orders, path, partition_by=["o_orderstatus"])
    # The second write replaces its own partition only.
    sinks.write_table(orders.where("o_orderstatus = 'O'").withColumn("o_orderpriority", F.lit("new")), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path)


@query("write_json_doc", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def write_json_doc(spark, sf):
    path = scratch_path(spark, "customers")
    sinks.write_json_doc(table(spark, sf, "customer"), path, ["c_custkey", "c_name", "c_acctbal"])
    return spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(path)


HEADED = "(SELECT doc_id, '% ' || source || chr(10) || text AS text FROM documents)"
SQL_MERGED = f"""m AS (SELECT doc_id, {sql_strip(f"array_to_string(list_filter({sql_lines('text')}, lambda l: NOT starts_with(l, '%')), chr(10))")} AS t FROM {HEADED}),
   l AS (SELECT doc_id, list_append(string_split(t, chr(10)), '') AS ls FROM m)"""


def _headed(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.concat(F.lit("% "), "source", F.lit("\n"), "text").alias("text"))


@query(
    "merged_lines",
    f"WITH {SQL_MERGED} SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l",
)
def merged_lines(spark, sf):
    return sinks.merged_lines(_headed(spark, sf), ["doc_id"], "simple")


@query(
    "merge_texts",
    f"""WITH {SQL_MERGED}, r AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l)
        SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS line_no, line FROM r""",
)
def merge_texts(spark, sf):
    path = scratch_path(spark, "merged")
    sinks.merge_texts(_headed(spark, sf), path, ["doc_id"], "simple")
    return tables.read_ordered_text(spark, path).select("line_no", "line")


@query(
    "append_texts",
    f"""WITH t AS (SELECT {sql_strip('text')} AS t FROM conversations), r AS (SELECT unnest(list_append(string_split(t, chr(10)), '')) AS line FROM t)
        SELECT line, count(*) AS n FROM r GROUP BY 1""",
)
def append_texts(spark, sf):
    path = scratch_path(spark, "appended")
    chat = texts(spark, sf, "conversations")
    for role in ("system", "user", "assistant"):
        sinks.append_texts(chat.where(F.col("role") == role), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _slots(spark, sf):
    chat = texts(spark, sf, "conversations").where("role <> 'system'")
    header = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return chat.select(F.col("role").alias("slot"), "conv_id", F.floor(F.col("turn") / 2).alias("exchange"), header.alias("header"), "text")


@query(
    "export_selection",
    """SELECT role AS slot, conv_id, turn // 2 AS exchange, conv_id || '/' || turn AS header,
         '\\subsubsection{' || conv_id || '/' || turn || '}' || chr(10) || text AS content
       FROM conversations c WHERE role <> 'system' AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id
         AND a.turn // 2 = c.turn // 2 AND a.role = 'assistant')""",
)
def export_selection(spark, sf):
    slots = _slots(spark, sf)
    return fc.selected_texts(slots, slots.where("slot = 'assistant'"), ["conv_id", "exchange"])


@query(
    "export_selection_files",
    """WITH s AS (SELECT role, conv_id, turn, '\\subsubsection{' || conv_id || '/' || turn || '}' || chr(10) || text || chr(10) AS t
         FROM conversations c WHERE role <> 'system' AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id
         AND a.turn // 2 = c.turn // 2 AND a.role = 'assistant')), r AS (SELECT role AS slot, conv_id, turn, unnest(range(len(string_split(t, chr(10))))) AS i, unnest(string_split(t, chr(10))) AS line FROM s)
       SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY conv_id, turn, i) - 1 AS line_no, line FROM r""",
)
def export_selection_files(spark, sf):
    path = scratch_path(spark, "selection")
    slots = _slots(spark, sf)
    sinks.export_selection(slots, slots.where("slot = 'assistant'"), path, ["conv_id", "exchange"])
    lines = tables.read_ordered_text(spark, f"{path}/texts").select(
        "line_no", "line", F.regexp_extract("path", r"slot=(\w+)", 1).alias("slot")
    )
    first = lines.groupBy("slot").agg(F.min("line_no").alias("first"))
    return lines.join(first, "slot").select("slot", (F.col("line_no") - F.col("first")).alias("line_no"), "line")


@query(
    "chapter_documents",
    """SELECT lang AS chapter_id, lang AS title, doc_id // 100 AS block, string_agg(doc_id, ',' ORDER BY doc_id) AS num_list
       FROM documents GROUP BY ALL""",
)
def chapter_documents(spark, sf):
    members = texts(spark, sf, "documents").select(
        F.col("lang").alias("chapter_id"), F.col("lang").alias("title"), F.col("doc_id").alias("num")
    )
    return sinks.chapter_documents(members, 100).withColumn("num_list", F.array_join("num_list", ","))


# --- the book -----------------------------------------------------------------------------------------------------

BOOK = f"""c AS (SELECT doc_id AS num, source AS topic, CASE WHEN lang = 'en' THEN '' ELSE lang || ' & ' || doc_id END AS advice,
     CAST(quality AS VARCHAR) AS code_sn, CAST(toxic AS VARCHAR) AS code_de,
     CASE WHEN lang = 'de' THEN 'STYLE: ' || text ELSE text END AS raw FROM documents LEFT JOIN labels USING (doc_id)),
   h AS (SELECT *, {sql_clean_body('raw')} AS t FROM c),
   b AS (SELECT *, {sql_untag('t')} AS body FROM h),
   x AS (SELECT num, num || '. ' || {sql_latex(sql_title('num', 'advice', 'topic', ['code_sn', 'code_de']))} AS head,
           {sql_latex('body')} AS body FROM b WHERE body <> ''),
   lines AS (SELECT num, ['\\section*{{' || head || '}}', '\\addcontentsline{{toc}}{{section}}{{' || head || '}}', '', body, ''] AS ls FROM x)"""


def _book_corpus(spark, sf):
    docs, labels = texts(spark, sf, "documents"), table(spark, sf, "labels")
    advice = F.when(F.col("lang") == "en", "").otherwise(F.concat("lang", F.lit(" & "), F.col("doc_id").cast("string")))
    body = F.when(F.col("lang") == "de", F.concat(F.lit("STYLE: "), "text")).otherwise(F.col("text"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("num"), F.col("source").alias("topic"), advice.alias("advice"),
        F.col("quality").cast("string").alias("code_sn"), F.col("toxic").cast("string").alias("code_de"), body.alias("body"),
    )


@query(
    "book_lines_flat",
    f"WITH {BOOK} SELECT 0 AS chapter_pos, num AS num_pos, unnest(range(5)) AS line_no, unnest(ls) AS line FROM lines",
)
def book_lines_flat(spark, sf):
    return ch.book_lines(_book_corpus(spark, sf), None)


@query(
    "book_lines",
    f"""WITH {BOOK}, p AS (SELECT doc_id AS num, dense_rank() OVER (ORDER BY source) AS pos, source AS title
          FROM documents SEMI JOIN labels USING (doc_id)),
        m AS (SELECT * FROM p UNION ALL SELECT doc_id, 2147483648, 'Other' FROM documents ANTI JOIN labels USING (doc_id)),
        heads AS (SELECT DISTINCT pos, ['\\chapter{{' || title || '}}', ''] ||
            CASE WHEN r_name IS NULL THEN [] ELSE ['\\begin{{quote}}\\small about ' || r_name || '\\end{{quote}}', ''] END AS ls
          FROM m LEFT JOIN region ON title = 'src' || r_regionkey)
        SELECT pos AS chapter_pos, num AS num_pos, unnest(range(5)) AS line_no, unnest(ls) AS line FROM m JOIN lines USING (num)
        UNION ALL SELECT pos, -1, unnest(range(len(ls))), unnest(ls) FROM heads""",
)
def book_lines(spark, sf):
    labelled = texts(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    assigned = labelled.select(F.col("doc_id").alias("id"), F.col("source").alias("theme"))
    members = ch.chapters_from_themes(ch.theme_members(assigned))
    themes = table(spark, sf, "region").select(
        F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("name"), F.concat(F.lit("about "), "r_name").alias("description")
    )
    return ch.book_lines(_book_corpus(spark, sf), members, themes)


