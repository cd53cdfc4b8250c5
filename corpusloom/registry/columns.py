"""Row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import codes as cd
from corpusloom.functions import requests as rq
from corpusloom.functions import text as tx
from corpusloom.registry.core import (
    RE_SPACE, query, sql_blank, sql_latex, sql_lines, sql_punct, sql_strip, table, texts,
)

S = f"[{RE_SPACE}]"


@query("non_blank", f"SELECT doc_id, text FROM documents WHERE NOT {sql_blank('text')}")
def non_blank(spark, sf):
    return texts(spark, sf, "documents").where(~tx.is_blank("text")).select("doc_id", "text")


@query(
    "coalesce_text",
    f"""SELECT u.conv_id, u.turn,
          CASE WHEN NOT {sql_blank('a.text')} THEN a.text ELSE coalesce(u.text, '') END AS body
        FROM conversations u LEFT JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'""",
)
def coalesce_text(spark, sf):
    chat = texts(spark, sf, "conversations")
    asked = chat.where("role = 'user'")
    answered = chat.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated")
    )
    joined = asked.join(answered, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", tx.coalesce_text("generated", "text").alias("body"))


@query(
    "flag_bad",
    "SELECT event_id, CAST(event_type IN ('error', 'click') AS INT) AS bad FROM events",
)
def flag_bad(spark, sf):
    kind = F.col("event_type")
    note = F.when(kind == "error", "x bad_field2").when(kind == "click", "BAD_").otherwise("notBAD_ bad")
    return table(spark, sf, "events").select("event_id", tx.flag_bad("props", note).cast("int").alias("bad"))


SLUG_WORDS = (
    "trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7f]', '', 'g')), "
    "'[^a-z0-9\\t-\\r\\x1c-\\x20-]', ' ', 'g'), '[\\t-\\r\\x1c-\\x20]+', ' ', 'g'))"
)


def sql_slug(x: str, n: int = 30) -> str:
    s = f"replace({SLUG_WORDS.format(x=x)}, ' ', '-')"
    return f"CASE WHEN length({s}) > {n} THEN rtrim(left({s}, {n - 7}), '-') || '-' || left(sha1({s}), 6) ELSE {s} END"


@query("slugify", f"SELECT doc_id, {sql_slug('text')} AS slug FROM documents")
def slugify(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.slugify("text").alias("slug"))


@query(
    "dataset_name",
    f"""SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || '_Merged_' || ({sql_slug('p_name')})
          || '.csv' AS name FROM part""",
)
def dataset_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.dataset_name("p_type", "Merged", "p_name").alias("name"))


@query("normalize_punct", f"SELECT page_id, {sql_punct('html')} AS plain FROM pages")
def normalize_punct(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.normalize_punct("html").alias("plain"))


@query("latex_escape", f"SELECT page_id, {sql_latex('html')} AS escaped FROM pages")
def latex_escape(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.latex_escape("html").alias("escaped"))


TAG_NAMES = "SN|DE|K|STYLE|VARIANT|NEUTRAL"


def sql_clean_body(x: str) -> str:
    """A SELECT expression; the steps are nested from the inside out."""
    t = sql_strip(x)
    fenced = f"starts_with({t}, '```') AND ends_with({t}, '```') AND length({t}) > 6"
    t = f"(CASE WHEN {fenced} THEN {sql_strip(f'substr({t}, 4, length({t}) - 6)')} ELSE {t} END)"
    t = f"trim({t}, ' \n\"“”«»')"
    lines = f"list_transform({sql_lines(t)}, lambda ln: rtrim(ln, '{tx.SPACES}'))"
    t = f"ltrim(array_to_string({lines}, '\n'), '\n')"
    return t


def sql_untag(t: str) -> str:
    """The second half of the cleaning, on a column `t` that holds the first half's result."""
    first = f"split_part({t}, '\n', 1)"
    rest = f"substr({t}, length({first}) + 1)"
    tag_line = f"(?i)^{S}*(?:{TAG_NAMES}){S}*[:=\\-]?{S}*$"
    bracket = f"(?i)^{S}*\\[(?:{TAG_NAMES})[^\\]]*\\]{S}*$"
    prefix = f"(?i)^{S}*(?:{TAG_NAMES}){S}*[:=\\-]{S}*"
    kept = f"ltrim(regexp_replace({first}, '{prefix}', ''), '{tx.SPACES}') || {rest}"
    drop = f"regexp_matches({first}, '{tag_line}') OR regexp_matches({first}, '{bracket}')"
    return sql_strip(f"(CASE WHEN {drop} THEN {rest} ELSE {kept} END)")


@query(
    "clean_body",
    f"""WITH raw AS (SELECT doc_id, source, lang,
            CASE lang WHEN 'en' THEN '```' || chr(10) || 'SN: ' || text || '  ' || chr(10) || '```'
                      WHEN 'fr' THEN '« [STYLE plain] ' || chr(10) || text || ' »'
                      WHEN 'de' THEN 'Neutral - ' || text ELSE text || '   ' END AS body FROM documents),
          half AS (SELECT doc_id, {sql_clean_body('body')} AS t FROM raw)
        SELECT doc_id, {sql_untag('t')} AS body FROM half""",
)
def clean_body(spark, sf):
    body = (
        F.when(F.col("lang") == "en", F.concat(F.lit("```\nSN: "), "text", F.lit("  \n```")))
        .when(F.col("lang") == "fr", F.concat(F.lit("« [STYLE plain] \n"), "text", F.lit(" »")))
        .when(F.col("lang") == "de", F.concat(F.lit("Neutral - "), "text"))
        .otherwise(F.concat("text", F.lit("   ")))
    )
    raw = texts(spark, sf, "documents").select("doc_id", body.alias("body"))
    return raw.select("doc_id", tx.clean_body("body").alias("body"))


@query(
    "filter_headers",
    f"""WITH raw AS (SELECT doc_id, '% ' || source || chr(10) || '### ' || lang || chr(10) || text AS t FROM documents)
        SELECT doc_id,
          array_to_string(list_filter({sql_lines('t')}, lambda ln: NOT starts_with(ln, '%')), chr(10)) AS simple,
          array_to_string(list_filter({sql_lines('t')}, lambda ln: NOT starts_with(ln, '%')
            AND NOT starts_with(ln, '###') AND NOT starts_with(ln, '\\')), chr(10)) AS bare
        FROM raw""",
)
def filter_headers(spark, sf):
    raw = texts(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("% "), "source", F.lit("\n### "), "lang", F.lit("\n"), "text").alias("t")
    )
    return raw.select(
        "doc_id", tx.filter_headers("t", "simple").alias("simple"), tx.filter_headers("t", "none").alias("bare")
    )


def sql_title(num: str, advice: str, topic: str, codes: list[str]) -> str:
    def filled(x):
        return f"nullif({sql_strip(x)}, '')"

    title = f"coalesce({filled(advice)}, {filled(topic)}, 'Text ' || {num})"
    label = f"regexp_extract({title}, '(?i)^{S}*Text{S}*')"
    after = f"substr({title}, length({label}) + 1)"
    rest = f"regexp_replace(substr({after}, length({num}::VARCHAR) + 1), '^{S}*[-–—:]?{S}*', '')"
    title = f"(CASE WHEN {label} <> '' AND starts_with({after}, {num}::VARCHAR) THEN {rest} ELSE {title} END)"
    title = f"trim(regexp_replace({title}, '^{S}*[0-9]+{S}*[.)-]{S}*', ''), ' \t-–—.:')"
    return f"concat_ws(' - ', {title}, {', '.join(filled(c) for c in codes)})"


@query(
    "build_title",
    f"""SELECT o_orderkey, {sql_title('o_orderkey',
          "(CASE o_orderstatus WHEN 'F' THEN 'Text ' || o_orderkey || ' – ' || o_orderpriority || '.' "
          "WHEN 'P' THEN o_orderpriority END)", "(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'x' END)",
          ['o_orderstatus'])} AS title FROM orders""",
)
def build_title(spark, sf):
    orders = table(spark, sf, "orders")
    label = F.concat(F.lit("Text "), F.col("o_orderkey").cast("string"), F.lit(" – "), "o_orderpriority", F.lit("."))
    advice = F.when(F.col("o_orderstatus") == "F", label).when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    topic = F.when(F.col("o_orderstatus") != "O", F.lit("x"))
    return orders.select(
        "o_orderkey", tx.build_title("o_orderkey", advice, topic, ["o_orderstatus"]).alias("title")
    )


@query("excerpt_ends", "SELECT doc_id, left(text, 15) AS head, right(text, 15) AS tail FROM documents")
def excerpt_ends(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", tx.excerpt_start("text").alias("head"), tx.excerpt_end("text").alias("tail")
    )


@query(
    "extract_codes",
    r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(
          regexp_extract_all(t, '(?i)\bbrand[0-9]+[A-Za-z]*\b'), lambda m: upper(left(m, 5)) || lower(substr(m, 6))))), ',') AS codes
        FROM (SELECT p_partkey, p_name || ' (' || replace(p_brand, '#', '') || ', ' || lower(replace(p_brand, '#', ''))
          || 'XY) pre' || replace(p_brand, '#', '') || ' ' || p_type AS t FROM part)""",
)
def extract_codes(spark, sf):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    text = F.concat(
        "p_name", F.lit(" ("), brand, F.lit(", "), F.lower(brand), F.lit("XY) pre"), brand, F.lit(" "), "p_type"
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(cd.extract_codes(text, "Brand"), ",").alias("codes"))


@query(
    "coerce_codes",
    r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(
          regexp_split_to_array(t, '[,\s]+'), lambda x: upper(regexp_extract(x, '^([A-Za-z]+)([0-9]+)([A-Za-z]*)', 1))
            || regexp_extract(x, '^([A-Za-z]+)([0-9]+)([A-Za-z]*)', 2)
            || lower(regexp_extract(x, '^([A-Za-z]+)([0-9]+)([A-Za-z]*)', 3))), lambda y: y <> ''))), ',') AS codes
        FROM (SELECT p_partkey, replace(p_brand, '#', '') || 'C-9, sn' || p_size || 'A  ' || p_name AS t FROM part)""",
)
def coerce_codes(spark, sf):
    text = F.concat(
        F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("C-9, sn"), F.col("p_size").cast("string"), F.lit("A  "), "p_name"
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(cd.coerce_codes(text), ",").alias("codes"))


@query(
    "resolve_codes",
    r"""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'GIVEN' || p_size ELSE 'BRAND' || replace(p_brand, 'Brand#', '') END
          AS codes FROM part""",
)
def resolve_codes(spark, sf):
    explicit = cd.coerce_codes(F.when(F.col("p_size") > 25, F.concat(F.lit("given"), F.col("p_size").cast("string"))))
    header = F.concat("p_name", F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(cd.resolve_codes(explicit, header, "p_type", "Brand"), ",").alias("codes")
    )


@query(
    "strip_trailing_codes",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' (' || p_type || ')' ELSE p_name END AS header FROM part",
)
def strip_trailing_codes(spark, sf):
    size = F.col("p_size").cast("string")
    header = F.when(
        F.col("p_size") > 25, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    ).otherwise(F.concat("p_name", F.lit(" – ( SN"), size, F.lit("a, de"), size, F.lit(") ")))
    return table(spark, sf, "part").select("p_partkey", cd.strip_trailing_codes(header, "SN", "DE").alias("header"))


@query(
    "natural_code_key",
    r"""WITH b AS (SELECT DISTINCT replace(p_brand, '#', '') AS code FROM part)
        SELECT code, regexp_extract(code, '^[A-Za-z]+') AS prefix, CAST(regexp_extract(code, '[0-9]+') AS INT) AS number,
          row_number() OVER (ORDER BY regexp_extract(code, '^[A-Za-z]+'), CAST(regexp_extract(code, '[0-9]+') AS INT)) AS place
        FROM b""",
)
def natural_code_key(spark, sf):
    from corpusloom.operators.alignment import renumber

    brands = table(spark, sf, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("code")).distinct()
    keyed = brands.select("code", cd.natural_code_key("code").alias("key"))
    return renumber(keyed, ["key"], "place").select(
        "code", "key.prefix", F.col("key.number").cast("int").alias("number"), "place"
    )


@query("match_search", "SELECT doc_id FROM documents WHERE contains(lower(source), 'tion') OR contains(lower(text), 'tion')")
def match_search(spark, sf):
    return texts(spark, sf, "documents").where(cd.match_search(" TION ", "source", "text")).select("doc_id")


@query(
    "facet_filter",
    """SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'SMALL')
         AND (p_brand IN ('Brand#2', 'Brand#4', 'Brand#17') OR split_part(p_name, ' ', 1) = 'Brand#2')""",
)
def facet_filter(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.array("p_type").alias("kinds"), F.array(F.col("p_brand"), F.split("p_name", " ")[0]).alias("codes")
    )
    keep = cd.facet_filter("kinds", ["ECONOMY", "SMALL"]) & cd.facet_filter("codes", ["Brand#2", "Brand#4", "Brand#17"])
    return rows.where(keep & cd.facet_filter("codes", [])).select("p_partkey")


@query(
    "estimate_tokens",
    "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS n_tokens FROM documents",
)
def estimate_tokens(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", rq.estimate_tokens("text").alias("n_tokens"))


MODEL_SPEC = {
    "1-URGENT": "OpenAI\\/gpt-4o", "2-HIGH": "mistral:7b-", "3-MEDIUM": "org/model-", "4-NOT SPECIFIED": "Gemini/flash ",
    "5-LOW": "llama3-",
}


@query(
    "split_model_spec",
    """SELECT o_orderkey,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'openai' WHEN '2-HIGH' THEN 'mistral' WHEN '3-MEDIUM' THEN 'openrouter'
           WHEN '4-NOT SPECIFIED' THEN 'gemini' ELSE 'ollama' END AS provider,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'gpt-4o' WHEN '2-HIGH' THEN '7b-' WHEN '3-MEDIUM' THEN 'org/model-'
           WHEN '4-NOT SPECIFIED' THEN 'flash ' ELSE 'llama3-' END || o_orderstatus AS model FROM orders""",
)
def split_model_spec(spark, sf):
    orders = table(spark, sf, "orders")
    spec = F.lit(None).cast("string")
    for priority, text in MODEL_SPEC.items():
        spec = F.when(F.col("o_orderpriority") == priority, text).otherwise(spec)
    parts = rq.split_model_spec(F.concat(spec, "o_orderstatus"))
    return orders.select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.provider", "p.model")


@query(
    "guess_provider",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'openai' WHEN 'SMALL' THEN 'mistral' WHEN 'LARGE' THEN 'ollama'
         WHEN 'MEDIUM' THEN 'openrouter' WHEN 'PROMO' THEN 'gemini' ELSE 'openai' END AS provider FROM part""",
)
def guess_provider(spark, sf):
    kind = F.col("p_type")
    prefix = (
        F.when(kind == "ECONOMY", "GPT-").when(kind == "SMALL", "codestral ").when(kind == "LARGE", "my-gemma ")
        .when(kind == "MEDIUM", "who/").when(kind == "PROMO", "google/").otherwise("plain ")
    )
    model = F.concat(prefix, "p_name")
    return table(spark, sf, "part").select("p_partkey", rq.guess_provider(model).alias("provider"))


@query(
    "flatten_messages",
    """SELECT conv_id, turn // 2 AS exchange,
         string_agg('[' || upper(role) || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS prompt
       FROM conversations GROUP BY ALL""",
)
def flatten_messages(spark, sf):
    # An exchange is two turns, whatever the length of the conversation.
    chat = texts(spark, sf, "conversations").withColumn("exchange", F.floor(F.col("turn") / 2))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return chat.groupBy("conv_id", "exchange").agg(rq.flatten_messages(turns).alias("prompt"))


def sql_redact(x: str) -> str:
    for _, pattern, groups, literal in rq.SECRET_PATTERNS:
        kept = "".join(f"\\{i}" for i in range(1, groups + 1))
        escaped = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{escaped}', '{kept}{literal}{rq.REDACTED}', 'g')"
    return x


@query("redact_secrets", f"SELECT doc_id, {sql_redact('text')} AS text FROM documents")
def redact_secrets(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", rq.redact_secrets("text").alias("text"))


@query(
    "context_block",
    """SELECT c_custkey, '[SN] ' || c_mktsegment || chr(10) || '[K] Character=' || c_name ||
         CASE WHEN c_acctbal < 0 THEN '' ELSE ' | Place=' || c_nationkey END AS block FROM customer""",
)
def context_block(spark, sf):
    place = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string"))
    block = tx.context_block({"Character": F.col("c_name"), "Place": place}, {"SN": F.col("c_mktsegment"), "DE": F.lit(" ")})
    return table(spark, sf, "customer").select("c_custkey", block.alias("block"))


@query("mean_std_label", "SELECT o_orderkey, format('{:.2f} ({:.2f})', o_totalprice, o_totalprice / 8) AS label FROM orders")
def mean_std_label(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", tx.mean_std_label("o_totalprice", F.col("o_totalprice") / 8).alias("label")
    )


@query(
    "percent_label",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, format('{:.1f}%', l_discount * 100) AS label FROM lineitem",
)
def percent_label(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.percent_label("l_discount").alias("label")
    )


@query(
    "extract_json_object",
    "SELECT event_id, props AS json, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
)
def extract_json_object(spark, sf):
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone {x}.")))
        .when(kind == "error", F.concat(F.lit("Sure, "), "props", F.lit(" is it")))
        .otherwise(F.col("props"))
    )
    found = table(spark, sf, "events").select("event_id", rq.extract_json_object(answer).alias("json"))
    return found.select("event_id", "json", F.from_json("json", "k int")["k"].alias("k"))
