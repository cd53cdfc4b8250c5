"""Joins, alignment and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import alignment as al
from corpusloom.operators import chapters as ch
from corpusloom.operators import facets as fc
from corpusloom.registry.core import query, sql_blank, table, texts
from corpusloom.schemas import CHAPTERS_JSON
from corpusloom.sources.tables import parse_documents


def _documents(spark, sf):
    return texts(spark, sf, "documents").withColumnRenamed("doc_id", "num")


def _labels(spark, sf):
    return table(spark, sf, "labels").withColumnRenamed("doc_id", "num")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("num"), "label")


@query(
    "assemble_corpus",
    f"""WITH v AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'variant of ' || doc_id ELSE ' ' END AS g FROM labels)
        SELECT d.doc_id AS num, d.source AS topic, d.lang AS advice, CAST(l.quality AS VARCHAR) AS code_sn,
          CAST(l.toxic AS VARCHAR) AS code_de, d.text,
          CASE WHEN NOT {sql_blank('v.g')} THEN v.g ELSE coalesce(d.text, '') END AS body
        FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN v USING (doc_id)""",
)
def assemble_corpus(spark, sf):
    docs, labels = _documents(spark, sf), _labels(spark, sf)
    advice = docs.select("num", F.col("source").alias("topic"), F.col("lang").alias("advice"))
    mapping = labels.select("num", F.col("quality").cast("string").alias("code_sn"), F.col("toxic").cast("string").alias("code_de"))
    made = F.when(F.col("quality") == 1, F.concat(F.lit("variant of "), F.col("num").cast("string"))).otherwise(" ")
    variant = labels.select("num", made.alias("generated_text"))
    return al.assemble_corpus(advice, mapping, docs, variant).drop("generated_text")


@query(
    "corpus_with_advice",
    """SELECT doc_id AS num, text, coalesce(CAST(quality AS VARCHAR), '') AS advice, '' AS chapter
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def corpus_with_advice(spark, sf):
    advice = _labels(spark, sf).select("num", F.col("quality").cast("string").alias("advice"))
    return al.corpus_with_advice(_documents(spark, sf), advice)


@query(
    "lookup_codes",
    """WITH ref AS (SELECT * FROM nation WHERE n_regionkey <> 2)
       SELECT c_custkey, coalesce(n_nationkey, 0) AS code, coalesce(n_name, (SELECT n_name FROM ref WHERE n_nationkey = 0)) AS code_name,
         coalesce(n_regionkey, (SELECT n_regionkey FROM ref WHERE n_nationkey = 0)) AS code_region
       FROM customer LEFT JOIN ref ON c_nationkey = n_nationkey""",
)
def lookup_codes(spark, sf):
    ref = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")
    )
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    return al.lookup_codes(rows, "code", ref, 0, ["name", "region"])


@query(
    "align_rows",
    """SELECT l.doc_id AS num, quality, toxic, lang, source, d.doc_id IS NULL AS missing_documents, label, vec_id IS NULL AS missing_vectors
       FROM labels l LEFT JOIN documents d USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id""",
)
def align_rows(spark, sf):
    others = {"documents": _documents(spark, sf).select("num", "lang", "source"), "vectors": _vectors(spark, sf)}
    return al.align_rows(_labels(spark, sf), others)


@query(
    "missing_keys",
    """SELECT 'labels' AS "table", doc_id AS num FROM documents ANTI JOIN labels USING (doc_id)
       UNION ALL SELECT 'embeddings', doc_id FROM documents ANTI JOIN embeddings ON vec_id = doc_id""",
)
def missing_keys(spark, sf):
    others = {"labels": _labels(spark, sf), "embeddings": _vectors(spark, sf)}
    return al.missing_keys(_documents(spark, sf).select("num"), others)


SYNC = """WITH keep AS (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels
            INTERSECT SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)"""


def _synced(spark, sf):
    tables = {
        "documents": _documents(spark, sf).select("num", F.col("source").alias("payload")),
        "labels": _labels(spark, sf).select("num", F.col("quality").cast("string").alias("payload"), "toxic"),
        "embeddings": _vectors(spark, sf).select("num", F.col("label").cast("string").alias("payload")),
    }
    return al.sync_filter(tables, "num", {"labels": F.col("toxic") == 1})


@query(
    "sync_filter",
    SYNC + """ SELECT 'documents' AS "table", doc_id AS num, source AS payload FROM documents SEMI JOIN keep USING (doc_id)
       UNION ALL SELECT 'labels', doc_id, CAST(quality AS VARCHAR) FROM labels SEMI JOIN keep USING (doc_id)
       UNION ALL SELECT 'embeddings', vec_id, CAST(label AS VARCHAR) FROM embeddings SEMI JOIN keep ON vec_id = keep.doc_id""",
)
def sync_filter(spark, sf):
    kept = _synced(spark, sf)
    return al.union_tables([df.select(F.lit(n).alias("table"), "num", "payload") for n, df in kept.items()])


@query(
    "renumber_all",
    SYNC + """, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS num FROM keep)
       SELECT 'documents' AS "table", num, source AS payload FROM documents JOIN n USING (doc_id)
       UNION ALL SELECT 'labels', num, CAST(quality AS VARCHAR) FROM labels JOIN n USING (doc_id)
       UNION ALL SELECT 'embeddings', num, CAST(label AS VARCHAR) FROM embeddings JOIN n ON vec_id = n.doc_id""",
)
def renumber_all(spark, sf):
    numbered = al.renumber_all(_synced(spark, sf), "num")
    return al.union_tables([df.select(F.lit(n).alias("table"), "num", "payload") for n, df in numbered.items()])


VALIDATED = """WITH st AS (SELECT DISTINCT l_linestatus AS code FROM lineitem),
    cu AS (SELECT c_custkey AS code FROM customer WHERE c_acctbal >= 0),
    v AS (SELECT o_orderkey, o_orderstatus, o_custkey, st.code IS NULL AS bad_s, cu.code IS NULL AS bad_c
          FROM orders LEFT JOIN st ON o_orderstatus = st.code LEFT JOIN cu ON o_custkey = cu.code)"""


def _validated(spark, sf, mode):
    status = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("code")).distinct()
    customers = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("code"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return al.validate_codes(
        orders, {"o_orderstatus": (status, "F"), "o_custkey": (customers, F.lit(-1).cast("long"))}, mode=mode
    )


@query(
    "validate_codes",
    VALIDATED + """ SELECT o_orderkey, CASE WHEN bad_s THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN bad_c THEN -1 ELSE o_custkey END AS o_custkey, bad_s AS o_orderstatus_invalid,
         bad_c AS o_custkey_invalid FROM v""",
)
def validate_codes(spark, sf):
    return _validated(spark, sf, "repair")


@query(
    "validate_codes_reject",
    VALIDATED + " SELECT o_orderkey, o_orderstatus, o_custkey FROM v WHERE NOT bad_s AND NOT bad_c",
)
def validate_codes_reject(spark, sf):
    return _validated(spark, sf, "reject")


@query(
    "invalid_counts",
    VALIDATED + """ SELECT count(*) FILTER (bad_s) AS n_invalid_o_orderstatus,
         count(*) FILTER (bad_c) AS n_invalid_o_custkey FROM v""",
)
def invalid_counts(spark, sf):
    return al.invalid_counts(_validated(spark, sf, "flag"), ["o_orderstatus", "o_custkey"])


def _exchanges(spark, sf):
    chat = texts(spark, sf, "conversations").where("role <> 'system'")
    return chat.withColumn("exchange", F.floor(F.col("turn") / 2))


def _pairs(spark, sf):
    chat = texts(spark, sf, "conversations")
    asked = chat.where("role = 'user'").select("conv_id", "turn", "text")
    answered = chat.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated_text")
    )
    return asked, answered


@query(
    "missing_rows",
    f"""SELECT conv_id, turn, text FROM conversations u WHERE role = 'user' AND NOT EXISTS (
          SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1
            AND NOT {sql_blank('a.text')})""",
)
def missing_rows(spark, sf):
    asked, answered = _pairs(spark, sf)
    return al.missing_rows(asked, answered, ["conv_id", "turn"])


@query(
    "remap_text",
    """SELECT doc_id AS num, lang, coalesce(CAST(label AS VARCHAR), '') AS generated_text
       FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def remap_text(spark, sf):
    texts = _vectors(spark, sf).select("num", F.col("label").cast("string").alias("generated_text"))
    return al.remap_text(_documents(spark, sf).select("num", "lang"), texts, ["num"])


@query("neutral_variant", "SELECT 'neutral' AS variant, doc_id AS num, text AS generated_text FROM documents")
def neutral_variant(spark, sf):
    return al.neutral_variant(_documents(spark, sf))


@query(
    "align_slots",
    """SELECT conv_id, turn // 2 AS exchange, max(CASE WHEN role = 'user' THEN text END) AS user_text,
         max(CASE WHEN role = 'assistant' THEN text END) AS assistant_text
       FROM conversations WHERE role <> 'system' GROUP BY ALL""",
)
def align_slots(spark, sf):
    chat = _exchanges(spark, sf)
    slots = {r: chat.where(F.col("role") == r).select("conv_id", "exchange", "text") for r in ("user", "assistant")}
    return al.slots_wide(al.align_slots(slots), list(slots), ["text"], ["conv_id", "exchange"])


@query(
    "slot_sizes",
    """WITH s AS (SELECT role AS slot, count(*) AS n_rows FROM conversations WHERE role <> 'system' GROUP BY 1)
       SELECT slot, n_rows, (SELECT min(n_rows) = max(n_rows) FROM s) AS aligned FROM s""",
)
def slot_sizes(spark, sf):
    chat = _exchanges(spark, sf)
    slots = {r: chat.where(F.col("role") == r).select("conv_id", "exchange") for r in ("user", "assistant")}
    return al.slot_sizes(al.align_slots(slots))


@query(
    "view_row",
    """SELECT conv_id, turn // 2 AS exchange, string_agg('--- ' || role || ' ---' || chr(10) || text, chr(10) || chr(10)
         ORDER BY role) AS view FROM conversations WHERE role <> 'system'
       GROUP BY ALL HAVING bool_or(role = 'assistant')""",
)
def view_row(spark, sf):
    chat = _exchanges(spark, sf)
    keys = chat.where("role = 'assistant'").select("conv_id", "exchange")
    return fc.view_row(chat.select("conv_id", "exchange", F.col("role").alias("slot"), "text"), keys, ["conv_id", "exchange"])


@query(
    "import_selection",
    """WITH h AS (SELECT trim(p_name) AS header, count(*) AS hits FROM
           (SELECT p_name FROM part WHERE p_size > 40 UNION ALL SELECT c_name FROM customer) GROUP BY 1)
       SELECT header, max(p_partkey) AS p_partkey, any_value(hits) AS hits FROM part JOIN h ON trim(p_name) = header GROUP BY 1""",
)
def import_selection(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_name").alias("header"), "p_partkey", "p_size")
    listed = part.where("p_size > 40").select("header").union(table(spark, sf, "customer").select("c_name"))
    return fc.import_selection(part, listed, ["p_partkey"])


# --- chapters -----------------------------------------------------------------------------------------------------


@query(
    "chapter_members",
    """WITH e AS (SELECT event_id AS chapter_pos, event_type AS chapter_id, json_extract(props, '$.k')::BIGINT AS k FROM events),
         c AS (SELECT chapter_pos, chapter_id, 0 AS num_pos, k AS num FROM e
               UNION ALL SELECT chapter_pos, chapter_id, 2, chapter_pos FROM e),
         r AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY chapter_pos, num_pos) AS rn
               FROM c SEMI JOIN documents ON doc_id = num)
       SELECT chapter_pos, chapter_id, chapter_id AS title, num, num_pos FROM r WHERE rn = 1""",
)
def chapter_members(spark, sf):
    kind = F.col("event_type")
    k = F.from_json("props", "k string")["k"]
    entry = F.struct(
        kind.alias("chapter_id"), F.lit(" ").alias("title"), F.lit("").alias("theme"), kind.alias("name"),
        F.array(k, F.lit("x"), F.col("event_id").cast("string")).alias("num_list"),
    )
    # The title is blank, so the name of the chapter is tried next.
    entry = entry.withField("title", F.lit(None).cast("string"))
    raw = table(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(F.array(entry).alias("chapters"))).alias("raw")
    )
    documents = parse_documents(raw, "raw", ["event_id"], CHAPTERS_JSON)
    return ch.chapter_members(documents, _documents(spark, sf), offset="event_id")


@query(
    "first_claim",
    """SELECT l_orderkey AS chapter_pos, l_returnflag AS chapter_id, l_linestatus AS title, l_partkey AS num, l_linenumber AS num_pos
       FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus) AS rn
             FROM lineitem) WHERE rn = 1""",
)
def first_claim(spark, sf):
    members = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chapter_pos"), F.col("l_returnflag").alias("chapter_id"),
        F.col("l_linestatus").alias("title"), F.col("l_partkey").alias("num"), F.col("l_linenumber").alias("num_pos"),
    )
    return ch.first_claim(members)


@query(
    "chapter_descriptions",
    """SELECT 'NATION_' || s_nationkey AS title, s_suppkey AS chapter_pos,
         coalesce('region ' || n_regionkey, '') AS description
       FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_name = 'NATION_' || s_nationkey""",
)
def chapter_descriptions(spark, sf):
    chapters = table(spark, sf, "supplier").select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("title"), F.col("s_suppkey").alias("chapter_pos")
    )
    themes = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.concat(F.lit(" "), "n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description")
    )
    return ch.chapter_descriptions(chapters, themes)


@query(
    "orphans",
    "SELECT 2147483648 AS chapter_pos, 'Other' AS chapter_id, 'Other' AS title, doc_id AS num, doc_id AS num_pos "
    "FROM documents ANTI JOIN labels USING (doc_id)",
)
def orphans(spark, sf):
    return ch.orphans(_documents(spark, sf), _labels(spark, sf))


# --- sets ---------------------------------------------------------------------------------------------------------


@query(
    "concat_tables",
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def concat_tables(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return al.union_tables([customers, suppliers])


@query(
    "common_keys",
    "SELECT doc_id AS num FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings",
)
def common_keys(spark, sf):
    tables = {"d": _documents(spark, sf), "l": _labels(spark, sf), "e": _vectors(spark, sf)}
    return al.common_keys(tables, "num")


@query("except_keys", SYNC + " SELECT doc_id AS num FROM keep")
def except_keys(spark, sf):
    bad = _labels(spark, sf).where("toxic = 1")
    return al.except_keys(common_keys(spark, sf), bad, "num")


@query(
    "merge_catalogue",
    """WITH n AS (SELECT n_name AS name, 'region ' || n_regionkey AS description, 0 AS rnd, 0 AS seq FROM nation WHERE n_regionkey <> 2
          UNION ALL SELECT 'NATION_' || s_nationkey, s_name, 1, s_suppkey FROM supplier)
       SELECT name, description, rnd = 1 AS is_new FROM
         (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rnd, seq, description) AS rn FROM n) WHERE rn = 1""",
)
def merge_catalogue(spark, sf):
    existing = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description")
    )
    proposed = table(spark, sf, "supplier").select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("name"),
        F.col("s_name").alias("description"), F.col("s_suppkey").alias("seq"),
    )
    return ch.merge_catalogue(existing, proposed)


@query(
    "best_attempt",
    f"""SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND NOT {sql_blank('text')}), '') AS text
        FROM conversations GROUP BY conv_id""",
)
def best_attempt(spark, sf):
    attempts = texts(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("attempt"), F.when(F.col("role") == "assistant", F.col("text")).otherwise(" ").alias("text")
    )
    return al.best_attempt(attempts, ["conv_id"])
