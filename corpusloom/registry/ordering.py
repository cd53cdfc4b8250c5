"""Numbering, batches, neighbours, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import alignment as al
from corpusloom.operators import facets as fc
from corpusloom.operators import generation as gn
from corpusloom.registry.core import query, table, texts
from corpusloom.session import scratch_path
from corpusloom.sources import tables


@query("renumber", "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) AS num FROM documents")
def renumber(spark, sf):
    return al.renumber(texts(spark, sf, "documents").select("doc_id", "lang"), ["lang", "doc_id"])


@query(
    "truncate_common",
    """WITH n AS (SELECT least((SELECT count(*) FROM documents), (SELECT count(*) FROM labels), (SELECT count(*) FROM embeddings)) AS n),
         a AS (SELECT 'documents' AS "table", doc_id AS k, row_number() OVER (ORDER BY doc_id) AS num FROM documents
           UNION ALL SELECT 'labels', doc_id, row_number() OVER (ORDER BY doc_id) FROM labels
           UNION ALL SELECT 'embeddings', vec_id, row_number() OVER (ORDER BY vec_id) FROM embeddings)
       SELECT "table", k, num FROM a WHERE num <= (SELECT n FROM n)""",
)
def truncate_common(spark, sf):
    keys = {"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id"}
    tables = {
        name: al.renumber(table(spark, sf, name).select(F.lit(name).alias("table"), F.col(key).alias("k")), ["k"])
        for name, key in keys.items()
    }
    return al.union_tables(list(al.truncate_common(tables).values()))


@query(
    "plan_batches",
    """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS num FROM documents)
       SELECT doc_id, num, (num - 1) // 20 AS batch_id FROM n""",
)
def plan_batches(spark, sf):
    return gn.plan_batches(al.renumber(texts(spark, sf, "documents").select("doc_id"), ["doc_id"]), 20)


@query(
    "batch_bounds",
    """WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS num FROM orders)
       SELECT (num - 1) // 20 AS batch_id, min(num) AS first_num, max(num) AS last_num, count(*) AS n_rows FROM n GROUP BY 1""",
)
def batch_bounds(spark, sf):
    numbered = al.renumber(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return gn.batch_bounds(gn.plan_batches(numbered, 20))


@query(
    "order_batches",
    """SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 10 THEN p_size ELSE 0 END, p_partkey) AS place FROM part""",
)
def order_batches(spark, sf):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") > 10, F.concat(F.lit("batch_"), "p_type", F.lit("_"), size, F.lit("_9.txt"))).otherwise(
        F.concat(F.lit("batch_"), size)
    )
    named = table(spark, sf, "part").select("p_partkey", gn.order_batches(name).alias("key"))
    return al.renumber(named, ["key", "p_partkey"], "place").drop("key")


@query("sort_by_key", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id || ';' || lang || ';' || source AS line FROM documents")
def sort_by_key(spark, sf):
    rows = texts(spark, sf, "documents").select("doc_id", "lang", "source").orderBy("doc_id")
    path = scratch_path(spark, "sorted")
    rows.select(F.concat_ws(";", "doc_id", "lang", "source")).write.text(path)
    return tables.read_ordered_text(spark, path).select("line_no", "line")


@query(
    "prev_next",
    """SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations
       WHERE contains(lower(text), 'th') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def prev_next(spark, sf):
    rows = texts(spark, sf, "conversations").where(F.lower("text").contains("th"))
    # A small block, so that the borders between blocks are exercised at any scale.
    return fc.prev_next(rows, ["conv_id"], ["turn"], block=50)


@query(
    "nav_list",
    """SELECT doc_id, source AS header, quality IS NOT NULL AS selected,
         'kinds:' || lang || CASE WHEN n_chars > 1000 THEN ',long' ELSE '' END || ' | none:-' AS codes
       FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality = 1) USING (doc_id)""",
)
def nav_list(spark, sf):
    kinds = F.when(F.col("n_chars") > 1000, F.array("lang", F.lit("long"))).otherwise(F.array("lang"))
    rows = texts(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("header"), kinds.alias("kinds"), F.array().cast("array<string>").alias("none")
    )
    chosen = table(spark, sf, "labels").where("quality = 1")
    return fc.nav_list(rows, chosen, ["kinds", "none"], ["doc_id"])


@query(
    "sample_ops",
    "SELECT p_partkey, p_name, md5('7' || p_partkey) AS sample_order FROM part ORDER BY sample_order LIMIT 20",
)
def sample_ops(spark, sf):
    return gn.sample_rows(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 20, "7")
