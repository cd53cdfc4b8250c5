"""Streams over the tables' files, run until all files there are read; what they wrote is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import generation as gn
from corpusloom.operators import parsing as ps
from corpusloom.operators import statistics as st
from corpusloom.registry.core import query, sql_strip, table
from corpusloom.registry.generation import FILL, SPECS, make_rewriter
from corpusloom.session import scratch_path
from corpusloom.streaming.appends import append_stream
from corpusloom.streaming.batches import batch_stream, read_newest, replace_stream


def _stream(spark, sf, name):
    # A pattern, as a table may be one file.
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


@query(
    "stream_parse",
    f"""SELECT doc_id, 1 AS num, 'Text 7 – ' || source AS header, {sql_strip('text')} AS text FROM documents
        UNION ALL SELECT doc_id, 2, 'text 12 - ' || lang, '' FROM documents""",
)
def stream_parse(spark, sf):
    raw = F.concat(F.lit(" Text 7 – "), "source", F.lit("\n"), "text", F.lit("\n\n text 12 - "), "lang")
    blocks = ps.parse_text_blocks(_stream(spark, sf, "documents").select("doc_id", raw.alias("raw")), "raw", ["doc_id"])
    path = scratch_path(spark, "parsed")
    append_stream(blocks, path, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_fill",
    f"""SELECT v.variant, doc_id AS num, CASE WHEN contains(text, '$') THEN '' ELSE v.variant || ': ' || {sql_strip('text')} END AS generated_text
        FROM (SELECT unnest(['DIRECT', 'FORMAL']) AS variant) v, documents""",
)
def stream_fill(spark, sf):
    path, store = scratch_path(spark, "filled"), scratch_path(spark, "answers")

    def fill(corpus):
        none = corpus.sparkSession.createDataFrame([], "variant string, num long, generated_text string")
        return gn.fill_missing(corpus, none, SPECS, make_rewriter, store=store, **FILL)

    corpus = _stream(spark, sf, "documents").select(F.col("doc_id").alias("num"), "text")
    batch_stream(corpus, fill, path, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


@query("stream_counts", "SELECT o_orderpriority AS code, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def stream_counts(spark, sf):
    path = scratch_path(spark, "counts")
    replace_stream(st.code_counts(_stream(spark, sf, "orders"), "o_orderpriority"), path, scratch_path(spark, "progress")).awaitTermination()
    return read_newest(spark, path)
