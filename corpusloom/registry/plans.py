"""Whole runs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import alignment as al
from corpusloom.operators import chapters as ch
from corpusloom.operators import generation as gn
from corpusloom.operators import statistics as st
from corpusloom.plans import book, corpus, variants
from corpusloom.registry.core import query, sql_blank, sql_sentences, sql_tokens, table, texts
from corpusloom.registry.sources import BOOK, _book_corpus
from corpusloom.session import scratch_path
from corpusloom.sources import tables


def _raw(rows, key, *fields):
    """Raw answers of 20 lines each, under a header line, as a model would give them."""
    cells = [F.regexp_replace(F.col(f).cast("string"), r"\s+", " ") for f in (key, *fields)]
    lines = rows.select(F.col(key).alias("k"), F.concat_ws("|", *cells).alias("line"))
    planned = gn.plan_batches(lines.join(al.renumber(lines.select("k"), ["k"]), "k"), 20)
    return gn.build_prompts(planned, "line", "num|" + "|".join(fields)).select("batch_id", F.col("prompt").alias("raw"))


@query(
    "aligned_tables",
    """WITH d AS (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents),
         k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS num FROM d JOIN labels USING (doc_id)
               SEMI JOIN embeddings ON vec_id = doc_id WHERE NOT contains(text, '|'))
       SELECT num, source, text, CASE WHEN toxic = 1 THEN '0' ELSE CAST(toxic AS VARCHAR) END AS toxic, CAST(label AS VARCHAR) AS label
       FROM k JOIN d USING (doc_id) JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id""",
)
def aligned_tables(spark, sf):
    labels = table(spark, sf, "labels")
    reference = labels.where("toxic = 0").select(F.col("toxic").cast("string").alias("code"))
    raw = {
        "advice": corpus.RawTable(_raw(texts(spark, sf, "documents"), "doc_id", "source", "text"), ["num", "source", "text"]),
        "mapping": corpus.RawTable(_raw(labels, "doc_id", "toxic"), ["num", "toxic"], {"toxic": (reference, "0")}),
        "context": corpus.RawTable(_raw(table(spark, sf, "embeddings"), "vec_id", "label"), ["num", "label"]),
    }
    found = corpus.aligned_tables(raw, sep="|")
    return found["advice"].join(found["mapping"], "num").join(found["context"], "num").select(
        "num", "source", F.trim("text").alias("text"), "toxic", "label"
    )


COMPARED = [*st.DIRECT_METRICS, *variants.LEXICAL]


@query(
    "compare_variants",
    f"""WITH c AS (SELECT 'neutral' AS variant, conv_id, turn, text FROM conversations WHERE role = 'user'
          UNION ALL SELECT 'reply', conv_id, turn, text FROM conversations WHERE role = 'assistant'),
        t AS (SELECT variant, conv_id, turn, unnest({sql_tokens('text')}) AS token FROM c),
        f AS (SELECT variant, conv_id, turn, token, count(*) AS f FROM t GROUP BY ALL),
        l AS (SELECT variant, conv_id, turn, sum(f)::DOUBLE AS n, count(*)::DOUBLE AS v, count(*) FILTER (f = 1) AS h FROM f GROUP BY ALL),
        m AS (SELECT c.variant, n AS len_tokens, length(text)::DOUBLE AS len_chars, n AS word_count,
            {sql_sentences('text')}::DOUBLE AS len_sentences, v / n AS "TTR", h / n AS "HapaxRatio",
            CASE WHEN n > 1 THEN ln(v) / ln(n) END AS "HerdanC", CASE WHEN n >= 5 THEN v / sqrt(n) END AS "RTTR",
            CASE WHEN n >= 5 THEN v / sqrt(2 * n) END AS "CTTR", CASE WHEN n >= 5 THEN (ln(n) - ln(v)) / (ln(n) * ln(n)) END AS "Maas"
          FROM c JOIN l USING (variant, conv_id, turn) WHERE NOT {sql_blank('text')}) """
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(avg({m}) FILTER (variant = 'neutral'), 5) AS neutral_mean,
              round(stddev_samp({m}) FILTER (variant = 'neutral'), 5) AS neutral_std,
              round(avg({m}) FILTER (variant = 'reply'), 5) AS reply_mean,
              round(stddev_samp({m}) FILTER (variant = 'reply'), 5) AS reply_std FROM m"""
        for m in COMPARED
    ),
)
def compare_variants(spark, sf):
    chat = texts(spark, sf, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    neutral = chat.where("role = 'user'").select(number.alias("num"), "text")
    replies = chat.where("role = 'assistant'").select(
        F.lit("reply").alias("variant"), number.alias("num"), F.col("text").alias("generated_text")
    )
    return variants.compared(neutral, replies, ["reply"], hdd=False, mtld=False, digits=5)


@query(
    "write_book",
    f"""WITH {BOOK}, p AS (SELECT doc_id AS num, dense_rank() OVER (ORDER BY source) AS pos, source AS title FROM documents),
        a AS (SELECT pos, num, range(len(ls)) AS i, ls FROM lines JOIN p USING (num)
              UNION ALL SELECT DISTINCT pos, -1, [0, 1], ['\\chapter{{' || title || '}}', ''] FROM p),
        u AS (SELECT pos, num, unnest(i) AS i, unnest(ls) AS line FROM a),
        s AS (SELECT pos, num, i, unnest(range(len(string_split(line, chr(10))))) AS j, unnest(string_split(line, chr(10))) AS line FROM u)
        SELECT row_number() OVER (ORDER BY pos, num, i, j) - 1 AS line_no, line FROM s""",
)
def write_book(spark, sf):
    rows = texts(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("theme"))
    members = ch.chapters_from_themes(ch.theme_members(rows))
    path = scratch_path(spark, "book")
    book.write_book(_book_corpus(spark, sf), members, path)
    return tables.read_ordered_text(spark, path).select("line_no", "line")
