"""Aggregations: codes, texts, corpora, facets, chapters, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import lexical as lx
from corpusloom.operators import alignment as al
from corpusloom.operators import chapters as ch
from corpusloom.operators import facets as fc
from corpusloom.operators import generation as gn
from corpusloom.operators import statistics as st
from corpusloom.registry.core import RE_SPACE, query, sql_blank, sql_sentences, sql_tokens, table, texts
from corpusloom.session import materialise

DIRECT = st.DIRECT_METRICS


def _documents(spark, sf):
    return texts(spark, sf, "documents")


# --- codes --------------------------------------------------------------------------------------------------------


@query("code_counts", "SELECT l_returnflag AS code, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def code_counts(spark, sf):
    return st.code_counts(table(spark, sf, "lineitem"), "l_returnflag")


@query(
    "code_distribution",
    """WITH c AS (SELECT o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1)
       SELECT code, n, round(n / (SELECT sum(n) FROM c) * 100, 2) AS percentage FROM c""",
)
def code_distribution(spark, sf):
    return st.code_distribution(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "name_distribution",
    """WITH c AS (SELECT c_nationkey AS code, count(*) AS n FROM customer GROUP BY 1)
       SELECT code, n, n_name AS name FROM c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = code""",
)
def name_distribution(spark, sf):
    counts = st.code_counts(table(spark, sf, "customer"), "c_nationkey")
    ref = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")
    )
    return st.name_distribution(counts, ref)


NULLED = "(SELECT CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_partkey END AS code FROM lineitem)"


def _nulled(spark, sf):
    return table(spark, sf, "lineitem").select(F.when(F.col("l_linestatus") != "O", F.col("l_partkey")).alias("code"))


@query(
    "diversity_pct",
    f"SELECT count(*) AS n_rows, round(count(DISTINCT code) / count(*) * 100, 6) AS diversity_pct FROM {NULLED}",
)
def diversity_pct(spark, sf):
    return st.diversity(_nulled(spark, sf), "code").select("n_rows", F.round("diversity_pct", 6).alias("diversity_pct"))


@query(
    "herfindahl",
    f"""WITH c AS (SELECT code, count(*) AS n FROM {NULLED} WHERE code IS NOT NULL GROUP BY 1)
        SELECT count(*) AS n_codes, round(sum(n * n) / (sum(n) * sum(n)), 9) AS herfindahl FROM c""",
)
def herfindahl(spark, sf):
    return st.diversity(_nulled(spark, sf), "code").select("n_codes", F.round("herfindahl", 9).alias("herfindahl"))


def _sql_report(code: str) -> str:
    return f"""SELECT '{code}' AS code_type, {code} AS code, count(*) AS n,
        round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage,
        round(count(*) OVER () / sum(count(*)) OVER () * 100, 6) AS diversity_pct,
        round(sum(count(*) * count(*)) OVER () / (sum(count(*)) OVER () * sum(count(*)) OVER ()), 9) AS herfindahl
      FROM lineitem GROUP BY 2"""


@query("distribution_report", " UNION ALL ".join(map(_sql_report, ["l_returnflag", "l_linestatus"])))
def distribution_report(spark, sf):
    report = st.distribution_report(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return report.withColumns(
        {"diversity_pct": F.round("diversity_pct", 6), "herfindahl": F.round("herfindahl", 9)}
    )


@query("corpus_sizes", "SELECT lang AS corpus, count(*) AS n_texts FROM documents GROUP BY 1")
def corpus_sizes(spark, sf):
    return st.corpus_sizes(_documents(spark, sf), "lang")


# --- texts --------------------------------------------------------------------------------------------------------

SQL_LENGTHS = f"""SELECT doc_id, lang, CAST(len({sql_tokens('text')}) AS DOUBLE) AS len_tokens,
    CAST(length(text) AS DOUBLE) AS len_chars, CAST(len({sql_tokens('text')}) AS DOUBLE) AS word_count,
    CAST({sql_sentences('text')} AS DOUBLE) AS len_sentences
  FROM documents WHERE NOT {sql_blank('text')}"""


@query("text_metrics", SQL_LENGTHS)
def text_metrics(spark, sf):
    return st.length_metrics(_documents(spark, sf), "text", ["doc_id", "lang"])


SQL_COUNTS = f"""tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents),
  freq AS (SELECT doc_id, token, count(*) AS f FROM tok GROUP BY ALL),
  lex AS (SELECT doc_id, sum(f)::DOUBLE AS n, count(*)::DOUBLE AS v, count(*) FILTER (f = 1) AS h FROM freq GROUP BY 1)"""


def _lexical(spark, sf, **options):
    return st.text_metrics(_documents(spark, sf), "text", ["doc_id"], **{"hdd": False, "mtld": False} | options)


@query(
    "lexical_basic",
    f"""WITH {SQL_COUNTS} SELECT doc_id, round(v / n, 6) AS ttr, round(h / n, 6) AS hapax,
          CASE WHEN n > 1 THEN round(ln(v) / ln(n), 6) END AS herdan FROM lex""",
)
def lexical_basic(spark, sf):
    return _lexical(spark, sf).select(
        "doc_id", F.round("TTR", 6).alias("ttr"), F.round("HapaxRatio", 6).alias("hapax"), F.round("HerdanC", 6).alias("herdan")
    )


@query(
    "lexical_advanced",
    f"""WITH {SQL_COUNTS} SELECT doc_id, CASE WHEN n >= 5 THEN round(v / sqrt(n), 6) END AS rttr,
          CASE WHEN n >= 5 THEN round(v / sqrt(2 * n), 6) END AS cttr,
          CASE WHEN n >= 5 THEN round((ln(n) - ln(v)) / (ln(n) * ln(n)), 6) END AS maas FROM lex""",
)
def lexical_advanced(spark, sf):
    return _lexical(spark, sf).select(
        "doc_id", F.round("RTTR", 6).alias("rttr"), F.round("CTTR", 6).alias("cttr"), F.round("Maas", 6).alias("maas")
    )


@query(
    "hdd",
    f"""WITH {SQL_COUNTS}, ff AS (SELECT doc_id, f, count(*) AS types FROM freq GROUP BY ALL),
          p AS (SELECT doc_id, types * (1 - list_product(list_transform(range(42),
                  lambda i: greatest(n - f - i, 0) / (n - i)))) / 42 AS part
                FROM ff JOIN lex USING (doc_id) WHERE n >= 42)
        SELECT doc_id, round(sum(part), 6) AS hdd FROM p GROUP BY 1
        UNION ALL SELECT doc_id, NULL FROM lex WHERE n < 42""",
)
def hdd(spark, sf):
    return _lexical(spark, sf, hdd=True).select("doc_id", F.round("HDD", 6).alias("hdd"))


@query(
    "lexical_normalized",
    "WITH " + SQL_COUNTS.replace(sql_tokens("text"), sql_tokens(f"regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}{RE_SPACE}]', '', 'g')"))
    + " SELECT doc_id, round(v / n, 6) AS ttr, coalesce(n, 0) AS n_tokens FROM documents LEFT JOIN lex USING (doc_id)",
)
def lexical_normalized(spark, sf):
    profile = lx.lexical_profile("text", "normalized", hdd=False)
    rows = texts(spark, sf, "documents").select("doc_id", profile.alias("p"))
    v, n = F.col("p.n_types"), F.col("p.n_tokens")
    return rows.select("doc_id", F.round(lx.ttr(v, n), 6).alias("ttr"), n.cast("double").alias("n_tokens"))


def _sql_factors(words: str) -> str:
    """Factors of a list of words: the fold carries the full ones, the words seen since, and their number."""
    zero = "{'w': '', 'full': 0::DOUBLE, 'seen': []::VARCHAR[], 'n': 0}"
    seen = "CASE WHEN list_contains(a.seen, x.w) THEN a.seen ELSE list_append(a.seen, x.w) END"
    return f"""list_reduce(list_prepend({zero}, list_transform({words},
          lambda w: {{'w': w, 'full': 0::DOUBLE, 'seen': []::VARCHAR[], 'n': 0}})), lambda a, x:
          CASE WHEN len({seen})::DOUBLE / (a.n + 1) <= 0.72 THEN {{'w': '', 'full': a.full + 1, 'seen': []::VARCHAR[], 'n': 0}}
          ELSE {{'w': '', 'full': a.full, 'seen': {seen}, 'n': a.n + 1}} END)"""


SQL_FACTORS = "CASE WHEN f = 0 THEN 1 ELSE f END"


@query(
    "mtld",
    f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS ws FROM documents),
        s AS (SELECT doc_id, len(ws) AS n, unnest([{_sql_factors('ws')}, {_sql_factors('list_reverse(ws)')}]) AS a FROM t),
        f AS (SELECT doc_id, n, a.full + CASE WHEN a.n > 0 THEN (1 - len(a.seen)::DOUBLE / a.n) / (1 - 0.72::DOUBLE) ELSE 0 END AS f FROM s)
        SELECT doc_id, CASE WHEN any_value(n) >= 5 THEN round(sum(n / {SQL_FACTORS}) / 2, 6) END AS mtld FROM f GROUP BY 1""",
)
def mtld(spark, sf):
    return _documents(spark, sf).select("doc_id", F.round(lx.mtld("text"), 6).alias("mtld"))


# --- summaries ----------------------------------------------------------------------------------------------------


def _sql_summary(names: list[str], source: str, corpus: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {corpus}, '{m}' AS metric, count(*) AS n_texts, count({m}) AS n, round(avg({m}), 5) AS mean,
              round(median({m}), 5) AS median, round(stddev_samp({m}), 5) AS std, round(min({m}), 5) AS min,
              round(max({m}), 5) AS max FROM {source} GROUP BY 1""" for m in names
    )


def _rounded(summary):
    return summary.withColumns({c: F.round(c, 5) for c in ("mean", "median", "std", "min", "max") if c in summary.columns})


RICH = f"""m AS (SELECT d.*, v / n AS "TTR", h / n AS "HapaxRatio",
     CASE WHEN n >= 5 THEN v / sqrt(n) END AS "RTTR" FROM ({SQL_LENGTHS}) d LEFT JOIN lex USING (doc_id))"""
RICH_NAMES = [*DIRECT, "TTR", "HapaxRatio", "RTTR"]


def _rich(spark, sf, keys=("doc_id", "lang")):
    metrics = st.text_metrics(_documents(spark, sf), "text", list(keys), hdd=False, mtld=False)
    return materialise(metrics.select(*keys, *RICH_NAMES), "metrics")


@query("corpus_summary", f"WITH {SQL_COUNTS}, {RICH} {_sql_summary(RICH_NAMES, 'm', 'lang')}")
def corpus_summary(spark, sf):
    return _rounded(st.corpus_summary(_rich(spark, sf), ["lang"], RICH_NAMES))


@query(
    "corpus_summary_prices",
    """SELECT l_returnflag, 'l_extendedprice' AS metric, count(*) AS n_texts, count(l_extendedprice) AS n,
         round(avg(l_extendedprice), 5) AS mean, round(median(l_extendedprice), 5) AS median,
         round(stddev_samp(l_extendedprice), 5) AS std, round(min(l_extendedprice), 5) AS min,
         round(max(l_extendedprice), 5) AS max FROM lineitem GROUP BY 1""",
)
def corpus_summary_prices(spark, sf):
    return _rounded(st.corpus_summary(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_extendedprice"]))


@query(
    "corpus_summary_null",
    """WITH d AS (SELECT nullif(lang, 'es') AS n, n_chars::DOUBLE AS value FROM documents)
       SELECT n, 'value' AS metric, count(*) AS n_texts, count(value) AS n_of_metric, round(avg(value), 5) AS mean, round(median(value), 5) AS median,
         round(stddev_samp(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max FROM d GROUP BY 1""",
)
def corpus_summary_null(spark, sf):
    rows = table(spark, sf, "documents").select(F.nullif("lang", F.lit("es")).alias("n"), F.col("n_chars").cast("double").alias("value"))
    return _rounded(st.corpus_summary(rows, ["n"], ["value"]))


@query(
    "summary_wide",
    f"""SELECT lang, count(*) AS n_texts, {', '.join(
        f'round({f}({m}), 5) AS {m}_{n}' for m in DIRECT for n, f in
        [('mean', 'avg'), ('median', 'median'), ('std', 'stddev_samp'), ('min', 'min'), ('max', 'max')])}
        FROM ({SQL_LENGTHS}) GROUP BY 1""",
)
def summary_wide(spark, sf):
    metrics = materialise(st.length_metrics(_documents(spark, sf), "text", ["lang"]), "metrics")
    return st.summary_wide(_rounded(st.corpus_summary(metrics, ["lang"], DIRECT)), ["lang"], DIRECT)


@query(
    "length_stats",
    f"""SELECT role AS corpus, count(*) FILTER (NOT {sql_blank('text')}) AS n_texts, {', '.join(
        f'round({f}({e}) FILTER (NOT {sql_blank("text")}), 5) AS {m}_{n}'
        for m, e in [('len_tokens', f"len({sql_tokens('text')})"), ('len_chars', 'length(text)')]
        for n, f in [('mean', 'avg'), ('median', 'median'), ('std', 'stddev_samp')])}
        FROM conversations GROUP BY 1""",
)
def length_stats(spark, sf):
    chat = texts(spark, sf, "conversations").withColumnRenamed("role", "corpus")
    stats = st.length_stats(chat, "text", ["corpus"])
    return stats.select("corpus", "n_texts", *[F.round(c, 5).alias(c) for c in stats.columns[2:]])


@query(
    "common_metrics",
    "SELECT 'l_quantity' AS metric WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_quantity > 0) = 3 "
    "UNION ALL SELECT 'l_discount' WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_discount > 0 AND l_returnflag <> 'A') = 3",
)
def common_metrics(spark, sf):
    return st.common_metrics(_uneven(spark, sf), "corpus", 3)


def _uneven(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("corpus"),
        F.explode(
            F.array(F.when(F.col("l_quantity") > 0, "l_quantity"), F.when((F.col("l_discount") > 0) & (F.col("l_returnflag") != "A"), "l_discount"))
        ).alias("metric"),
    )
    return rows.where("metric is not null").distinct()


@query(
    "lacking_metrics",
    """WITH have AS (SELECT DISTINCT l_returnflag AS corpus, 'l_quantity' AS metric FROM lineitem WHERE l_quantity > 0
         UNION SELECT DISTINCT l_returnflag, 'l_discount' FROM lineitem WHERE l_discount > 0 AND l_returnflag <> 'A')
       SELECT metric, corpus FROM (SELECT DISTINCT metric FROM have), (SELECT DISTINCT corpus FROM have)
       EXCEPT SELECT metric, corpus FROM have""",
)
def lacking_metrics(spark, sf):
    return st.lacking_metrics(_uneven(spark, sf), "corpus", ["l_quantity", "l_discount", "l_tax"])


LANGUAGES = ["en", "fr", "de", "es"]


@query(
    "compare_corpora",
    f"""WITH {SQL_COUNTS}, {RICH}, s AS ({_sql_summary(RICH_NAMES, 'm', 'lang')})
        SELECT metric, {', '.join(f"max(mean) FILTER (lang = '{c}') AS {c}_mean, max(std) FILTER (lang = '{c}') AS {c}_std"
        for c in LANGUAGES)} FROM s GROUP BY 1 HAVING count(DISTINCT lang) = 4""",
)
def compare_corpora(spark, sf):
    summary = _rounded(st.corpus_summary(_rich(spark, sf), ["lang"], RICH_NAMES, median=False))
    return st.compare_corpora(summary, LANGUAGES, corpus="lang", baseline="en")


@query(
    "compare_corpora_labels",
    f"""WITH s AS ({_sql_summary(DIRECT, f'({SQL_LENGTHS})', 'lang')})
        SELECT metric, {', '.join(f"max(format('{{:.2f}} ({{:.2f}})', mean, std)) FILTER (lang = '{c}') AS {c}"
        for c in LANGUAGES)} FROM s GROUP BY 1""",
)
def compare_corpora_labels(spark, sf):
    metrics = materialise(st.length_metrics(_documents(spark, sf), "text", ["lang"]), "metrics")
    summary = _rounded(st.corpus_summary(metrics, ["lang"], DIRECT, median=False))
    return st.compare_corpora(summary, LANGUAGES, corpus="lang", baseline="en", source="direct", labels=True)


# --- scores -------------------------------------------------------------------------------------------------------

def _lexicon(spark, sf):
    """A lexicon from the benchmark's words: long ones are "long", the others "short", weighted by their length."""
    words = table(spark, sf, "benchmark").select(F.explode(lx.tokens("text")).alias("token")).distinct()
    label = F.when(F.length("token") > 6, "long").otherwise("short")
    return materialise(words.select("token", label.alias("label"), (F.length("token") / 4).alias("weight")), "lexicon")


@query(
    "lexicon_scores",
    f"""WITH w AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS token FROM benchmark),
          t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents)
        SELECT doc_id, coalesce(sum(length(w.token) / 4) FILTER (length(w.token) > 6), 0) AS lex_long,
          coalesce(sum(length(w.token) / 4) FILTER (length(w.token) <= 6), 0) AS lex_short
        FROM t LEFT JOIN w USING (token) GROUP BY 1""",
)
def lexicon_scores(spark, sf):
    return st.lexicon_scores(_documents(spark, sf), "text", ["doc_id"], _lexicon(spark, sf), ["long", "short"], "lex")


def make_scorer():
    def score(texts):
        return [{"vowels": sum(t.count(v) for v in "aeiou") / 1.0, "stops": float(t.count("."))} for t in texts]

    return score


@query(
    "score_texts",
    """SELECT doc_id, CAST(length(regexp_replace(text, '[^aeiou]', '', 'g')) AS DOUBLE) AS s_vowels,
         CAST(length(regexp_replace(text, '[^.]', '', 'g')) AS DOUBLE) AS s_stops FROM documents""",
)
def score_texts(spark, sf):
    return st.score_texts(_documents(spark, sf), "text", ["doc_id"], make_scorer, ["vowels", "stops"], "s")


# --- facets -------------------------------------------------------------------------------------------------------

SQL_ALIGNED = """aligned AS (SELECT doc_id AS ordinal, 'a' AS slot, source AS header, text, [source, lang] AS kinds, [lang] AS langs
     FROM documents
   UNION ALL SELECT vec_id, 'b', 'vector ' || vec_id, 'label ' || label, ['L' || label], []::VARCHAR[] FROM embeddings
   UNION ALL SELECT doc_id, 'c', 'label', '', CASE WHEN quality = 1 THEN ['good'] ELSE ['bad', 'poor'] END, []::VARCHAR[] FROM labels)"""

SQL_ROWS = SQL_ALIGNED + """, g AS (SELECT ordinal, list_distinct(flatten(list(kinds))) AS kinds,
     list_distinct(flatten(list(langs))) AS langs,
     bool_or(contains(lower(header), 'the') OR contains(lower(text), 'the')) AS found FROM aligned GROUP BY 1)"""

ACTIVE_KINDS = ["src1", "src2", "L3", "good"]
ACTIVE_LANGS = ["en", "fr"]
SQL_KIND_OK = f"list_has_any(kinds, {ACTIVE_KINDS})"
SQL_LANG_OK = f"list_has_any(langs, {ACTIVE_LANGS})"
STATE = fc.FacetState({"kinds": ACTIVE_KINDS, "langs": ACTIVE_LANGS}, "the")
FACETS = ["kinds", "langs"]


def _aligned(spark, sf):
    none = F.array().cast("array<string>")
    docs = _documents(spark, sf).select(
        F.col("doc_id").alias("ordinal"), F.col("source").alias("header"), "text",
        F.array("source", "lang").alias("kinds"), F.array("lang").alias("langs"),
    )
    label = F.col("label").cast("string")
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ordinal"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("header"),
        F.concat(F.lit("label "), label).alias("text"), F.array(F.concat(F.lit("L"), label)).alias("kinds"), none.alias("langs"),
    )
    judged = F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array(F.lit("bad"), F.lit("poor")))
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("ordinal"), F.lit("label").alias("header"), F.lit("").alias("text"), judged.alias("kinds"), none.alias("langs")
    )
    return al.align_slots({"a": docs, "b": vectors, "c": labels})


def _rows(spark, sf):
    return fc.facet_rows(_aligned(spark, sf), FACETS, ["ordinal"], "the")


def _selection(spark, sf):
    return table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("ordinal"))


@query(
    "facet_totals",
    f"""WITH {SQL_ALIGNED}, c AS (SELECT 'kinds' AS facet, unnest(kinds) AS code FROM aligned
          UNION ALL SELECT 'langs', unnest(langs) FROM aligned)
        SELECT facet, code, count(*) AS total FROM c GROUP BY ALL""",
)
def facet_totals(spark, sf):
    return fc.facet_totals(_aligned(spark, sf), FACETS)


SQL_FLAGGED = f"""WITH {SQL_ROWS}, f AS (SELECT *, found AND {SQL_KIND_OK} AND {SQL_LANG_OK} AS vis,
       ordinal IN (SELECT doc_id FROM labels WHERE quality = 1) AS sel FROM g),
     c AS (SELECT 'kinds' AS facet, unnest(kinds) AS code, vis, sel FROM f UNION ALL SELECT 'langs', unnest(langs), vis, sel FROM f)"""


@query(
    "facet_visible",
    SQL_FLAGGED + " SELECT facet, code, count(*) FILTER (vis) AS visible FROM c GROUP BY ALL HAVING count(*) FILTER (vis) > 0",
)
def facet_visible(spark, sf):
    return fc.facet_counts(_rows(spark, sf), STATE, FACETS).where("visible > 0").select("facet", "code", "visible")


@query(
    "facet_selected",
    SQL_FLAGGED + """ SELECT facet, code, count(*) FILTER (vis) AS visible, count(*) FILTER (sel) AS selected,
        count(*) FILTER (vis AND sel) AS selected_visible FROM c GROUP BY ALL""",
)
def facet_selected(spark, sf):
    return fc.facet_counts(_rows(spark, sf), STATE, FACETS, _selection(spark, sf))


@query(
    "facet_available",
    f"""WITH {SQL_ROWS} SELECT DISTINCT 'langs' AS facet, unnest(langs) AS code FROM g WHERE found AND {SQL_KIND_OK}
        UNION SELECT DISTINCT 'kinds', unnest(kinds) FROM g WHERE found AND {SQL_LANG_OK}""",
)
def facet_available(spark, sf):
    return fc.facet_available(_rows(spark, sf), STATE, "kinds", "langs")


@query(
    "facet_gauge",
    SQL_FLAGGED + """ SELECT facet, code, count(*) FILTER (vis) AS visible, count(*) FILTER (sel) AS selected,
        count(*) FILTER (vis AND sel) AS selected_visible, round(count(*) FILTER (sel) / count(*) FILTER (vis), 6) AS ratio
        FROM c GROUP BY ALL HAVING count(*) FILTER (vis) > 0""",
)
def facet_gauge(spark, sf):
    counts = fc.facet_counts(_rows(spark, sf), STATE, FACETS, _selection(spark, sf))
    return fc.facet_gauge(counts).withColumn("ratio", F.round("ratio", 6))


@query(
    "selection_share",
    """SELECT count(*) AS n_texts, count(l.doc_id) AS n_selected, round(count(l.doc_id) * 100 / count(*), 6) AS percentage
       FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)""",
)
def selection_share(spark, sf):
    rows = _documents(spark, sf).select(F.col("doc_id").alias("ordinal"))
    share = fc.selection_share(rows, _selection(spark, sf), ["ordinal"])
    return share.withColumn("percentage", F.round("percentage", 6))


@query("visible_rows", f"WITH {SQL_ROWS} SELECT ordinal FROM g WHERE found AND {SQL_KIND_OK} AND {SQL_LANG_OK}")
def visible_rows(spark, sf):
    return fc.visible_rows(_rows(spark, sf), STATE, FACETS).select("ordinal")


# --- themes and chapters ------------------------------------------------------------------------------------------


def _members(spark, sf):
    rows = table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_name").alias("theme"),
        F.when(F.col("p_type") == "SMALL", "n/a").otherwise(F.col("p_partkey").cast("string")).alias("id"),
    )
    return ch.theme_members(rows)


SQL_MEMBERS = "members AS (SELECT DISTINCT trim(p_name) AS theme, p_partkey AS num FROM part WHERE p_type <> 'SMALL')"


@query("theme_groups", f"WITH {SQL_MEMBERS} SELECT theme, num FROM members")
def theme_groups(spark, sf):
    return _members(spark, sf)


@query("theme_sizes", f"WITH {SQL_MEMBERS} SELECT theme, count(*) AS n_texts FROM members GROUP BY 1")
def theme_sizes(spark, sf):
    return ch.theme_sizes(_members(spark, sf))


@query(
    "merge_small_groups",
    f"""WITH {SQL_MEMBERS}, s AS (SELECT theme, count(*) < 27 AS merged FROM members GROUP BY 1)
        SELECT DISTINCT CASE WHEN merged THEN 'Other' ELSE theme END AS theme, num, merged FROM members JOIN s USING (theme)""",
)
def merge_small_groups(spark, sf):
    return ch.merge_small_groups(_members(spark, sf), 27)


SQL_CHAPTERS = f"""WITH {SQL_MEMBERS}, s AS (SELECT theme, count(*) < 27 AS merged,
       row_number() OVER (ORDER BY theme) AS pos FROM members GROUP BY 1)
     SELECT DISTINCT CASE WHEN merged THEN 2147483647 ELSE pos END AS chapter_pos,
       CASE WHEN merged THEN 'Other' ELSE 'Theme_' || pos || '_' || left(replace(theme, ' ', '_'), 40) END AS chapter_id,
       CASE WHEN merged THEN 'Other' ELSE theme END AS title, num, num AS num_pos FROM members JOIN s USING (theme)"""


@query("number_chapters", SQL_CHAPTERS)
def number_chapters(spark, sf):
    return ch.chapters_from_themes(_members(spark, sf), 27)


@query(
    "get_chapter",
    """SELECT 2 AS chapter_pos, 'Theme_2_en' AS chapter_id, 'en' AS title, doc_id AS num, doc_id AS num_pos
       FROM documents WHERE lang = 'en'""",
)
def get_chapter(spark, sf):
    rows = _documents(spark, sf).select(F.col("lang").alias("theme"), F.col("doc_id").alias("id"))
    return ch.get_chapter(ch.chapters_from_themes(ch.theme_members(rows)), "Theme_2_en")


@query(
    "single_chapter",
    """SELECT 1 AS chapter_pos, 'All_Texts' AS chapter_id, 'All Texts' AS title, row_number() OVER (ORDER BY doc_id) AS num,
         row_number() OVER (ORDER BY doc_id) AS num_pos FROM documents""",
)
def single_chapter(spark, sf):
    return ch.single_chapter(_documents(spark, sf), ["doc_id"])


VARIANTS = f"(SELECT role AS variant, conv_id, turn, CASE WHEN role = 'user' AND length(text) < 60 THEN ' ' ELSE text END AS generated_text FROM conversations)"


def _variants(spark, sf):
    text = F.when((F.col("role") == "user") & (F.length("text") < 60), " ").otherwise(F.col("text"))
    return texts(spark, sf, "conversations").select(F.col("role").alias("variant"), "conv_id", "turn", text.alias("generated_text"))


@query(
    "complete_variants",
    f"SELECT * FROM {VARIANTS} WHERE variant NOT IN (SELECT variant FROM {VARIANTS} WHERE {sql_blank('generated_text')})",
)
def complete_variants(spark, sf):
    return ch.complete_variants(_variants(spark, sf))


# --- audits -------------------------------------------------------------------------------------------------------

SQL_FILL = """WITH w AS (SELECT v.variant, doc_id AS num, quality IS NOT NULL AND (v.variant = 'a' OR toxic = 1) AS filled
     FROM (SELECT unnest(['a', 'b']) AS variant) v, documents LEFT JOIN labels USING (doc_id))"""


def _filled(spark, sf):
    labels = table(spark, sf, "labels")
    first = labels.select(F.lit("a").alias("variant"), F.col("doc_id").alias("num"), F.lit("x").alias("generated_text"))
    text = F.when(F.col("toxic") == 1, "y").otherwise(" ")
    second = labels.select(F.lit("b").alias("variant"), F.col("doc_id").alias("num"), text.alias("generated_text"))
    return first.unionByName(second)


def _corpus(spark, sf):
    return _documents(spark, sf).select(F.col("doc_id").alias("num"), "text")


@query(
    "fill_audit",
    SQL_FILL + """ SELECT variant, count(*) AS total, count(*) FILTER (filled) AS filled, count(*) FILTER (NOT filled) AS missing,
        round(count(*) FILTER (filled) * 100 / count(*), 6) AS pct_filled,
        round(count(*) FILTER (NOT filled) * 100 / count(*), 6) AS pct_missing FROM w GROUP BY 1""",
)
def fill_audit(spark, sf):
    audit = gn.fill_audit(_corpus(spark, sf), _filled(spark, sf), ["a", "b"])
    return audit.withColumns({c: F.round(c, 6) for c in ("pct_filled", "pct_missing")})


@query("fill_status", SQL_FILL + " SELECT * FROM w")
def fill_status(spark, sf):
    return gn.fill_status(_corpus(spark, sf), _filled(spark, sf), ["a", "b"])


def _sql_keys(name: str, source: str, key: str) -> str:
    return f"""SELECT '{name}' AS "table", count(*) AS n_rows, count(*) FILTER ({key} IS NULL) AS n_null,
       count(DISTINCT {key}) AS n_distinct, (SELECT count(*) FROM (SELECT {key} FROM {source} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS n_duplicated,
       min({key}) AS min_key, max({key}) AS max_key,
       count(*) FILTER ({key} IS NULL) = 0 AND count(*) = count(DISTINCT {key}) AND min({key}) = 1 AND max({key}) = count(*) AS contiguous,
       count(DISTINCT {key}) = (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT event_id // 4 FROM events)) AS same_keys
     FROM {source}"""


@query(
    "check_keys",
    " UNION ALL ".join([
        _sql_keys("documents", "documents", "doc_id"), _sql_keys("labels", "labels", "doc_id"),
        _sql_keys("events", "(SELECT event_id // 4 AS k FROM events)", "k"),
    ]),
)
def check_keys(spark, sf):
    tables = {
        "documents": _documents(spark, sf).select(F.col("doc_id").alias("k")),
        "labels": table(spark, sf, "labels").select(F.col("doc_id").alias("k")),
        "events": table(spark, sf, "events").select(F.floor(F.col("event_id") / 4).alias("k")),
    }
    return al.check_keys(tables, "k")


@query(
    "same_key_lists",
    """WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS k FROM documents),
         b AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS k FROM labels),
         c AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS k FROM documents WHERE n_chars >= 0)
       SELECT 'documents' AS "table", (SELECT count(*) FROM a) AS n_rows, true AS same_list
       UNION ALL SELECT 'labels', (SELECT count(*) FROM b), (SELECT bool_and(a.k IS NOT DISTINCT FROM b.k) FROM a FULL JOIN b USING (i))
       UNION ALL SELECT 'copy', (SELECT count(*) FROM c), (SELECT bool_and(a.k IS NOT DISTINCT FROM c.k) FROM a FULL JOIN c USING (i))""",
)
def same_key_lists(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    parts = {"documents": docs, "labels": labels, "copy": docs.where("n_chars >= 0")}
    numbered = {name: al.renumber(df.select("doc_id"), ["doc_id"], "i") for name, df in parts.items()}
    return al.same_key_lists(numbered, "doc_id", "i")


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return al.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "row_count_guard",
    """SELECT o_orderkey AS batch_id, CAST(floor(o_totalprice / 100000) AS BIGINT) AS n_expected, count(l_orderkey) AS n_rows
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(l_orderkey) <> n_expected""",
)
def row_count_guard(spark, sf):
    produced = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"))
    expected = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.floor(F.col("o_totalprice") / 100000).alias("n_expected")
    )
    return gn.row_count_guard(produced, expected, ["batch_id"])
