"""Queries of the operators, and the SQL they must agree with."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    bpe, collocations, cross_tokens, langid, lines, ngram_join, packing, quality, search, sharding, simhash, suffix, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"
CAPACITY = 2048
PASSAGE = 100
SHARDS = 24
TOP = 20
FOLDS = 5


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_bytes(text: str = "text"):
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def held_out(key: str = "doc_id") -> Column:
    """The rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op1_previous_factors(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix.dedup_passages(documents(spark, folder), length=PASSAGE)
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_hyperdimensional_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    profiles = langid.learn(docs, ~held_out())
    return langid.predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_string_kernel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out())
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_adaptive_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_simhash_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder), shingle=3, distance=3)


def op6_vector_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(documents(spark, folder), tokenizer(), CAPACITY)


def op7_interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    payload = {
        "doc_id": F.col("doc_id"), "size": (F.octet_length(text_bytes()) + 8).cast("long"), "text_crc32": F.crc32(text_bytes()),
    }
    dealt = sharding.interleave(documents(spark, folder), SHARDS, "source", "doc_id", payload)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    kept = lines.dedup_lines(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select(
        "doc_id", F.col("lines_removed").cast("long").alias("lines_removed"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


def op9_tree_concatenation(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), tokenizer())


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return search.top_k(vectors, F.col("vec_id") % 20 == 0, TOP)


def op11_collocation_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


def op12_grouped_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, folder))


def op13_aligned_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    return cross_tokens.alignment(documents(spark, folder), tokenizer(), public_tokenizers.path(OTHER_TOKENIZER))


SQL_PASSAGES = f"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (
  select doc_id, unnest(list_transform(range(length(h) // 2 - {PASSAGE - 1}),
    lambda i: {{'i': i, 's': md5_number(substr(h, 2 * i + 1, {2 * PASSAGE}))}})) as w from b),
later as (
  select doc_id, w.i as i from w qualify row_number() over (partition by w.s order by doc_id, w.i) > 1),
cut as (
  select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > {PASSAGE}, true) as opens from later),
runs as (
  select doc_id, i, sum(opens::int) over (partition by doc_id order by i) as run from cut),
spans as (select doc_id, run, min(i) as lo, max(i) + {PASSAGE} as hi from runs group by all),
gaps as (
  select doc_id, coalesce(lag(hi) over w, 0) as lo, lo as hi from spans window w as (partition by doc_id order by run)
  union all select doc_id, max(hi), null from spans group by doc_id),
kept as (
  select doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, length(h) // 2) - lo)), '' order by lo) as k
  from gaps join b using (doc_id) group by doc_id),
sums as (select doc_id, sum(hi - lo)::bigint as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k, h))) as kept_sha256
from b left join kept using (doc_id) left join sums using (doc_id)
"""


def _sql_quality() -> str:
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    shares = {
        "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "upper_case": ("n_upper", "word_chars"),
        "punctuation": ("n_punct", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeated": ("n_repeat_words", "n_words"),
    }
    values = ", ".join(f"case when {b} > 0 then {a} * 1000 // {b} end as {s}" for s, (a, b) in shares.items())
    cells = ", ".join(f"{{'signal': '{s}', 'value': {s}}}" for s in shares)
    def level(groups: str) -> str:
        by = groups + ", " if groups else ""
        at = "min(case when bucket >= 0 and upto >= ceil(rows * {}) then 2 * pow({}, bucket) / {} end)"
        low, mid, high = (at.format(q, quality.GAMMA, quality.GAMMA + 1) for q in (quality.LOW, 0.5, quality.HIGH))
        return f"""(select {by}signal, max(rows) as rows, {low} as low, {mid} as mid, {high} as high from (
            select *, sum(m) over (partition by {by}signal order by bucket) as upto, sum(m) over (partition by {by}signal) as rows
            from (select {by}signal, bucket, sum(case when bucket >= 0 then n else 0 end) as m from sk group by all))
          group by {by}signal)"""

    def drawn(own: str, other: str) -> str:
        c = quality.PRIOR_ROWS
        return ", ".join(
            f"case when {own}.rows > 0 then ({own}.rows * {own}.{q} + {c} * {other}.{q}) / ({own}.rows + {c}) else {other}.{q} end as {q}"
            for q in ("low", "mid", "high")
        )

    mine = "filter (signal = '{}')"
    edges = ", ".join(
        f"max((high + {quality.SPREADS} * (high - mid)) * {1 + quality.ACCURACY} + 1) {mine.format(s)} as {s}_high, "
        + (f"max((low - {quality.SPREADS} * (mid - low)) * {1 - quality.ACCURACY} - 1) {mine.format(s)}" if low else "-1")
        + f" as {s}_low"
        for s, low in quality.SIGNALS
    )
    fits = " and ".join(
        f"coalesce(c.{s} between f.{s}_low and f.{s}_high, true)" for s in shares
    )
    failed = f"(n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words)"
    return f"""
with t as (
  select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}+') as ws from documents),
l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as ls from t),
r as (
  select doc_id, unnest([w.i, w.i + 1, w.i + 2]) as i from (
    select doc_id, w, count(*) over (partition by doc_id, w.s) as n from (
      select doc_id, unnest(list_transform(range(1, len(ws) - 1),
        lambda i: {{'i': i, 's': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) as w from t)) where n > 1),
rep as (select doc_id, count(distinct i) as n from r group by 1),
k as (
  select doc_id, lang, source, len(ws) as n_words, length(regexp_replace(t, '{space}+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
    length(regexp_replace(t, '[^!-/:-@\\[-`{{-~]', '', 'g')) as n_punct
  from l left join rep using (doc_id)),
c as (select *, {values} from k),
sk as (
  select lang, source, x.signal as signal, case when x.value > 0 then ceil(ln(x.value) / {math.log(quality.GAMMA)!r})::int else -1 end as bucket,
    count(*) as n from (select lang, source, unnest([{cells}]) as x from c where not {failed}) where x.value is not null group by all),
a as {level("lang, source")}, b as {level("lang")}, z as {level("")},
bz as (select b.lang, b.signal, {drawn("b", "z")} from b join z using (signal)),
abz as (
  select a.lang, a.source, a.signal, {drawn("a", "bz")}
  from a join bz on a.lang is not distinct from bz.lang and a.signal = bz.signal),
f as (select lang, source, {edges} from abz group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} as base_failed, not {failed} and {fits} as kept
from c left join f on c.lang is not distinct from f.lang and c.source is not distinct from f.source
"""


SQL_LINES = """
with cut as (select doc_id, coalesce(text, '') as text, string_split(text, chr(10)) as ls from documents),
windows as (
  select doc_id, unnest(range(1, len(ls) - 1)) as i, ls from cut where len(ls) >= 3),
texts as (
  select doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] as w from windows),
later as (
  select doc_id, i from texts where regexp_matches(w, '\\S')
  qualify row_number() over (partition by w order by doc_id, i) > 1),
gone as (select distinct doc_id, i + d as i from later, (values (0), (1), (2)) as t(d)),
rest as (
  select c.doc_id, c.text, list(g.i) filter (g.i is not null) as gone, any_value(c.ls) as ls
  from cut c left join gone g using (doc_id) group by c.doc_id, c.text)
select doc_id, coalesce(len(gone), 0) as lines_removed,
  sha256(case when gone is null then text else coalesce(array_to_string(
    list_transform(list_filter(range(1, len(ls) + 1), lambda x: NOT list_contains(gone, x)), lambda x: ls[x]), chr(10)), '') end)
  as kept_sha256
from rest
"""

# The tables of the CRC, from its polynomial; a byte of the text is two hex digits.
SQL_SHARDS = """
with recursive crc(n, step, v) as (
  select n, 0, n from range(256) as t(n)
  union all
  select n, step + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from crc where step < 8),
tbl as (select list(v order by n) as t from crc where step = 8),
docs as (
  select doc_id, source, coalesce(text, '') as text, md5('0:' || coalesce(doc_id::varchar, '')) as shuffle,
    hex(encode(coalesce(text, ''))) as hexed from documents),
sums as (
  select doc_id, source, shuffle, length(hexed) // 2 + 8 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(hexed) // 2),
      lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::bigint)),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) as crc
  from docs, tbl),
ranked as (
  select *, (row_number() over (partition by source order by shuffle, doc_id) - 0.5::double)
    / count(*) over (partition by source) as fraction from sums),
mixed as (
  select *, row_number() over (order by fraction, source nulls first, doc_id) - 1 as r, count(*) over () as n from ranked)
select doc_id, size, crc as text_crc32, 'rows' as law, (r * 24 // n)::int as shard,
  r - ((r * 24 // n) * n + 23) // 24 as slot, null::int as grown_shard
from mixed
"""

SQL_TOP = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id as query_id, row_number() over (partition by q.vec_id order by list_dot_product(q.e, c.e) desc, c.vec_id)::int as rank,
  c.vec_id, list_dot_product(q.e, c.e)::bigint as score
from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
qualify rank <= 20
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_COLLOCATIONS = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\n\\x0b\\x0c\\r]')) as piece from documents),
split as (select lang, regexp_extract_all(piece, '[^ \\t]+') as ws from pieces),
f as (
  select lang, m, p as phrase, count(*) as a from (
    select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as p
    from split, range(1, {collocations.LONGEST + 1}) as t(m)) group by all),
totals as (select lang, sum(a) as n from f where m = 1 group by lang),
c as (select lang, m, phrase, a, string_split(phrase, ' ') as ws from f where m > 1 and a >= {collocations.LEAST}),
cuts as (select *, unnest(range(1, m)) as k from c),
scored as (
  select cuts.lang, cuts.phrase, cuts.a, min({{'score': ({collocations.SCALE}::hugeint * cuts.a) // (x.a + y.a), 'k': k, 'l': x.a, 'r': y.a}}) as best
  from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(ws[1:k], ' ')
    join f y on y.lang = cuts.lang and y.phrase = array_to_string(ws[k + 1:], ' ') group by all),
inner_ as (select lang, ws, m, a, unnest(range(2, m)) as s from c where m > 2),
longer as (
  select lang, phrase, max(a) as longest from (
    select lang, a, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) as phrase from inner_)
  group by all)
select lang, row_number() over w as rank, phrase, a, best.l::bigint as l, best.r::bigint as r, n::bigint as n, best.score::bigint as score
from scored left join longer using (lang, phrase) join totals using (lang)
where longest is null or 100::hugeint * longest < {collocations.COVERED_PERCENT}::hugeint * a
window w as (partition by lang order by best.score desc, a desc, phrase)
qualify rank <= {collocations.TOP}
"""

SQL_NGRAM_JOIN = f"""
with recursive cut as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as g from cut),
grams as (select doc_id, len(g) as n, unnest(g) as gram from sets),
links as (
  select a.doc_id as a, b.doc_id as b from grams a join grams b using (gram)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= {ngram_join.SIMILAR[0]} * (a.n + b.n - count(*))),
reached as (
  select a, b from links
  union
  select r.a, l.b from reached r join links l on r.b = l.a),
least as (select a as doc_id, min(b) as component_id from reached group by a)
select doc_id, len(g) as n_shingles, coalesce(component_id, doc_id) as component_id from sets left join least using (doc_id)
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_previous_factors, op2_hyperdimensional_language, op3_string_kernel_toxicity, op4_adaptive_quality,
        op5_simhash_anchors, op6_vector_best_fit, op7_interleaved_shards, op8_line_windows, op9_tree_concatenation, op10_exact_top_k,
        op11_collocation_tiles, op12_grouped_prefix_join, op13_aligned_tokenizers,
    )
}

SQL: dict[str, str] = {
    "op1_previous_factors": SQL_PASSAGES, "op4_adaptive_quality": _sql_quality(),
    "op7_interleaved_shards": SQL_SHARDS, "op8_line_windows": SQL_LINES, "op10_exact_top_k": SQL_TOP,
    "op11_collocation_tiles": SQL_COLLOCATIONS, "op12_grouped_prefix_join": SQL_NGRAM_JOIN,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def sql() -> dict[str, str]:
    return dict(SQL)
