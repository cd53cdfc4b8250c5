"""Column functions on small literals."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import codes as cd
from corpusloom.functions import requests as rq
from corpusloom.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("out")).first()["out"]


def many(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["out"] for r in df.select("i", fn("t").alias("out")).orderBy("i").collect()]


WORDS = st.lists(st.text(alphabet="aZ é\t\n\r\x0b\x1c\x85\xa0  .!?-`“”…&%$#_{}~^\\\x01", max_size=30), min_size=1, max_size=30)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(WORDS)
def test_strip_and_blank_follow_unicode(spark, texts):
    assert many(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert many(spark, texts, tx.is_blank) == [not t.strip() for t in texts]


@QUICK
@given(WORDS)
def test_lines_and_counts(spark, texts):
    from corpusloom.functions import lexical as lx

    joined = many(spark, texts, lambda t: F.array_join(tx.split_lines(t), "|"))
    assert joined == ["|".join(t.splitlines()) for t in texts]
    assert many(spark, texts, lx.token_count) == [len(t.split()) for t in texts]
    assert many(spark, texts, lx.tokens) == [t.split() for t in texts]


@QUICK
@given(WORDS)
def test_latex_escape(spark, texts):
    plain = {"`": "'", "“": '"', "”": '"', "…": "...", "\xa0": " "}
    special = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}

    def expected(t):
        kept = "".join(plain.get(c, c) for c in t if ord(c) >= 32 or c in "\n\t")
        return "".join(special.get(c, c) for c in kept)

    assert many(spark, texts, tx.latex_escape) == [expected(t) for t in texts]


def test_slug_is_cut_and_hashed(spark):
    import hashlib

    def expected(text):
        words = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
        slug = "-".join("".join(c if c.isascii() and (c.isalnum() or c == "-") else " " for c in words).split())
        return slug if len(slug) <= 30 else slug[:23].rstrip("-") + "-" + hashlib.sha1(slug.encode()).hexdigest()[:6]

    texts = ["Walking in the city", " Éa_b  ç!", "a - b", "ñ" * 40, "Staying dry and warm on long winter walks", "", "ﬁne ½"]
    assert many(spark, texts, tx.slugify) == [expected(t) for t in texts]


def test_dataset_name(spark):
    assert one(spark, tx.dataset_name(F.lit("ADVICE"), "Merged", F.lit("Urban Walk"))) == "Advice_Merged_urban-walk.csv"


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("```text\nHello\n```", "text\nHello"),
        ("  “Hello  \nyou” ", "Hello\nyou"),
        ("[SN3 whatever]\n\nBody", "Body"),
        ("STYLE:\nBody", "Body"),
        ("k - Body", "Body"),
        ("Knot - Body", "Knot - Body"),
        ("``````", "``````"),
        ("", ""),
    ],
)
def test_clean_body(spark, raw, clean):
    assert one(spark, tx.clean_body("t"), t=raw) == clean


def test_titles(spark):
    title = tx.build_title(F.lit(3), F.lit(" Text 3 – Go out. "), F.lit("t"), [F.lit("SN1"), F.lit(" ")], numbered=True)
    assert one(spark, title) == "3. Go out - SN1"
    none = F.lit(None).cast("string")
    assert one(spark, tx.build_title(F.lit(3), none, none)) == ""
    assert one(spark, tx.build_title(F.lit(3), none, none, tidy=False)) == "Text 3"
    assert one(spark, tx.build_title(F.lit(1), F.lit("12) Walk"), none)) == "Walk"


def test_labels_round_half_even(spark):
    assert one(spark, tx.mean_std_label(F.lit(0.125), F.lit(2.675))) == f"{0.125:.2f} ({2.675:.2f})"
    assert one(spark, tx.mean_std_label(F.lit(1234567.0), F.lit(None).cast("double"))) == "1234567.00 (nan)"
    assert one(spark, tx.percent_label(F.lit(34.65), scale=False)) == f"{34.65:.1f}%"
    assert one(spark, tx.percent_label(F.lit(None).cast("double"))) == "0.0%"


def test_codes(spark):
    text = F.lit("sn12A, SN3 (SN3) xSN4 SN2é SN10_")
    assert one(spark, cd.extract_codes(text, "SN")) == ["SN12a", "SN3"]
    assert one(spark, cd.coerce_codes(F.lit("sn2B; de4,, foo 77 SN2b"))) == ["DE4", "SN2b"]
    assert one(spark, cd.coerce_code_list(F.array(F.lit("sn1 sn2"), F.lit(None).cast("string")))) == ["SN1", "SN2"]
    assert one(spark, cd.coerce_codes(F.lit(None).cast("string"))) == []
    assert one(spark, cd.strip_trailing_codes(F.lit("A title - (sn1a, DE3) "), "SN", "DE")) == "A title"
    assert one(spark, cd.strip_trailing_codes(F.lit("(SN1)"), "SN", "DE")) == "(SN1)"
    rows = spark.createDataFrame([("SN10",), ("SN2b",), ("SN2",), ("x",)], "c string")
    assert [r["c"] for r in rows.orderBy(cd.natural_code_key("c")).collect()] == ["SN2", "SN2b", "SN10", "x"]


def test_facet_filter_with_nothing_active(spark):
    codes = F.array(F.lit("SN1"))
    assert one(spark, cd.facet_filter(codes, [])) is True
    assert one(spark, cd.facet_filter(codes, [], allow_all_when_empty=False)) is False


def test_secrets(spark):
    raw = "Authorization: Bearer abcdefghijklmnop1234 and sk-abcd1234, api_key = 'abcdefghijklmnop' OPENAI_API_KEY=abcdefghijklmnop"
    out = one(spark, rq.redact_secrets("t"), t=raw)
    assert out == (
        "Authorization: Bearer ***REDACTED*** and sk-***REDACTED***, api_key = '***REDACTED*** OPENAI_API_KEY=***REDACTED***"
    ).replace("'***REDACTED*** ", "'***REDACTED***' ")
    assert one(spark, rq.redact_secrets(F.lit(None).cast("string"))) == ""


def test_json_object_in_prose(spark):
    assert one(spark, rq.extract_json_object(F.lit('```json\n{"a": {"b": 1}}\n``` bye }'))) == '{"a": {"b": 1}}'
    assert one(spark, rq.extract_json_object(F.lit('I think {"a": 1} fits'))) == '{"a": 1}'
    assert one(spark, rq.extract_json_object(F.lit("no object"))) == "no object"


def test_header_checks(spark):
    df = spark.createDataFrame([], "`﻿Num` string, Code_SN string")
    assert schemas.check_columns(df, ["Num", "Code_SN"]) == []
    with pytest.raises(ValueError):
        schemas.check_columns(df, schemas.MAPPING_COLUMNS)
    assert schemas.check_columns(df, schemas.MAPPING_COLUMNS, "warn") == ["missing Code_DE"]
    assert schemas.pick_column(df, "Text", "Code_SN") == "Code_SN"
    with pytest.raises(ValueError):
        schemas.pick_column(df, "Text", "Generated_Text")
