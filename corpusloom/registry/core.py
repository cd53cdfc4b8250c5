"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.text import CONTROLS, FANCY, PLAIN, SPACES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Keys of the text tables.
TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts as it is stored; with the session setting `corpusloom.spread` = n its rows are dealt by key to n
    partitions first, for tables stored in fewer pieces than there are cores. The size of the table decides nothing."""
    df = table(spark, folder, name)
    spread = spark.conf.get("corpusloom.spread", None)
    return df.repartition(int(spread), *TEXT_KEYS[name]) if spread else df


# --- SQL text shared by several checks ----------------------------------------------------------------------------

RE_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RE_BREAK = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def sql_strip(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def sql_blank(x: str) -> str:
    return f"(coalesce({sql_strip(x)}, '') = '')"


def sql_lines(x: str) -> str:
    return f"regexp_split_to_array(regexp_replace({x}, '{RE_BREAK}$', ''), '{RE_BREAK}')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{RE_SPACE}]+')"


def sql_sentences(x: str) -> str:
    return (
        f"greatest(1, len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda s: NOT {sql_blank('s')})))"
    )


def sql_punct(x: str) -> str:
    pairs = x
    for old, new in zip(FANCY, PLAIN, strict=True):
        pairs = f"replace({pairs}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    pairs = f"replace({pairs}, '…', '...')"
    return f"regexp_replace({pairs}, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g')"


def sql_latex(x: str) -> str:
    marked = sql_punct(x)
    for i, ch in enumerate("\\~^", start=1):
        marked = f"replace({marked}, '{ch}', chr({i}))"
    marked = f"regexp_replace({marked}, '([&%$#_{{}}])', '\\\\\\1', 'g')"
    for i, macro in enumerate(("textbackslash", "textasciitilde", "textasciicircum"), start=1):
        marked = f"replace({marked}, chr({i}), '\\{macro}{{}}')"
    return marked


assert len(CONTROLS) == 30
