"""Quality rules with adaptive thresholds from mergeable quantile sketches.

The sketch of a signal is the number of rows per logarithmic bucket: counts add up, so sketches of files, days or
sources merge by a sum, in any order and with the same result. Quantiles are right to 1 % of their value. Each
language and source gets its own fences from its own spread; its quantiles are drawn towards those of its language, and
these towards those of all rows, the more the fewer rows it has, without a size at which the rule changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.session import materialise

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
# A fence lies so many times the distance from the median to the outer quantile beyond that quantile. A quarter of a
# group's rows may be junk before the outer quantile is one of theirs.
LOW, HIGH = 0.25, 0.75
SPREADS = 10.0
# A group of so many rows has the same weight as what it is drawn towards.
PRIOR_ROWS = 200
# Signals in thousandths, and whether a low value is bad as well.
SIGNALS = [
    ("word_length", True), ("symbols", False), ("upper_case", False), ("punctuation", False), ("dup_lines", False),
    ("repeated", False),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]

_UPPER = bytes(range(65, 91))
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(words) - 2 + i] |= often
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of `COUNTS`; words end at ASCII white space only."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines), len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _PUNCT)),
    )


def counts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, COUNTS) of every row; a null text has no words."""
    inputs = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))

    def start():
        def work(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
            found = np.array([text_counts(t or "") for t in batch["text"]], np.int64).reshape(-1, len(COUNTS))
            yield np.arange(len(batch)), pd.DataFrame(found, columns=COUNTS)

        return work

    done = map_rows(inputs, [f"k{i}" for i in range(len(keys))], start, ", ".join(f"{c} long" for c in COUNTS))
    return done.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *COUNTS)


def signals() -> dict[str, Column]:
    """The signals from the counts, as whole thousandths; null without words."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b)))

    return {
        "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
        "upper_case": share("n_upper", "word_chars"), "punctuation": share("n_punct", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeated": share("n_repeat_words", "n_words"),
    }


def bucket(value: Column) -> Column:
    """Bucket b holds the values above GAMMA ** (b - 1) up to GAMMA ** b; 0 has one of its own."""
    return F.when(value > 0, F.ceil(F.ln(value) / F.lit(math.log(GAMMA)))).otherwise(F.lit(-1)).cast("int")


def sketch(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, signal, bucket, n): combined before the shuffle, a few hundred rows per group and signal at most."""
    cells = [F.struct(F.lit(s).alias("signal"), bucket(c).alias("bucket"), c.alias("value")) for s, c in signals().items()]
    long = rows.select(*groups, F.explode(F.array(*cells)).alias("cell")).where("cell.value is not null")
    return long.groupBy(*groups, F.col("cell.signal").alias("signal"), F.col("cell.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of finer groups, or several sketches of the same ones, added up."""
    return sketches.groupBy(*groups, "signal", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, a struct of rows, low, mid and high for each signal): the outer quantiles and the median of the values above
    0, a value that most rows of some signals have. The window runs over the buckets of one sketch, whose number is
    bounded by the logarithm of the largest value."""
    one = Window.partitionBy(*groups, "signal")
    counted = F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)
    placed = sketches.withColumn("upto", F.sum(counted).over(one.orderBy("bucket"))).withColumn("rows", F.sum(counted).over(one))
    value = 2 * F.pow(F.lit(GAMMA), F.col("bucket")) / F.lit(GAMMA + 1)

    def at(q: float) -> Column:
        return F.min(F.when((F.col("bucket") >= 0) & (F.col("upto") >= F.ceil(F.col("rows") * q)), value))

    found = placed.groupBy(*groups, "signal").agg(
        F.max("rows").alias("rows"), at(LOW).alias("low"), at(0.5).alias("mid"), at(HIGH).alias("high")
    )
    mine = F.struct("rows", "low", "mid", "high")
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("signal") == s, mine)).alias(s) for s, _ in SIGNALS])


def drawn(own: str, towards: dict[str, Column], prior_rows: int = PRIOR_ROWS) -> dict[str, Column]:
    """The quantiles of the struct `own`, as a mean with others that weigh as much as `prior_rows` rows."""
    n = F.col(f"{own}.rows")
    return {
        q: F.when(n > 0, (n * F.col(f"{own}.{q}") + prior_rows * other) / (n + prior_rows)).otherwise(other)
        for q, other in towards.items()
    }


def thresholds(sketches: DataFrame, lang: str, source: str, spreads: float = SPREADS) -> DataFrame:
    """(lang, source, lowest and highest value that pass for each signal): a row per group, from its quantiles drawn towards
    those of its language, drawn towards those of all. 1 % and a thousandth, what sketch and signals round, are let pass;
    a signal that is 0 in all rows has no fence."""
    own, wide, whole = (quantiles(sketches if len(g) == 2 else merge(sketches, g), g) for g in ([lang, source], [lang], []))
    every = [s for s, _ in SIGNALS]
    wide = wide.select(F.col(lang).alias("__wide_lang"), F.struct(*every).alias("wide"))
    whole = whole.select(F.lit(1).alias("__all"), F.struct(*every).alias("whole"))
    joined = own.join(wide, F.col(lang).eqNullSafe(F.col("__wide_lang")), "left").withColumn("__one", F.lit(1))
    joined = joined.join(whole, F.col("__one") == F.col("__all"), "left")
    columns = []
    for name, low_is_bad in SIGNALS:
        q = {k: F.col(f"whole.{name}.{k}") for k in ("low", "mid", "high")}
        for level in (f"wide.{name}", name):
            q = drawn(level, q)
        high = (q["high"] + spreads * (q["high"] - q["mid"])) * (1 + ACCURACY) + 1
        low = (q["low"] - spreads * (q["mid"] - q["low"])) * (1 - ACCURACY) - 1
        columns += [high.alias(f"{name}_high"), (low if low_is_bad else F.lit(-1.0)).alias(f"{name}_low")]
    return joined.select(lang, source, *columns)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", others: list[str] = ()) -> DataFrame:
    """(key, lang, source, COUNTS, base_failed, kept, others) of every row; the others are columns that are asked for.

    base_failed: fewer than 50 words, or over half of the words in repeated windows; such rows are never kept and do not
    count in the sketches. The others are kept if all signals lie within the fences of their language and source. Null
    languages and sources are groups of their own; a null or empty text fails. Repeated rows are counted and returned
    as often as they come; columns not asked for are not read; an empty table gives an empty result. Building the result writes
    the counts and the sketch.
    """
    rows = df.select(
        F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.col(text).alias("__text"),
        *others,
    )
    rows = materialise(counts(rows, ["__key", "__lang", "__source", *others], "__text"), "counts")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    sketches = materialise(sketch(rows.where(~failed), ["__lang", "__source"]), "sketch")
    bars = thresholds(sketches, "__lang", "__source").withColumnsRenamed({"__lang": "__l", "__source": "__s"})
    joined = rows.join(
        bars,
        F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left",
    )
    within = F.lit(True)
    for name, value in signals().items():
        within = within & F.coalesce(value.between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    return joined.select(
        F.col("__key").alias(key), F.col("__lang").alias(lang), F.col("__source").alias(source), *COUNTS,
        failed.alias("base_failed"), (~failed & within).alias("kept"), *others,
    )
