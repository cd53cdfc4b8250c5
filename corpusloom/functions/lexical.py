"""Per-text measures. All stay inside the row: no token leaves its text, so nothing is shuffled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ASCII_SPACE_CLASS, _col, fold_spaces, let, strip

HDD_DRAWS = 42
MTLD_THRESHOLD = 0.72
MIN_TOKENS_ADVANCED = 5


def normalized(c: Column | str) -> Column:
    """Lower case, letters, digits and spaces only: the optional second tokeniser."""
    return F.regexp_replace(F.lower(fold_spaces(c)), rf"[^a-z\p{{L}}\p{{N}}{ASCII_SPACE_CLASS}]+", "")


def _folded(c: Column | str) -> Column:
    return F.coalesce(fold_spaces(c), F.lit(""))


def tokens(c: Column | str, tokenizer: str = "whitespace") -> Column:
    """White-space separated tokens, case kept; `normalized` lower-cases and drops punctuation first."""
    text = normalized(c) if tokenizer == "normalized" else c
    return let(
        strip(_folded(text)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{ASCII_SPACE_CLASS}]+")),
    )


def token_count(c: Column | str) -> Column:
    return F.regexp_count(_folded(c), F.lit(f"[^{ASCII_SPACE_CLASS}]+"))


def sentence_count(c: Column | str) -> Column:
    """Non-blank pieces between runs of `.!?`, at least one."""
    # A piece starts at a character that is neither a stop nor a space and runs to the next stop.
    piece = rf"[^.!?{ASCII_SPACE_CLASS}][^.!?]*"
    return F.greatest(F.lit(1), F.regexp_count(_folded(c), F.lit(piece)))


def token_counts(words: Column) -> Column:
    """array<struct(token, n)> of the distinct tokens of an array, in token order."""

    def ends_of_runs(s: Column) -> Column:
        ends = F.transform(s, lambda x, i: F.when(~x.eqNullSafe(F.get(s, i + 1)), i + 1))
        return let(F.filter(ends, lambda e: e.isNotNull()), lambda e: runs(s, e))

    def runs(s: Column, ends: Column) -> Column:
        return F.transform(
            ends,
            lambda e, k: F.struct(
                F.get(s, e - 1).alias("token"), (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).alias("n")
            ),
        )

    return let(F.sort_array(words), ends_of_runs)


def type_counts(words: Column) -> Column:
    """How often each distinct token of an array occurs, as an array of counts."""

    def ends_of_runs(s: Column) -> Column:
        ends = F.transform(s, lambda x, i: F.when(~x.eqNullSafe(F.get(s, i + 1)), i + 1))
        return F.filter(ends, lambda e: e.isNotNull())

    def lengths(ends: Column) -> Column:
        return F.transform(ends, lambda e, k: e - F.coalesce(F.get(ends, k - 1), F.lit(0)))

    return let(let(F.sort_array(words), ends_of_runs), lengths)


def _absent_probability(n: Column, f: Column) -> Column:
    """Chance that a type seen `f` times in `n` tokens is missed by all draws, without replacement."""
    draws = F.sequence(F.lit(0), F.lit(HDD_DRAWS - 1))
    return F.aggregate(
        draws, F.lit(1.0), lambda acc, i: acc * F.greatest(n - f - i, F.lit(0)).cast("double") / (n - i).cast("double")
    )


def _hdd(counts: Column, n: Column) -> Column:
    def share(f: Column) -> Column:
        types = F.size(F.filter(counts, lambda x: x == f)).cast("double")
        return types * (F.lit(1.0) - _absent_probability(n, f)) / F.lit(float(HDD_DRAWS))

    total = F.aggregate(F.transform(F.sort_array(F.array_distinct(counts)), share), F.lit(0.0), lambda a, x: a + x)
    return F.when(n >= HDD_DRAWS, total)


def lexical_profile(c: Column | str, tokenizer: str = "whitespace", hdd: bool = True) -> Column:
    """struct(n_tokens, n_types, n_hapax, hdd) of a text."""

    def profile(counts: Column) -> Column:
        n = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        fields = [
            n.alias("n_tokens"),
            F.size(counts).alias("n_types"),
            F.size(F.filter(counts, lambda x: x == 1)).alias("n_hapax"),
        ]
        if hdd:
            fields.append(let(n, lambda m: _hdd(counts, m)).alias("hdd"))
        return F.struct(*fields)

    return let(type_counts(tokens(c, tokenizer)), profile)


def ttr(v: Column, n: Column) -> Column:
    return F.when(n > 0, v / n)


def hapax_ratio(h: Column, n: Column) -> Column:
    return F.when(n > 0, h / n)


def herdan_c(v: Column, n: Column) -> Column:
    return F.when(n > 1, F.ln(v) / F.ln(n))


def _advanced(n: Column, value: Column) -> Column:
    return F.when(n >= MIN_TOKENS_ADVANCED, value)


def rttr(v: Column, n: Column) -> Column:
    return _advanced(n, v / F.sqrt(n))


def cttr(v: Column, n: Column) -> Column:
    return _advanced(n, v / F.sqrt(n * 2))


def maas(v: Column, n: Column) -> Column:
    return _advanced(n, (F.ln(n) - F.ln(v)) / F.pow(F.ln(n), F.lit(2)))


def _factors(words: list[str], threshold: float) -> float:
    """Number of stretches whose type/token ratio falls to the threshold, the last one in part."""
    full, seen, size, ratio = 0, set(), 0, 1.0
    for word in words:
        size += 1
        seen.add(word)
        ratio = len(seen) / size
        if ratio <= threshold:
            full += 1
            seen, size = set(), 0
    return full + ((1 - ratio) / (1 - threshold) if size else 0.0)


def _mtld_of(words: list[str], threshold: float) -> float:
    passes = []
    for sequence in (words, words[::-1]):
        factors = _factors(sequence, threshold)
        if factors == 0:
            # Every token differs: one factor by convention.
            factors = 1.0
        passes.append(len(words) / factors)
    return sum(passes) / 2


def mtld(c: Column | str, tokenizer: str = "whitespace", threshold: float = MTLD_THRESHOLD) -> Column:
    """Mean length of stretches above the type/token threshold, both directions; null below five tokens.

    The fold depends on token order and on a growing set, which array expressions cannot hold cheaply.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = [] if text is None else text.split()
            out.append(_mtld_of(words, threshold) if len(words) >= MIN_TOKENS_ADVANCED else None)
        return pd.Series(out, dtype="float64")

    text = normalized(c) if tokenizer == "normalized" else _col(c)
    return score(text)
