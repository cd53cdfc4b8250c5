"""Code distributions, per-text metrics, corpus summaries and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import lexical as lx
from corpusloom.functions.text import is_blank, mean_std_label
from corpusloom.operators.alignment import join_null_safe, running_total
from corpusloom.session import materialise

# Metric names by source.
DIRECT_METRICS = ["len_tokens", "len_chars", "word_count", "len_sentences"]
PACKAGE_METRICS = ["TTR", "RTTR", "CTTR", "HDD", "MTLD", "Maas", "HapaxRatio", "HerdanC"]


# --- codes --------------------------------------------------------------------------------------------------------


def code_counts(df: DataFrame, code: str) -> DataFrame:
    """(code, n) of the non-null codes."""
    return df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def code_distribution(df: DataFrame, code: str, reference: DataFrame | None = None) -> DataFrame:
    """(code, n, percentage[, name]): shares of the non-null codes in percent, two decimals, half to even."""
    counts = code_counts(df, code)
    total = counts.agg(F.sum("n")).scalar()
    shares = counts.withColumn("percentage", F.bround(F.col("n") / total * 100, 2))
    return shares if reference is None else name_distribution(shares, reference)


def name_distribution(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts with the name of each code, null for unknown ones."""
    return counts.join(reference.select("code", "name"), "code", "left")


def _per_code(df: DataFrame, codes: list[str]) -> DataFrame:
    """(code_type, code, n), nulls counted too: every code column in one pass, combined before the shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("code_type"), F.col(c).cast("string").alias("code")) for c in codes])
    return df.select(F.inline(cells)).groupBy("code_type", "code").agg(F.count(F.lit(1)).alias("n"))


def _diversity(counts: DataFrame, *by: str) -> DataFrame:
    known = F.col("code").isNotNull()
    n_known = F.sum(F.when(known, F.col("n")))
    # As doubles: the square of a large count does not fit a long.
    share = F.when(known, F.col("n").cast("double"))
    squares, total = F.sum(share * share), F.sum(share)
    return counts.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        n_known.alias("n_known"),
        F.count("code").alias("n_codes"),
        (F.count("code") / F.sum("n") * 100).alias("diversity_pct"),
        (squares / (total * total)).alias("herfindahl"),
    )


def diversity(df: DataFrame, code: str) -> DataFrame:
    """One row: distinct codes per hundred rows (null rows count), and the sum of squared shares of known codes."""
    counts = df.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return _diversity(counts).withColumn("diversity_pct", F.coalesce("diversity_pct", F.lit(0.0)))


def distribution_report(df: DataFrame, codes: list[str]) -> DataFrame:
    """Counts, shares and diversity of several code columns at once."""
    counts = materialise(_per_code(df, codes), "counts")
    totals = _diversity(counts, "code_type")
    # One row per code column.
    joined = counts.where(F.col("code").isNotNull()).join(F.broadcast(totals), "code_type")
    return joined.select(
        "code_type", "code", "n", F.bround(F.col("n") / F.col("n_known") * 100, 2).alias("percentage"),
        "diversity_pct", "herfindahl",
    )


def corpus_sizes(df: DataFrame, corpus: str) -> DataFrame:
    return df.groupBy(F.col(corpus).alias("corpus")).agg(F.count(F.lit(1)).alias("n_texts"))


# --- texts --------------------------------------------------------------------------------------------------------


def length_metrics(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Length measures of every non-blank text; a narrow projection."""
    n = lx.token_count(text)
    return df.where(~is_blank(text)).select(
        *keys, n.cast("double").alias("len_tokens"), F.length(text).cast("double").alias("len_chars"),
        n.cast("double").alias("word_count"), lx.sentence_count(text).cast("double").alias("len_sentences"),
    )


def text_metrics(
    df: DataFrame,
    text: str,
    keys: list[str],
    *,
    tokenizer: str = "whitespace",
    hdd: bool = True,
    mtld: bool = True,
) -> DataFrame:
    """Length and lexical measures of every non-blank text; narrow, whatever the number of tokens."""
    lengths = [
        F.length(text).cast("double").alias("len_chars"),
        lx.sentence_count(text).cast("double").alias("len_sentences"),
        lx.lexical_profile(text, tokenizer, hdd).alias("p"),
    ]
    if tokenizer != "whitespace":
        lengths.append(lx.token_count(text).alias("n_words"))
    if mtld:
        lengths.append(lx.mtld(text, tokenizer).alias("MTLD"))
    base = df.where(~is_blank(text)).select(*keys, *lengths)
    n, v, h = F.col("p.n_tokens"), F.col("p.n_types"), F.col("p.n_hapax")
    words = n if tokenizer == "whitespace" else F.col("n_words")
    return base.select(
        *keys,
        words.cast("double").alias("len_tokens"), "len_chars", words.cast("double").alias("word_count"),
        "len_sentences",
        lx.ttr(v, n).alias("TTR"), lx.hapax_ratio(h, n).alias("HapaxRatio"), lx.herdan_c(v, n).alias("HerdanC"),
        lx.rttr(v, n).alias("RTTR"), lx.cttr(v, n).alias("CTTR"), lx.maas(v, n).alias("Maas"),
        *([F.col("p.hdd").alias("HDD")] if hdd else []),
        *([F.col("MTLD")] if mtld else []),
    )


# --- summaries ----------------------------------------------------------------------------------------------------

_ACCURACY = 10_000
_MARGIN = 5 / _ACCURACY


def _finite(name: str) -> Column:
    c = F.col(name).cast("double")
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~bad, c)


STATISTICS = ["n_texts", "n", "mean", "median", "std", "min", "max"]


def corpus_summary(metrics: DataFrame, corpus: list[str], names: list[str], *, median: bool = True) -> DataFrame:
    """Long form (corpus…, metric, n_texts, n, mean, median, std, min, max), one row per corpus and metric.

    Two passes over `metrics`, which should therefore be a written table. The first takes the moments and, for
    each metric, a narrow bracket that surely holds the median; the second counts what lies below the bracket and
    the distinct values inside, and ranks these by ranges. No group is ever held whole: a corpus may own most of the
    texts. Without `median` there is one pass and no such column. A null corpus is a corpus. A corpus column may be
    called anything but `metric`; a statistic of the same name is then called `<name>_of_metric`. Writes tables.
    """
    if "metric" in corpus:
        raise ValueError("a corpus column cannot be called metric")
    groups = [f"__g{i}" for i in range(len(corpus))]
    inner = [f"__m{i}" for i in range(len(names))]
    clean = metrics.select(
        *[F.col(c).alias(g) for c, g in zip(corpus, groups)], *[_finite(m).alias(i) for m, i in zip(names, inner)]
    )
    probes = [0.5 - _MARGIN, 0.5 + _MARGIN]
    aggregates = [F.count(F.lit(1)).alias("__texts")]
    for m in inner:
        aggregates.append(
            F.struct(
                F.count(m).alias("n"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"),
                F.max(m).alias("max"), *([F.percentile_approx(m, probes, _ACCURACY).alias("bracket")] if median else []),
            ).alias(f"{m}_s")
        )
    # Written: both uses read it from there, and its known size lets the texts stay where they are.
    wide = materialise(clean.groupBy(*groups).agg(*aggregates), "moments")
    cells = F.array(*[F.struct(F.lit(m).alias("__metric"), F.col(f"{i}_s").alias("__s")) for m, i in zip(names, inner)])
    long = wide.select(*groups, "__texts", F.inline(cells))
    if median:
        long = join_null_safe(long, _medians(clean, wide, groups, names, inner), [*groups, "__metric"], "left")
    values = {"n_texts": F.col("__texts"), "n": F.col("__s.n"), "mean": F.col("__s.mean")}
    if median:
        lost = (F.col("__s.n") > 0) & F.col("__median").isNull()
        values["median"] = F.when(lost, F.raise_error(F.lit("the bracket does not hold the median")).cast("double")).otherwise(F.col("__median"))
    values |= {s: F.col(f"__s.{s}") for s in ("std", "min", "max")}
    return long.select(
        *[F.col(g).alias(c) for c, g in zip(corpus, groups)], F.col("__metric").alias("metric"),
        *[v.alias(f"{s}_of_metric" if s in corpus else s) for s, v in values.items()],
    )


def _medians(clean: DataFrame, wide: DataFrame, groups: list[str], names: list[str], inner: list[str]) -> DataFrame:
    """(groups, __metric, __median): the exact medians."""
    brackets = wide.select(*groups, *[F.col(f"{i}_s.bracket").alias(f"{i}_b") for i in inner])
    keyed = join_null_safe(clean, brackets, groups)
    cells = F.array(
        *[
            F.when(
                F.col(i) <= F.get(F.col(f"{i}_b"), F.lit(1)),
                F.struct(
                    F.lit(m).alias("__metric"),
                    F.when(F.col(i) >= F.get(F.col(f"{i}_b"), F.lit(0)), F.col(i)).alias("__value"),
                ),
            )
            for m, i in zip(names, inner)
        ]
    )
    values = keyed.select(*groups, F.inline(F.filter(cells, lambda x: x.isNotNull())))
    group = [*groups, "__metric"]
    # __value is null for everything below the bracket: one combined row per group.
    counted = values.groupBy(*group, "__value").agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_total(counted, [*[F.col(g) for g in group], F.col("__value").asc_nulls_first()], "__c", "__last")
    before = ranked.groupBy(*group).agg(F.min(F.col("__last") - F.col("__c")).alias("__before"))
    sizes = wide.select(*groups, F.inline(F.array(*[
        F.struct(F.lit(m).alias("__metric"), F.col(f"{i}_s.n").alias("__n")) for m, i in zip(names, inner)
    ])))
    sized = join_null_safe(ranked, join_null_safe(before, sizes, group), group)
    last = F.col("__last") - F.col("__before")

    def at(rank: Column) -> Column:
        return F.max(F.when((last - F.col("__c") < rank) & (rank <= last), F.col("__value")))

    lower, upper = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    return sized.groupBy(*group).agg(((at(lower) + at(upper)) / 2).alias("__median"))


def summary_wide(summary: DataFrame, corpus: list[str], names: list[str]) -> DataFrame:
    """One row per corpus: `{metric}_mean`, `_median`, `_std`, and `_min`, `_max` for the length metrics."""
    cells = []
    for m in names:
        stats = ["mean", "median", "std"] + (["min", "max"] if m in DIRECT_METRICS else [])
        cells += [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for s in stats]
    return summary.groupBy(*corpus).agg(F.max("n_texts").alias("n_texts"), *cells)


def length_stats(df: DataFrame, text: str, corpus: list[str]) -> DataFrame:
    """Number of texts and mean, median, deviation of tokens and characters; 0 texts and nulls when all are blank."""
    blank = is_blank(text)
    sizes = df.groupBy(*corpus).agg(F.count(F.when(~blank, 1)).alias("n_texts"))
    names = ["len_tokens", "len_chars"]
    metrics = materialise(length_metrics(df, text, corpus).select(*corpus, *names), "lengths")
    summary = corpus_summary(metrics, corpus, names)
    cells = [
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in names for s in ("mean", "median", "std")
    ]
    return join_null_safe(sizes, summary.groupBy(*corpus).agg(*cells), corpus, "left")


def common_metrics(summary: DataFrame, corpus: str, k: int) -> DataFrame:
    """Metrics that all k corpora have."""
    return (
        summary.groupBy("metric").agg(F.count_distinct(corpus).alias("n")).where(F.col("n") == k).select("metric")
    )


def lacking_metrics(summary: DataFrame, corpus: str, names: list[str]) -> DataFrame:
    """(corpus, metric) pairs that are missing although another corpus has the metric, for the given metrics."""
    have = summary.select(corpus, "metric").distinct()
    wanted = have.select(corpus).distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in names])))
    return wanted.join(have, [corpus, "metric"], "left_anti").join(have.select("metric"), "metric", "left_semi")


def compare_corpora(
    summary: DataFrame, corpora: list[str], *, corpus: str = "corpus", baseline: str | None = None,
    source: str = "both", labels: bool = False,
) -> DataFrame:
    """Metric by corpus, baseline first: `{corpus}_mean` and `{corpus}_std`, or one `mean (std)` label each.

    Only metrics every corpus has; `source` keeps the "package" or the "direct" ones.
    """
    kept = {"both": None, "package": PACKAGE_METRICS, "direct": DIRECT_METRICS}[source]
    rows = summary if kept is None else summary.where(F.col("metric").isin(kept))
    rows = rows.where(F.col(corpus).isin(corpora)).join(common_metrics(rows, corpus, len(corpora)), "metric", "left_semi")
    ordered = ([baseline] if baseline else []) + [c for c in corpora if c != baseline]
    table = rows.groupBy("metric").pivot(corpus, ordered).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    if labels:
        return table.select("metric", *[mean_std_label(f"{c}_mean", f"{c}_std").alias(c) for c in ordered])
    return table


# --- scores -------------------------------------------------------------------------------------------------------

Scorer = Callable[[list[str]], list[dict[str, float]]]


def score_texts(
    df: DataFrame, text: str, keys: list[str], make_scorer: Callable[[], Scorer], labels: list[str], prefix: str
) -> DataFrame:
    """Columns `<prefix>_<label>` from a user-supplied scorer, built once per task and fed in batches."""
    inputs = df.where(~is_blank(text)).select(*keys, F.col(text).alias("__text"))
    schema = T.StructType(
        [inputs.schema[k] for k in keys] + [T.StructField(f"{prefix}_{name}", T.DoubleType()) for name in labels]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scores = scorer(batch["__text"].tolist())
            out = batch[keys].copy()
            for name in labels:
                out[f"{prefix}_{name}"] = pd.Series([s.get(name) for s in scores], index=out.index, dtype="float64")
            yield out

    return inputs.mapInPandas(run, schema)


def lexicon_scores(
    df: DataFrame, text: str, keys: list[str], lexicon: DataFrame, labels: list[str], prefix: str
) -> DataFrame:
    """Sum of lexicon weights (token, label, weight) per text and label, 0 where nothing matches."""
    # One row per distinct token of a text: frequent words weigh no more than rare ones in the join.
    words = df.where(~is_blank(text)).select(*keys, F.inline(lx.token_counts(lx.tokens(text))))
    sums = [
        F.coalesce(F.sum(F.when(F.col("label") == name, F.col("weight") * F.col("n"))), F.lit(0.0)).alias(f"{prefix}_{name}")
        for name in labels
    ]
    return words.join(lexicon, "token", "left").groupBy(*keys).agg(*sums)
