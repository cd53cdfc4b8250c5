"""Variants of a corpus: fill, audit, measure, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import alignment as al
from corpusloom.operators import statistics as st
from corpusloom.session import materialise

LEXICAL = ["TTR", "HapaxRatio", "HerdanC", "RTTR", "CTTR", "Maas"]


def measured(variants: DataFrame, *, hdd: bool = True, mtld: bool = True) -> DataFrame:
    """Per-text metrics of all variants (variant, num, generated_text) in one narrow pass, written once."""
    keys = [c for c in variants.columns if c != "generated_text"]
    return materialise(st.text_metrics(variants, "generated_text", keys, hdd=hdd, mtld=mtld), "metrics")


def compared(
    neutral: DataFrame, variants: DataFrame, names: list[str], *, source: str = "both", labels: bool = False,
    hdd: bool = True, mtld: bool = True, digits: int | None = None,
) -> DataFrame:
    """Metric by corpus: the neutral corpus first, then the named variants; blank texts are left out."""
    everything = al.union_tables([al.neutral_variant(neutral), variants.select("variant", "num", "generated_text")])
    metrics = measured(everything, hdd=hdd, mtld=mtld)
    chosen = st.DIRECT_METRICS + LEXICAL + ["HDD"] * hdd + ["MTLD"] * mtld
    summary = st.corpus_summary(metrics, ["variant"], chosen, median=False)
    if digits is not None:
        summary = summary.withColumns({c: F.round(c, digits) for c in ("mean", "std")})
    return st.compare_corpora(
        summary, ["neutral", *names], corpus="variant", baseline="neutral", source=source, labels=labels
    )
