"""Corpus files side by side: load, align, filter, count, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import alignment as al
from corpusloom.operators import facets as fc
from corpusloom.session import materialise
from corpusloom.sources import tables

FACETS = ["sn_codes", "de_codes"]


def load_slots(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The corpora of several files or folders in long form; `ordinal` is a row's place in its corpus."""
    slots = {}
    for name, path in paths.items():
        rows = tables.read_text_corpus(spark, path)
        # Parsed and written once; only the keys are sorted.
        parsed = materialise(rows.select("*", F.monotonically_increasing_id().alias("__row")), name)
        places = al.renumber(parsed.select("path", "__row"), ["path", "__row"], "ordinal").select("__row", "ordinal")
        slots[name] = parsed.join(places, "__row").drop("__row")
    aligned = al.align_slots(slots)
    uneven = al.slot_sizes(aligned).where("not aligned")
    if not uneven.isEmpty():
        raise ValueError(f"the corpora differ in length: {[tuple(r)[:2] for r in uneven.collect()]}")
    return aligned


def view(aligned: DataFrame, state: fc.FacetState, selection: DataFrame | None = None) -> dict[str, DataFrame]:
    """Visible rows, counts per code, reachable codes and totals under a filter."""
    rows = fc.facet_rows(aligned, FACETS, ["ordinal"], state.search)
    return {
        "visible": fc.visible_rows(rows, state, FACETS),
        "counts": fc.facet_counts(rows, state, FACETS, selection),
        "available": fc.facet_available(rows, state, *FACETS),
        "totals": fc.facet_totals(aligned, FACETS),
    }
