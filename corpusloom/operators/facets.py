"""Search, facets and selections over aligned corpora in long form (ordinal, slot, header, text, codes…)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.codes import code_label, facet_filter, match_search
from corpusloom.operators.alignment import renumber


@dataclass(frozen=True)
class FacetState:
    """The active codes per facet column and the search text. A facet without entry is not restricted."""

    active: dict[str, list[str]] = field(default_factory=dict)
    search: str = ""
    allow_all_when_empty: bool = True

    def admits(self, facet: str) -> Column:
        if facet not in self.active:
            return F.lit(True)
        return facet_filter(facet, self.active[facet], allow_all_when_empty=self.allow_all_when_empty)


def facet_rows(aligned: DataFrame, facets: list[str], key: list[str], search: str = "") -> DataFrame:
    """One row per ordinal: the codes of all its slots as sets, and whether any slot matches the search.

    A group holds one row per slot, so it stays small.
    """
    codes = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(f)))).alias(f) for f in facets]
    return aligned.groupBy(*key).agg(*codes, F.max(match_search(search, "header", "text")).alias("found"))


def visible_rows(rows: DataFrame, state: FacetState, facets: list[str]) -> DataFrame:
    """Rows that match the search and, in every facet, an active code."""
    keep = F.col("found")
    for f in facets:
        keep = keep & state.admits(f)
    return rows.where(keep)


def facet_totals(aligned: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, code, total) over all rows and slots, repeats within the slots included."""
    return _code_rows(aligned, facets).groupBy("facet", "code").agg(F.count(F.lit(1)).alias("total"))


def _code_rows(df: DataFrame, facets: list[str], *others: str) -> DataFrame:
    return df.select(*others, F.inline(F.flatten(F.array(*[_pairs(f) for f in facets]))))


def _pairs(facet: str) -> Column:
    name = F.lit(facet)
    return F.transform(F.col(facet), lambda c: F.struct(name.alias("facet"), c.alias("code")))


def facet_counts(
    rows: DataFrame, state: FacetState, facets: list[str], selection: DataFrame | None = None, key: list[str] = ("ordinal",)
) -> DataFrame:
    """(facet, code, visible, selected, selected_visible): rows per code, all counts in one pass."""
    keep = F.col("found")
    for f in facets:
        keep = keep & state.admits(f)
    flagged = rows.withColumn("is_visible", keep)
    if selection is None:
        flagged = flagged.withColumn("is_selected", F.lit(False))
    else:
        chosen = selection.select(*key).distinct().withColumn("is_selected", F.lit(True))
        flagged = flagged.join(chosen, list(key), "left").withColumn(
            "is_selected", F.coalesce("is_selected", F.lit(False))
        )
    codes = _code_rows(flagged, facets, "is_visible", "is_selected")
    both = F.col("is_visible") & F.col("is_selected")
    return codes.groupBy("facet", "code").agg(
        F.count(F.when(F.col("is_visible"), 1)).alias("visible"),
        F.count(F.when(F.col("is_selected"), 1)).alias("selected"),
        F.count(F.when(both, 1)).alias("selected_visible"),
    )


def facet_available(rows: DataFrame, state: FacetState, first: str, second: str) -> DataFrame:
    """(facet, code) reachable: codes of one facet in rows that pass the search and the other facet."""
    found = rows.where(F.col("found"))
    parts = F.flatten(
        F.array(
            F.when(state.admits(first), _pairs(second)).otherwise(F.slice(_pairs(second), 1, 0)),
            F.when(state.admits(second), _pairs(first)).otherwise(F.slice(_pairs(first), 1, 0)),
        )
    )
    return found.select(F.inline(parts)).distinct()


def facet_gauge(counts: DataFrame) -> DataFrame:
    """Selected share of the visible rows per code, 0 when none is visible."""
    share = F.coalesce(F.try_divide(F.col("selected"), F.col("visible")), F.lit(0.0))
    return counts.where("visible > 0").withColumn("ratio", share)


def selection_share(rows: DataFrame, selection: DataFrame, key: list[str]) -> DataFrame:
    """One row: texts, selected texts, and their percentage."""
    chosen = selection.select(*key).distinct().withColumn("__chosen", F.lit(1))
    joined = rows.join(chosen, key, "left")
    counts = joined.agg(F.count(F.lit(1)).alias("n_texts"), F.count("__chosen").alias("n_selected"))
    share = F.coalesce(F.try_divide(F.col("n_selected") * 100.0, F.col("n_texts")), F.lit(0.0))
    return counts.withColumn("percentage", share)


def import_selection(corpus: DataFrame, headers: DataFrame, key: list[str]) -> DataFrame:
    """Rows named by a list of headers: of equal headers the last row counts; unknown ones are ignored.

    `hits` tells how often the list named the row.
    """
    wanted = (
        headers.select(F.trim("header").alias("header")).where("header <> ''")
        .groupBy("header").agg(F.count(F.lit(1)).alias("hits"))
    )
    # The last place first: a header shared by very many rows is one row before anything is joined.
    last = corpus.groupBy(F.trim("header").alias("header")).agg(F.max(F.struct(*key)).alias("place"))
    return last.join(wanted, "header").select("header", "place.*", "hits")


def nav_list(rows: DataFrame, selection: DataFrame, facets: list[str], key: list[str]) -> DataFrame:
    """The list a reader steps through: key, header, selected flag and a label of the codes."""
    chosen = selection.select(*key).distinct().withColumn("selected", F.lit(True))
    label = F.concat_ws(" | ", *[F.concat(F.lit(f"{f}:"), code_label(f)) for f in facets])
    return rows.join(chosen, key, "left").select(
        *key, "header", F.coalesce("selected", F.lit(False)).alias("selected"), label.alias("codes")
    )


def prev_next(rows: DataFrame, corpus: list[str], order: list[str], block: int = 100_000) -> DataFrame:
    """Previous and next key of each row within its corpus.

    The rows are numbered once over all corpora; each block of numbers is one small window that also sees its two
    neighbours, so a corpus of any size spreads over many tasks.
    """
    values = F.struct(*corpus, *order)
    numbered = renumber(rows.select(*corpus, *order).distinct(), [*corpus, *order], "__n", start=0)
    home = F.floor(F.col("__n") / block)
    at_start, at_end = F.col("__n") % block == 0, F.col("__n") % block == block - 1
    copies = F.array(
        home, F.when(at_start & (home > 0), home - 1), F.when(at_end, home + 1)
    )
    spread = numbered.select(
        "*", home.alias("__home"), F.explode(F.filter(copies, lambda b: b.isNotNull())).alias("__block")
    )
    window = Window.partitionBy("__block").orderBy("__n")
    seen = spread.select(
        "*", F.lag(values).over(window).alias("__before"), F.lead(values).over(window).alias("__after")
    ).where(F.col("__block") == F.col("__home"))

    def same(side: str) -> Column:
        test = F.lit(True)
        for c in corpus:
            test = test & F.col(f"{side}.{c}").eqNullSafe(F.col(c))
        return test

    out = [*corpus, *order]
    for name, side in (("prev", "__before"), ("next", "__after")):
        out += [F.when(same(side), F.col(f"{side}.{o}")).alias(f"{name}_{o}") for o in order]
    return seen.select(*out)


def view_row(aligned: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """All slots of the wanted ordinals as one text, slots in order. A group holds one row per slot."""
    wanted = aligned.join(keys.select(*key).distinct(), key, "left_semi")
    part = F.concat(F.lit("--- "), F.col("slot"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct(F.col("slot").alias("slot"), part.alias("part"))))
    return wanted.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("view"))


def selected_texts(aligned: DataFrame, selection: DataFrame, key: list[str]) -> DataFrame:
    """(slot, key, content) of the selected rows, each as a titled section."""
    chosen = aligned.join(selection.select(*key).distinct(), key, "left_semi")
    content = F.concat(F.lit("\\subsubsection{"), F.col("header"), F.lit("}\n"), F.col("text"))
    return chosen.select("slot", *key, "header", content.alias("content"))
