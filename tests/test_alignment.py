"""Keys, numbering, lookups."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alignment as al
from corpusloom.operators import facets as fc


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_are_dense_and_ordered(spark, parts):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    rows = al.renumber(df.repartition(parts), ["g", F.col("id").desc()]).collect()
    ordered = sorted(rows, key=lambda r: (r["g"], -r["id"]))
    assert [r["num"] for r in ordered] == list(range(1, 5001))


def test_numbering_nothing(spark):
    assert al.renumber(spark.range(0), ["id"]).collect() == []


def tables_of(spark):
    return {
        "advice": spark.createDataFrame([(1, "a"), (2, "BAD_field2"), (3, "c"), (5, "e"), (None, "z")], "num long, x string"),
        "mapping": spark.createDataFrame([(1, "SN1"), (2, "SN2"), (3, "not bad_ here"), (4, "SN4"), (5, "SN5")], "num long, x string"),
        "context": spark.createDataFrame([(5, "q"), (3, "r"), (1, "s"), (1, "t"), (2, "u")], "num long, x string"),
    }


def test_sync_filter(spark):
    kept = al.sync_filter(tables_of(spark), "num")
    assert {n: sorted(r["num"] for r in df.collect()) for n, df in kept.items()} == {
        "advice": [1, 5], "mapping": [1, 5], "context": [1, 1, 5],
    }
    again = al.sync_filter(kept, "num")
    assert all(again[n].count() == kept[n].count() for n in kept)
    numbered = al.renumber_all(kept, "num")
    assert sorted(tuple(r) for r in numbered["context"].collect()) == [(1, "s"), (1, "t"), (2, "q")]


def test_sync_ignores_an_empty_table(spark):
    tables = tables_of(spark) | {"none": spark.createDataFrame([], "num long, x string")}
    kept = al.sync_filter(tables, "num")
    assert kept["advice"].count() == 2 and kept["none"].count() == 0


def test_key_audit(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "num long"),
        "b": spark.createDataFrame([(1,), (1,), (3,), (None,)], "num long"),
        "c": spark.createDataFrame([], "num long"),
    }
    rows = {r["table"]: r for r in al.check_keys(tables, "num").collect()}
    assert rows["a"]["contiguous"] and not rows["a"]["same_keys"]
    b = rows["b"]
    assert (b["n_rows"], b["n_null"], b["n_distinct"], b["n_duplicated"], b["contiguous"]) == (4, 1, 2, 1, False)
    assert rows["c"]["n_rows"] == 0 and not rows["c"]["contiguous"]
    assert [tuple(r) for r in al.duplicate_keys(tables["b"].where("num is not null"), ["num"]).collect()] == [(1, 2)]


def test_lookup_uses_the_default_for_unknown_codes(spark):
    ref = spark.createDataFrame([("SN1", "first"), ("SN2", "second")], "code string, name string")
    df = spark.createDataFrame([(1, "SN2"), (2, "SN9"), (3, None)], "num long, sn string")
    rows = {r["num"]: (r["sn"], r["sn_name"]) for r in al.lookup_codes(df, "sn", ref, "SN1", ["name"]).collect()}
    assert rows == {1: ("SN2", "second"), 2: ("SN1", "first"), 3: ("SN1", "first")}


def test_resume_primitives(spark):
    corpus = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "num long, text string")
    variant = spark.createDataFrame([(1, " x "), (2, " ")], "num long, generated_text string")
    assert [r["num"] for r in al.missing_rows(corpus, variant, ["num"]).orderBy("num").collect()] == [2, 3]
    mapped = {r["num"]: r["generated_text"] for r in al.remap_text(corpus, variant, ["num"]).collect()}
    assert mapped == {1: "x", 2: "", 3: ""}
    tries = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, " "), (2, 1, None)], "num long, attempt int, text string")
    assert {r["num"]: r["text"] for r in al.best_attempt(tries, ["num"]).collect()} == {1: "b", 2: ""}


def test_slots_of_different_length(spark):
    slots = {n: spark.range(k).select(F.col("id").alias("ordinal"), F.lit(n).alias("text")) for n, k in (("a", 3), ("b", 2))}
    aligned = al.align_slots(slots)
    assert {r["slot"]: (r["n_rows"], r["aligned"]) for r in al.slot_sizes(aligned).collect()} == {"a": (3, False), "b": (2, False)}
    wide = {r["ordinal"]: (r["a_text"], r["b_text"]) for r in al.slots_wide(aligned, ["a", "b"], ["text"], ["ordinal"]).collect()}
    assert wide[2] == ("a", None)


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_neighbours_across_blocks(spark, block):
    df = spark.createDataFrame([("a", i) for i in range(0, 40, 2)] + [("b", 1)] + [("c", i) for i in range(5)], "c string, o int")
    rows = fc.prev_next(df, ["c"], ["o"], block=block).collect()
    assert len(rows) == 26
    got = {(r["c"], r["o"]): (r["prev_o"], r["next_o"]) for r in rows}
    assert got[("a", 0)] == (None, 2) and got[("a", 38)] == (36, None) and got[("b", 1)] == (None, None)
    assert got[("c", 2)] == (1, 3)


def test_selection_import(spark):
    corpus = spark.createDataFrame([(0, "A"), (1, " B "), (2, "A")], "ordinal long, header string")
    listed = spark.createDataFrame([("A",), ("A",), ("B",), ("unknown",), (" ",)], "header string")
    rows = {(r["header"], r["ordinal"], r["hits"]) for r in fc.import_selection(corpus, listed, ["ordinal"]).collect()}
    assert rows == {("A", 2, 2), ("B", 1, 1)}
