"""Prompts, calls, retries and fills."""

import os
import re
import sys
import time
import uuid
from collections import Counter

import pytest
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.operators import generation as gn
from corpusloom.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def corpus_of(spark, n):
    return spark.createDataFrame([(i, f"text {i}") for i in range(1, n + 1)], "num long, text string")


def test_prompts_keep_row_order(spark):
    planned = gn.plan_batches(corpus_of(spark, 5).repartition(4), 2)
    prompts = {r["batch_id"]: r["prompt"] for r in gn.build_prompts(planned, "text", "HEAD", head=gn.input_head).collect()}
    assert prompts[0] == "HEAD\n\n[INPUT_TEXT 1 | Num=1]\ntext 1\n\n[INPUT_TEXT 2 | Num=2]\ntext 2"
    assert prompts[2] == "HEAD\n\n[INPUT_TEXT 1 | Num=5]\ntext 5"
    block = gn.line_block({"Topic": F.lit(None).cast("string"), "Advice": "text"}, "num")
    assert "--- LINE 5 ---\nTopic: \nAdvice: text 5" in [r["prompt"] for r in gn.build_prompts(planned, block).collect()]


def test_large_tables_become_blocks(spark):
    rows = {r["block_no"]: r["text"] for r in gn.table_as_text(spark.range(2500).repartition(3), ["id"], ["id"]).collect()}
    assert [len(rows[i].split("\n")) for i in range(3)] == [1001, 1001, 501]
    assert rows[2].startswith("id\n2000\n2001\n")


def flaky():
    calls = {}

    def model(prompts):
        out = []
        for p in prompts:
            calls[p] = calls.get(p, 0) + 1
            if "never" in p or ("later" in p and calls[p] < 3):
                out.append(RuntimeError("busy"))
            else:
                out.append(f"{calls[p]}: {p}")
        return out

    return model


def spoiled():
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("whole list")
        return [p.upper() for p in prompts]

    return model


def test_one_bad_prompt_spoils_no_list(spark):
    prompts = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(9)], "batch_id long, prompt string")
    rows = {r["batch_id"]: r for r in gn.generate_batches(prompts, spoiled, ["batch_id"], tasks=2, backoff=0.0).collect()}
    assert all(rows[i]["raw"] == f"P{i}" and rows[i]["attempt"] == 1 for i in range(9) if i != 3)
    assert (rows[3]["raw"], rows[3]["error"]) == (None, "RuntimeError: whole list")


def counting():
    import uuid

    me = uuid.uuid4().hex
    return lambda prompts: [f"{me} {len(prompts)}"] * len(prompts)


def test_calls_are_spread_and_listed(spark):
    prompts = spark.range(2000).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    rows = gn.generate_batches(prompts, counting, ["id"], tasks=6, list_size=50).collect()
    models = {r["raw"].split()[0] for r in rows}
    assert len(models) == 6 and max(int(r["raw"].split()[1]) for r in rows) == 50


def test_attempts(spark):
    prompts = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never")], "batch_id long, prompt string")
    rows = {r["batch_id"]: r for r in gn.generate_batches(prompts, flaky, ["batch_id"], tasks=2, backoff=0.0).collect()}
    assert (rows[1]["attempt"], rows[1]["raw"]) == (1, "1: now")
    assert (rows[2]["attempt"], rows[2]["raw"]) == (3, "3: later")
    assert (rows[3]["raw"], rows[3]["error"]) == (None, "RuntimeError: busy")


def test_a_second_run_asks_only_for_what_is_open(spark):
    prompts = spark.createDataFrame([(1, "now"), (3, "never")], "batch_id long, prompt string")
    path = scratch_path(spark, "answers")
    assert gn.generate_into(path, prompts, flaky, ["batch_id"], tasks=2, backoff=0.0, attempts=1).count() == 2
    again = gn.generate_into(path, prompts, flaky, ["batch_id"], tasks=2, backoff=0.0, attempts=1)
    assert {r["batch_id"]: r["count"] for r in again.groupBy("batch_id").count().collect()} == {1: 1, 3: 2}
    bounds = spark.createDataFrame([(1, 1, 2), (3, 5, 6)], "batch_id long, first_num long, last_num long")
    lines = [r["text"] for r in gn.placeholder_failed(again, bounds, ["batch_id"]).orderBy("num").collect()]
    assert lines == ["[GENERATION_FAILED for line 5]", "[GENERATION_FAILED for line 6]"]


def dying_once(folder):
    """Notes each prompt it is asked; the first time, the process that is given `p5` ends, after the others are done."""

    def make():
        def model(prompts):
            for p in prompts:
                open(f"{folder}/{p}.{uuid.uuid4().hex}", "w").close()
            if "p5" in prompts and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                time.sleep(6)
                os._exit(1)
            return [p.upper() for p in prompts]

        return model

    return make


def test_a_lost_list_repeats_its_own_calls_only(spark, tmp_path):
    prompts = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    ask = lambda: gn.generate_into(f"{tmp_path}/store", prompts, make, ["id"], tasks=4, list_size=5)
    notes = tmp_path / "notes"
    notes.mkdir()
    make = dying_once(str(notes))
    with pytest.raises((PySparkException, Py4JJavaError)):
        ask()
    asked = {f.split(".")[0] for f in os.listdir(notes)} - {"died"}
    answered = {r["raw"].lower() for r in spark.read.parquet(f"{tmp_path}/store").collect()}
    lost = asked - answered
    assert "p5" in lost and len(lost) == 5
    assert {r["id"]: r["raw"] for r in ask().collect()} == {i: f"P{i}" for i in range(40)}
    calls = Counter(f.split(".")[0] for f in os.listdir(notes) if f != "died")
    assert calls == {f"p{i}": 2 if f"p{i}" in lost else 1 for i in range(40)}


def test_answers_belong_to_their_prompts(spark):
    path = scratch_path(spark, "answers")
    ask = lambda rows: {
        r["batch_id"]: r["raw"]
        for r in gn.generate_into(
            path, spark.createDataFrame(rows, "batch_id long, prompt string"), flaky, ["batch_id"], tasks=2, backoff=0.0
        ).collect()
    }
    assert ask([(1, "now"), (2, "now too")]) == {1: "1: now", 2: "1: now too"}
    assert ask([(1, "now changed"), (2, "now too")]) == {1: "1: now changed", 2: "1: now too"}
    assert ask([(2, "now")]) == {2: "1: now"}


def rewriter():
    def model(prompts):
        out = []
        for p in prompts:
            parts = []
            for num, text in re.findall(r"Num=(\d+)\]\n(.*)", p):
                if int(num) == 4 or (int(num) % 3 == 0 and "AGAIN" not in p):
                    continue
                parts.append(f"[REWRITE 1 | Num={num}]\n{p.split()[0]} {text}")
            out.append("\n".join(parts))
        return out

    return model


def test_fill_resumes_and_retries(spark):
    corpus = corpus_of(spark, 7).union(spark.createDataFrame([(8, " ")], "num long, text string"))
    existing = spark.createDataFrame([("A", 1, " kept "), ("A", 2, " "), ("A", 99, "gone")], "variant string, num long, generated_text string")
    specs = [gn.VariantSpec("A", "A"), gn.VariantSpec("B", "B")]
    options = dict(batch_size=3, retry_preamble="AGAIN", backoff=0.0, tasks=2)
    store = scratch_path(spark, "answers")
    rows = {(r["variant"], r["num"]): r["generated_text"] for r in gn.fill_missing(corpus, existing, specs, rewriter, store=store, **options).collect()}
    assert len(rows) == 14
    assert rows[("A", 1)] == "kept" and rows[("A", 2)] == "A text 2" and rows[("B", 3)] == "B text 3"
    assert rows[("A", 4)] == rows[("B", 4)] == ""
    once = gn.fill_missing(corpus, existing, specs, rewriter, rounds=1, overwrite=True, store=scratch_path(spark, "answers"), **options)
    rows = {(r["variant"], r["num"]): r["generated_text"] for r in once.collect()}
    assert rows[("A", 1)] == "A text 1" and rows[("A", 3)] == ""
    audit = {r["variant"]: r for r in gn.fill_audit(corpus, once, ["A", "B"]).collect()}
    assert (audit["A"]["total"], audit["A"]["filled"], audit["A"]["missing"]) == (7, 4, 3)


def moves(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [word for word in ("Exchange", "Join", "Aggregate") if word in plan]


def test_answers_of_a_run_are_read_where_they_lie(spark):
    path = scratch_path(spark, "answers")
    prompts = spark.range(30).select("id", F.lit("x").alias("more"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    answers = gn.generate_into(path, prompts, counting, ["id"], tasks=2, carry=["more"])
    assert moves(answers) == [] and answers.columns == ["id", "more", "attempt", "raw", "error"]
    again = gn.generate_into(path, prompts, counting, ["id"], tasks=2, carry=["more"])
    assert sorted(again.collect()) == sorted(answers.collect())


def test_jobs_do_not_grow_with_the_prompts(spark, tmp_path):
    prompts = spark.range(gn.JOBS * 3).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    rows = gn.generate_into(f"{tmp_path}/store", prompts, counting, ["id"], tasks=1, list_size=1).collect()
    assert sorted(r["id"] for r in rows) == list(range(gn.JOBS * 3)) and {r["raw"].split()[1] for r in rows} == {"1"}
    assert len({r["raw"].split()[0] for r in rows}) == gn.JOBS


def test_fill_takes_answers_of_stores_without_columns_carried(spark):
    options = dict(batch_size=3, rounds=1, backoff=0.0, tasks=2)
    store, old = scratch_path(spark, "answers"), scratch_path(spark, "answers")
    none = spark.createDataFrame([], "variant string, num long, generated_text string")
    found = lambda path, model: sorted(gn.fill_missing(corpus_of(spark, 7), none, [gn.VariantSpec("A", "A")], model, store=path, **options).collect())
    first = found(store, rewriter)
    spark.read.parquet(store).select("ask", "request", "attempt", "raw", "error").write.parquet(old)
    assert found(old, lambda: None) == first and any(r["generated_text"] for r in first)


def test_fill_of_rows_that_come_twice(spark):
    corpus = corpus_of(spark, 4).union(corpus_of(spark, 2))
    existing = spark.createDataFrame([("A", 2, "kept"), ("A", 2, "kept")], "variant string, num long, generated_text string")
    rows = gn.fill_missing(corpus, existing, [gn.VariantSpec("A", "A")], rewriter, store=scratch_path(spark, "answers"), rounds=1, tasks=2, backoff=0.0)
    found = [(1, "A text 1"), (1, "A text 1"), (2, "kept"), (2, "kept"), (3, ""), (4, "")]
    assert sorted((r["num"], r["generated_text"]) for r in rows.collect()) == found


def test_sample_is_repeatable(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("op"))
    first = [r["op"] for r in gn.sample_rows(df, "op", 5, "s").collect()]
    assert first == [r["op"] for r in gn.sample_rows(df.repartition(7), "op", 5, "s").collect()]
    assert first != [r["op"] for r in gn.sample_rows(df, "op", 5, "t").collect()]
