"""Sources and sinks: file order, partitions, runs; chapters and the book; the reader; streams; plans."""

import glob
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import alignment as al
from corpusloom.operators import chapters as ch
from corpusloom.operators import facets as fc
from corpusloom.operators import statistics as st
from corpusloom.plans import book, reader
from corpusloom.sources import sinks, tables
from corpusloom.streaming.appends import append_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def document(path):
    """The part files in name order, as one text."""
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_merged_text_is_in_order(spark, tmp_path):
    rows = [(i, f"% head\nbatch {i}\nline") for i in range(1, 200)]
    df = spark.createDataFrame(rows, "n int, text string").repartition(7)
    sinks.merge_texts(df, f"{tmp_path}/m", ["n"], "simple", partitions=4)
    assert len(glob.glob(f"{tmp_path}/m/part-*")) == 4
    assert document(f"{tmp_path}/m") == "".join(f"batch {i}\nline\n\n" for i in range(1, 200))


def test_append(spark, tmp_path):
    for text in (" a\n", "b\n"):
        sinks.append_texts(spark.createDataFrame([(text,)], "text string"), f"{tmp_path}/a")
    assert sorted(document(f"{tmp_path}/a").split()) == ["a", "b"]


def test_csv_round_trip_keeps_quotes_and_separators(spark, tmp_path):
    rows = [("1", 'say "hi"; ok', "SN1"), ("2", "", None), ("x", "é", "SN2")]
    df = spark.createDataFrame(rows, "Num string, Code_SN string, Code_DE string")
    sinks.write_table(df, f"{tmp_path}/t", format="csv")
    back = tables.read_table(spark, f"{tmp_path}/t", schemas.MAPPING, types={"Num": "long"}).collect()
    got = {(r["Num"], r["Code_SN"] or "", r["Code_DE"] or "") for r in back}
    assert got == {(1, 'say "hi"; ok', "SN1"), (2, "", ""), (None, "é", "SN2")}


def test_union_batches_keeps_the_file(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"Mapping_b{i}.csv").write_bytes(f"﻿Num;Code_SN;Code_DE\r\n{i};SN1;DE{i}\r\n".encode())
    (tmp_path / "Advice_b1.csv").write_text("Num;Topic\n1;x\n")
    rows = tables.union_batches(spark, str(tmp_path), "Mapping_", schemas.MAPPING).orderBy("batch").collect()
    assert [(r["batch"], r["Num"], r["Code_DE"]) for r in rows] == [("Mapping_b1.csv", "1", "DE1"), ("Mapping_b2.csv", "2", "DE2")]


def test_latest(spark, tmp_path):
    import os

    for i, name in enumerate(("b.csv", "a.csv", "c.csv")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_000_000 + i * (name != "c.csv"), 1_000_000 + i * (name != "c.csv")))
    assert tables.latest_file(spark, f"{tmp_path}/*.csv").endswith("a.csv")
    runs = spark.createDataFrame([("t", "t_2"), ("t", "t_10"), ("t", "t_x"), ("u", "u")], "topic string, run string")
    assert [tuple(r) for r in tables.latest_run(runs, ["topic"], "run").collect()] == [("t", "t_10", 11)]


def members_of(spark, pairs):
    return ch.theme_members(spark.createDataFrame(pairs, "id string, theme string"))


def test_chapters(spark):
    pairs = [("2", "B"), ("1", "B"), (" 1 ", "B"), ("3", "A"), ("x", "A"), ("4", " "), ("3", "C"), (None, "A")]
    rows = ch.chapters_from_themes(members_of(spark, pairs), threshold=2).collect()
    got = sorted((r["chapter_id"], r["title"], r["num"]) for r in rows)
    assert got == [("Other", "Other", 3), ("Theme_2_B", "B", 1), ("Theme_2_B", "B", 2)]
    plain = ch.chapters_from_themes(members_of(spark, pairs))
    assert {r["chapter_id"] for r in plain.collect()} == {"Theme_1_A", "Theme_2_B", "Theme_3_C"}
    with pytest.raises(ValueError):
        ch.get_chapter(plain, "Theme_9")
    corpus = spark.range(1, 6).withColumnRenamed("id", "num")
    claimed = ch.first_claim(plain)
    rest = ch.orphans(corpus, claimed)
    assert sorted(r["num"] for r in claimed.collect()) == [1, 2, 3] and sorted(r["num"] for r in rest.collect()) == [4, 5]
    assert {r["num"]: r["title"] for r in claimed.collect()}[3] == "A"


def test_book(spark, tmp_path):
    rows = [(1, "t", "Go_out", "SN1", None, "Body & more"), (2, "t2", "", None, None, "second"), (3, "", "", None, None, " "), (4, "x", "y", None, None, "z")]
    corpus = spark.createDataFrame(rows, "num long, topic string, advice string, code_sn string, code_de string, body string")
    members = ch.chapters_from_themes(members_of(spark, [("1", "One"), ("2", "Two"), ("3", "Two")]))
    themes = spark.createDataFrame([("Two", "about 100%")], "name string, description string")
    book.write_book(corpus, members, f"{tmp_path}/b", themes, partitions=3, chapter_numbers=False)
    assert document(f"{tmp_path}/b").split("\n")[:-1] == [
        "\\chapter*{One}", "\\addcontentsline{toc}{chapter}{One}", "\\markboth{One}{One}", "",
        "\\section*{1. Go\\_out - SN1}", "\\addcontentsline{toc}{section}{1. Go\\_out - SN1}", "", "Body \\& more", "",
        "\\chapter*{Two}", "\\addcontentsline{toc}{chapter}{Two}", "\\markboth{Two}{Two}", "",
        "\\begin{quote}\\small about 100\\%\\end{quote}", "",
        "\\section*{2. t2}", "\\addcontentsline{toc}{section}{2. t2}", "", "second", "",
        "\\chapter*{Other}", "\\addcontentsline{toc}{chapter}{Other}", "\\markboth{Other}{Other}", "",
        "\\section*{4. y}", "\\addcontentsline{toc}{section}{4. y}", "", "z", "",
    ]


def test_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Text 1 – SN1 start\nThe walk\nText 2 – SN2 DE1\nrain\nText 3 – none\nthe end")
    (tmp_path / "b.json").write_text('[{"text": "x DE1"}, {"text": "THE y"}, {"text": "z SN1"}]')
    aligned = reader.load_slots(spark, {"a": f"{tmp_path}/a.txt", "b": f"{tmp_path}/b.json"})
    seen = reader.view(aligned, fc.FacetState({"sn_codes": ["SN1"]}, "the"))
    assert sorted(r["ordinal"] for r in seen["visible"].collect()) == [1, 3]
    assert {(r["facet"], r["code"]): r["visible"] for r in seen["counts"].collect()}[("sn_codes", "SN1")] == 2
    assert {r["code"] for r in seen["available"].where("facet = 'de_codes'").collect()} == {"DE1"}
    selection = seen["visible"].select("ordinal")
    sinks.export_selection(aligned, selection, f"{tmp_path}/out", ["ordinal"], partitions=2)
    assert document(f"{tmp_path}/out/headers") == "Text 1 – SN1 start\nText 3 – none\n"
    (tmp_path / "c.txt").write_text("one text")
    with pytest.raises(ValueError):
        reader.load_slots(spark, {"a": f"{tmp_path}/a.txt", "c": f"{tmp_path}/c.txt"})


def test_row_wise_work_runs_on_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, f"SN{i} one two. three")], "num int, text string").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("num int, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    metrics = st.text_metrics(stream, "text", ["num"], mtld=False)
    append_stream(metrics, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    batch = st.text_metrics(spark.read.parquet(f"{tmp_path}/in"), "text", ["num"], mtld=False)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 3 and got.exceptAll(batch).isEmpty()


def test_a_text_is_evaluated_once_for_an_ordered_document(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(text):
        calls.add(1)
        return text

    rows = spark.range(500).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("raw")).repartition(5)
    marked = rows.select("id", F.udf(seen, "string")("raw").alias("text"))
    sinks.merge_texts(marked, f"{tmp_path}/doc", ["id"], partitions=4)
    assert calls.value == 500
    lines = [r["line"] for r in tables.read_ordered_text(spark, f"{tmp_path}/doc").orderBy("line_no").collect()]
    assert lines == [x for i in range(500) for x in (f"text {i}", "")]


def test_run_folder(spark):
    import os

    from corpusloom.session import drop_folder, materialise, run_folder

    path = run_folder(spark, "run")
    materialise(spark.range(3))
    assert os.listdir(path)
    drop_folder(spark, path)
    assert not os.path.exists(path) and materialise(spark.range(3)).count() == 3


def test_streams(spark, tmp_path):
    """A parser row by row, a fill per micro-batch, and a distribution over all that has come."""
    from corpusloom.operators import generation as gn
    from corpusloom.operators import parsing as ps

    for i in range(3):
        raw = f"[REWRITE 1 | Num={i}]\ntext {i}\n"
        spark.createDataFrame([(i, raw, f"SN{i % 2}")], "id long, raw string, code string").write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("id long, raw string, code string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    append_stream(ps.parse_rewrites(read(), "raw", ["id"]), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert {(r["num"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(i, f"text {i}") for i in range(3)}

    def fill(batch, epoch):
        corpus = batch.select(F.col("id").alias("num"), F.col("raw").alias("text"))
        none = batch.sparkSession.createDataFrame([], "variant string, num long, generated_text string")
        done = gn.fill_missing(corpus, none, [gn.VariantSpec("A", "A")], upper, store=f"{tmp_path}/store", tasks=2, backoff=0.0)
        done.write.mode("append").parquet(f"{tmp_path}/filled")

    query = read().writeStream.foreachBatch(fill).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    filled = spark.read.parquet(f"{tmp_path}/filled").collect()
    assert sorted((r["num"], r["generated_text"]) for r in filled) == [(i, "DONE") for i in range(3)]

    counts = st.code_counts(read(), "code")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option(
        "checkpointLocation", f"{tmp_path}/c3"
    ).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, st.code_counts(spark.read.parquet(f"{tmp_path}/in"), "code").collect()))


def upper():
    import re

    return lambda prompts: ["\n".join(f"[REWRITE 1 | Num={n}]\nDONE" for n in re.findall(r"INPUT_TEXT \d+ \| Num=(\d+)", p)) for p in prompts]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    metrics = plan_of(st.text_metrics(docs, "text", ["doc_id"], mtld=False))
    assert "Exchange" not in metrics and "Python" not in metrics
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in metrics
    scores = plan_of(st.text_metrics(docs, "text", ["doc_id"]))
    assert "ArrowEvalPython" in scores and "Exchange" not in scores
    pushed = plan_of(docs.where("lang = 'en'").select(F.length("text")))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in pushed
    summary = st.corpus_summary(docs.select("lang", F.col("n_chars").alias("m")), ["lang"], ["m"])
    # No window runs over a corpus: values are ranked within ranges, and the sums of the ranges have the other window.
    windows = plan_of(summary).split("Window [")[1:]
    assert windows and all("windowspecdefinition(__range" in w.split("specifiedwindowframe")[0] for w in windows)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    codes = orders.select(F.col("o_orderstatus").alias("code"))
    checked = plan_of(al.validate_codes(orders, {"o_orderstatus": (codes, "F")}))
    assert "BroadcastHashJoin" in checked and "SortMergeJoin" not in checked and "hashpartitioning" not in checked
    members = orders.select(F.col("o_orderpriority").alias("theme"), F.col("o_orderkey").alias("num"))
    placed = plan_of(ch.chapters_from_themes(members, 100).where("chapter_id <> 'Other'"))
    assert "BroadcastHashJoin" in placed and "SortMergeJoin" not in placed
    # The one window without partitions runs over the sizes of the ranges.
    numbered = plan_of(al.renumber(orders.select("o_orderkey"), ["o_orderkey"]))
    assert numbered.count("Window [") == 1 and "rangepartitioning" not in numbered


def test_from_raw_answers_to_narratives(spark, tmp_path):
    from corpusloom.operators import generation as gn
    from corpusloom.operators import parsing as ps
    from corpusloom.plans import corpus
    from corpusloom.session import scratch_path

    codes = spark.createDataFrame([("SN1",), ("SN2",)], "code string")

    def raw(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "batch_id int, raw string")

    tables_in = {
        "advice": corpus.RawTable(raw("Num;Advice\n1;walk\n2;run\n", "3;rest;x\n4;sleep"), ["Num", "Advice"]),
        "mapping": corpus.RawTable(raw("1;SN2\n2;SN9\n3;SN1\n4;SN1\n5;SN1"), ["Num", "Code_SN"], {"Code_SN": (codes, "SN1")}),
    }
    found = corpus.aligned_tables(tables_in, "Num")
    assert sorted(map(tuple, found["advice"].collect())) == [(1, "walk"), (2, "run"), (3, "sleep")]
    assert sorted(map(tuple, found["mapping"].collect())) == [(1, "SN2"), (2, "SN1"), (3, "SN1")]

    def model():
        def answer(prompts):
            return [None if "sleep" in p else p.splitlines()[-1] for p in prompts]

        return answer

    block = gn.line_block({"Advice": "Advice", "SN": "Code_SN"}, "Num")
    texts = corpus.narrate(found, block, "HEAD", model, scratch_path(spark, "n"), key="Num", batch_size=2, tasks=2, backoff=0.0)
    assert sorted(r["text"] for r in texts.collect()) == ["SN: SN1", "[GENERATION_FAILED for line 3]"]

    (tmp_path / "a.json").write_text('{"assignments": [{"id": 1, "theme": "T"}, {"id": 2, "theme": "T"}], "new_themes": []}')
    answers = ps.parse_answers(tables.read_responses(spark, f"{tmp_path}/a.json"), "raw", ["path"])
    members = book.chapters_from_answers(answers, ["path"])
    assert sorted((r["chapter_id"], r["num"]) for r in members.collect()) == [("Theme_1_T", 1), ("Theme_1_T", 2)]
    (tmp_path / "c.json").write_text('{"chapters": [{"title": "A", "num_list": [2, "x", 9]}, {"name": "B", "num_list": ["1", 2]}]}')
    documents = tables.read_json_document(spark, f"{tmp_path}/c.json", schemas.CHAPTERS_JSON)
    listed = ch.chapter_members(documents, spark.range(1, 4).withColumnRenamed("id", "num")).collect()
    assert sorted((r["title"], r["num"]) for r in listed) == [("A", 2), ("B", 1)]


def test_keyword_themes_against_plain_python(spark, monkeypatch):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    items = [(rnd.choice([*range(40), None]), rnd.choice(["x", None]), " ".join(rnd.choices(words, k=rnd.randint(0, 6)))) for _ in range(150)]
    items += [(7, "x", None), (99, "x", "nothing known"), (5, None, "w1 " * 500)]
    themes = [(rnd.choice(["b", "a", "é", "c", None]), rnd.choice([*words, None])) for _ in range(40)]

    expected = {}
    for a, b, text in items:
        for word in set((text or "").split()):
            for theme in {t for t, k in themes if k == word}:
                found = expected.setdefault((a, b), {})
                found[theme] = found.get(theme, 0) + 1
    first = lambda t: (t is not None, (t or "").encode())
    expected = sorted(((*k, *min(v.items(), key=lambda x: (-x[1], first(x[0])))) for k, v in expected.items()), key=repr)

    docs = spark.createDataFrame(items, "a long, b string, text string").repartition(3)
    catalogue = spark.createDataFrame(themes, "theme string, keyword string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for listed, places in ((1000, 2**20), (2, 4)):
            monkeypatch.setattr(ch, "THEMES", listed)
            monkeypatch.setattr(ch, "PLACES", places)
            got = ch.keyword_themes(docs, F.split("text", " "), ["a", "b"], catalogue)
            assert sorted(map(tuple, got.collect()), key=repr) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.dtypes == [("a", "bigint"), ("b", "string"), ("theme", "string"), ("score", "bigint")]
    assert ch.keyword_themes(docs.limit(0), F.split("text", " "), ["a"], catalogue).collect() == []
    assert ch.keyword_themes(docs, F.split("text", " "), ["a"], catalogue.limit(0)).collect() == []


def test_themes_of_an_item_are_one_row(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20))) for i in range(300)], "num long, text string")
    themes = spark.range(50).crossJoin(spark.range(20).withColumnRenamed("id", "j")).select(
        F.concat(F.lit("t"), "id").alias("theme"), F.concat(F.lit("w"), "j").alias("keyword")
    )
    found = ch.keyword_themes(items, F.split("text", " "), ["num"], themes)
    # Nothing groups by item and theme: there are as many such groups as items times themes.
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["theme"], r["score"]) for r in found.collect()} == {("t0", 20)} and found.count() == 300
