"""The pipeline on a small folder: every stage against plain Python on the rows the stage before it left."""

import random

import corpus_pipeline as pipeline
from corpusloom.llm import quality
from corpusloom.session import materialise
from tests.llm.test_language_toxicity_quality import DOC, brute_kept
from tests.llm.test_shards_lines_search import brute_lines
from tests.llm.test_simhash import brute as brute_copies
from tests.llm.test_suffix import brute as brute_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(9)
    syllables = ["ba", "ne", "to", "li", "ku", "ra", "mi", "so"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(260):
        body = text(rnd.randint(6, 12))
        if i % 9 == 0:
            body = body[:50] + passage + body[50:]
        if i % 10 == 4:
            body = rows[i // 2][1]
        if i % 10 == 7:
            words = rows[i // 3][1].split(" ")
            words[len(words) // 2] = word()
            body = " ".join(words)
        if i % 20 == 11:
            body = " ".join(w + "$$%" for w in body.split())
        rows.append((i, body, "en", rnd.choice(["a", "a", "b"])))
    return rows + [(500, None, "en", "a"), (501, "", None, None), (502, "few words", "en", "b")]


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in corpus()], f"{DOC}, n_chars long").repartition(3)
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    done = {}
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), name.replace(" ", "_"))
        if name != names[-1]:
            assert docs.columns == COLUMNS
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        done[name] = docs
    rows = corpus()
    assert len(quality.SIGNALS) == 6
    kept = [r[:2] for r, k in zip(rows, brute_kept(rows)) if k]
    assert sorted(texts_of(done["quality rules"])) == sorted(kept) and len(kept) > 200
    lines = [(k, t) for k, t, n in brute_lines(kept) if not n or t.split()]
    assert sorted(texts_of(done["line dedup"])) == sorted(lines)
    single = {k for k, _, first in brute_copies(lines) if k == first}
    copies = [r for r in lines if r[0] in single]
    assert sorted(texts_of(done["near copies"])) == sorted(copies)
    passages = [(k, raw.decode("utf-8", "ignore")) for k, _, raw, _ in brute_passages(copies, 100)]
    assert sorted(texts_of(done["passage dedup"])) == sorted((k, t) for k, t in passages if t.split())
    packed = done["packing"].toPandas()
    assert set(packed.doc_id) == {k for k, t in passages if t.split()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_rows_without_an_id_are_judged_each(spark):
    rows = corpus()
    good, copy, other = rows[1][1], rows[2][1], rows[3][1]
    rows = rows[:200] + [(None, good + "\nmore of it", "en", "a"), (None, "few words", "en", "a"), (None, copy, "en", "a"), (None, other[::-1], "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], f"{DOC}, n_chars long").repartition(3)
    kept = pipeline.quality_rules(spark, docs, "")
    assert sorted(t for k, t in texts_of(kept) if k is None) == sorted(r[1] for r, k in zip(rows, brute_kept(rows)) if k and r[0] is None)
    assert sorted(t for k, t in texts_of(kept) if k is None and t == "few words") == []
    assert [t for k, t in texts_of(pipeline.near_copies(spark, docs, "")) if k is None and t == copy] == []
    assert other[::-1] in [t for k, t in texts_of(pipeline.near_copies(spark, docs, "")) if k is None]


def test_of_repeated_rows_one_stays(spark):
    rows = [r for r in corpus()[:40]]
    rows += [rows[0], rows[0], rows[5], (None, rows[7][1][::-1], "en", "a"), (None, rows[7][1][::-1], "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], f"{DOC}, n_chars long").repartition(3)
    kept = pipeline.near_copies(spark, docs, "")
    assert kept.columns == COLUMNS
    got = texts_of(kept)
    assert len(got) == len(set(got)) and rows[0][:2] in got and (None, rows[7][1][::-1]) in got


def test_the_query_runs_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in corpus()[:60]], f"{DOC}, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 20


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], f"{DOC}, n_chars long")
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), name.replace(" ", "_"))
        assert docs.count() == 0
