"""Ids above 2**53 beside a null id, through every operator and the pipeline."""

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from corpusloom.llm import bpe, collocations, cross_tokens, langid, lines, ngram_join, packing, quality, sharding, simhash, suffix, toxicity
from corpusloom.llm.registry import search
from corpusloom.session import materialise
from pyspark.sql import functions as F

IDS = [2**53 + 1, 2**60 + 3, 2**60 + 5, None]
PATH, OTHER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(spark):
    own = [" ".join(f"word{i}x{j}" for j in range(70)) for i in range(4)]
    shared = "\n".join(f"line {j} that all four of these documents share with one another" for j in range(5))
    rows = [(k, f"{t}\n{shared}", "en", "a", 1) for k, t in zip(IDS, own)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


OPERATORS = {
    "op1": lambda d: suffix.dedup_passages(d),
    "op2": lambda d: langid.predict(d, langid.learn(d, F.lit(True))),
    "op3": lambda d: toxicity.score(d, toxicity.Model([], None, -3.0)),
    "op4": lambda d: quality.judge(d),
    "op5": lambda d: simhash.near_duplicates(d),
    "op6": lambda d: packing.pack_texts(d, PATH, 2048),
    "op7": lambda d: sharding.interleave(d, 2, "source", "doc_id", {"doc_id": F.col("doc_id")}),
    "op8": lambda d: lines.dedup_lines(d),
    "op9": lambda d: bpe.digests(d, PATH),
    "op12": lambda d: ngram_join.near_duplicates(d),
    "op13": lambda d: cross_tokens.alignment(d, PATH, OTHER),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay(spark, name):
    rows = OPERATORS[name](documents(spark)).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted(IDS, key=str)
    by_id = {r["doc_id"]: r for r in rows}
    if name == "op1":
        assert by_id[IDS[0]]["n_spans"] == 0 and all(by_id[k]["n_spans"] == 1 for k in IDS[1:])
    if name == "op8":
        assert [by_id[k]["lines_removed"] for k in IDS] == [0, 5, 5, 5]


def test_search(spark):
    df = spark.createDataFrame([(k, [1.0 * i]) for i, k in enumerate(IDS)], "vec_id long, embedding array<float>").coalesce(1)
    found = search.top_k(df, F.lit(True), 5).collect()
    assert {(r["query_id"], r["vec_id"]) for r in found} == {(a, b) for a in IDS[:3] for b in IDS[:3] if a != b}


def test_phrases_without_ids(spark):
    df = documents(spark)
    assert collocations.collocations(df.unionAll(df), least=8).where("phrase = 'one another'").count() == 0


def test_pipeline(spark):
    docs = documents(spark)
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), name.replace(" ", "_"))
        assert {r["doc_id"] for r in docs.collect()} == set(IDS), name
