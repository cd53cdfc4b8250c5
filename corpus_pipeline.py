"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, folder) and returns a table; all but the last return the columns of documents. Each is
written and read again before the next one. `run` needs a folder shared by the cluster, as `corpusloom.session` says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import lines, packing, quality, simhash, suffix
from corpusloom.llm.rows import place, same, told_apart
from corpusloom.session import materialise

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
PASSAGE = 100
SHINGLE = 3
DISTANCE = 3

# Fingerprints, components and packing are beyond SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def _columns(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with another text; null texts stay null."""
    return docs.select("doc_id", text.alias("text"), "lang", "source").withColumn(
        "n_chars", F.length("text").cast("long")
    ).select("doc_id", "text", "lang", "source", "n_chars")


def _told_apart(docs: DataFrame) -> DataFrame:
    """With `part`: an id does not say which document it is where it is null or comes with several texts."""
    return told_apart(docs, "doc_id", "text", "part")


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs` whose columns named in `keys` are one of its rows."""
    equal = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys.columns]
    keys = keys.select(*[F.col(c).alias(f"__{c}") for c in keys.columns])
    return docs.join(keys, equal, "left_semi").select("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    docs = _told_apart(docs)
    return _only(docs, quality.judge(docs, others=["part"]).where("kept").select("doc_id", "part", "lang", "source"))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Later copies of three lines in a row removed; a document that loses all its words goes."""
    done = lines.dedup_lines(docs)
    emptied = (F.col("lines_removed") > 0) & ~F.col("text").rlike(r"\S")
    return _columns(done.where(~F.coalesce(emptied, F.lit(False))), F.col("text"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once; of its repeated rows, and without an id, one."""
    docs = _told_apart(docs)
    found = simhash.near_duplicates(docs, shingle=SHINGLE, distance=DISTANCE, others=["part"])
    least = found.groupBy("root").agg(F.min(place("doc_id", "part")).alias("least"))
    least = least.select(F.col("least.key").alias("doc_id"), F.col("least.part").alias("part"))
    # Only numbered rows can be repeated; the others need no shuffle of their texts.
    single = _only(docs.where("part = 0"), least)
    first = least.withColumnsRenamed({"doc_id": "__id", "part": "__part"})
    again = docs.where("part != 0").join(first, same("doc_id", "part", "__id", "__part"), "left_semi")
    one = again.groupBy("doc_id", "part").agg(F.min(F.struct("lang", "source", "text", "n_chars")).alias("row"))
    return single.unionAll(one.select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars"))


def passage_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of 100 bytes or more kept at their first place only; a document that loses all its words goes."""
    whole = docs.withColumn("no_text", F.col("text").isNull())
    done = suffix.dedup_passages(whole, length=PASSAGE, others=["lang", "source", "no_text"], as_text=True)
    done = done.withColumn("text", F.when(~F.col("no_text"), F.col("kept")))
    emptied = (F.col("n_spans") > 0) & ~F.col("text").rlike(r"\S")
    return _columns(done.where(~F.coalesce(emptied, F.lit(False))), F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces with their places in training sequences."""
    return packing.pack_texts(docs, public_tokenizers.path(TOKENIZER), CAPACITY)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("near copies", near_copies),
    ("passage dedup", passage_dedup), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents below `sf_dir`; stages between are written once each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
