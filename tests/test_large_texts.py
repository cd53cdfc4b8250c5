"""Files read in splits give what a whole file gives, wherever the splits' borders lie."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import parsing as ps
from corpusloom.sources import large_texts, tables

SPLITS = [23, 64, 200]


@contextmanager
def split_size(spark, n):
    """Files are split into n bytes; what is written from them meanwhile can be read without that afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for name, value in zip(names, (str(n), "0", "1"), strict=True):
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def write(folder, name, text, encoding="utf-8"):
    with open(f"{folder}/{name}", "w", encoding=encoding, newline="") as f:
        f.write(text)


def fuzz(seed, pieces, n):
    rng = random.Random(seed)
    return "".join(rng.choice(pieces) for _ in range(n))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.selectExpr("substring_index(path, '/', -1)", *columns).collect())


BLOCK_PIECES = ["Text 1 – head\n", " text 22 - x\n", "Text 3 –\n", "Text 4 – \n", "\n", "  \n", "body\n", "is Text 5 – inside\n", "é\r\n", "-\n", "Text\n"]


@pytest.mark.parametrize("size", SPLITS)
def test_blocks_as_in_whole_files(spark, tmp_path, size):
    for seed in range(2):
        write(tmp_path, f"f{seed}.txt", fuzz(seed, BLOCK_PIECES, 40))
    write(tmp_path, "bare.txt", "Text 1 –\n\n" * 41 + "end")
    write(tmp_path, "none.txt", "no head\nat all\n")
    write(tmp_path, "empty.txt", "")
    write(tmp_path, "latin.txt", "Text 1 - café\nbody à\n" + "x\n" * 30 + "Text 2 - b\nc", "latin-1")
    whole = tables.read_text_corpus(spark, f"{tmp_path}/latin.txt").select("path", "num", "header", "text")
    found = ps.parse_text_blocks(tables.read_responses(spark, f"{tmp_path}/[!l]*.txt"), "raw", ["path"])
    expected = rows(found, "num", "header", "text") + rows(whole, "num", "header", "text")
    with split_size(spark, size):
        found = large_texts.read_text_blocks(spark, f"{tmp_path}/*.txt")
    assert rows(found, "num", "header", "text") == sorted(expected)


SECTION_PIECES = ["\\subsection*{h}", "\\subsubsection{ k }", "\\subset", "\\subsections ", "body\n", " \\sub", "\\x{y}", "\r\n", "section*{z}", "é "]


@pytest.mark.parametrize("size", SPLITS)
def test_sections_as_in_whole_files(spark, tmp_path, size):
    for seed in range(2):
        write(tmp_path, f"f{seed}.tex", fuzz(seed, SECTION_PIECES, 40) + ".")
    write(tmp_path, "first.tex", "section*{no}body\\subsection{yes}body")
    expected = rows(ps.parse_sections(tables.read_responses(spark, f"{tmp_path}/*.tex"), "raw", ["path"]), "num", "header", "text")
    with split_size(spark, size):
        found = large_texts.read_sections(spark, f"{tmp_path}/*.tex")
    assert rows(found, "num", "header", "text") == expected


@pytest.mark.parametrize("size", SPLITS)
def test_segments_as_in_whole_files(spark, tmp_path, size):
    for seed in range(2):
        write(tmp_path, f"f{seed}.txt", fuzz(seed, ["one two\n", ">||<", "\r\n", " ", "é>", "|"], 80) + ".")
    raw = tables.read_responses(spark, f"{tmp_path}/*.txt")
    expected = rows(ps.export_segments(raw, "raw", ["path"]), "X", "segment")
    with split_size(spark, size):
        found = large_texts.read_segments(spark, f"{tmp_path}/*.txt")
    assert rows(found, "X", "segment") == expected


def test_texts_move_by_split_and_part(spark, tmp_path):
    write(tmp_path, "a.txt", "Text 1 – a\nb\n")
    plan = large_texts.read_text_blocks(spark, f"{tmp_path}/a.txt")._jdf.queryExecution().sparkPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("size", [23, 200])
def test_part_files_of_a_folder_are_one_file(spark, tmp_path, size):
    """Cut between lines, before a `\\sub` or behind a marker or a tag, the parts read as the whole."""
    texts = {
        "blocks": fuzz(3, BLOCK_PIECES, 40), "sections": "x" + fuzz(4, ["\\subsection*{h}", "\\subset", "body\n", "é "], 40) + ".",
        "segments": fuzz(5, ["one\n", ">||<", " ", "é>"], 60), "xml": "".join(f"<text num='{i}'>t {i}</text>\n" for i in range(9)),
        "json": "".join(f'{{"text": "t {i}"}}\nbroken {i}\n' for i in range(9)),
    }
    cut = {"blocks": "\n", "sections": "\\sub", "segments": ">||<", "xml": "</text>", "json": "\n"}
    for name, text in texts.items():
        pieces = text.split(cut[name])
        before = ["" if i == 0 else cut[name] for i in range(len(pieces))] if name == "sections" else [""] * len(pieces)
        behind = [cut[name] if name != "sections" and i < len(pieces) - 1 else "" for i in range(len(pieces))]
        whole = [b + p + e for b, p, e in zip(before, pieces, behind, strict=True)]
        for kind, parts in (("whole", [text]), ("parts", ["".join(whole[i : i + 7]) for i in range(0, len(whole), 7)])):
            folder = tmp_path / name / kind
            folder.mkdir(parents=True)
            for i, part in enumerate(parts):
                write(folder, f"part-{i:05d}.txt", part)
    readers = {
        "blocks": (large_texts.read_text_blocks, ("num", "header", "text")), "sections": (large_texts.read_sections, ("num", "header", "text")),
        "segments": (large_texts.read_segments, ("X", "segment")), "xml": (tables.read_xml_texts, ("num", "header", "text")),
        "json": (tables.read_json_lines, ("num", "header", "text")),
    }
    for name, (read, columns) in readers.items():
        with split_size(spark, size):
            found = [read(spark, f"{tmp_path}/{name}/{kind}/*.txt", folders=True) for kind in ("whole", "parts")]
        one, several = ([r[1:] for r in rows(df, *columns)] for df in found)
        assert several == one and one, name


def test_a_language_is_written_by_several_tasks(spark, tmp_path):
    from corpusloom.registry import sources

    docs = spark.range(400).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'src1' as source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = sources._write_by_language(spark, str(tmp_path), F.col("text"), "files")
        found = sources.read_text_blocks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.text(path).inputFiles()) > 1
    assert sorted(r["num"] for r in found) == list(range(1, 401))
    assert {(r["num"], r["text"]) for r in found} == {(i + 1, f"text {i}") for i in range(400)}
