"""Interleaved shards, line windows, exact search."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lines, search, sharding

# --- shards -------------------------------------------------------------------------------------------------------


def shards_of(df, n, seed="0"):
    payload = {"doc_id": F.col("doc_id"), "source": F.col("source")}
    return [tuple(r) for r in sharding.interleave(df, n, "source", "doc_id", payload, seed).collect()]


@pytest.mark.parametrize("n_rows,n_shards", [(1000, 7), (5, 24), (0, 3), (24, 24)])
def test_shards_are_even_and_mixed(spark, n_rows, n_shards):
    rnd = random.Random(n_rows)
    rows = [(i, rnd.choice(["a"] * 6 + ["b", "b", None])) for i in range(n_rows)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, shard int, slot string")
    got = shards_of(df.repartition(5), n_shards)
    assert sorted((r[:2] for r in got), key=repr) == sorted(rows, key=repr)
    sizes = Counter(r[2] for r in got)
    assert all(sizes[s] in (n_rows // n_shards, -(-n_rows // n_shards)) for s in range(n_shards))
    slots = defaultdict(list)
    for r in got:
        slots[r[2]].append(r[3])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for source, total in Counter(r[1] for r in rows).items():
        for s in range(n_shards):
            assert abs(sum(r[1] == source and r[2] == s for r in got) - total / n_shards) <= 2
    assert sorted(got, key=repr) == sorted(shards_of(df.repartition(3), n_shards), key=repr)


def test_shards_of_repeated_and_null_keys(spark):
    rows = [(1, "a")] * 5 + [(None, "a"), (None, None)]
    got = shards_of(spark.createDataFrame(rows, "doc_id long, source string"), 2)
    assert sorted((r[:2] for r in got), key=repr) == sorted(rows, key=repr) and Counter(r[2] for r in got) == {0: 4, 1: 3}
    with pytest.raises(ValueError):
        shards_of(spark.createDataFrame(rows, "doc_id long, source string"), 0)


# --- lines --------------------------------------------------------------------------------------------------------


def brute_lines(rows, size=3):
    seen, later = {}, defaultdict(set)
    for k, t in sorted({(k, t) for k, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        ls = t.split("\n")
        for i in range(len(ls) - size + 1):
            window = tuple(ls[i : i + size])
            if "".join(window).strip():
                if window in seen and seen[window] != (k, i):
                    later[k, t].update(range(i, i + size))
                seen.setdefault(window, (k, i))
    return sorted(((k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in later[k, t]), len(later[k, t])) for k, t in rows), key=repr)


def test_lines_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "", "c d", " "]) for _ in range(rnd.randint(0, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "x\ny\nz\n" * 3), (104, "q\nr"), (105, "q\nr"), (103, "x\ny\nz\n" * 3), (None, "x\ny\nz")]
    rows += [(200, "\n".join(f"line {i}" for i in range(60_000))), (201, "new\nline 7\nline 8\nline 9\nend")]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, place string, lines_removed int").repartition(4)
    got = sorted(((r["doc_id"], r["text"], r["lines_removed"]) for r in lines.dedup_lines(df).collect()), key=repr)
    assert got == brute_lines(rows)
    assert set(lines.dedup_lines(df).columns) == {"doc_id", "text", "place", "lines_removed"}
    assert lines.dedup_lines(df.limit(0)).collect() == []


def test_lines_of_texts_without_a_key_or_under_one_key(spark):
    rows = [(1, "a\nb\nc"), (None, "a\nb\nc\nd\ne"), (None, "1\n2\n3\n4\n5\n6"), (4, "x\ny\nz\na\nb\nc"), (4, "p\nq\nr\ns\nt\nu")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["text"], r["lines_removed"]) for r in lines.dedup_lines(df).collect()}
    assert got == {(1, "a\nb\nc", 0), (None, "d\ne", 3), (None, rows[2][1], 0), (4, "x\ny\nz", 3), (4, rows[4][1], 0)}


# --- search -------------------------------------------------------------------------------------------------------


def brute_top(rows, k, is_query):
    top = 2**63 - 1

    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [max(-top, min(top, math.floor(64 * x))) for x in v]

    known = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for i, v in known:
        if is_query(i):
            scores = sorted((-max(-top, min(top, sum(a * b for a, b in zip(v, w)))), j) for j, w in known if j != i and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("tile,block", [(8192, 2048), (7, 3)])
def test_search_against_all_pairs(spark, tile, block):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.26, 1.0]) for _ in range(4)]) for i in range(150)]
    rows += [(150, None), (151, []), (152, [1.0, None, 0.0, 0.0]), (153, [float("nan"), 0.0, 0.0, 0.0]), (154, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(155, [2.0, 3.0]), (160, [1.0, 1.0]), (170, [1e9, -1e9, 1e9, 0.0]), (180, [2.0**30 + 0.5] * 4), (-20, [1.0] * 4), (190, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, score double").repartition(3)
    got = search.top_k(df, F.col("vec_id") % 10 == 0, 6, tile=tile, block=block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 6, lambda i: i % 10 == 0)
    assert search.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 6).collect() == []


def test_search_with_repeated_keys(spark):
    rows = [(0, [1.0]), (0, [2.0]), (1, [3.0]), (1, [3.0])]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 2)
    want = [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 192), (0, 1, 1, 128 * 192), (0, 2, 1, 128 * 192)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
