import random

import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import bitmaps, ngram_join


def grams(text, size=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, similar=(85, 100)):
    """(key, n, component) by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and similar[1] * common >= similar[0] * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (k, _) in enumerate(rows):
        names[find(i)] = min((x for x in (names.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, len(sets[i]), names[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n, seed=5):
    """Chains of copies with a few changed words, templates with a common front, and unlike texts of the same words."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(60)}"
    bases = [[word() for _ in range(rnd.randint(30, 120))] for _ in range(4)]
    front = [f"f{i}" for i in range(90)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.5:
            words = list(rnd.choice(bases)) if rnd.random() < 0.5 or not rows else rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice([word(), f"new{i}", "THE"])
        elif kind < 0.8:
            words = front[: rnd.randint(60, 90)] + [word() for _ in range(rnd.randint(0, 14))]
        else:
            words = [word() for _ in range(rnd.randint(0, 6))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("few,tile", [(ngram_join.FEW, ngram_join.TILE), (3, 8)])
def test_against_all_pairs(spark, few, tile):
    rows = corpus(260)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One\tTWO"), (1005, "one two three four"), (3, rows[3][1]), (3, rows[9][1])]
    rows += [(None, rows[5][1]), (None, "no other text is like this one"), (2**60 + 3, rows[5][1]), (2**60 + 5, "É é"), (2**53 + 1, "é É")]
    expected = brute(rows)
    assert len({c for _, n, c in expected if n > 10}) > 10 and sum(k != c for k, _, c in expected) > 60
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n int, cls int").repartition(4)
    assert answer(ngram_join.near_duplicates(df, few=few, tile=tile)) == expected


def test_other_ratio_and_empty_table(spark):
    rows = corpus(120, seed=8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(ngram_join.near_duplicates(df, similar=(3, 5))) == brute(rows, (3, 5))
    assert ngram_join.near_duplicates(df.limit(0)).collect() == []


def test_one_large_group_of_near_copies_makes_few_pairs(spark):
    """Copies of one text, each with a change of its own, are linked through the first at each n-gram."""
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        words = list(base)
        words[rnd.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(words)))
    made = []
    original = ngram_join.verified

    def counted(texts, classes, pairs, size, similar):
        made.append(pairs.where("a <> b").distinct().count())
        return original(texts, classes, pairs, size, similar)

    ngram_join.verified = counted
    try:
        found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["component_id"] for r in found.collect()} == {0}
    finally:
        ngram_join.verified = original
    assert sum(made) < 30 * len(rows)


def test_the_bitmap_marks_every_repeated_hash(spark):
    draw = np.random.default_rng(4)
    once = np.unique(draw.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    draw.shuffle(once)
    twice, hot = once[:3000], once[3000]
    values = np.r_[once, twice, np.full(9000, hot)].view(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"h": values})).repartition(5)
    marks = bitmaps.repeated(df, lambda batch: iter([batch.column("h").to_numpy()]), 1 << 27, room=1500)
    assert bitmaps.may_hold(marks, np.r_[twice, hot]).all()
    assert bitmaps.may_hold(marks, once[3001:]).sum() < 20
    none = bitmaps.repeated(df.limit(0), lambda batch: iter([batch.column("h").to_numpy()]), 1 << 20)
    assert not none.any()
