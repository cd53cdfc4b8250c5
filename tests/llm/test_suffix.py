import random

import numpy as np
import pytest

from corpusloom.llm import suffix


def brute(rows, length):
    """{key: (bytes, kept, spans)} with every string looked up."""
    first = {}
    order = sorted({(k is None, k, t) for k, t in rows}, key=lambda r: (r[0], r[1] if r[1] is not None else 0))
    for _, k, t in order:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], (k, i))
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] != (k, i):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(raw), bytes(b for b, g in zip(raw, gone) if not g), spans))
    return sorted(out, key=repr)


def answer(df):
    return sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in df.collect()), key=repr)


def rows_with_repeats(n, seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(3, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else word() for _ in range(rnd.randint(0, 12))]
        rows.append((i, "".join(parts)))
    return rows + [(1000, "ab" * 300), (1001, "x" + "ab" * 200), (1002, None), (1003, ""), (5, rows[5][1]), (1004, "ö" * 90)]


@pytest.mark.parametrize("contexts", [1000, 2])
@pytest.mark.parametrize("length,gram", [(20, 8), (33, 8)])
def test_against_every_string(spark, length, gram, contexts):
    rows = rows_with_repeats(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(suffix.dedup_passages(df, length=length, gram=gram, contexts=contexts)) == brute(rows, length)


def test_long_text_empty_table_and_clashing_names(spark):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    long = "".join(rnd.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(1, long + passage), (2, "start " + passage + " end"), (3, passage[:99]), (None, passage)]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, low string, key int")
    assert answer(suffix.dedup_passages(df)) == brute(rows, 100)
    assert suffix.dedup_passages(df.limit(0)).collect() == []


@pytest.mark.parametrize("contexts", [1000, 2])
def test_a_repeated_row_holds_the_first_place(spark, contexts):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(200)
    rows = [(i, word(60 + i) + passage + word(80 + i)) for i in range(1, 6)]
    rows += [rows[0]] * 3 + [rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = answer(suffix.dedup_passages(df, contexts=contexts))
    assert got == brute(rows, 100) and sum(passage.encode() in kept for _, _, kept, _ in got) == 4


@pytest.mark.parametrize("contexts", [1000, 2])
def test_texts_without_a_key_or_under_one_key_are_told_apart(spark, contexts):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(150)
    short, long, clean = word(10) + passage, word(2000) + passage + word(40), word(2300)
    rows = [(1, word(30) + passage + word(20)), (None, short), (None, long), (None, clean), (4, clean[:900]), (4, word(300) + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # The passage stands first in 1 whatever the order of the others, the clean text's beginning in 4.
    numbered = [(i, t) for i, (_, t) in enumerate([rows[0], rows[4], rows[5], *rows[1:4]])]
    want = [(rows[[t for _, t in rows].index(numbered[i][1])][0], n, kept, spans) for i, n, kept, spans in brute(numbered, 100)]
    assert answer(suffix.dedup_passages(df, contexts=contexts)) == sorted(want, key=repr)


def test_previous_smaller():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        order = rnd.permutation(n)
        want = [max((j for j in range(i) if order[j] < order[i]), default=-1) for i in range(n)]
        assert suffix.previous_smaller(order).tolist() == want


def test_ranks_follow_suffix_order():
    data = np.random.default_rng(2).integers(97, 100, 400, dtype=np.uint8)
    for length in (8, 13, 40, 100):
        strings = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        rank = suffix.ranks(data, np.arange(len(strings)), length)
        want = {s: i for i, s in enumerate(sorted(set(strings)))}
        got = [rank[i] for i in range(len(strings))]
        assert [sorted(set(got)).index(g) for g in got] == [want[s] for s in strings]
