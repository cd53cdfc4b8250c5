import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import collocations as C
from corpusloom.llm import words as W


def brute(rows, least=30, top=2000, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            cuts = [(C.SCALE * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in found.items()):
                score, _, left, right = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), left, right))
        best.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(best[:top])]
    return sorted(out)


def corpus(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "naïve", "the", "The", "of"]
    fixed = ["new york city hall", "as well as", "of the", "x x x x x", "rock n roll"]
    rows = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else words[min(int(rnd.expovariate(0.15)), 44)] for _ in range(rnd.randint(0, 60))]
        text = "".join(p + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ▁ "]) for p in parts)
        rows.append((text, rnd.choice(["en", "en", "en", "fr", None])))
    return rows + [(None, "en"), ("", None), (" ,. \t", "de"), ("a", ""), ("of the " * 300, "fr")]


def answer(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"side": 8, "crowded": 5, "ranked": 6, "bits": 1 << 15, "top": 20}])
def test_against_plain_counts(spark, limits, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 3000)
    rows = corpus(300) * 2
    expected = brute(rows, top=limits.get("top", 2000))
    assert len(expected) > (50 if "top" not in limits else 30)
    df = spark.createDataFrame([(t, lang, 5, "k") for t, lang in rows], "text string, lang string, n int, word string").repartition(3)
    assert answer(C.collocations(df, **limits)) == expected


def test_empty_table_and_no_phrase(spark):
    df = spark.createDataFrame([("only once here", "en")], "text string, lang string")
    assert C.collocations(df).collect() == []
    assert C.collocations(df.limit(0)).collect() == []


def test_equal_codes_of_two_words_are_seen(spark, monkeypatch):
    plain = W.word_hashes

    def weak(data, starts, stops, seed=0):
        return plain(data, starts, stops, seed) if seed else plain(data, starts, stops) % np.uint64(3)

    monkeypatch.setattr(W, "word_hashes", weak)
    rows = [("one two three four five six " * 40, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert answer(C.collocations(df)) == brute(rows)


def test_tiles_count_like_a_dictionary():
    rng = np.random.default_rng(1)
    left, right = (np.minimum(rng.geometric(0.02, 20_000), 500) for _ in range(2))
    plain = Counter(zip(left.tolist(), right.tolist()))
    for crowded in (1, 50, 10**9):
        where, often = C.tile_counts(left, right, 16, crowded)
        assert dict(zip(zip(left[where].tolist(), right[where].tolist()), often.tolist())) == plain


def test_large_counts_are_exact(spark):
    a = 9_000_000_000_000_001
    candidates = spark.createDataFrame([("en", ["x", "y"], "x y", a)], "lang string, words array<string>, phrase string, a long")
    parts = spark.createDataFrame([("en", "x", a + 5), ("en", "y", 3 * a + 2)], "lang string, phrase string, n long")
    row = C._scores(candidates, parts, C.SCALE).first()
    assert row["score"] == C.SCALE * a // (4 * a + 7)
