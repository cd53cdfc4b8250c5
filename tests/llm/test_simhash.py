import random

import pytest
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """{position: (fingerprint, component)} by comparing all pairs."""
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    names = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        names[r] = min((x for x in (names.get(r), k) if x is not None), default=None)
    return sorted(((k, f"{prints[i]:016x}", names[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def variants(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(400)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 6])):
            copy[rnd.randrange(400)] = rnd.choice(words)
        rows.append((i + 10, " ".join(copy)))
    return rows + [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(1000, 1100)]


EDGES = [
    (5, None), (4, ""), (3, " \t"), (None, "a b c d"), (1, "A b C d"), (2, "a b"), (2, "a b"), (9, "é ß x " * 30_000),
    (8, "solo"), (None, "only without key here"),
]


def test_against_all_pairs(spark):
    rows = variants(250) + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(simhash.near_duplicates(df)) == brute(rows)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 7)], "doc_id long, text string, fingerprint string, place int")
    assert [r[0] for r in simhash.near_duplicates(df).collect()] == [1]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_every_pair_meets_at_a_home():
    """All words at up to three flips from a word have a replica at its home in one half at least."""
    import numpy as np

    rnd = random.Random(3)
    for _ in range(200):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 3):
            y ^= 1 << b
        met = False
        for shift in simhash.HALVES:
            half = np.array([(v >> shift) & ((1 << 31) - 1) for v in (x, y)], np.uint64)
            home, around = simhash.anchors(half)
            assert all((int(home[i]) ^ int(half[i])).bit_count() <= 1 for i in (0, 1))
            met |= int(home[0]) in set(map(int, around[1]))
        assert met


@pytest.mark.parametrize("shape", ["path", "star", "rings", "random"])
def test_components(spark, shape):
    rnd = random.Random(5)
    pairs = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(100)],
        "rings": [(10 * r + i, 10 * r + (i + 1) % 10) for r in range(8) for i in range(10)],
        "random": [(rnd.randrange(-100, 100), rnd.randrange(-100, 100)) for _ in range(90)],
    }[shape]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert dict(map(tuple, got.collect())) == root
