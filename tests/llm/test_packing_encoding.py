"""Encoding by tree concatenation against the library, and best-fit packing against its constraints."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(1)
    alphabet = "ab'sltrevmd \n\t.,!19é漢 　😀\0"
    texts = ["", " ", "  a", "it's we'll 'tis ''s 's's x'rex", "<|endoftext|>a<|endoftext|><|endoftext|>b ", "a" * 5000, "é'd 9'm １２3 x²"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(60)]
    return texts + ["日本語" * 900, "😀" * 700, " " * 1500 + "x", "'" * 1300 + "s"]


@pytest.mark.parametrize("leaf", [3, 16, 512])
def test_encoding_is_the_librarys(library, leaf):
    encoder = bpe.Encoder(PATH, leaf)
    texts = odd_texts() + ["".join(random.Random(i).choice("abcdeth") for _ in range(2000)) for i in range(3)]
    for group in (texts, [t for t in texts if "<|" not in t]):
        ids, begins = encoder.encode(group)
        for i, text in enumerate(group):
            mine = ids[begins[i] : begins[i + 1]].tolist()
            assert mine == library.encode(text, add_special_tokens=False).ids, repr(text[:60])
            assert encoder.decode(mine) == library.decode(mine, skip_special_tokens=False)


def test_bytes_that_are_no_text(library):
    encoder = bpe.Encoder(PATH)
    rnd = random.Random(2)
    for _ in range(200):
        ids = [rnd.randrange(256) for _ in range(12)]
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:80])] + [(None, "no key"), (7, odd_texts()[7]), (900, None), (901, "long text " * 150_000)]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, n_tokens int")
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.digests(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(df.limit(0), PATH).collect() == []


def test_columns_round_trip(spark):
    df = spark.createDataFrame([("a bé 😀",), (None,), ("",)], "text string")
    back = df.select(bpe.decode_column(bpe.encode_column(F.col("text"), PATH), PATH).alias("b")).collect()
    assert [r["b"] for r in back] == ["a bé 😀", "", ""]


def check(lengths, bins, offsets, capacity, documents, attention):
    for b in set(bins.tolist()):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]
        assert lengths[own].sum() <= capacity and len(own) <= documents and (lengths[own] ** 2).sum() <= attention


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 100, 700)
    bins, offsets = packing.best_fit(lengths, 100, 5, 6000 + 4000, rule)
    check(lengths, bins, offsets, 100, 5, 10_000)
    bins, offsets = packing.best_fit(lengths, 100, 3, 10_000, rule, (1.0, 2.0, 0.5))
    check(lengths, bins, offsets, 100, 3, 10_000)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 5, 100**2)
    assert len(packing.best_fit(np.zeros(0, int), 10, 1, 100)[0]) == 0


def test_best_fit_takes_the_tightest_bin():
    bins, _ = packing.best_fit(np.array([60, 50, 45, 35]), 100, 100, 10_000)
    assert bins.tolist() == [0, 1, 1, 0]


def test_few_bins():
    lengths = np.random.default_rng(1).integers(1, 1500, 5000)
    bins, _ = packing.best_fit(lengths, 2048, 2048, 2048**2)
    assert bins.max() + 1 <= -(-lengths.sum() // 2048) * 1.01


def test_packed_pieces(spark, library):
    rnd = random.Random(4)
    rows = [(i, "word " * rnd.choice([0, 1, 5, 40, 300])) for i in range(300)] + [(1000, None), (None, "no key"), (5, "word again"), (1001, "ab " * 70_000)]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, sequence_id int, piece string")
    got = packing.pack_texts(df, PATH, 64, block=200).toPandas()
    for key, text in rows:
        if key == 5 or key is None:
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == key].sort_values("piece")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        assert (own.length.to_numpy()[1:] == 64).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert got.doc_id.isna().sum() >= 1
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 64
    limited = packing.pack_texts(df, PATH, 64, documents=2, attention=64 * 64).toPandas()
    assert limited.groupby("sequence_id").size().max() <= 2
    assert packing.pack_texts(df.limit(0), PATH, 64).collect() == []
