"""Collocations: phrases of two to four words that are frequent and hold together.

Phrases are counted level by level. The symbols of level m are the frequent phrases of m - 1 words; a phrase of m words is
a pair of them, one place apart, so that nothing is counted whose parts are rare. Symbols are ranked by frequency, and the
pairs of a batch fall into tiles of ranks: crowded tiles, those of the frequent symbols, are counted by address, the other
ones as sorted pairs. Counts of batches are added up on the cluster, and the frequent pairs are ranked anew as the
symbols of the next level.

What a task knows of the level before has a fixed size: the ranks of its `RANKED` most frequent symbols, and a bitmap of
`BITS` bits of all frequent ones, which only saves work. A symbol without a rank gets a number of the batch's own; counts are
exact either way. Words are told apart by 64-bit hashes, which are held against all words; should two words share one, all
hashes are taken anew with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.bitmaps import BITS, bitmap, may_hold
from corpusloom.operators.skew import join_hot
from corpusloom.session import materialise

UNKNOWN = "und"
# What separates words, and what phrases do not cross.
SPACES, BREAKS = b" \t", b".,;:!?\n\v\f\r"
LONGEST = 4
LEAST = 30
SCALE = 2_000_000
COVERED_PERCENT = 80
TOP = 2000
RANKED = 1 << 16
SIDE = 1024  # ranks per side of a tile
CROWDED = SIDE * SIDE // 16
CHUNK = (1 << 20) - 1
PARTS = 64
TURN = 13


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def phrase_codes(words: list[np.ndarray]) -> np.ndarray:
    """One code of several words' codes in a row."""
    out = np.zeros(len(words[0]), np.uint64)
    for k, c in enumerate(words):
        out ^= _rotated(c, TURN * k)
    return out


def _code(columns: list[str]) -> Column:
    """`phrase_codes` of columns."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        turned = F.shiftleft(c, TURN * k).bitwiseOR(F.shiftrightunsigned(c, 64 - TURN * k)) if k else F.col(c)
        out = out.bitwiseXOR(turned)
    return out


class Symbols:
    """The frequent phrases of a level, as far as a task knows them: the codes of the first ranks, and a bitmap of all."""

    def __init__(self, ranked: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(ranked, kind="stable")
        self.sorted = ranked[self.order]
        self.bits = bits

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The rank of each symbol, or a number of its own behind the ranks."""
        out = np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, codes), max(0, len(self.sorted) - 1))
        known = self.sorted[at] == codes if len(self.sorted) else np.zeros(len(codes), bool)
        out[known] = self.order[at[known]]
        out[~known] = len(self.sorted) + np.unique(codes[~known], return_inverse=True)[1]
        return out


def tile_counts(left: np.ndarray, right: np.ndarray, side: int = SIDE, crowded: int = CROWDED) -> tuple[np.ndarray, np.ndarray]:
    """(where a pair stands, how often it does) of each different pair of numbers (left, right).

    Pairs fall into tiles of `side` numbers a side. A tile with `crowded` pairs or more is counted by address, the pairs
    of all other tiles are sorted.
    """
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    across = int(right.max()) // side + 1
    tile = left // side * across + right // side
    tiles, which, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    dense = np.flatnonzero(sizes >= crowded)
    where, often = [], []
    order = np.argsort(which, kind="stable") if len(dense) else None
    begins = np.cumsum(sizes) - sizes
    for t in dense:
        mine = order[begins[t] : begins[t] + sizes[t]]
        cell = left[mine] % side * side + right[mine] % side
        counts = np.bincount(cell, minlength=side * side)
        place = np.zeros(side * side, np.int64)
        place[cell] = mine
        used = np.flatnonzero(counts)
        where.append(place[used])
        often.append(counts[used])
    rest = np.flatnonzero((sizes < crowded)[which])
    if len(rest):
        _, first, counts = np.unique(left[rest] * (int(right.max()) + 1) + right[rest], return_index=True, return_counts=True)
        where.append(rest[first])
        often.append(counts)
    return np.concatenate(where), np.concatenate(often)


def _words(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, starts, stops, codes, pieces, rows) of the words of runs of texts; equal pieces are one stretch of one text."""
    kinds = W.kinds(SPACES, BREAKS)
    data, ends = W.raw_values(batch.column("text"))
    langs = batch.column("lang_hash").to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in W.chunks(ends, CHUNK):
        part, stops_at = W.cut(data, ends, a, b)
        part = W.lowered(part)
        kind = kinds[part]
        starts, stops = W.word_bounds(kind, stops_at)
        row = np.searchsorted(stops_at, starts, "right")
        codes = W.chain(W.word_hashes(part, starts, stops, seed), langs[a:b][row])
        pieces = np.cumsum(kind == W.BREAK)[starts] + row if len(starts) else starts
        yield part, starts, stops, codes, pieces, a + row


def vocabulary(texts: DataFrame, seed: int) -> DataFrame:
    """(code, lang, word, n) of every different word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, stops, codes, _, rows in _words(batch, seed):
                _, first, which, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
                if not W.same_bytes(data, starts, stops, first[which]):
                    # Two words of one code: both are shown, so that the collision is seen.
                    first, n = np.arange(len(codes)), np.ones(len(codes), np.int64)
                sizes = stops[first] - starts[first]
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                at = np.repeat(starts[first] - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
                listed = pa.Array.from_buffers(pa.utf8(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
                langs = batch.column("lang").take(pa.array(rows[first]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[first].view(np.int64)), langs, listed, pa.array(n.astype(np.int64))], ["code", "lang", "word", "n"]
                )

    counted = texts.mapInArrow(run, "code long, lang string, word string, n long")
    return counted.groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


def known_words(texts: DataFrame) -> tuple[int, DataFrame]:
    """(seed, vocabulary) with a seed under which no two words share a code."""
    seed = 0
    while True:
        found = materialise(vocabulary(texts, seed), "vocabulary")
        if found.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return seed, found
        seed += 1


def symbols(frequent: DataFrame, columns: list[str], ranked: int = RANKED, bits: int = BITS) -> Symbols:
    """What tasks need to know of the frequent phrases (code columns, n): the driver gets `ranked` codes and `bits` bits."""
    codes = frequent.select(_code(columns).alias("code"), "n")
    top = codes.orderBy(F.desc("n"), "code").limit(ranked).select("code").toPandas()["code"].to_numpy(np.int64)
    return Symbols(top.view(np.uint64), bitmap(codes, F.col("code"), bits))


def phrase_counts(texts: DataFrame, seed: int, words: int, known: Symbols, least: int, side: int = SIDE, crowded: int = CROWDED) -> DataFrame:
    """(c0 …, n): the phrases of so many words, as their words' codes, that occur `least` times or more."""
    columns = [f"c{i}" for i in range(words)]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, codes, pieces, _ in _words(batch, seed):
                n = len(codes) - words + 1
                if n <= 0:
                    continue
                parts = phrase_codes([codes[i : len(codes) - words + 2 + i] for i in range(words - 1)])
                frequent = may_hold(known.bits, parts)
                at = np.flatnonzero((pieces[:n] == pieces[words - 1 :]) & frequent[:n] & frequent[1 : n + 1])
                if not len(at):
                    continue
                numbers = known.numbers(np.r_[parts[at], parts[at + 1]])
                left, right = numbers[: len(at)], numbers[len(at) :]
                where, often = tile_counts(left, right, side, crowded)
                listed = [codes[at[where] + i] for i in range(words)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in listed], pa.array(often.astype(np.int64))], [*columns, "n"])

    kinds = ", ".join(f"{c} long" for c in columns)
    counted = texts.mapInArrow(run, f"{kinds}, n long")
    return counted.groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _scores(candidates: DataFrame, parts: DataFrame, scale: int) -> DataFrame:
    """Candidates with the lowest score of their cuts, and the counts l and r of that cut's parts."""
    joined = lambda words: F.array_join(words, " ")
    cuts = candidates.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", joined(F.expr("slice(words, 1, k)")).alias("left"),
        joined(F.expr("slice(words, k + 1, size(words))")).alias("right"),
    )
    for side, count in (("left", "l"), ("right", "r")):
        counts = parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        cuts = materialise(join_hot(cuts, counts, ["lang", side], ["phrase"]), "cuts")
    # Products may pass 64 bits.
    exact = F.expr(f"(cast(a as decimal(28,0)) * {scale}) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))")
    best = F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _covered(candidates: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of candidates that stand in a longer one nearly as often as they occur."""
    longer = candidates.where(F.size("words") > 2).select("lang", "words", "a")
    sizes = F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m")
    starts = F.explode(F.expr("sequence(1, size(words) - m + 1)")).alias("at")
    inner = longer.select("*", sizes).select("*", starts).select("lang", F.array_join(F.expr("slice(words, at, m)"), " ").alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    wide = F.col("longest").cast("decimal(28,0)") * 100 >= F.col("a").cast("decimal(28,0)") * percent
    return candidates.select("lang", "phrase", "a").join(most, ["lang", "phrase"]).where(wide).select("lang", "phrase")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
    scale: int = SCALE, covered_percent: int = COVERED_PERCENT, side: int = SIDE, crowded: int = CROWDED, ranked: int = RANKED, bits: int = BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A to Z are lower-cased. Texts are cut at `[.,;:!?]` and line ends into pieces, and these at spaces and tabs into words; a
    phrase lies in one piece. Candidates are phrases of 2 to `longest` words that occur `least` times or more in their
    language, overlapping places counted. A cut of a candidate with a places in parts of l and r places scores
    floor(scale * a / (l + r)); the lowest cut counts, the first of equal ones. Candidates go that stand in a longer one which
    occurs at least `covered_percent` as often. Of the rest each language has its first `top` by score, a, and phrase
    in the order of its bytes; n is the number of the language's words.

    A null language is `und`, a null text is empty. Repeated rows count as often as they come; other columns are not read;
    an empty table gives an empty result. A very long text is handled alone. Building the result runs jobs and writes tables.
    """
    named = F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))
    texts = df.select(F.col(text).cast("binary").alias("text"), named.alias("lang"), F.xxhash64(named).alias("lang_hash"))
    seed, words = known_words(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = materialise(words.where(F.col("n") >= least).select(F.col("code").alias("c0"), "lang", F.array("word").alias("words"), "n"), "words")
    levels = [single]
    for m in range(2, longest + 1):
        columns = [f"c{i}" for i in range(m)]
        known = symbols(levels[-1], columns[:-1], ranked, bits)
        counted = materialise(phrase_counts(texts.drop("lang"), seed, m, known, least, side, crowded), "phrases")
        begins = levels[-1].select(*columns[:-1], "lang", F.col("words").alias("begin"))
        last = single.select(F.col("c0").alias(columns[-1]), F.element_at("words", 1).alias("last"))
        joined = join_hot(join_hot(counted, begins, columns[:-1], [columns[-1]]), last, columns[-1:], columns[:-1])
        levels.append(materialise(joined.select(*columns, "lang", F.array_append("begin", F.col("last")).alias("words"), "n"), "named"))
    listed = [level.select("lang", "words", F.array_join("words", " ").alias("phrase"), "n") for level in levels]
    parts, candidates = listed[0], None
    for level in listed[1:]:
        candidates = level if candidates is None else candidates.unionAll(level)
    parts = parts.unionAll(candidates)
    candidates = candidates.withColumnRenamed("n", "a")
    scored = _scores(candidates, parts, scale).join(_covered(candidates, covered_percent), ["lang", "phrase"], "left_anti")
    # The best of each part of a language first, so that no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked_all = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    best = ranked_all.where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
