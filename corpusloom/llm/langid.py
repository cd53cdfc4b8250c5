"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter sequence is the product of its letters' vectors, rotated
by their place; a text is the sum over its sequences, and so is a language over its training texts. A text gets the
language whose sum is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows, remembered
from corpusloom.llm.bpe import LETTER, _classes, batches_of

DIMENSIONS = 512
ORDER = 3
SEED = 20
# Texts a language's profile is made of, at most about so many.
TRAINING_TEXTS = 3000
CHUNK = 4096
EDGE = 32
UNKNOWN = "und"


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # a row of unit length per language


@remembered
def letter_vector(point: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The random vector of a letter; the same on every machine."""
    return (np.random.default_rng((seed, point)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.float32)


def letter_sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, text number, sequence as number in base of the letters, weight) of the different three-letter sequences
    of each text. Everything but letters is one edge between words; the weight is the rounded 16-fold root of the count,
    so that a text of one repeated word does not outweigh many."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    letter = _classes()[points] == LETTER
    # An edge is kept where it ends a word.
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    points, owner, letter = np.where(letter, points, EDGE)[kept], owner[kept], letter[kept]
    # Each word begins with an edge as well: the one that ended the word before, or one that is put in.
    letters, code = np.unique(np.r_[points, np.uint32(EDGE)], return_inverse=True)
    edge, code = code[-1], code[:-1]
    base = len(letters)
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    code, owner = np.insert(code, at, edge), np.insert(owner, at, owner[at])
    if len(code) < ORDER:
        none = np.zeros(0, np.int64)
        return letters, none, none, none
    inside = owner[2:] == owner[:-2]
    sequence = ((code[:-2] * base + code[1:-1]) * base + code[2:])[inside]
    both, counts = np.unique(owner[2:][inside] * base**3 + sequence, return_counts=True)
    return letters, both // base**3, both % base**3, np.rint(16 * np.sqrt(counts)).astype(np.int64)


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of each text, as rows; zero for a text without letters."""
    letters, owner, sequence, weight = letter_sequences(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(owner):
        return out
    table = np.stack([letter_vector(int(p), dimensions) for p in letters])
    places = [np.roll(table, ORDER - 1 - i, axis=1) for i in range(ORDER)]
    base = len(letters)
    different, column = np.unique(sequence, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    for start in range(0, len(different), CHUNK):
        part = different[start : start + CHUNK]
        bound = places[0][part // (base * base)] * places[1][part // base % base] * places[2][part % base]
        a, b = np.searchsorted(column, [start, start + len(part)])
        amounts = np.zeros((len(texts), len(part)), np.float32)
        amounts[owner[a:b], column[a:b] - start] = weight[a:b]
        out += amounts @ bound
    return out


def learn(df: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = TRAINING_TEXTS, dimensions: int = DIMENSIONS) -> Profiles:
    """Profiles from rows for which `may_learn` holds, with a text and a language.

    Of a language with more than `texts` such rows, those are taken whose seeded hash of key falls below the share
    that gives about `texts`. Profiles are summed on the cluster, per language and dimension; the driver gets one
    count per language and one vector per language, the model itself. Runs two jobs.
    """
    rows = df.where(may_learn).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 20)).alias("draw"),
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros((0, dimensions), np.float32))
    bar = F.lit(1 << 20)
    for name, n in counts.items():
        if n > texts:
            bar = F.when(F.col("lang") == name, int((1 << 20) * texts / n)).otherwise(bar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            listed, names = batch["text"].tolist(), batch["lang"].to_numpy()
            for a, b in batches_of(listed):
                vectors = text_vectors(listed[a:b], dimensions)
                for name in set(names[a:b]):
                    total = vectors[names[a:b] == name].astype(np.float64).sum(axis=0)
                    sums[name] = sums.get(name, 0) + total
        for name, total in sums.items():
            yield pd.DataFrame({"lang": name, "place": np.arange(dimensions), "part": np.rint(total).astype(np.int64)})

    parts = rows.where(F.col("draw") < bar).mapInPandas(run, "lang string, place int, part long")
    sums = parts.groupBy("lang", "place").agg(F.sum("part").alias("total")).collect()
    names = sorted({r["lang"] for r in sums})
    vectors = np.zeros((len(names), dimensions))
    for r in sums:
        vectors[names.index(r["lang"]), r["place"]] = r["total"]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles(names, (vectors / np.where(norms > 0, norms, 1)).astype(np.float32))


def predict(df: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row: the nearest language and the cosine with it, at least 0.

    Null texts and texts without letters are `und` with score 0, and so are all texts if no language was learned.
    Equal cosines go to the language first in alphabetical order. Whole texts are read; repeated rows give repeated
    results; other columns, a language column among them, are not read.
    """
    inputs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = np.array([*profiles.languages, UNKNOWN], dtype=object)
    dimensions = profiles.vectors.shape[1]
    matrix = profiles.vectors.T.copy()

    def start():
        def work(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
            texts = batch["text"].fillna("").tolist()
            best, scores = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if len(names) > 1:
                for a, b in batches_of(texts):
                    vectors = text_vectors(texts[a:b], dimensions)
                    norms = np.linalg.norm(vectors, axis=1)
                    near = (vectors @ matrix).astype(np.float64) / np.where(norms > 0, norms, 1)[:, None]
                    chosen = near.argmax(axis=1)
                    best[a:b] = np.where(norms > 0, chosen, len(names) - 1)
                    scores[a:b] = np.where(norms > 0, np.clip(near[np.arange(b - a), chosen], 0, 1), 0)
            yield np.arange(len(texts)), pd.DataFrame({"lang_pred": names[best], "score": scores})

        return work

    return map_rows(inputs, ["key"], start, "lang_pred string, score double").withColumnRenamed("key", key)
