"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel counts the letter triples two words share in order, each gap costing a factor. A word is held against a landmark
by the letters it shares with it, and every other letter between these costs a small factor more, so that inserted letters
lower a match but do not end it; signs put between letters are dropped before, and short pieces in a row are read as one word
as well. A sentence's kernel row is its best word for each landmark. The landmarks are words, and beginnings of longer words,
that mark the labelled texts, learned from the labels, and the shorter words of clean texts that these begin with; the
kernel matrix of the landmarks maps rows to a space in which the machine is linear. It is trained on sentences: those of the
clean texts, and of each toxic text the ones that come nearest to a landmark. A text scores as its worst sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows, remembered
from corpusloom.llm.bpe import batches_of
from corpusloom.session import materialise

ORDER = 3
DECAY = 0.6
# The normalised kernel is taken to this power, a kernel as well, which sets whole matches off from common letters.
POWER = 3
# What a letter costs that a landmark does not have, between letters that it has.
GAP = 0.97
PIECE = 24
STRIDE = 12
STEMS = (4, 5, 6, 7, 8)
WORD = 12
# Landmarks that mark toxic texts; each toxic text of the training set gets so many of them.
LANDMARKS, DEEP = 64, 3
# Words of clean texts that marks begin with.
BARE = 16
# A landmark that stands for longer words only; words are coded between two signs of their own.
OPEN, BEGIN, END = "-", "\x01", "\x02"
# Occurrences in toxic texts for one in clean texts.
MARKS = 10
# Values below it are common letters.
FLOOR = 0.05
# A toxic text teaches by the sentences that reach this for some landmark, and this share of its best one.
TEACHES, NEAR_BEST = 0.3, 0.8
# Rows the machine is trained on: at most so many of each label.
TOXIC_TEXTS, CLEAN_TEXTS = 1500, 3000
# Sentences a text lends to training: those most like a landmark.
SENTENCES = 16
CANDIDATES = 4000
# Characters of texts whose different words are looked at together, so many words at a time, and pairs whose kernel is.
TEXT_CHARS, WORDS, TOGETHER = 1 << 22, 100_000, 2000
SEED = 3


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the kernel row, in units of the logit
    bias: float


# --- kernel ---


def coded(words: list[str], length: int = PIECE) -> np.ndarray:
    """Code points of words, a row each, 0 behind the end."""
    return np.array(words, dtype=f"<U{length}").reshape(-1, 1).view(np.uint32).reshape(len(words), length)


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of the rows of s with those of t, pair by pair."""
    n, a = s.shape
    b = t.shape[1]
    match = [[((s[:, i] == t[:, j]) & (s[:, i] != 0)).astype(np.float32) * decay**2 for j in range(b)] for i in range(a)]
    level = match
    zero = np.zeros(n, np.float32)
    for _ in range(order - 1):
        above = [zero] * (b + 1)
        new = []
        for i in range(a):
            row, here = [zero], []
            for j in range(b):
                here.append(match[i][j] * above[j])
                row.append(level[i][j] + decay * (above[j + 1] + row[j]) - decay**2 * above[j])
            new.append(here)
            above = row
        level = new
    return sum((level[i][j] for i in range(a) for j in range(b)), zero)


@remembered
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places i < j < k of a word of n letters."""
    at = np.arange(n)
    return np.nonzero((at[:, None, None] < at[:, None]) & (at[:, None] < at))


class Landmarks:
    """The kernel with fixed landmarks. A word that lacks more than a quarter of a landmark's letters counts as 0."""

    def __init__(self, words: list[str]):
        self.words = words
        ends = [BEGIN + (w[:-1] if w.endswith(OPEN) else w + END) for w in words]
        self.points = coded(ends, max(map(len, ends)))
        self.norms = np.sqrt(kernel(self.points, self.points))
        self.own = [row[row != 0] for row in self.points]
        # All code points of landmarks have numbers from 1 on, 0 is any other.
        self.alphabet = np.unique(np.concatenate(self.own))
        self.numbers = np.zeros(int(self.alphabet[-1]) + 2, np.intp)
        self.numbers[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.letters = np.zeros((len(self.alphabet) + 1, len(words)), np.float32)
        for k, own in enumerate(self.own):
            self.letters[self.numbers[own[own > 2]], k] = 1
        self.codes, self.triples = zip(*[self._triples(own) for own in self.own])

    def _triples(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the alphabet's numbers from 1 on in a landmark, 0 for those it lacks; weight of each triple of codes)."""
        different = np.unique(own)
        base = len(different) + 1
        codes = np.zeros(len(self.alphabet) + 1, np.uint8)
        codes[self.numbers[different]] = np.arange(1, base)
        row = codes[self.numbers[own]].astype(np.intp)
        i, j, k = places(len(row))
        weights = DECAY ** (k - i + 1.0)
        return codes, np.bincount((row[i] * base + row[j]) * base + row[k], weights, base**3).astype(np.float32)

    def among(self) -> np.ndarray:
        n = len(self.words)
        i, j = np.divmod(np.arange(n * n), n)
        value = kernel(self.points[i], self.points[j]) / (self.norms[i] * self.norms[j])
        return (value**POWER).reshape(n, n).astype(np.float64)

    def most(self, codes: np.ndarray, n: np.ndarray, landmark: int) -> np.ndarray:
        """What the normalised kernel of words (n codes each, without gaps) with the landmark is at most: the whole kernel by a
        norm that is never above a word's own, as it leaves out that a triple may stand in a word twice."""
        base, triples = int(self.codes[landmark].max()) + 1, self.triples[landmark]
        out = np.zeros(len(codes))
        for size in np.unique(n[n >= ORDER]).tolist():
            i, j, k = places(size)
            weights = (DECAY ** (k - i + 1.0)).astype(np.float32)
            norm = np.sqrt((weights.astype(np.float64) ** 2).sum()) * self.norms[landmark]
            mine = np.flatnonzero(n == size)
            step = max(1, 100_000 // len(i))
            for a in range(0, len(mine), step):
                part = mine[a : a + step]
                row = codes[part, :size].T.astype(np.intp)
                both = row * base
                out[part] = weights @ triples[(both[i] + row[j]) * base + row[k]] / norm
        return out

    def candidates(self, points: np.ndarray, numbers: np.ndarray, at: np.ndarray, landmark: int) -> tuple[np.ndarray, ...]:
        """(rows, other letters between those that the landmark has, number of these letters, different letters) of the coded
        words `at` that may reach `FLOOR` with it; many words have the same of its letters."""
        codes = self.codes[landmark][numbers[at]]
        shared = codes != 0
        n = shared.sum(axis=1)
        width = codes.shape[1]
        first, last = shared.argmax(axis=1), width - 1 - shared[:, ::-1].argmax(axis=1)
        gaps = last - first + 1 - n
        together = np.arange(width) < n[:, None]
        dense = np.zeros(together.shape, np.uint8)
        dense[together] = codes[shared]
        # Up to 15 codes of four bits are a number; longer words, and landmarks with more letters, stay apart.
        key = dense[:, :15].astype(np.uint64) @ (np.uint64(1) << np.arange(0, 4 * min(width, 15), 4, dtype=np.uint64))
        apart = np.flatnonzero((n > 15) | (codes.max(axis=1) > 15))
        key[apart] = np.uint64(1 << 63) + apart.astype(np.uint64)
        _, sample, which = np.unique(key, return_index=True, return_inverse=True)
        most = self.most(dense[sample], n[sample], landmark)
        rows = np.flatnonzero(most[which] * GAP**gaps >= 0.999 * FLOOR ** (1 / POWER))
        used, which = np.unique(which[rows], return_inverse=True)
        sample = sample[used]
        letters = np.zeros((len(sample), PIECE + 2), np.uint32)
        letters[:, :width][together[sample]] = points[at[sample]][shared[sample]]
        return at[rows], gaps[rows], which, letters

    def likeness(self, letters: np.ndarray, landmark: np.ndarray) -> np.ndarray:
        """The normalised kernel of letters with landmarks, pair by pair."""
        out = np.zeros(len(letters), np.float32)
        n = (letters != 0).sum(axis=1)
        order = np.argsort(n, kind="stable")
        for a in range(0, len(order), TOGETHER):
            part = order[a : a + TOGETHER]
            mine = letters[part, : n[part[-1]]]
            norms = np.sqrt(kernel(mine, mine)) * self.norms[landmark[part]]
            out[part] = kernel(mine, self.points[landmark[part]]) / np.maximum(norms, 1e-12)
        return out

    def pairs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, kernel value) where it is `FLOOR` at least."""
        word, landmark, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        sizes = np.array([len(w) for w in words])
        allowed = self.letters.sum(axis=0) - self.letters.sum(axis=0) // 4
        for low, high in zip((0, 12), (12, PIECE + 2)):
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(mine), WORDS):
                part = mine[a : a + WORDS]
                points = coded([words[i] for i in part], high)
                numbers = self.numbers[np.minimum(points, len(self.numbers) - 1)]
                has = np.zeros((len(part), len(self.alphabet) + 1), np.float32)
                has[np.arange(len(part))[:, None], numbers] = 1
                near = (has @ self.letters >= allowed).T
                found, different = [], 0
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    rows, gaps, which, letters = self.candidates(points, numbers, np.flatnonzero(near[k]), k)
                    found.append((part[rows], np.full(len(rows), k), gaps, different + which, letters, np.full(len(letters), k)))
                    different += len(letters)
                if not different:
                    continue
                # The exact kernel of the few that are left, of all landmarks together.
                row, k, gaps, which, letters, theirs = map(np.concatenate, zip(*found))
                reached = (self.likeness(letters, theirs)[which] * np.float32(GAP) ** gaps.astype(np.float32)) ** POWER
                high_enough = reached >= FLOOR
                word.append(row[high_enough])
                landmark.append(k[high_enough])
                value.append(reached[high_enough])
        return np.concatenate(word), np.concatenate(landmark), np.concatenate(value)


# --- texts ---


def _joined(run: list[str]) -> Iterator[str]:
    """The words that a run of pieces of one or two letters may be: its single letters in a row, and, if it has any, the
    pieces from each one on."""
    for letters in re.findall(r"(?:(?<= )|^)\w(?: \w)+(?= |$)", " ".join(run)):
        if len(letters) > 4:
            yield letters.replace(" ", "")
    if min(map(len, run)) < max(map(len, run)):
        for i in range(len(run) - 2):
            yield "".join(run[i : i + WORD])[:WORD]


def tokens(text: str) -> list[str]:
    """Lower-cased words without signs; what a run of three or more pieces of one or two letters may be as words as well."""
    out, run = [], []
    for token in text.lower().split():
        word = token if token.isalpha() else "".join(filter(str.isalpha, token))
        out.append(word)
        if len(word) > 2:
            if len(run) > 2:
                out.extend(_joined(run))
            run = []
        elif word:
            run.append(word)
    if len(run) > 2:
        out.extend(_joined(run))
    return out


# A sentence ends behind a word of two letters at least, so that letters which stand alone stay together.
# It begins with what is no letter, so that the search runs over words at once.
_END = re.compile(r"\W(?<=\w\w\W)(?:(?<=\n)\n*|(?<=[^\w\s])(?:[^\w\s]*\n+|(?:(?<=[.!?])|[^\w\s]*[.!?])[^\w\s]*\s+))")


def sentences(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(sentences of all texts, where each text's begin); a text has one at least."""
    cut = [_END.split(t) for t in texts]
    begins = np.zeros(len(cut) + 1, np.int64)
    np.cumsum([len(c) for c in cut], out=begins[1:])
    return [s for c in cut for s in c], begins


def pieces(word: str) -> list[str]:
    """The word in overlapping pieces, the first with a sign of its begin, the last with one of its end."""
    word = BEGIN + word + END
    if len(word) <= PIECE + 2:
        return [word]
    return [word[i : i + PIECE] for i in [*range(0, len(word) - PIECE, STRIDE), len(word) - PIECE]]


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, number of a word, number of a text): a pair for every word that `tokens` gives of a text."""
    cut = [t.lower().split() for t in texts]
    flat = list(chain.from_iterable(cut))
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    seen = {t: i for i, t in enumerate(dict.fromkeys(flat))}
    at = np.fromiter(map(seen.__getitem__, flat), np.int64, len(flat))
    cleaned = [t if t.isalpha() else "".join(filter(str.isalpha, t)) for t in seen]
    different = {w: i for i, w in enumerate(dict.fromkeys(cleaned))}
    number = np.fromiter(map(different.__getitem__, cleaned), np.int64, len(cleaned))[at]
    length = np.fromiter(map(len, different), np.int64, len(different))[number]
    # A run goes on until a longer word or the next text; pieces without letters are not part of it.
    run = np.cumsum(length > 2) + owner
    short = np.flatnonzero((length > 0) & (length <= 2))
    short = short[np.bincount(run[short], minlength=1)[run[short]] > 2]
    words, more, theirs = list(different), [], []
    for mine in np.split(short, np.flatnonzero(np.diff(run[short])) + 1) if len(short) else []:
        for word in _joined([words[i] for i in number[mine].tolist()]):
            more.append(different.setdefault(word, len(different)))
            theirs.append(owner[mine[0]])
    return list(different), np.r_[number, np.array(more, np.int64)], np.r_[owner, np.array(theirs, np.int64)]


def kernel_rows(texts: list[str], landmarks: Landmarks) -> np.ndarray:
    """The best value of the words of each text, here a sentence, for each landmark; values below `FLOOR` count as 0."""
    out = np.zeros((len(texts), len(landmarks.words)), np.float32)
    words, number, text = words_of(texts)
    different = [i for i, w in enumerate(words) if len(w) >= ORDER]
    if not different:
        return out
    cut = [pieces(words[i]) for i in different]
    owner = np.repeat(different, [len(c) for c in cut])
    piece, landmark, value = landmarks.pairs([p for c in cut for p in c])
    order = np.argsort(owner[piece], kind="stable")
    many = np.bincount(owner[piece], minlength=len(words))
    begins = np.cumsum(many) - many
    # Each occurrence of a word brings all its values.
    found = np.flatnonzero(many[number] > 0)
    each = many[number[found]]
    ends = np.cumsum(each)
    at = order[np.arange(each.sum()) + np.repeat(begins[number[found]] - ends + each, each)]
    np.maximum.at(out.reshape(-1), np.repeat(text[found], each) * out.shape[1] + landmark[at], value[at])
    return out


# --- training ---


def _stems(word: str) -> set[str]:
    return {word[:n] + OPEN for n in STEMS if len(word) > n} | ({word} if 4 <= len(word) <= WORD else set())


def _follows(mark: str, other: str) -> bool:
    return mark.rstrip(OPEN).startswith(other.rstrip(OPEN))


def cover(marks: dict[str, int], texts: list[set[str]], limit: int = LANDMARKS, deep: int = DEEP) -> list[str]:
    """Marks such that each text has `deep` of them, if it has so many: always the one that serves most texts still in need."""
    need = [deep] * len(texts)
    holds: dict[str, list[int]] = {m: [] for m in marks}
    for i, mine in enumerate(texts):
        for m in mine & marks.keys():
            holds[m].append(i)
    chosen: list[str] = []
    left = set(marks)
    while left and len(chosen) < limit:
        gain, _, best = max((sum(need[i] > 0 for i in holds[m]), marks[m], m) for m in left)
        if gain < 2:
            break
        # A beginning that nearly always goes on in the same way stands for the longer one.
        best = max((m for m in left if _follows(m, best) and 5 * marks[m] >= 4 * marks[best]), key=lambda m: (len(m.rstrip(OPEN)), m))
        chosen.append(best)
        for i in holds[best]:
            need[i] -= 1
        left -= {m for m in left if _follows(m, best) or _follows(best, m)}
    return chosen


def choose_landmarks(texts: DataFrame, limit: int = LANDMARKS) -> tuple[list[str], list[str]]:
    """(marks, words of clean texts): words, and beginnings of longer words, that toxic texts (text, __label) have in many different
    surroundings and clean ones hardly ever; and words that clean texts have and marks begin with.

    Surroundings are counted instead of texts, so that copies of one text do not stand for many; in clean texts every
    occurrence counts. Two jobs over the training texts; both counts meet on the cluster, and the driver gets at most
    `CANDIDATES` marks, all of them good ones, and which of these each toxic training text has.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            clean: dict[str, int] = {}
            for text, label in zip(batch["text"], batch["__label"]):
                words = ["", *tokens(text), ""]
                if label == 1:
                    rows = {
                        (stem, xxhash.xxh64_intdigest(f"{words[i - 1]} {words[i]} {words[i + 1]}") >> 1)
                        for i in range(1, len(words) - 1) for stem in _stems(words[i])
                    }
                    yield pd.DataFrame(list(rows), columns=["stem", "around"]).astype({"around": "int64"}).assign(n=0)
                else:
                    for word in words:
                        for stem in _stems(word):
                            clean[stem] = clean.get(stem, 0) + 1
            yield pd.DataFrame({"stem": list(clean), "around": 0, "n": list(clean.values())}).astype({"around": "int64", "n": "int64"})

    once = texts.mapInPandas(found, "stem string, around long, n long").groupBy("stem", "around").agg(F.sum("n").alias("n"))
    counted = once.groupBy("stem").agg(F.count_if(F.col("around") != 0).alias("toxic"), F.sum("n").alias("clean"))
    counted = materialise(counted, "marks")
    good = counted.where(f"toxic >= 4 and {MARKS} * clean <= toxic").orderBy(F.desc("toxic"), "stem").limit(CANDIDATES)
    marks = {r["stem"]: r["toxic"] for r in good.collect()}
    if not marks:
        return [], []

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"marks": [sorted({s for w in set(tokens(t)) for s in _stems(w) if s in marks}) for t in batch["text"]]})

    holds = texts.where("__label = 1").select("text").mapInPandas(holding, "marks array<string>").collect()
    chosen = cover(marks, [set(r["marks"]) for r in holds], limit)
    begins = sorted({m[:k] for m in chosen for k in range(4, len(m))} - set(chosen))
    known = counted.where(F.col("stem").isin(begins) & (F.col("clean") >= MARKS)) if begins else counted.limit(0)
    return chosen, [r["stem"] for r in known.orderBy(F.desc("clean"), "stem").limit(BARE).collect()]


def disguised(mark: str, seed: int = SEED) -> list[str]:
    """The mark with letters it does not have put into one gap, into two, and into all."""
    draw = np.random.default_rng([seed, *map(ord, mark)])
    word = mark.rstrip(OPEN)
    others = [c for c in "abcdefghijklmnopqrstuvwxyz" if c not in word]
    out = []
    for n in (1, 1, 2, 2, len(word) - 1, len(word) - 1):
        gaps = set(draw.choice(np.arange(1, len(word)), min(n, len(word) - 1), replace=False).tolist())
        out.append("".join(others[draw.integers(len(others))] * (i in gaps) + c for i, c in enumerate(word)))
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, penalty: float = 1e-6, steps: int = 50) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, the last one the bias. Rows of a label weigh the same, so that a
    landmark of clean rows too counts less; the toxic ones together weigh a quarter of the clean ones, however few they are.

    Newton steps on the rows within the margin, the support vectors.
    """
    x = np.c_[x, np.ones(len(x))]
    share = np.where(y > 0, 0.2 / max(1, (y > 0).sum()), 0.8 / max(1, (y <= 0).sum()))
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        if not inside.any():
            break
        xs = x[inside] * share[inside, None]
        new = np.linalg.solve(ridge + xs.T @ x[inside], xs.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def logit_of(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into the logit of label 1, with targets drawn in a little."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        gradient = np.array([(p - target) @ margins + 1e-6 * slope, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        hessian = np.array([[v @ margins**2, v @ margins], [v @ margins, v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def least_errors(margins: np.ndarray, y: np.ndarray) -> float:
    """The lowest cut between two margins with the fewest errors."""
    order = np.argsort(margins, kind="stable")
    sorted_margins, toxic = margins[order], y[order] > 0
    errors = np.r_[0, np.cumsum(toxic)] + np.r_[np.cumsum(~toxic[::-1])[::-1], 0]
    edges = np.r_[sorted_margins[0] - 1, (sorted_margins[1:] + sorted_margins[:-1]) / 2, sorted_margins[-1] + 1]
    real = np.r_[True, sorted_margins[1:] > sorted_margins[:-1], True]
    return float(edges[np.argmin(np.where(real, errors, len(y) + 1))])


def fit(rows: list[np.ndarray], labels: np.ndarray, space: Landmarks, marks: int, hidden: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logit, from the kernel rows of each text's sentences and the texts' labels; the first
    landmarks, `marks` in number, are those of toxic texts; `hidden` are toxic rows besides, of disguised words, which weigh as
    much as those of the texts together."""
    if not any(r[:, :marks].max() >= TEACHES for r, y in zip(rows, labels) if y > 0):
        return np.zeros(len(space.words)), -30.0
    values, vectors = np.linalg.eigh(space.among())
    keep = values > 1e-6
    to_space = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    mapped = [r @ to_space for r in rows]
    clean = np.concatenate([m for m, y in zip(mapped, labels) if y <= 0])
    likest = [r[:, :marks].max(axis=1) for r in rows]
    near = [r >= max(TEACHES, NEAR_BEST * r.max()) for r in likest]
    toxic = np.concatenate([m[n] for m, n, y in zip(mapped, near, labels) if y > 0])
    many = max(1, round(len(toxic) / len(hidden)))
    toxic = np.r_[toxic, np.tile(hidden @ to_space, (many, 1))]
    w = support_vectors(np.r_[toxic, clean], np.r_[np.ones(len(toxic)), -np.ones(len(clean))])
    margins = np.array([(m @ w[:-1]).max() + w[-1] for m in mapped])
    slope = max(logit_of(margins, labels)[0], 1e-6)
    return slope * (to_space @ w[:-1]), slope * (float(w[-1]) - least_errors(margins, labels))


def train(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows of `labels`, at most `TOXIC_TEXTS` and `CLEAN_TEXTS` of each label, those with the
    smallest seeded hash of key. Rows without label, key or text are passed over; with one label only the model
    scores every text 0. The bounded training set is broadcast as keys; the driver gets at most `SENTENCES` kernel
    rows per text of it.
    """
    draw = F.xxhash64(F.lit(SEED), F.col(key))
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("__label"))
    parts = [rows.where(F.col("__label") == v).orderBy(draw, key).limit(n) for v, n in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS))]
    drawn = parts[0].unionAll(parts[1])
    known = texts.select(key, F.col(text).alias("text")).where("text is not null").join(F.broadcast(drawn), key)
    marks, bare = choose_landmarks(known)
    landmarks = marks + bare
    if not marks:
        return Model([], np.zeros(0), -30.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Landmarks(landmarks)
        for batch in batches:
            listed, labels = batch["text"].tolist(), batch["__label"].to_numpy()
            for a, b in batches_of(listed, TEXT_CHARS):
                cut, begins = sentences(listed[a:b])
                found = kernel_rows(cut, mine)
                best = [found[i:j] for i, j in zip(begins, begins[1:])]
                best = [r[np.argsort(-r[:, : len(marks)].max(axis=1), kind="stable")[:SENTENCES]].ravel() for r in best]
                yield pd.DataFrame({"label": labels[a:b], "rows": best})

    sample = known.select("text", "__label").mapInPandas(run, "label int, rows array<float>").toPandas()
    y = np.where(sample["label"].to_numpy() == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model([], np.zeros(0), -30.0)
    listed = [np.asarray(r, np.float32).reshape(-1, len(landmarks)) for r in sample["rows"]]
    del sample
    space = Landmarks(landmarks)
    return Model(landmarks, *fit(listed, y, space, len(marks), kernel_rows([d for m in marks for d in disguised(m)], space)))


def logits(texts: list[str], model: Model, space: Landmarks) -> np.ndarray:
    """The logit of each text: that of its worst sentence."""
    cut, begins = sentences(texts)
    return np.maximum.reduceat(kernel_rows(cut, space) @ model.weights, begins[:-1]) + model.bias


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row: score 0 to 1, predicted 1 from 0.5 on.

    Null and empty texts have no word and get the score of a text without any likeness to a landmark. Whole texts are
    read; repeated rows give repeated results; other columns, labels among them, are not read.
    """
    inputs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def start():
        space = Landmarks(model.landmarks) if model.landmarks else None

        def work(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
            texts = batch["text"].fillna("").tolist()
            found = np.full(len(texts), model.bias)
            if space is not None:
                for a, b in batches_of(texts, TEXT_CHARS):
                    found[a:b] = logits(texts[a:b], model, space)
            scores = 1 / (1 + np.exp(-np.clip(found, -30, 30)))
            yield np.arange(len(texts)), pd.DataFrame({"score": scores, "predicted": (scores >= 0.5).astype(np.int32)})

        return work

    return map_rows(inputs, ["key"], start, "score double, predicted int").withColumnRenamed("key", key)
