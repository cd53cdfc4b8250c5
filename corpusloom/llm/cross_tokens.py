"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

Rows are shuffled by their full text and combined, so that however often a text stands in the corpus it is tokenised and
aligned once, with its multiplicity as weight. Where tokens of both sides end at the same byte they are linked, and these
places cut the text in groups. The counts of linked pairs of ids are weighted sums over the distinct texts. A task knows
the `KNOWN` most frequent pairs' counts, a table of fixed size; texts that hold other pairs get these counts by a join, in
which no key is frequent. What each text measures is joined to the rows by a digest of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.arrow import remembered
from corpusloom.llm.bpe import CACHE_WORDS, Encoder, _runs, expand
from corpusloom.operators.skew import join_hot
from corpusloom.session import materialise

KNOWN = 1 << 18
CHUNK = 1 << 20
# Fixed value: how the piece model writes a space.
BLANK = "▁"

class Pieces:
    """A sentencepiece model, applied to each different stretch of a batch once.

    A stretch is a run of spaces and what follows up to the next one. No piece reaches from one stretch into the next (a
    model with such a piece, or one that rewrites texts, is applied to whole texts), so stretches are tokenised alike
    wherever they stand.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = _runs([self._raw(i, p) for i, p in enumerate(pieces)])
        self.n_bytes = np.diff(self.bytes_of[0])
        self.size = len(pieces)
        same = all(self.model.normalize(x) == BLANK + x.replace(" ", BLANK) for x in ("a", " a  b ", "ﬁ　̈́\t", "x\n"))
        self.splits = same and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.blank = self.model.piece_to_id(BLANK)
        self.known: dict[bytes, bytes] = {}

    def _raw(self, i: int, piece: str) -> bytes:
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode()

    def _stretches(self, stretches: list[bytes]) -> list[bytes]:
        """The ids of stretches, as bytes of 32-bit numbers."""
        known = self.known
        new = [s for s in stretches if s not in known]
        if len(known) + len(new) > CACHE_WORDS:
            self.known = known = {s: known[s] for s in stretches if s in known}
        # The model puts a space in front; a lone space is none but that one.
        found = self.model.encode([s[1:].decode("utf-8", "replace") for s in new], num_threads=1)
        for s, ids in zip(new, found):
            known[s] = np.array(ids if len(s) > 1 else [self.blank], np.uint32).tobytes()
        return [known[s] for s in stretches]

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end); each text in `data` has a space in
        front, as the model puts it there."""
        begins = np.r_[0, ends[:-1]]
        if not self.splits:
            texts = [data[a + 1 : b].tobytes().decode() for a, b in zip(begins, ends)]
            listed = [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]
            return np.concatenate([np.zeros(0, np.uint32), *listed]), np.r_[0, np.cumsum([len(x) for x in listed])].astype(np.int64)
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begins] = True
        starts = np.flatnonzero(start)
        stops = np.r_[starts[1:], len(data)]
        _, first, which = np.unique(W.word_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if not W.same_bytes(data, starts, stops, first[which]):
            first, which = np.arange(len(starts)), np.arange(len(starts))
        raw = data.tobytes()
        runs = self._stretches([raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())])
        offsets = np.r_[0, np.cumsum([len(r) // 4 for r in runs])].astype(np.int64)
        ids, upto = expand(offsets, np.frombuffer(b"".join(runs), np.uint32), which)
        return ids, np.r_[0, np.r_[0, upto][np.searchsorted(starts, ends)]]


class Aligner:
    """Both tokenizers, and the alignment of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a, plain=True), Pieces(path_b)
        self.size_a = len(self.a.n_bytes)
        digits_a, digits_b = self.a.digits_of, _runs([b"%d," % i for i in range(self.b.size)])
        self.digits = np.r_[digits_a[0], digits_a[0][-1] + digits_b[0][1:]], np.r_[digits_a[1], digits_b[1]]

    def align(self, texts: list[bytes]) -> dict[str, object]:
        """n_a, n_b, n_groups and n_links of each text, the hash of its groups, and its linked pairs (id of a times the
        size of b's vocabulary plus id of b) with how often each is linked. A text must not be empty; one whose tokens
        of either side do not spell it has none."""
        spaced = [b" " + t for t in texts]
        data = np.frombuffer(b"".join(spaced), np.uint8)
        ends = np.cumsum([len(t) for t in spaced])
        sides = (self.a, *self.a.encode([t.decode() for t in spaced])), (self.b, *self.b.encode(data, ends))
        valid = np.ones(len(texts), bool)
        for side, ids, begins in sides:
            spelled, upto = expand(*side.bytes_of, ids)
            upto = np.r_[0, upto][begins]
            if not np.array_equal(upto[1:], ends) or not np.array_equal(spelled, data):
                for i in range(len(texts)):
                    valid[i] &= spelled[upto[i] : upto[i + 1]].tobytes() == spaced[i]
        kept, counts, at = [], [], []
        for side, ids, begins in sides:
            sizes = np.diff(begins)
            ids = ids[np.repeat(valid, sizes)].astype(np.int64)
            kept.append(ids)
            counts.append(np.where(valid, sizes, 0))
            at.append(np.cumsum(side.n_bytes[ids]))
        total = int(at[0][-1]) if len(at[0]) else 0
        meets = []
        for mine, other in ((0, 1), (1, 0)):
            mark = np.zeros(total + 1, bool)
            mark[at[other]] = True
            meets.append(mark[at[mine]])
        text = np.repeat(np.arange(len(texts)), counts[0])[meets[0]]
        pairs = kept[0][meets[0]] * self.b.size + kept[1][meets[1]]
        n_links = np.bincount(text, minlength=len(texts))
        span = self.size_a * self.b.size
        both, times = np.unique(text * span + pairs, return_counts=True)
        cuts = np.searchsorted(both, np.arange(len(texts) + 1) * span)
        return {
            "n_a": counts[0], "n_b": counts[1], "n_groups": n_links, "n_links": n_links, "groups_sha256": self._listed(kept, meets, counts),
            "cuts": cuts, "pairs": both % span, "times": times,
        }

    def _listed(self, ids: list[np.ndarray], meets: list[np.ndarray], counts: list[np.ndarray]) -> list[str]:
        group = [np.cumsum(m) - m for m in meets]
        order = np.argsort(np.r_[2 * group[0], 2 * group[1] + 1], kind="stable")
        listed, ends = expand(*self.digits, np.r_[ids[0], ids[1] + self.size_a][order])
        ends_with = np.r_[np.where(meets[0], ord("|"), ord(",")), np.where(meets[1], ord(";"), ord(","))].astype(np.uint8)
        listed = listed.copy()
        listed[ends - 1] = ends_with[order]
        upto = np.r_[0, ends][np.r_[0, np.cumsum(counts[0] + counts[1])]]
        return [hashlib.sha256(listed[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(upto, upto[1:])]


@remembered
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker."""
    return Aligner(path_a, path_b)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = "digest binary, weight long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """An ALIGNED row per distinct text of (text, digest), none of them null or empty."""
    distinct = texts.groupBy("text").agg(F.count(F.lit(1)).alias("weight")).select(
        F.col("text").cast("binary").alias("text"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "weight"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = aligner(path_a, path_b)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            _, ends = W.raw_values(batch.column("text"))
            for a, b in W.chunks(ends, CHUNK):
                found = mine.align(raw[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").slice(a, b - a), batch.column("weight").slice(a, b - a),
                     *[pa.array(found[m].astype(np.int64)) for m in MEASURES], pa.array(found["groups_sha256"], pa.string()),
                     _lists(found["cuts"], found["pairs"]), _lists(found["cuts"], found["times"].astype(np.int32))],
                    ["digest", "weight", *MEASURES, "groups_sha256", "pairs", "times"],
                )

    return distinct.mapInArrow(run, ALIGNED)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a list column in a row, how many each list has)."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best) of every linked pair: its links in the whole corpus, and whether no pair of the same id of b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, sizes = _flat(batch.column("pairs"))
            times, _ = _flat(batch.column("times"))
            weights = np.repeat(batch.column("weight").to_numpy(), sizes) * times.astype(np.int64)
            different, which = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(different), np.int64)
            np.add.at(n, which, weights)
            yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(n)], ["pair", "n"])

    parts = aligned.select("weight", "pairs", "times").mapInArrow(run, "pair long, n long")
    counts = materialise(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts").withColumn("b", F.col("pair") % size_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def measured(aligned: DataFrame, counts: DataFrame, known: int = KNOWN) -> DataFrame:
    """(digest, MEASURES, groups_sha256, n_best, count_sum) of every distinct text. The driver gets `known` counts."""
    top = counts.orderBy(F.desc("n"), "pair").limit(known).toPandas()
    order = np.argsort(top["pair"].to_numpy(np.int64))
    pairs, n, best = (top[c].to_numpy(t)[order] for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, sizes = _flat(batch.column("pairs"))
            times = _flat(batch.column("times"))[0].astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pairs, mine), max(0, len(pairs) - 1))
            found = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            sums = np.zeros((2, len(sizes)), np.int64)
            np.add.at(sums[0], owner[found], times[found] * best[at[found]])
            np.add.at(sums[1], owner[found], times[found] * n[at[found]])
            offsets = np.r_[0, np.cumsum(np.bincount(owner[~found], minlength=len(sizes)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), *[batch.column(m) for m in MEASURES], batch.column("groups_sha256"), pa.array(sums[0]),
                 pa.array(sums[1]), _lists(offsets, mine[~found]), _lists(offsets, times[~found])],
                ["digest", *MEASURES, "groups_sha256", "n_best", "count_sum", "pairs", "times"],
            )

    kinds = ", ".join(f"{m} long" for m in MEASURES)
    done = materialise(
        aligned.select("digest", *MEASURES, "groups_sha256", "pairs", "times").mapInArrow(
            run, f"digest binary, {kinds}, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"
        ), "measured",
    )
    if len(top) < known:
        return done.drop("pairs", "times")
    last = top.iloc[-1]
    rare = counts.where((F.col("n") < int(last["n"])) | ((F.col("n") == int(last["n"])) & (F.col("pair") > int(last["pair"]))))
    open_ = done.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("digest", "x.pairs", "x.times")
    joined = open_.join(rare, F.col("pairs") == F.col("pair"))
    more = joined.groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    return done.join(more, "digest", "left").select(
        "digest", *MEASURES, "groups_sha256", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


def alignment(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", known: int = KNOWN) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, from the tokens of a byte-level BPE
    file (a) and a sentencepiece model (b).

    Both tokenise a space and the text; special tokens written out in a text are ordinary text. Byte offsets at which
    tokens of both sides end cut the tokens in groups, and link the two tokens that end there. A pair of ids counts as
    often as it is linked in all rows, repeated ones included; n_best are the links whose pair has the highest count of its id of b, ties
    included, count_sum is the sum of the links' counts. groups_sha256 is the hash of the groups, `a,a|b;a|b,b` as decimals.
    A text that is null or empty, or that the tokens of either side do not spell byte by byte, has no tokens: zeros and ''.
    Rows of one text get the same result, null keys stay null; other columns are not read; an empty table gives an empty result.
    A very long text is handled alone; memory grows with the longest text. Building the result runs jobs and writes tables.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = materialise(aligned_texts(rows.where("text <> ''").select("text"), path_a, path_b), "aligned")
    done = measured(aligned, materialise(pair_counts(aligned, size_b), "counts"), known)
    digests = rows.select("key", F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("digest"))
    joined = join_hot(digests, done, ["digest"], ["key"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("key").alias(key), *[F.coalesce(m, zero).alias(m) for m in [*MEASURES, "n_best", "count_sum"]],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
