"""Grouped prefix join: documents whose sets of word n-grams are alike by Jaccard similarity.

1. Every text becomes the set of its n-grams, as hashes; equal sets are one class.
2. All n-grams have one order, rare ones first. Two sets that are alike share an n-gram in their prefixes, the first
   n - ceil(share * n) + 1 in that order. The order comes from a bitmap of the n-grams that stand in several places and from
   counts in buckets, both of a fixed size, so that it can be known in every task; any order gives the same links, a good
   one keeps repeated n-grams out of prefixes.
3. Classes of the same prefix and size are one group. Groups meet at the n-grams of their prefixes, if their sizes and the
   places there leave room for enough common n-grams.
4. First every group meets only the group that stands first at an n-gram, and a group's members meet its first member:
   as many pairs as places. After these are verified, other pairs are left only where an n-gram holds groups of several
   components; they meet in a join or, at frequent n-grams, in blocks of bounded size, and are expanded to members and
   verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.bitmaps import bitmap, may_hold, repeated
from corpusloom.llm.components import components
from corpusloom.operators.skew import join_hot
from corpusloom.session import materialise

WORDS = 4
SIMILAR = (85, 100)
BUCKETS = 1 << 20
BLOCK = 4096  # buckets per row of counts
GRAM_BITS = 1 << 27
CHUNK = (1 << 20) - 1  # bytes of text at a time
FEW = 64  # groups at one n-gram up to which a join lets them meet
TILE = 1024  # groups of one block where there are more
SLAB = 1 << 21


def _shingles(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, text of each): a text of fewer words is one n-gram, one without words has none."""
    data = W.lowered(data)
    starts, stops = W.word_bounds(W.kinds()[data], ends)
    hashes = W.word_hashes(data, starts, stops)
    text = np.searchsorted(ends, starts, "right")
    counts = np.bincount(text, minlength=len(ends))
    n = len(hashes)
    at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    found, owner = [W.chain(*[hashes[at + i] for i in range(size)])], [text[at]]
    first = np.cumsum(counts) - counts
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        found.append(W.chain(*[hashes[first[short] + i] for i in range(k)]))
        owner.append(short)
    return np.concatenate(found), np.concatenate(owner)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first text, sets of n-grams, as sorted hashes) of runs of texts."""
    data, ends = W.raw_values(column)
    for a, b in W.chunks(ends, CHUNK):
        hashes, owner = _shingles(*W.cut(data, ends, a, b), size)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
        hashes, owner = hashes[new], owner[new]
        yield a, np.split(hashes, np.searchsorted(owner, np.arange(1, b - a)))


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums of the scattered hashes, which do not depend on their order."""
    more = W._scatter(hashes * W._STEP)
    return int(W._scatter(hashes).sum(dtype=np.uint64).view(np.int64)), int(more.sum(dtype=np.uint64).view(np.int64))


def _longs(runs: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
    values = np.concatenate(runs).astype(np.uint64).view(np.int64) if runs else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def bucket_counts(texts: DataFrame, size: int = WORDS) -> np.ndarray:
    """How many n-grams of all texts (a binary column `text`) fall into each of `BUCKETS` buckets, those of the upper bits of
    their hashes. The table has a fixed size; it is summed on the cluster in blocks."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            data, ends = W.raw_values(batch.column(0))
            for a, b in W.chunks(ends, CHUNK):
                hashes, _ = _shingles(*W.cut(data, ends, a, b), size)
                total += np.bincount((hashes >> shift).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
        blocks = total.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "counts"]
        )

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for counts in rows["counts"]:
            total += np.frombuffer(counts, np.uint32)
        return pd.DataFrame({"block": [key[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    parts = texts.select("text").mapInArrow(run, "block int, counts binary")
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint32)
    for row in parts.groupBy("block").applyInPandas(merge, "block int, counts binary").collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.uint32)
    return out.ravel()


def repeated_grams(texts: DataFrame, size: int = WORDS) -> np.ndarray:
    """A bitmap of the n-grams that stand in several places of all texts."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, ends = W.raw_values(batch.column(0))
        for a, b in W.chunks(ends, CHUNK):
            yield _shingles(*W.cut(data, ends, a, b), size)[0]

    return repeated(texts.select("text"), hashes, GRAM_BITS)


def _prefix_size(n: int, similar: tuple[int, int]) -> int:
    return n - -(-n * similar[0] // similar[1]) + 1


def described(texts: DataFrame, kind: str, size: int, similar: tuple[int, int], several: np.ndarray) -> DataFrame:
    """(key, n, h1, h2, prefix) of every text: the size of its set, a digest of the set, and its rarest n-grams in
    order: those that stand nowhere else, then by the counts of their buckets."""
    counts = bucket_counts(texts, size)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prefixes = [], []
            for _, sets in _sets(batch.column("text"), size):
                for hashes in sets:
                    n = len(hashes)
                    rows.append((n, *_digest(hashes)))
                    order = np.lexsort((hashes, counts[(hashes >> shift).astype(np.int64)], may_hold(several, hashes)))
                    prefixes.append(hashes[order[: _prefix_size(n, similar)]] if n else hashes)
            table = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(table[:, i].copy()) for i in range(3)], _longs(prefixes)],
                ["key", "n", "h1", "h2", "prefix"],
            )

    return texts.mapInArrow(run, f"key {kind}, n long, h1 long, h2 long, prefix array<long>")


def _sets_of(texts: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, n, grams) of the wanted classes: made again from the texts of their first documents, which a bitmap of these
    documents' keys finds; no text is shuffled."""
    needed = classes.join(wanted.select("cls").distinct(), "cls", "left_semi").select("cls", "h1", "h2", "n", "first")
    needed = materialise(needed, "needed")
    marks = bitmap(needed, F.xxhash64("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = may_hold(marks, batch.column("hash").to_numpy())
            digests, kept = [], []
            for _, sets in _sets(batch.column("text").filter(pa.array(mine)), size):
                digests += [_digest(s) for s in sets]
                kept += sets
            table = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy()), _longs(kept)], ["h1", "h2", "grams"])

    made = texts.select(F.xxhash64("key").alias("hash"), "text").mapInArrow(run, "h1 long, h2 long, grams array<long>")
    # A key may stand in several rows: each class takes one set, whichever row it comes from.
    return materialise(
        made.join(needed.select("cls", "h1", "h2", "n"), ["h1", "h2"]).groupBy("cls", "n").agg(F.any_value("grams").alias("grams")), "sets"
    )


def _repeated_places(groups: DataFrame, several: np.ndarray) -> DataFrame:
    """(token, at, gid, n, members): the places of prefixes whose n-gram stands elsewhere too, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = np.diff(prefix.offsets.to_numpy())
            token = prefix.flatten().to_numpy()
            kept = np.flatnonzero(may_hold(several, token))
            owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
            at = kept - (np.cumsum(sizes) - sizes)[owner]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[kept]), pa.array(at.astype(np.int64)), *[batch.column(c).take(rows) for c in ("gid", "n", "members")]],
                ["token", "at", "gid", "n", "members"],
            )

    return groups.mapInArrow(run, "token long, at long, gid long, n long, members long")


def _enough(n_x: Column, n_y: Column, similar: tuple[int, int]) -> Column:
    """The least number of common n-grams, times the sum of both terms of the ratio, that makes two sets alike."""
    return (n_x + n_y) * similar[0]


def verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs (a, b) of classes that are alike."""
    pairs = materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sets = _sets_of(texts, classes, pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))), size)
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    met = join_hot(join_hot(pairs, right, ["b"], ["a"]), left, ["a"], ["b"])
    common = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    return materialise(met.where(common * sum(similar) >= _enough(F.col("n_a"), F.col("n_b"), similar)).select("a", "b"), "alike")


def _room(n_x: str, at_x: str, n_y: str, at_y: str, similar: tuple[int, int]) -> Column:
    """Whether two sets that first meet at these places of their prefixes can have enough in common."""
    left = F.least(F.col(n_x) - F.col(at_x), F.col(n_y) - F.col(at_y))
    return left * sum(similar) >= _enough(F.col(n_x), F.col(n_y), similar)


def _fits(similar: tuple[int, int]) -> Column:
    """Whether the places x and y of one n-gram leave room for enough common ones and are not known to be of one component."""
    apart = (F.col("x.comp") != F.col("y.comp")) | (F.col("x.comp") < 0)
    return (F.col("x.gid") < F.col("y.gid")) & apart & _room("x.n", "x.at", "y.n", "y.at", similar)


def _meet_in_join(places: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(g, h) that meet at n-grams with few places."""
    x, y = places.alias("x"), places.alias("y")
    return x.join(y, (F.col("x.token") == F.col("y.token")) & _fits(similar)).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h"))


def _meet_in_tiles(places: DataFrame, similar: tuple[int, int], tile: int) -> DataFrame:
    """(g, h) that meet at n-grams with many places: these are cut in blocks of about `tile` by hash, and each pair of blocks
    is a cell of bounded size, compared by array operations."""
    low, both = similar[0], sum(similar)
    mine = places.withColumn("of", F.ceil(F.col("size") / tile)).withColumn("mine", F.pmod(F.xxhash64("gid"), F.col("of")))
    cells = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).select(
        "token", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "gid", "n", "at", "comp"
    )

    def met(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gid, n, at, comp, mine = (rows[c].to_numpy(np.int64) for c in ("gid", "n", "at", "comp", "mine"))
        left, right = np.flatnonzero(mine == key[1]), np.flatnonzero(mine == key[2])
        found, step = [np.zeros((0, 2), np.int64)], max(1, SLAB // max(1, len(right)))
        for s in range(0, len(left), step):
            i, j = left[s : s + step, None], right[None, :]
            fits = np.minimum(n[i] - at[i], n[j] - at[j]) * both >= (n[i] + n[j]) * low
            fits &= (comp[i] != comp[j]) | (comp[i] < 0)
            fits &= (gid[i] < gid[j]) | ((key[1] != key[2]) & (gid[i] != gid[j]))
            p, q = np.nonzero(fits)
            g, h = gid[left[s : s + step][p]], gid[right[q]]
            found.append(np.c_[np.minimum(g, h), np.maximum(g, h)])
        pairs = np.concatenate(found)
        return pd.DataFrame({"g": pairs[:, 0], "h": pairs[:, 1]})

    return cells.groupBy("token", "x", "y").applyInPandas(met, "g long, h long")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, similar: tuple[int, int] = SIMILAR, few: int = FEW, tile: int = TILE
) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the number of different n-grams of `size` words, and the smallest key
    that is reachable by links. Two texts are linked if their common n-grams are at least the share `similar`, a ratio of
    whole numbers, of all n-grams of both.

    A to Z are lower-cased; words end at ASCII white space. A text of fewer words is one n-gram; one without words, null
    among them, has an empty set, is linked with nothing and is its own component. Rows without a key belong to components,
    but do not name them unless no other row is there (then null). Repeated rows and equal sets are one class, so copies
    make no pairs. N-grams are told apart by 64-bit hashes, sets by two such sums. Other columns are not read; an empty
    table gives an empty result. A very long text is handled alone; memory grows with the longest text. Building the
    result runs jobs and writes tables.
    """
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    several = repeated_grams(texts, size)
    marked = materialise(described(texts, kind, size, similar, several), "described")
    single = marked.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("key").alias("first"), F.any_value("prefix").alias("prefix"))
    classes = materialise(single.withColumn("cls", F.monotonically_increasing_id()), "classes")

    # Groups of the same prefix and size, named by their first class.
    groups = materialise(classes.groupBy("n", "prefix").agg(F.min("cls").alias("gid"), F.count(F.lit(1)).alias("members")), "groups")
    shared = classes.select("cls", "n", "prefix").join(groups.where("members > 1").select("n", "prefix", "gid"), ["n", "prefix"])
    shared = materialise(shared.select("cls", "gid"), "members")

    # The n-grams that stand in several prefixes, and of each the place nearest to the front of its prefix.
    order = F.shiftleft("at", 33) + F.shiftleft("n", 1) + (F.col("members") > 1).cast("int")
    postings = materialise(_repeated_places(groups, several).withColumn("order", order), "postings")
    tokens = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("order").alias("first_order"), F.min_by("gid", "order").alias("first_gid")
    ).where("size > 1")
    tokens = materialise(tokens, "tokens")
    size_of = F.shiftright(F.col("first_order").bitwiseAND(F.lit((1 << 33) - 1)), 1)
    places = join_hot(postings.drop("order"), tokens.drop("size"), ["token"], ["gid"]).select(
        "token", "gid", "n", "at", "first_gid", F.shiftright("first_order", 33).alias("first_at"),
        size_of.alias("first_n"), ((F.col("members") > 1) | (F.col("first_order") % 2 == 1)).alias("several"),
    )
    places = materialise(places.where("gid <> first_gid"), "places")

    to_first = places.where(_room("n", "at", "first_n", "first_at", similar)).select(F.col("gid").alias("a"), F.col("first_gid").alias("b"))
    to_first = to_first.unionAll(shared.select(F.col("cls").alias("a"), F.col("gid").alias("b")))
    links = verified(texts, classes, to_first, size, similar)
    roots = materialise(components(links), "roots")

    # What a group's members belong to: one component, or several (-1).
    of_first = groups.select("gid").join(roots, F.col("gid") == F.col("node"), "left").select("gid", F.coalesce("root", "gid").alias("comp"))
    mixed = shared.join(roots, F.col("cls") == F.col("node"), "left").groupBy("gid").agg(
        F.min(F.coalesce("root", "cls")).alias("least"), F.max(F.coalesce("root", "cls")).alias("most")
    ).where("least <> most").select("gid", F.lit(-1).cast("long").alias("mixed"))
    state = materialise(of_first.join(mixed, "gid", "left").select("gid", F.coalesce("mixed", "comp").alias("comp")), "states")
    # Every group has met the first one of its n-gram, but only first members have.
    again = places.where("several").where(_room("n", "at", "first_n", "first_at", similar)).select(F.col("gid").alias("g"), F.col("first_gid").alias("h"))
    placed = materialise(places.select("token", "gid", "n", "at").join(state, "gid"), "placed")
    open_ = placed.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("size"))
    open_ = open_.where("size > 1 and (least <> most or least < 0)").select("token", "size")
    left = materialise(join_hot(placed, materialise(open_, "open"), ["token"], ["gid"]), "left")
    meetings = _meet_in_join(left.where(F.col("size") <= few), similar).unionAll(_meet_in_tiles(left.where(F.col("size") > few), similar, tile))
    inside = mixed.select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    meetings = materialise(meetings.unionAll(again.unionAll(inside)).distinct(), "meetings")
    members = state.select("gid", F.col("gid").alias("cls")).unionAll(shared.where("cls <> gid").select("gid", "cls"))
    members = members.join(roots, F.col("cls") == F.col("node"), "left").select("gid", "cls", F.coalesce("root", "cls").alias("comp"))
    members = materialise(members, "rooted")
    left = members.select(F.col("gid").alias("g"), F.col("cls").alias("a"), F.col("comp").alias("comp_a"))
    right = members.select(F.col("gid").alias("h"), F.col("cls").alias("b"), F.col("comp").alias("comp_b"))
    others = meetings.join(left, "g").join(right, "h").where("comp_a <> comp_b").select("a", "b")
    links = links.unionAll(verified(texts, classes, others, size, similar))

    roots = components(links)
    rooted = classes.select("cls", "h1", "h2", "n", "first").join(roots, F.col("cls") == F.col("node"), "left").select(
        "h1", "h2", "n", "first", F.coalesce("root", "cls").alias("root")
    )
    rooted = materialise(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes_named = materialise(join_hot(rooted, named, ["root"], ["h1"]).select("h1", "h2", "n", "component_id", F.lit(True).alias("named")), "named")
    done = join_hot(marked.select("key", "n", "h1", "h2"), classes_named, ["h1", "h2", "n"], ["key"], "left")
    return done.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("named"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
    )
