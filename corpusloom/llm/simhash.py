"""SimHash near-duplicates, found through anchor points of a covering code.

A fingerprint has two halves of 31 bits (and two bits of neither). At most three differing bits leave one half with at
most one, so each half is searched with threshold 1. The anchors of a half are the words of the perfect Hamming code of
length 31, whose covering radius is 1: every fingerprint has one home anchor within the radius, and is replicated to all
anchors within radius plus threshold, 2. Whatever lies within the threshold of a fingerprint therefore has a replica at
its home; there the whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.llm.components import components
from corpusloom.session import materialise

LENGTH = 31
HALVES = (0, 33)  # where the halves begin
SALTS = 8
SLAB = 1 << 21
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority of the bits of the hashes of all shingles of lower-cased words; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[last:].tolist())), np.uint64, len(words) - last
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, others: list[str] = ()) -> DataFrame:
    """(key, fingerprint long, others) of every row; a null text has no words."""
    inputs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *others)

    def start():
        def work(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
            found = np.array([fingerprint(t or "", shingle) for t in batch["text"]], np.uint64)
            yield np.arange(len(batch)), pd.DataFrame({"fingerprint": found.view(np.int64)})

        return work

    done = map_rows(inputs, ["key", *others], start, "fingerprint long")
    return done.select(F.col("key").alias(key), "fingerprint", *others)


# The parity checks of the code: bit k of the syndrome covers the positions whose number, from 1, has bit k.
CHECKS = [np.uint64(sum(1 << (p - 1) for p in range(1, LENGTH + 1) if p >> k & 1)) for k in range(5)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home anchor of each half, all anchors within distance 2 as rows of 16; absent ones repeat the home)."""
    syndrome = np.zeros(len(half), np.uint64)
    for k, mask in enumerate(CHECKS):
        syndrome |= (np.bitwise_count(half & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), np.uint64(0))
    home = half ^ flip
    out = np.repeat(home[:, None], 16, axis=1)
    # Two flipped positions whose numbers differ by the syndrome give a code word; no others are at distance 2.
    for s in range(1, LENGTH + 1):
        rows = syndrome == s
        if rows.any():
            pairs = [(i, i ^ s) for i in range(1, LENGTH + 1) if i < i ^ s]
            masks = np.array([(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs], np.uint64)
            out[rows, 1:] = half[rows][:, None] ^ masks[None, :]
    return home, out


def replicas(nodes: DataFrame) -> DataFrame:
    """(place, home, fingerprint): each fingerprint at its homes, once per salt, and at the anchors around it.

    A place is half, anchor and salt. The replicas of an anchor are dealt over the salts, while its homes stand at all
    of them, which splits an anchor with very many fingerprints.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["fingerprint"].to_numpy(np.int64)
            for start in range(0, len(whole), 20_000):
                value = whole[start : start + 20_000]
                bits = value.view(np.uint64)
                salt = (bits * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61)
                for number, shift in enumerate(HALVES):
                    half = (bits >> np.uint64(shift)) & np.uint64((1 << LENGTH) - 1)
                    home, around = anchors(half)
                    side = np.uint64(number << 34)
                    at_home = (side | (home[:, None] << np.uint64(3)) | np.arange(SALTS, dtype=np.uint64)).ravel()
                    near = side | (around << np.uint64(3)) | salt[:, None]
                    first = np.ones(around.shape, bool)
                    first[:, 1:] = around[:, 1:] != home[:, None]
                    yield pd.DataFrame(
                        {"place": np.r_[at_home, near[first]].view(np.int64),
                         "home": np.r_[np.ones(len(at_home), np.int8), np.zeros(int(first.sum()), np.int8)],
                         "fingerprint": np.r_[np.repeat(value, SALTS), np.repeat(value, first.sum(axis=1))]}
                    )

    return nodes.select("fingerprint").mapInPandas(run, "place long, home byte, fingerprint long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links a-b."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j):
            # Hang the roots too, so that whole trees move.
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(place: np.ndarray, home: np.ndarray, value: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest of the links between homes and replicas of the same place; rows are sorted by place."""
    begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    sizes = np.diff(np.r_[begins, len(place)])
    n_homes = np.add.reduceat(home.astype(np.int64), begins)
    kept_a, kept_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    mates = sizes - n_homes
    busy = np.flatnonzero((n_homes > 0) & (mates > 0))
    group = np.repeat(np.arange(len(begins)), sizes)
    order = np.lexsort((1 - home, group))  # homes first in each place
    value = value[order]
    # Each home meets the replicas of its place; homes are taken in runs that make about a slab of pairs.
    homes = np.repeat(begins[busy], n_homes[busy]) + (
        np.arange(int(n_homes[busy].sum())) - np.repeat(np.cumsum(n_homes[busy]) - n_homes[busy], n_homes[busy])
    )
    first = np.repeat(begins[busy] + n_homes[busy], n_homes[busy])
    count = np.repeat(mates[busy], n_homes[busy])
    total = np.cumsum(count)
    at = 0
    while at < len(homes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + SLAB, "right")))
        n = count[at:to]
        mate = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        x, y = np.repeat(value[homes[at:to]], n), value[mate]
        near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= distance)
        if near.any():
            kept_a, kept_b = np.r_[kept_a, x[near]], np.r_[kept_b, y[near]]
            if len(kept_a) > SLAB // 4:
                kept_a, kept_b = _forest(kept_a, kept_b)
        at = to
    return _forest(kept_a, kept_b) if len(kept_a) else (kept_a, kept_b)


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs at up to `distance` differing bits do.

    Of each anchor's links only a spanning forest is returned, so a dense group of near copies costs no square of rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the two halves cover up to three differing bits")
    placed = replicas(nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            place = rest["place"].to_numpy(np.int64)
            # The last place may go on in the next batch.
            cut = int(np.searchsorted(place, place[-1], "left")) if len(place) else 0
            if cut >= 200_000 or cut and cut == len(place):
                yield found(rest.iloc[:cut])
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield found(rest)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _links(
            rows["place"].to_numpy(np.int64), rows["home"].to_numpy(np.int8), rows["fingerprint"].to_numpy(np.int64), distance
        )
        return pd.DataFrame({"a": a, "b": b})

    together = placed.repartition("place").sortWithinPartitions("place")
    return together.mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, others: list[str] = ()) -> DataFrame:
    """(key, fingerprint, component_id) of every row; fingerprint as 16 hex digits, component_id the smallest key that
    is reachable by links of at most `distance` differing bits. If other columns are asked for, they follow, and `root`,
    a fingerprint of the component, which also tells components apart that have the same smallest key or none.

    Null and empty texts have fingerprint zero and are linked like any other. Rows of null keys belong to components
    but do not name them, unless no other row is there (then null). Repeated rows give repeated results; columns
    not asked for are not read; an empty table gives an empty result. Equal fingerprints are one node, so copies make no pairs.
    Building the result runs jobs.
    """
    marked = materialise(fingerprints(df, key, text, shingle, others), "fingerprints")
    nodes = materialise(marked.groupBy("fingerprint").agg(F.min(key).alias("__first")), "nodes")
    roots = components(materialise(links(nodes, distance), "links"))
    rooted = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "__first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("__first").alias("component_id"))
    named = materialise(rooted.join(least, "root").select(F.col("fingerprint").alias("__f"), "component_id", "root"), "classes")
    return marked.join(named, F.col("fingerprint") == F.col("__f")).select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id",
        *([*others, "root"] if others else []),
    )
