"""Vector best-fit packing of token sequences.

A bin has several capacities: tokens, documents, and attention cost (the sum of squared piece lengths, for attention
that does not cross documents). Pieces are placed longest first into the open bin that suits them best under every
capacity. Blocks of pieces, dealt at random, are packed independently; each holds thousands of bins, so the few bins
left open at the end of a block add little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.llm.bpe import batches_of, encoder
from corpusloom.session import materialise

BLOCK = 32_768
END = 0  # the id that ends a document


def token_pieces(df: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every row: the ids of the text and the end id, cut into pieces of
    `capacity` ids of which the first may be shorter; with `ids` if wanted.

    A null text counts as '' and is one piece, the end id. Repeated rows give repeated pieces; other columns are not
    read.
    """

    def start():
        enc = encoder(path)

        def work(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
            texts = batch["text"].fillna("").tolist()
            for a, b in batches_of(texts):
                ids, begins = enc.encode(texts[a:b])
                owner, rows, parts = [], [], []
                for i in range(b - a):
                    whole = np.append(ids[begins[i] : begins[i + 1]], np.uint32(END)).astype("<u4")
                    first = (len(whole) - 1) % capacity + 1
                    bounds = [0, *range(first, len(whole) + 1, capacity)]
                    for piece, (s, e) in enumerate(zip(bounds, bounds[1:])):
                        part = whole[s:e]
                        owner.append(a + i)
                        rows.append((piece, s, e - s, zlib.crc32(part.tobytes())))
                        if keep_ids:
                            parts.append(part.astype(np.int32))
                out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"]).astype("int64").astype({"piece": "int32"})
                yield np.array(owner), out.assign(ids=parts) if keep_ids else out

        return work

    inputs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    results = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_rows(inputs, ["key"], start, results).withColumnRenamed("key", key)


def best_fit(lengths: np.ndarray, capacity: int, documents: int, attention: int, rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, into the open bin that all three capacities admit and the rule
    prefers, else into a new one.

    rule "norm": the least weighted norm of what would be left of the three capacities, each as a share of the whole;
    "dot": the largest weighted dot product of the item's and the bin's free shares. Equal choices go to the bin opened
    first, equal lengths keep their order. A length above a capacity, alone in its bin, is an error.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > capacity or lengths.max() ** 2 > attention or documents < 1):
        raise ValueError("an item exceeds a capacity")
    whole = np.array([capacity, documents, attention], np.float64)
    w = np.asarray(weights, np.float64)
    free = np.zeros((len(lengths), 3), np.float64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = np.zeros(len(lengths), np.int64)
    # Bins that can still take the shortest item, in the order of their opening.
    open_bins = np.zeros(0, np.int64)
    shortest = int(lengths.min()) if len(lengths) else 0
    least = np.array([shortest, 1, shortest**2], np.float64)
    count = 0
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        need = np.array([size, 1, size * size], np.float64)
        fits = open_bins[(free[open_bins] >= need).all(axis=1)]
        if len(fits):
            room = free[fits]
            if rule == "norm":
                chosen = fits[np.argmin((((room - need) / whole) ** 2) @ w)]
            else:
                chosen = fits[np.argmax((room / whole) @ (w * need / whole))]
        else:
            chosen, count = count, count + 1
            free[chosen] = whole
            open_bins = np.append(open_bins, chosen)
        bins[item], offsets[item] = chosen, used[chosen]
        used[chosen] += size
        free[chosen] -= need
        if (free[chosen] < least).any():
            open_bins = open_bins[open_bins != chosen]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights=(1.0, 1.0, 1.0), block: int = BLOCK) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: gapless places in sequences of at most `capacity` tokens,
    `documents` pieces and `attention` cost.

    Left out, the two other capacities are as wide as `capacity` can need, so that tokens decide. Pieces are written
    once and dealt to blocks of about `block` by their place in that table, so that neither repeated rows nor a source
    with most of them makes a block larger. Columns called sequence_id or offset are replaced, all others pass through.
    An empty table gives an empty result. Writing and counting the pieces runs jobs.
    """
    documents = documents or capacity
    attention = attention or capacity * capacity
    pieces = materialise(pieces.drop("sequence_id", "offset"), "pieces")
    blocks = max(1, ceil(pieces.count() / block))
    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    columns = pieces.columns
    sorts = [(c, "ascending") for c in [*(c for c in ("length", "ids_crc32", "start") if c in columns), *columns[:2]]]

    # Whole columns stay Arrow's: in pandas a null would make doubles of a column of ids.
    def run(group: pa.Table) -> pa.Table:
        # A retried task may receive its rows in another order.
        group = group.take(pc.sort_indices(group, sort_keys=list(dict(sorts).items())))
        bins, offsets = best_fit(group.column("length").to_numpy(), capacity, documents, attention, rule, weights)
        block = group.column("__block").to_numpy().astype(np.int64)
        out = group.select(columns).append_column("sequence_id", pa.array((block << 32) + bins))
        return out.append_column("offset", pa.array(offsets))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("__block").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_texts(df: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text", keep_ids: bool = False, **limits) -> DataFrame:
    """Token pieces of all rows (`token_pieces`) with their places in sequences (`pack`)."""
    return pack(token_pieces(df, path, capacity, key, text, keep_ids), capacity, **limits)
