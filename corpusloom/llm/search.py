"""Exact top-k search by tiled matrix products.

Rows are dealt by hash into tiles, queries into blocks, both of a bounded size; each (block, tile) pair is one product
in one task, which keeps the k best per query; the lists are merged along a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 8192
BLOCK = 2048
FAN_IN = 16
NONE = np.iinfo(np.int64).min

PACKED = "dim int, no long, ids binary, cells binary, largest long"
LISTS = "dim int, block long, part long, queries binary, ids binary, scores binary"


def integer_vector(vector: Column) -> Column:
    """floor(64 * x) of each component, at most 64 bits; null for a null vector, one of no components, and one with a
    component that is null or not finite."""
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(64.0)))
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when((F.size(vector) > 0) & fine, cells)


def _packed(vectors: DataFrame, parts: int) -> DataFrame:
    """One row per (dim, no): ids in rising order and their components, about rows / parts of them."""

    def pack(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        cells = np.maximum(np.array(group["cells"].tolist(), dtype=np.int64), NONE + 1)
        return pd.DataFrame(
            {"dim": [keys[0]], "no": [keys[1]], "ids": [group["id"].to_numpy(np.int64).tobytes()],
             "cells": [cells.tobytes()], "largest": [int(np.abs(cells).max())]}
        )

    dealt = vectors.withColumn("no", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return dealt.groupBy("dim", "no").applyInPandas(pack, PACKED)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row (all, padded with NONE, if fewer), ids rising within a row of equal scores."""
    rows, n = scores.shape
    take = min(k, n)
    top = int(np.abs(scores[scores != NONE]).max(initial=0))
    if top < (1 << 62) // n:
        # Score and column in one number: no two are equal, so a partial selection is exact.
        key = np.where(scores == NONE, NONE, scores * n + np.arange(n - 1, -1, -1))
        chosen = np.argpartition(key, n - take, axis=1)[:, n - take :]
        order = np.argsort(-np.take_along_axis(key, chosen, 1), axis=1, kind="stable")
        # -NONE overflows to NONE, which would sort first: absent cells are put last explicitly.
        chosen = np.take_along_axis(chosen, order, 1)
        absent = np.take_along_axis(scores, chosen, 1) == NONE
        chosen = np.take_along_axis(chosen, np.argsort(absent, axis=1, kind="stable"), 1)
    else:
        chosen = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, scores == NONE), axis=1)[:, :take]
    best = np.take_along_axis(scores, chosen, 1)
    best_ids = np.where(best == NONE, 0, ids[chosen] if ids.ndim == 1 else np.take_along_axis(ids, chosen, 1))
    if take < k:
        pad = ((0, 0), (0, k - take))
        best, best_ids = np.pad(best, pad, constant_values=NONE), np.pad(best_ids, pad)
    return best_ids, best


def _product(queries: np.ndarray, rows: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products: doubles hold them up to 2**53, 64-bit whole numbers and Python's beyond; those over 64 bits
    become the largest or smallest number."""
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return queries @ rows.T
    return np.clip(queries.astype(object) @ rows.T.astype(object), NONE + 1, -(NONE + 1)).astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, <key>, score): for each query row its k highest integer inner products with rows of another
    key; equal scores go to the smaller key; all rows if there are fewer than k.

    Components are floor(64 * x). Rows without a key or with an unusable vector (`integer_vector`) take no part, and
    vectors are compared with those of their own length only. A key on several rows is several rows, each of them a
    candidate of other keys; a repeated query key gives its list once per row. An empty table gives an empty result. A
    score beyond 64 bits counts as the largest or smallest number. Counting rows and queries, for the number of tiles and blocks, runs a job.
    """
    vectors = df.select(
        F.col(key).cast("long").alias("id"), integer_vector(F.col(vector)).alias("cells"), is_query.alias("is_query")
    ).where("id is not null and cells is not null").withColumn("dim", F.size("cells"))
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    tiles, blocks = max(1, ceil(n / tile)), max(1, ceil(n_queries / block))
    rows = _packed(vectors.drop("is_query"), tiles)
    queries = _packed(vectors.where("is_query").drop("is_query"), blocks)
    # The grid: a tile meets every block and a block every tile, each pair by its own key.
    left = rows.withColumnRenamed("no", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = queries.select(
        "dim", F.col("no").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")).alias("part"),
        F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("largest").alias("q_largest"),
    )
    grid = left.join(right, ["dim", "part", "block"])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch.itertuples(index=False):
                ids, q_ids = np.frombuffer(cell.ids, np.int64), np.frombuffer(cell.q_ids, np.int64)
                m = np.frombuffer(cell.cells, np.int64).reshape(-1, cell.dim)
                q = np.frombuffer(cell.q_cells, np.int64).reshape(-1, cell.dim)
                found = []
                for i in range(0, len(q), 256):
                    scores = _product(q[i : i + 256], m, cell.dim * cell.largest * cell.q_largest)
                    scores[q_ids[i : i + 256, None] == ids[None, :]] = NONE
                    found.append(_best(scores, ids, k))
                best_ids, best = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame(
                    {"dim": [cell.dim], "block": [cell.block], "part": [cell.part], "queries": [cell.q_ids],
                     "ids": [best_ids.tobytes()], "scores": [best.tobytes()]}
                )

    def merge(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in group["ids"]], axis=1)
        scores = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in group["scores"]], axis=1)
        # Columns by rising id, so that ties keep going to the smaller one.
        order = np.argsort(ids, axis=1, kind="stable")
        best_ids, best = _best(np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1), k)
        return pd.DataFrame(
            {"dim": [keys[0]], "block": [keys[1]], "part": [keys[2]], "queries": [group["queries"].iloc[0]],
             "ids": [best_ids.tobytes()], "scores": [best.tobytes()]}
        )

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch.itertuples(index=False):
                q = np.frombuffer(cell.queries, np.int64)
                scores = np.frombuffer(cell.scores, np.int64)
                out = pd.DataFrame(
                    {"query_id": np.repeat(q, k), "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(q)),
                     key: np.frombuffer(cell.ids, np.int64), "score": scores}
                )
                yield out[scores != NONE]

    lists = grid.mapInPandas(multiply, LISTS)
    while tiles > 1:
        tiles = ceil(tiles / FAN_IN)
        lists = lists.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("dim", "block", "part").applyInPandas(merge, LISTS)
    return lists.mapInPandas(unpack, f"query_id long, rank int, {key} long, score long")
