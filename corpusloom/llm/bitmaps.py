"""Filters of a fixed size that tasks hold: they only save work, since what they let through is checked again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import raw_values

BITS = 1 << 24
# Hashes are told apart by 16 + 24 bits here: a block, and what is packed in three bytes.
TAIL = 24
ROOM = 1 << 22  # hashes a task holds before it packs them


def bitmap(df: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """A bit per value of the upper bits of a 64-bit hash: set if a row has it. Built on the cluster; the driver gets `bits`
    bits, packed, whatever the size of the table. Runs one job."""
    place = F.shiftrightunsigned(hashed, 64 - (bits.bit_length() - 1)) + 1
    parts = df.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marks")).collect():
        found = np.frombuffer(row["marks"], np.uint8)
        begin = (row["bucket"] - 1) * len(found)
        out[begin : begin + len(found)] = found[: max(0, len(out) - begin)]
    return out


def may_hold(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    place = (hashes.view(np.uint64) >> np.uint64(64 - (len(packed).bit_length() + 2))).astype(np.int64)
    return (packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _packed(held: list[np.ndarray]) -> pa.RecordBatch:
    """(block, tails) of hashes cut to 40 bits; one that comes several times is packed twice."""
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    keys = np.repeat(keys, np.minimum(n, 2))
    block = (keys >> np.uint64(TAIL)).astype(np.int32)
    begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    data = np.ascontiguousarray(keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    offsets = (3 * np.r_[begins, len(keys)]).astype(np.int32)
    tails = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(block[begins]), tails], ["block", "tails"])


def repeated(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, room: int = ROOM) -> np.ndarray:
    """A bitmap, by their upper bits, of the hashes that the batches of `df` give more than once.

    They are compared by their upper 40 bits, so that a few others may be marked too, but none is left out. A hash costs
    three bytes of shuffle: they are sorted, packed by their upper 16 bits, and meet in one stream per range of blocks, which
    holds the different hashes of one block, 2^24 at most. Runs one job.
    """
    cut, cell = np.uint64(64 - 16 - TAIL), np.uint64(64 - (bits.bit_length() - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for found in hashes_of(batch):
                held.append(found.view(np.uint64) >> cut)
                size += len(found)
                if size >= room:
                    yield _packed(held)
                    held, size = [], 0
        if size:
            yield _packed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.zeros(0, np.uint64)  # the hashes of a block that may go on
        for batch in batches:
            data, ends = raw_values(batch.column("tails"))
            tails = np.zeros((len(data) // 3, 4), np.uint8)
            tails[:, :3] = data.reshape(-1, 3)
            block = np.repeat(batch.column("block").to_numpy().astype(np.uint64), np.diff(ends, prepend=0) // 3)
            keys = np.sort((block << np.uint64(TAIL)) | tails.view("<u4").ravel().astype(np.uint64))
            # Two sorted runs: a stable sort merges them.
            keys = np.sort(np.r_[open_, keys], kind="stable")
            new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
            cells = np.unique((keys[~new] << cut) >> cell) << cell
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64))], ["cell"])
            keys = keys[new]
            open_ = keys[np.searchsorted(keys, keys[-1] >> np.uint64(TAIL) << np.uint64(TAIL)) :] if len(keys) else keys

    packed = df.mapInArrow(pack, "block int, tails binary")
    # Neighbouring blocks share a cell block of the bitmap.
    met = packed.repartition(F.shiftright("block", 4)).sortWithinPartitions("block")
    return bitmap(met.mapInArrow(merge, "cell long"), F.col("cell"), bits)
