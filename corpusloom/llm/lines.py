"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.llm.rows import place, same, told_apart

WINDOW = 3


def window_hashes(text: str, size: int = WINDOW) -> list[tuple[int, int, int]]:
    """(line number, two 64-bit halves of a hash) of every window of `size` lines that holds a non-blank line, only the
    first of equal windows being followed by a 1 in the lowest bit of the line number's double."""
    lines = text.split("\n")
    seen, out = set(), []
    for i in range(len(lines) - size + 1):
        window = "\n".join(lines[i : i + size])
        if not window.strip():
            continue
        digest = xxhash.xxh3_128_digest(window.encode("utf-8", "surrogatepass"))
        out.append((2 * i + (digest not in seen), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
        seen.add(digest)
    return out


def later_windows(inputs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, part, starts) of texts (key, part, text): line numbers at which a window begins that also begins earlier: at a smaller key, or higher up in
    the same text. Texts without such a window have no row.

    Windows are counted by hash with combination before the shuffle; what meets its group again is joined on the
    hash, so that a window in a third of all texts is a join key whose rows the planner may split.
    """

    def start():
        def work(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
            found = [window_hashes(t, size) if t is not None else [] for t in batch["text"]]
            cells = np.array([row for rows in found for row in rows], dtype=np.int64).reshape(-1, 3)
            yield np.repeat(np.arange(len(found)), [len(rows) for rows in found]), pd.DataFrame(cells, columns=["place", "h1", "h2"])

        return work

    windows = map_rows(inputs, ["key", "part"], start, "place long, h1 long, h2 long")
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place("key", "part")).alias("first")).where("n > 1")
    met = windows.join(repeated.drop("n"), ["h1", "h2"])
    # In the first text only the first place of a window is kept; everywhere else, all of them are later ones.
    later = met.where(~(same("key", "part", "first.key", "first.part") & (F.col("place") % 2 == 1)))
    return later.groupBy("key", "part").agg(F.collect_set(F.shiftright("place", 1)).alias("starts"))


def keep_lines(text: str, starts, size: int = WINDOW) -> tuple[str, int]:
    """The text without the lines that the windows at `starts` cover, and how many these are."""
    lines = text.split("\n")
    covered = np.zeros(len(lines) + size, dtype=bool)
    for s in starts:
        covered[s : s + size] = True
    kept = [line for line, gone in zip(lines, covered) if not gone]
    return "\n".join(kept), len(lines) - len(kept)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """`df` with later occurrences of `size` consecutive lines removed from the texts, and `lines_removed`.

    Lines end at \\n. A window is later if the same lines begin earlier: at a smaller key, or higher up in the same
    text; all windows are judged on the input, and the positions they cover are merged. Windows of blank lines only are
    ignored, and texts of fewer lines than a window stay as they are. A text that loses all lines becomes ''. A null
    text stays null with 0 lines removed; rows without a key count as later than all others. A repeated row is the
    same document again: all its copies get the same result. Other texts under the same key, or without one, are documents
    of their own, in the order of a digest. Equal windows are told by 128-bit hashes. Other columns pass through; one called lines_removed is
    replaced. Building the result writes the keys of several rows.
    """
    rest = told_apart(df.drop("lines_removed"), key, text, "__mine")
    inputs = rest.select(F.col(key).alias("key"), F.col("__mine").alias("part"), F.col(text).alias("text"))
    starts = later_windows(inputs, size).select(
        F.col("key").alias("__key"), F.col("part").alias("__part"), F.col("starts").alias("__starts")
    )
    joined = rest.join(starts, same(key, "__mine", "__key", "__part"), "left").drop("__key", "__part", "__mine")

    @F.pandas_udf("text string, removed int")
    def applied(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [
            (t, 0) if t is None or s is None or len(s) == 0 else keep_lines(t, s, size) for t, s in zip(texts, found)
        ]
        return pd.DataFrame(rows, columns=["text", "removed"]).astype({"removed": "int32"})

    # Not deterministic to the planner, or a filter on the result would be pushed below and run the function twice.
    applied = applied.asNondeterministic()
    done = joined.withColumn("__done", applied(F.col(text), F.col("__starts")))
    return done.withColumn(text, F.col("__done")["text"]).withColumn("lines_removed", F.col("__done")["removed"]).drop(
        "__done", "__starts"
    )
