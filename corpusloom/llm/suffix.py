"""Exact removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of `length` bytes around it begins earlier in the corpus too. Every such string holds an
anchor: its smallest hash of `GRAM` bytes, chosen alike wherever the string stands; the strings with the same anchor
make a run of starts, whose text is the anchor's context. Strings can be equal only if their anchors are, so:

1. anchors whose hash occurs once drop out (counts, combined before the shuffle, and a bitmap of the repeated ones);
2. of equal contexts the first is kept, all starts of the others have an earlier match;
3. the different contexts of an anchor are compared by suffix order: their starts are sorted as suffixes, and the
   previous and the next smaller position in that order give the longest previous factor;
4. an anchor with very many different contexts is dealt out by the strings themselves, whose first place is an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import chunks, cut, raw_values
from corpusloom.llm.bitmaps import may_hold, repeated
from corpusloom.llm.bpe import _powers
from corpusloom.llm.rows import place, same, told_apart
from corpusloom.operators.skew import join_hot
from corpusloom.session import drop_table, materialise

LENGTH = 100
GRAM = 24
# Different contexts of one anchor up to which one task compares them.
CONTEXTS = 20_000
# Bits for the number of starts of a run; a run has fewer starts than a string has bytes.
SPAN_BITS = 12
# The bitmap of repeated anchors, and by how much their hashes are shifted for it.
MARK_BITS = 1 << 27
LOWER = 24
# Bytes of texts, or of contexts, handled at a time; a longer text is handled alone.
BATCH = 1 << 20

_MIX = np.random.default_rng(11).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _sums(data: np.ndarray, mix: np.ndarray) -> np.ndarray:
    up, _ = _powers(max(20, len(data).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix[data] * up[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches start:end, the same wherever they stand."""
    _, down = _powers(max(20, (len(sums) - 1).bit_length()))
    return _scatter((sums[end] - sums[start]) * down[start])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The anchors of texts that stand in a row in `data` and end at `ends`.

    For each: the text, the first and the last start (within the text) of the strings it belongs to, the hash of the
    anchor, the hash of its context, and whether this is the context's first place in the text.
    """
    begins = np.r_[0, ends[:-1]]
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "low", "high", "h", "context", "first")}
    sums = _sums(data, _MIX[0])
    n = len(data) - gram + 1
    places = np.arange(n, dtype=np.uint64)
    hashes = _hash(sums, np.arange(n), np.arange(gram, n + gram))
    bits = np.uint64(max(1, n.bit_length()))
    # Hash above, place below: the least is the smallest hash, the leftmost of equal ones.
    chosen = _sliding_min((hashes >> bits << bits) | places, length - gram + 1)
    at = (chosen & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(ends)), ends - begins)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + length <= ends[owner])
    at, owner = at[starts], owner[starts]
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else np.zeros(0, np.int64)
    low, high = starts[cut], starts[np.r_[cut[1:], len(at)] - 1] if len(at) else starts[cut]
    text, h = owner[cut], hashes[at[cut]].view(np.int64)
    context = _hash(_sums(data, _MIX[1]), low, high + length).view(np.int64)
    order = np.lexsort((low, context, h, text))
    first = np.ones(len(order), bool)
    first[order[1:]] = (
        (text[order[1:]] != text[order[:-1]]) | (h[order[1:]] != h[order[:-1]]) | (context[order[1:]] != context[order[:-1]])
    )
    return {
        "text": text, "low": low - begins[text], "high": high - begins[text], "h": h, "context": context, "first": first,
    }


def previous_smaller(order: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 without one."""
    before = np.arange(-1, len(order) - 1)
    open_ = np.flatnonzero((before >= 0) & (order[before] > order))
    while len(open_):
        before[open_] = before[before[open_]]
        open_ = open_[(before[open_] >= 0) & (order[before[open_]] > order[open_])]
    return before


def ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length` bytes from each start on, in suffix order, equal for equal ones; by doubling or tripling the
    known length. `length` bytes must follow every start."""
    padded = np.r_[data, np.zeros(length + 8, np.uint8)]
    word = np.zeros(len(data) + length, np.uint64)
    for i in range(8):
        word |= padded[i : i + len(word)].astype(np.uint64) << np.uint64(56 - 8 * i)
    rank, known = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while known < length:
        top = int(rank.max()) + 1
        parts = 3 if top**3 < 1 << 63 and 2 * known < length else 2
        # The last part may overlap the one before.
        steps = [known * i for i in range(parts - 1)] + [min(known * (parts - 1), length - known)]
        places = np.arange(len(rank) - steps[-1]) if steps[-1] + known < length else starts
        key = rank[places]
        for step in steps[1:]:
            key = key * top + rank[places + step]
        rank, known = np.unique(key, return_inverse=True)[1].astype(np.int64), steps[-1] + known
    return rank if len(rank) == len(starts) else rank[starts]


def has_previous_factor(data: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor at each of `starts` reaches `length`; `order` tells which start is earlier.

    The starts are sorted as suffixes of `length` bytes, equal ones by order. The nearest neighbours with a smaller
    order on either side share the longest prefixes of all earlier suffixes.
    """
    rank = ranks(data, starts, length)
    suffixes = np.lexsort((order, rank))
    place = np.empty(len(order), np.int64)
    place[np.argsort(order, kind="stable")] = np.arange(len(order))
    sorted_rank, sorted_place = rank[suffixes], place[suffixes]
    found = np.zeros(len(starts), bool)
    previous = previous_smaller(sorted_place)
    following = len(suffixes) - 1 - previous_smaller(sorted_place[::-1])[::-1]
    for near, there in ((previous, previous >= 0), (following, following < len(suffixes))):
        near = np.where(there, near, 0)
        found[suffixes] |= there & (sorted_rank[near] == sorted_rank)
    return found


# --- jobs ---


def _packed(low: np.ndarray, high: np.ndarray, later: np.ndarray | int = 0) -> np.ndarray:
    """A run of starts as one number: its first start, how many follow, and whether its context stands earlier in the text."""
    return (low << (SPAN_BITS + 1)) | ((high - low) << 1) | later


def _unpacked(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = runs >> (SPAN_BITS + 1)
    return low, low + ((runs >> 1) & ((1 << SPAN_BITS) - 1))


def occurrences(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, marks: np.ndarray | None = None) -> DataFrame:
    """(k1, k2, key, part, run) of every anchor of (key, part, text): k1 its hash, k2 its context's; with `marks` only those
    whose k1 the bitmap of its lower bits may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = raw_values(batch.column("text"))
            for a, b in chunks(ends, BATCH):
                found = anchors(*cut(data, ends, a, b), length, gram)
                kept = np.flatnonzero(may_hold(marks, found["h"] << LOWER)) if marks is not None else np.arange(len(found["h"]))
                owner = pa.array(a + found["text"][kept])
                runs = _packed(found["low"][kept], found["high"][kept], 1 - found["first"][kept].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["h"][kept]), pa.array(found["context"][kept]), batch.column("key").take(owner),
                     batch.column("part").take(owner), pa.array(runs)], ["k1", "k2", "key", "part", "run"],
                )

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "part", "text").mapInArrow(run, f"k1 long, k2 long, key {kind}, part long, run long")


def repeated_anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """A bitmap of the anchors that occur twice or more: it leaves them, and a few others that do no harm, before any shuffle.
    It goes by the lower bits: an anchor is a smallest hash, so its upper bits are mostly 0."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, ends = raw_values(batch.column("text"))
        for a, b in chunks(ends, BATCH):
            yield anchors(*cut(data, ends, a, b), length, gram)["h"] << LOWER

    return repeated(texts.select("text"), hashes, MARK_BITS)


def _first_places(rows: DataFrame) -> DataFrame:
    """(k1, k2, first_key, first_part): the text with the smallest key, and of one key's the smallest number, in which each
    pair stands."""
    firsts = rows.groupBy("k1", "k2").agg(F.min(place("key", "part")).alias("first"))
    return firsts.select("k1", "k2", F.col("first.key").alias("first_key"), F.col("first.part").alias("first_part"))


def _is_first():
    return (F.col("run") % 2 == 0) & same("key", "part", "first_key", "first_part")


def _contexts(texts: DataFrame, wanted: DataFrame, length: int, apart: bool) -> DataFrame:
    """The wanted contexts (k1, key, part, low, high) with their bytes, or (apart) a row of `occurrences` per string in them."""
    kind = texts.schema["key"].dataType.simpleString()
    # Copies of a repeated row want the same contexts.
    listed = wanted.groupBy(F.col("key").alias("__key"), F.col("part").alias("__part")).agg(F.collect_set(F.struct("k1", "run")).alias("parts"))
    listed = listed.select("__key", "__part", F.col("parts.k1").alias("k1s"), F.col("parts.run").alias("runs"))
    joined = texts.join(listed, same("key", "part", "__key", "__part")).select("key", "part", "text", "k1s", "runs")

    def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        data, ends = raw_values(batch.column("text"))
        begins = np.r_[0, ends]
        for i, (k1s, runs) in enumerate(zip(batch.column("k1s"), batch.column("runs"))):
            yield i, data[begins[i] : ends[i]], k1s.values.to_numpy(), runs.values.to_numpy()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch, rows):
            owner = pa.array(np.concatenate([np.full(len(r[1]), r[0]) for r in rows]))
            k1, low, high = (pa.array(np.concatenate([r[j] for r in rows])) for j in (1, 2, 3))
            found = pa.array([x for r in rows for x in r[4]], pa.binary())
            columns = [k1, batch.column("key").take(owner), batch.column("part").take(owner), low, high, found]
            return pa.RecordBatch.from_arrays(columns, ["k1", "key", "part", "low", "high", "bytes"])

        for batch in batches:
            rows, size = [], 0
            for i, data, k1s, runs in texts_of(batch):
                low, high = _unpacked(runs)
                raw = data.tobytes()
                parts = [raw[x:y] for x, y in zip(low.tolist(), (high + length).tolist())]
                rows.append((i, k1s, low, high, parts))
                size += sum(map(len, parts))
                if size > 4 * BATCH:
                    yield made(batch, rows)
                    rows, size = [], 0
            if rows:
                yield made(batch, rows)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, _, runs in texts_of(batch):
                at = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(*_unpacked(runs))]))
                k1, k2 = (_hash(_sums(data, mix), at, at + length).view(np.int64) for mix in _MIX)
                order = np.lexsort((at, k2, k1))
                later = np.zeros(len(at), np.int64)
                later[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
                owner = pa.array(np.full(len(at), i))
                columns = [pa.array(k1), pa.array(k2), batch.column("key").take(owner), batch.column("part").take(owner), pa.array(_packed(at, at, later))]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "key", "part", "run"])

    if apart:
        return joined.mapInArrow(strings, f"k1 long, k2 long, key {kind}, part long, run long")
    return joined.mapInArrow(contexts, f"k1 long, key {kind}, part long, low long, high long, bytes binary")


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """(key, part, run): runs of starts with a previous factor among the contexts of the same anchor."""
    kind = contexts.schema["key"].dataType.simpleString()

    def solve(rows: pa.Table) -> pa.RecordBatch:
        # Earlier contexts come first: smaller key, or further up in the same text; a null key comes last.
        data, ends = raw_values(rows.column("bytes").combine_chunks())
        begins = np.r_[0, ends[:-1]]
        low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
        counts = high - low + 1
        owner = np.repeat(np.arange(len(low)), counts)
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        start = low[owner] + within
        found = has_previous_factor(data, begins[owner] + within, np.arange(len(owner)), length)
        owner, start = owner[found], start[found]
        cuts = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)] if len(owner) else np.zeros(0, bool)
        at = np.flatnonzero(cuts)
        last = np.r_[at[1:], len(owner)] - 1 if len(at) else at
        chosen = pa.array(owner[at])
        columns = [rows.column(c).combine_chunks().take(chosen) for c in ("key", "part")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(_packed(start[at], start[last]))], ["key", "part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not len(rows):
                continue
            # The copies of a repeated row cut the same contexts; a second one would count as later than the first.
            key = rows.column("key").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            named = np.c_[key, *[rows.column(c).to_numpy() for c in ("k1", "part", "low")]]
            rows = rows.filter(pa.array(np.r_[True, (named[1:] != named[:-1]).any(axis=1)]))
            # Whole anchors are solved together up to a batch of bytes; the last one may go on in the next rows.
            k1 = rows.column("k1").to_numpy()
            begins = np.flatnonzero(np.r_[True, k1[1:] != k1[:-1]])
            upto = np.r_[0, raw_values(rows.column("bytes").combine_chunks())[1]]
            i = 0
            while i < len(begins) - 1:
                j = max(i + 1, int(np.searchsorted(upto[begins], upto[begins[i]] + BATCH, "right")) - 1)
                yield solve(rows.slice(begins[i], begins[j] - begins[i]))
                i = j
            rest = rows.slice(begins[-1])
        if rest is not None and len(rest):
            yield solve(rest)

    together = contexts.repartition("k1").sortWithinPartitions("k1", F.col("key").asc_nulls_last(), "part", "low")
    return together.mapInArrow(run, f"key {kind}, part long, run long")


def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS) -> DataFrame:
    """(key, part, run): runs of starts, both ends included, of strings of `length` bytes that begin earlier as well, in
    texts (key, part, text) told apart by `part`."""
    places = materialise(occurrences(texts, length, gram, repeated_anchors(texts, length, gram)), "anchors")
    firsts = materialise(_first_places(places), "first_contexts")
    marked = join_hot(places, firsts, ["k1", "k2"], ["key", "run"]).withColumn("first", _is_first())
    # A copy is known by its run alone.
    marked = materialise(marked.select(F.when(F.col("first"), F.col("k1")).alias("k1"), "key", "part", "run", "first"), "places")
    copies = marked.where("not first").select("key", "part", "run")
    several = materialise(firsts.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    drop_table(places)
    drop_table(firsts)
    # Of each context the first place; only anchors with several contexts are left to compare.
    open_ = materialise(join_hot(marked.where("first").drop("first"), several, ["k1"], ["key", "run"]), "open")
    few, many = open_.where(F.col("n") <= contexts).drop("n"), open_.where(F.col("n") > contexts).drop("n")
    compared = _compared(_contexts(texts, few, length, apart=False), length)
    strings = _contexts(texts, many, length, apart=True)
    dealt = strings.join(_first_places(strings), ["k1", "k2"]).where(~_is_first()).select("key", "part", "run")
    return copies.unionAll(compared).unionAll(dealt)


def without(raw: bytes, runs: np.ndarray, length: int) -> tuple[bytes, int]:
    """The bytes that no string starting in `runs` covers, and the number of maximal removed stretches."""
    edges = np.zeros(len(raw) + 1, np.int64)
    low, high = _unpacked(np.asarray(runs))
    np.add.at(edges, low, 1)
    np.add.at(edges, np.minimum(len(raw), high + length), -1)
    gone = np.cumsum(edges[:-1]) > 0
    data = np.frombuffer(raw, np.uint8)
    spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
    return data[~gone].tobytes(), spans


def dedup_passages(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS, others: list[str] = (), as_text: bool = False) -> DataFrame:
    """(key, n_bytes, kept, n_spans, others) of every row: the length of the text in UTF-8, the bytes that are left, how
    many maximal stretches were removed, and the other columns that are asked for.

    A byte is removed if a string of `length` bytes that covers it also starts earlier: at a smaller key, or further up
    in the same text. Strings are judged on the input, may overlap, and never cross texts. A null text counts as '';
    texts shorter than `length` stay whole. A row without a key counts as later than all others. A repeated row is the
    same text again: its copies have the same places and get the same result. Other texts under the same key, or without
    one, are texts of their own, in the order of a digest. Columns not asked for are not read. What
    is left may begin or end within a character: `kept` is binary, or with `as_text` a string without characters of which
    a part is missing. An empty table gives an empty result. Building the result writes the
    keys of several rows and the anchors that occur more than once.
    """
    if not 8 <= gram <= length < 1 << SPAN_BITS:
        raise ValueError("an anchor has at least 8 bytes and at most a string's, which are fewer than 4096")
    passed = [F.struct(*others).alias("__others")] if others else []
    texts = told_apart(df.select(F.col(key).alias("key"), F.col(text).alias("text"), *passed), "key", "text", "part")
    runs = repeated_starts(texts.select("key", "part", F.col("text").cast("binary").alias("text")), length, gram, contexts)
    listed = runs.groupBy(F.col("key").alias("__key"), F.col("part").alias("__part")).agg(F.collect_list("run").alias("__runs"))
    joined = texts.join(listed, same("key", "part", "__key", "__part"), "left")

    @F.pandas_udf(f"n_bytes long, kept {'string' if as_text else 'binary'}, n_spans long")
    def applied(rows: pd.Series, found: pd.Series) -> pd.DataFrame:
        sizes, kept, spans = [], [], []
        for text, run in zip(rows, found):
            raw = (text or "").encode("utf-8", "surrogatepass")
            rest, n = (raw, 0) if run is None else without(raw, run, length)
            sizes.append(len(raw))
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            spans.append(n)
        return pd.DataFrame({"n_bytes": sizes, "kept": kept, "n_spans": spans}).astype({"n_bytes": "int64", "n_spans": "int64"})

    # Not deterministic to the planner, or a filter on the result would be pushed below and run the function twice.
    applied = applied.asNondeterministic()
    done = joined.withColumn("__done", applied("text", "__runs"))
    return done.select(
        F.col("key").alias(key), "__done.n_bytes", "__done.kept", "__done.n_spans",
        *[F.col("__others")[c].alias(c) for c in others],
    )
