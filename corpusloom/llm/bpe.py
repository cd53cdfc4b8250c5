"""Byte-level BPE: encoding and decoding, with tree concatenation of long unsplit text.

Whole batches are cut into words by array operations over code points; each different word is encoded once. A word
longer than a leaf cannot be split by the pattern: its leaves are encoded in parallel and joined pairwise, and around
each join a growing window is encoded again until its first token is the left side's and its last token the right
side's.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.arrow import map_rows, remembered

LEAF = 512
THREADS = 2
# Code points handled at a time (a longer text is a batch of its own), and different words remembered by a task.
BATCH_CHARS = 1 << 19
CACHE_WORDS = 100_000

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
# White space of the split pattern, and the endings split off after an apostrophe.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@remembered
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


@remembered
def _mixed() -> np.ndarray:
    """A random 64-bit number per code point."""
    return np.random.default_rng(7).integers(0, 1 << 64, 0x110000, dtype=np.uint64)


@remembered
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    return tuple(
        np.multiply.accumulate(np.r_[np.uint64(1), np.full((1 << bits) - 1, b, np.uint64)])
        for b in (base, pow(base, -1, 1 << 64))
    )


def byte_of_char() -> dict[str, int]:
    """The vocabulary's spelling of bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def expand(offsets: np.ndarray, data: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `data[offsets[i]:offsets[i+1]]` of the chosen i in a row, and where each one ends."""
    sizes = offsets[chosen + 1] - offsets[chosen]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(offsets[chosen] - (ends - sizes), sizes) + np.arange(total)], ends


def _runs(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) for x in items], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(items), np.uint8)


def word_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the words of the split pattern begin; `edges` are places between texts, each a word of its own."""
    kind = _classes()[points]
    kind[edges] = EDGE
    white = kind == SPACE
    start = np.ones(len(points), bool)
    start[1:] = (kind[1:] != kind[:-1]) & (white[1:] | (points[:-1] != 32) | (kind[:-1] == EDGE))
    # The last white character before a word is one of its own, or the word's if it is a space.
    start[:-1] |= white[:-1] & ~white[1:] & (kind[1:] != EDGE)
    start[edges] = True
    n = len(points)
    for i in np.flatnonzero(start & (points == 39) & (kind == OTHER)):
        after = "".join(map(chr, points[i + 1 : i + 3]))
        for ending in ENDINGS:
            if after.startswith(ending):
                start[i + 1] = False
                if i + 1 + len(ending) < n:
                    start[i + 1 + len(ending)] = True
                break
    return np.flatnonzero(start)


class Encoder:
    """A tokenizer file of byte-level BPE, as the tokenizers library applies it without special tokens added. With `plain`
    special tokens written out in a text are ordinary text."""

    def __init__(self, path: str, leaf: int = LEAF, plain: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf = leaf
        # Ids as the bytes of 32-bit numbers, which take less room than lists and join fast.
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {} if plain else special
        spelled = self.library.get_vocab(with_added_tokens=False)
        to_byte = byte_of_char()
        size = max([*spelled.values(), *special.values()]) + 1
        pieces = [b""] * size
        for token, i in spelled.items():
            pieces[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in special.items():
            pieces[i] = token.encode()
        self.bytes_of = _runs(pieces)
        self.digits_of = _runs([b"%d," % i for i in range(size)])
        self.n_bytes = np.diff(self.bytes_of[0])
        self.words_at_once = self._ranked(spelled, spec["model"]["merges"], pieces)

    # --- single words ---

    def _ranked(self, spelled: dict[str, int], merges: list, pieces: list[bytes]):
        """The same merges as a table of ranks, which encodes single words several times faster; None for a file whose
        ids do not follow its merges."""
        made = [spelled["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(b <= a for a, b in zip(made, made[1:])) or any(x not in spelled for x in byte_of_char()):
            return None
        ranks = {pieces[i]: i for i in spelled.values()}
        return tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, words: list[str], threads: int = 1) -> list[list[int]]:
        if self.words_at_once is None:
            return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        if threads > 1:
            return self.words_at_once.encode_ordinary_batch(words, num_threads=threads)
        return list(map(self.words_at_once.encode_ordinary, words))

    def _tree(self, word: str) -> list[int]:
        """The encoding of a word the pattern does not split."""
        leaves = [word[i : i + self.leaf] for i in range(0, len(word), self.leaf)]
        nodes = list(zip(leaves, self._plain(leaves, THREADS)))
        while len(nodes) > 1:
            pairs = [(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            joined = self._join(pairs)
            nodes = joined + nodes[2 * len(pairs) :]
        return nodes[0][1]

    def _join(self, pairs) -> list[tuple[str, list[int]]]:
        done: list = [None] * len(pairs)
        width, open_ = 4, list(range(len(pairs)))
        while open_:
            windows = []
            for p in open_:
                (left, left_ids), (right, right_ids) = pairs[p]
                a, i = self._edge(left, left_ids, width)
                b, j = self._edge(right, right_ids, width, front=True)
                windows.append((i, j, left[a:] + right[:b]))
            still = []
            for p, (i, j, _), ids in zip(open_, windows, self._plain([w for _, _, w in windows], THREADS)):
                (left, left_ids), (right, right_ids) = pairs[p]
                if (i == 0 or ids[0] == left_ids[i]) and (j == len(right_ids) or ids[-1] == right_ids[j - 1]):
                    done[p] = (left + right, left_ids[:i] + ids + right_ids[j:])
                else:
                    still.append(p)
            open_, width = still, width * 4
        return done

    def _edge(self, text: str, ids: list[int], width: int, front: bool = False) -> tuple[int, int]:
        """(character, token) at which a window of about `width` tokens ends, between two characters: from the end of the
        text backwards, or from its front on."""
        if width >= len(ids):
            return (len(text), len(ids)) if front else (0, 0)
        part = ids[:width] if front else ids[-width:]
        raw = text.encode()
        at = int(self.n_bytes[part].sum())
        at = at if front else len(raw) - at
        token = width if front else len(ids) - width
        # A token may hold a part of a character: move on to the next token that begins with a whole one.
        step = 1 if front else -1
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += step * int(self.n_bytes[ids[token if front else token - 1]])
            token += step
        return len(raw[:at].decode()), token

    # --- texts ---

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ids of the given words."""
        known = self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            # Start anew, keeping what this batch needs.
            self.words = known = {w: known[w] for w in words if w in known}
        short = [w for w in new if len(w) <= self.leaf]
        known.update((w, np.array(ids, np.uint32).tobytes()) for w, ids in zip(short, self._plain(short)))
        known.update((w, np.array(self._tree(w), np.uint32).tobytes()) for w in new if len(w) > self.leaf)
        runs = [known[w] for w in words]
        offsets = np.zeros(len(runs) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)) // 4, out=offsets[1:])
        return offsets, np.frombuffer(b"".join(runs), np.uint32)

    def _segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments without special tokens, and where each segment's ids end."""
        joined = "\0".join(segments) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        edges = np.cumsum(sizes + 1) - 1
        starts = word_starts(points, edges)
        ends = np.r_[starts[1:], len(points)]
        up, down = _powers(max(20, int(len(points)).bit_length()))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed()[points] * up[: len(points)], out=sums[1:])
        _, first, which = np.unique((sums[ends] - sums[starts]) * down[starts], return_index=True, return_inverse=True)
        # Equal hashes are taken for equal words only after all their characters have been compared.
        like = starts[first][which]
        lengths = ends - starts
        same = np.array_equal(lengths, lengths[first][which]) and np.array_equal(
            points, points[np.repeat(like - starts, lengths) + np.arange(len(points))]
        )
        if same:
            words = [joined[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        else:
            words, which = [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist())], np.arange(len(starts))
        offsets, ids = self._known(words)
        # The places between texts are words of no token.
        offsets, which = np.r_[offsets, offsets[-1]], which.copy()
        between = np.searchsorted(starts, edges)
        which[between] = len(words)
        out, token_ends = expand(offsets, ids, which)
        return out, token_ends[between]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin and the last one's end)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not any(s in t for s in self.special for t in texts):
            ids, ends = self._segments(texts)
            return ids, np.r_[0, ends]
        runs = []
        for text in texts:
            parts = self._cut(text)
            plain = [p for p in parts if isinstance(p, str)]
            ids, ends = self._segments(plain)
            begins, k, run = np.r_[0, ends], 0, []
            for part in parts:
                if isinstance(part, str):
                    run.append(ids[begins[k] : begins[k + 1]])
                    k += 1
                else:
                    run.append(np.array([part], np.uint32))
            runs.append(np.concatenate(run))
        return np.concatenate(runs), np.r_[0, np.cumsum([len(r) for r in runs])]

    def _cut(self, text: str) -> list[str | int]:
        """Stretches between special tokens written out in the text, and these tokens' ids."""
        parts: list[str | int] = [text]
        for special, i in self.special.items():
            cut: list[str | int] = []
            for part in parts:
                pieces = part.split(special) if isinstance(part, str) else [part]
                cut.append(pieces[0])
                for piece in pieces[1:]:
                    cut += [i, piece]
            parts = cut
        return parts

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return expand(*self.bytes_of, np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


@remembered
def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """One per Python worker."""
    return Encoder(path, leaf)


def batches_of(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most `limit` characters, or of one longer text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def encode_column(text: Column | str, path: str) -> Column:
    """The ids of a text, array<int>; null as ''."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        out = []
        for a, b in batches_of(texts):
            ids, begins = encoder(path).encode(texts[a:b])
            out.extend(ids[begins[i] : begins[i + 1]].astype(np.int32) for i in range(b - a))
        return pd.Series(out, dtype="object")

    return run(text)


def decode_column(ids: Column | str, path: str) -> Column:
    """The text of ids; null for null. An id the vocabulary lacks is an error."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else encoder(path).decode(x))

    return run(ids)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: the number of ids, and the hashes of the ids as decimals
    joined by commas and of the text that these ids decode to.

    A null text counts as ''. Repeated rows give repeated results, null keys stay null, an empty table gives an empty
    result; other columns are not read. A very long text is a batch of its own; memory grows with the longest text.
    """

    def start():
        enc = encoder(path)

        def work(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
            texts = batch["text"].fillna("").tolist()
            for a, b in batches_of(texts):
                ids, begins = enc.encode(texts[a:b])
                digits, digit_ends = expand(*enc.digits_of, ids)
                raw, byte_ends = expand(*enc.bytes_of, ids)
                digit_ends, byte_ends = np.r_[0, digit_ends][begins], np.r_[0, byte_ends][begins]
                id_hashes, text_hashes = [], []
                for i in range(b - a):
                    listed = digits[digit_ends[i] : max(digit_ends[i], digit_ends[i + 1] - 1)]
                    id_hashes.append(hashlib.sha256(listed).hexdigest())
                    back = raw[byte_ends[i] : byte_ends[i + 1]].tobytes().decode("utf-8", "replace")
                    text_hashes.append(hashlib.sha256(back.encode()).hexdigest())
                out = {"n_tokens": np.diff(begins).astype(np.int64), "ids_sha256": id_hashes, "decoded_sha256": text_hashes}
                yield np.arange(a, b), pd.DataFrame(out)

        return work

    inputs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_rows(inputs, ["key"], start, "n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
