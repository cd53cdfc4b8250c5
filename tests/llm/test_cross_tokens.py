import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import cross_tokens as X

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIBRARY_A = Tokenizer.from_file(A)
LIBRARY_A.encode_special_tokens = True
LIBRARY_B = sentencepiece.SentencePieceProcessor(model_file=B)


def byte_level():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE = byte_level()


def spelled_b(i):
    piece = LIBRARY_B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()


def groups_of(text):
    """[(ids of a, ids of b)] by the libraries on the whole text; [] without tokens."""
    if not text:
        return []
    a, b = LIBRARY_A.encode(" " + text, add_special_tokens=False), LIBRARY_B.encode(text)
    parts = [bytes(BYTE[c] for c in t) for t in a.tokens], [spelled_b(i) for i in b]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return []
    ends = [[sum(map(len, p[: i + 1])) for i in range(len(p))] for p in parts]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((a.ids[i:i2], b[j:j2]))
        i, j = i2, j2
    return out


def listed(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(rows):
    found = [(k, groups_of(t)) for k, t in rows]
    counts, most = Counter(), defaultdict(int)
    for _, groups in found:
        counts.update((a[-1], b[-1]) for a, b in groups)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for k, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        out.append((
            k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(listed(groups).encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(4)
    words = ["the", "tokenizer", "naïve", "日本語", "<|endoftext|>", "<s>", "<0x41>", "don't", " ", "x" * 70, "  ", "\n", "🙂", "1234567", "\t"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "", "  "]) for _ in range(rnd.randint(1, 25))) for _ in range(60)]
    texts += [" ", "   ", " a", "a ", "▁", "a▁b", "", None, "\x00", "é", "ﬁ", "ab" * 3000, "é" * 700]
    return [(i, t) for i, t in enumerate(texts + texts[:20] * 3)] + [(3, texts[3]), (None, texts[4]), (None, "own"), (2**60 + 3, "own"), (2**53 + 1, "an own one")]


@pytest.mark.parametrize("known", [X.KNOWN, 20])
def test_against_the_libraries(spark, known):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, "d") for k, t in rows], "doc_id long, text string, weight int, digest string").repartition(5)
    found = X.alignment(df, A, B, known=known)
    assert sorted((tuple(r) for r in found.select("doc_id", *X.MEASURES, "n_best", "count_sum", "groups_sha256").collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert X.alignment(df.limit(0), A, B).collect() == []
    assert {r["n_a"] for r in X.alignment(df, A, B).collect()} == {0}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab eé́\n\t▁日🙂<0x41>  \x00'1"), min_size=1, max_size=30), min_size=1, max_size=6))
def test_stretches_like_whole_texts(texts):
    mine = X.aligner(A, B)
    assert mine.b.splits
    raw = [t.encode() for t in texts]
    assert mine.align(raw)["groups_sha256"] == [
        hashlib.sha256(listed(g).encode()).hexdigest() if g else "" for g in map(groups_of, texts)
    ]
