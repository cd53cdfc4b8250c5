"""Models and rules: hyperdimensional language profiles, the string-kernel machine, adaptive fences."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string"


def held_out(key="doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


# --- language -----------------------------------------------------------------------------------------------------


def test_a_text_is_the_sum_of_its_bound_sequences():
    texts = ["Ab, c", "", "12 !", None or "é", "ab ab ab"]
    got = langid.text_vectors(texts, 64)
    vec = lambda c: langid.letter_vector(ord(c), 64)

    def brute(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        line = " " + " ".join(words) + " " if words else ""
        counts = defaultdict(int)
        for i in range(len(line) - 2):
            counts[line[i : i + 3]] += 1
        total = np.zeros(64, np.float32)
        for g, n in counts.items():
            bound = np.roll(vec(g[0]), 2) * np.roll(vec(g[1]), 1) * vec(g[2])
            total += np.rint(16 * np.sqrt(n)) * bound
        return total

    for text, row in zip(texts, got):
        assert np.array_equal(row, brute(text)), text


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    profiles = langid.learn(docs, ~held_out(), texts=200)
    found = langid.predict(docs, profiles).join(docs.where(held_out()), "doc_id").select("lang", "lang_pred", "score").collect()
    assert len(found) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark):
    rows = [(1, "der die und", "de", "a"), (2, "the and of", "en", "a"), (3, None, "en", "a"), (4, "12 .", "xx", "a"), (5, "", None, None), (None, "und die der " * 20_000, None, "b"), (2, "the and of", "en", "a")]
    df = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    profiles = langid.learn(df, F.lit(True))
    got = sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 2)) for r in langid.predict(df, profiles).collect()), key=repr)
    assert [g[:2] for g in got] == [(1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (None, "de")]
    assert [g[2] for g in got if g[1] == "und"] == [0.0] * 3
    none = langid.learn(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), profiles).collect() == []


# --- toxicity -----------------------------------------------------------------------------------------------------


def brute_kernel(s, t, p=toxicity.ORDER, decay=toxicity.DECAY):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), p):
        for j in combinations(range(len(t)), p):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_counts_common_subsequences():
    rnd = random.Random(1)
    words = ["idiot", "idxiot", "i", "", "aaaa"] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(20)]
    pairs = [(a, b) for a in words for b in words]
    got = toxicity.kernel(toxicity.coded([a for a, _ in pairs]), toxicity.coded([b for _, b in pairs]))
    assert np.allclose(got, [brute_kernel(a, b) for a, b in pairs], rtol=1e-4)


def test_gaps_and_signs_keep_their_likeness():
    space = toxicity.Landmarks(["idiot", "stupid"])
    rows = toxicity.kernel_rows(["an i.d.i.o.t here", "i d i o t", "an idxiot", "the weather", ""], space)
    assert rows[0, 0] == pytest.approx(1) and rows[1, 0] == pytest.approx(1)
    assert 0.2 < rows[2, 0] < 1 and rows[3].max() < 0.05 and not rows[4].any()


def test_likeness_against_plain_python():
    marks = ["idiot", "achlich-", "scum", "pathetic"]
    words = ["idiot", "idxiot", "ixdxixoxt", "achlichung", "achlich", "scamus", "pathetically", "hepatitc", "idio", "the"]
    words += ["disinvitation" * 3, "ò" * 30 + "idiot"]

    def brute(word, mark):
        own = toxicity.BEGIN + (mark[:-1] if mark.endswith("-") else mark + toxicity.END)
        letters = set(own) - {toxicity.BEGIN, toxicity.END}
        if len(letters - set(word)) > len(letters) // 4:
            return 0.0
        at = [i for i, c in enumerate(word) if c in own]
        shared = "".join(word[i] for i in at)
        norm = (brute_kernel(shared, shared) * brute_kernel(own, own)) ** 0.5
        gaps = at[-1] - at[0] + 1 - len(at)
        return (brute_kernel(shared, own) / norm * toxicity.GAP**gaps) ** toxicity.POWER if norm else 0.0

    expected = [[max(brute(p, m) for p in toxicity.pieces(w)) for m in marks] for w in words]
    expected = [[v if v >= toxicity.FLOOR else 0 for v in row] for row in expected]
    assert np.allclose(toxicity.kernel_rows(words, toxicity.Landmarks(marks)), expected, atol=1e-4)


def test_words_of_many_texts_are_those_of_each():
    rnd = random.Random(4)
    parts = ["a", "b.", "é", "12", "-", "ab", "c", "The", "the,", "word", "i.d.i.o.t", "ß", "\n", "\u2003"]
    texts = ["", " ", "i d i o t", "ab c ab", "a 1 b - c"] + [" ".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(400)]
    words, number, text = toxicity.words_of(texts)
    got = [set() for _ in texts]
    for n, i in zip(number.tolist(), text.tolist()):
        got[i].add(words[n])
    assert got == [set(toxicity.tokens(t)) for t in texts] and len(set(words)) == len(words)
    assert toxicity.words_of([])[0] == [] and toxicity.words_of([""])[0] == []


def test_sentences_end_behind_words():
    rule = re.compile(r"(?<=\w\w)(?:[^\w\s]*\n+|[^\w\s]*[.!?][^\w\s]*\s+)")
    rnd = random.Random(7)
    texts = ["Ab cd. Ef (gh!) ij", "i. d. i. o. t", "ab\n\ncd?\" \n e", ""]
    texts += ["".join(rnd.choices('ab1_.!?,"\n\t  \u0085é-', k=rnd.randint(0, 14))) for _ in range(20_000)]
    found, begins = toxicity.sentences(texts)
    assert [found[i:j] for i, j in zip(begins, begins[1:])] == [rule.split(t) for t in texts]


def test_the_kernel_is_computed_only_for_pairs_that_may_reach_the_floor(monkeypatch):
    rnd = random.Random(6)
    space = toxicity.Landmarks(["pathetic", "stupid", "worthless", "lostra-", "chlla-", "idiot"])
    words = sorted({"".join(rnd.choices("aeioutsrlhpdwc", k=rnd.randint(3, 20))) for _ in range(2000)} | {"idxiot", "aaaaaa" * 4})
    points = toxicity.coded(["\x01" + w + "\x02" for w in words], toxicity.PIECE + 2)
    plain, near = [], 0
    for k, own in enumerate(space.points):
        own = own[own != 0]
        for row in points:
            row = row[row != 0]
            letters = set(own.tolist()) - {1, 2}
            if len(letters - set(row.tolist())) > len(letters) // 4:
                continue
            near += 1
            at = np.flatnonzero(np.isin(row, own))
            shared = row[at][None, :]
            value = toxicity.kernel(shared, own[None, :]) / (np.sqrt(toxicity.kernel(shared, shared)) * space.norms[k])
            value = (value * np.float32(toxicity.GAP) ** np.float32(at[-1] - at[0] + 1 - len(at))) ** toxicity.POWER
            plain.append(float(value[0]))
    counted = []
    real = toxicity.kernel
    monkeypatch.setattr(toxicity, "kernel", lambda s, t, *rest: counted.append(len(s)) or real(s, t, *rest))
    _, _, values = space.pairs(["\x01" + w + "\x02" for w in words])
    assert sorted(values.tolist()) == pytest.approx(sorted(v for v in plain if v >= toxicity.FLOOR), rel=1e-5)
    # Two kernels a pair; and few calls, each of which goes over all letters: none a landmark.
    assert sum(counted) < near and len(counted) <= 4


def test_least_errors():
    margins, y = np.array([0.0, 1.0, 2.0, 3.0, 3.0]), np.array([-1, 1, -1, 1, 1])
    assert toxicity.least_errors(margins, y) == 0.5 and toxicity.least_errors(margins, -np.ones(5)) == 4.0


def test_toxic_texts_are_found(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ba", "ne", "to", "li", "ku", "ra"]) for _ in range(rnd.randint(1, 3)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for insult in rnd.sample(["wretch", "vermin", "jackass"], 2):
                words.insert(rnd.randrange(60), insult)
        rows.append((i, " ".join(w + "." * (k % 8 == 7) for k, w in enumerate(words))))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks.where(~held_out()))
    assert {"wretch", "vermin", "jackass"} <= set(model.landmarks)
    got = toxicity.score(docs, model).join(marks.where(held_out()), "doc_id").collect()
    assert len(got) > 80 and all(r["predicted"] == r["toxic"] for r in got)
    more = [(1, "ba ne v.e.r.m.i.n to"), (2, "ba j a c k a s s"), (3, None), (4, ""), (None, "wretch " * 40_000), (1, "ba ne v.e.r.m.i.n to")]
    edge = spark.createDataFrame([(*r, "x") for r in more], "doc_id long, text string, score string")
    found = sorted(((r["doc_id"], r["predicted"]) for r in toxicity.score(edge, model).collect()), key=repr)
    assert found == [(1, 1), (1, 1), (2, 1), (3, 0), (4, 0), (None, 1)]
    assert toxicity.score(edge.limit(0), model).collect() == []
    hidden = ["verxmin", "vexrmxin", "vxexrxmxixn", "j - a - c - k - a - s - s", "j. a. c. k. a. s. s", "v\ne\nr\nm\ni\nn", "ja ck as s", "wreqtch"]
    disguised = spark.createDataFrame([(i, f"ba ne ku {w} tobali kura") for i, w in enumerate(hidden)], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.score(disguised, model).where("predicted = 0").collect()] == []
    blank = toxicity.train(docs, marks.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(docs, blank).collect()} == {0}


# --- quality ------------------------------------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + d for places in windows.values() if len(places) > 1 for i in places for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force():
    rnd = random.Random(5)
    texts = ["", " \n\t", "a a a a", "é # b\n\n# b\né # b", "x y  z", "a b c d a b c"]
    texts += ["".join(rnd.choice("ab #\n \x0b|é") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for text in texts:
        assert quality.text_counts(text)[:5] == brute_counts(text), repr(text)


def brute_kept(rows):
    """The whole rule in plain Python, from the counts."""
    counts = [quality.text_counts(t or "") for _, t, _, _ in rows]
    names = [s for s, _ in quality.SIGNALS]

    def signals(c):
        n, chars, symbols, dup, repeated, lines, upper, punct = c
        share = lambda a, b: a * 1000 // b if b else None
        return dict(zip(names, [share(chars, n), share(symbols, n), share(upper, chars), share(punct, chars), share(dup, lines), share(repeated, n)]))

    values = [signals(c) for c in counts]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]

    def quantiles(members, name, towards):
        own = sorted(v[name] for v in members if v[name])
        if not own:
            return towards
        q = []
        for share in (quality.LOW, 0.5, quality.HIGH):
            x = own[math.ceil(len(own) * share) - 1]
            q.append(2 * quality.GAMMA ** math.ceil(math.log(x) / math.log(quality.GAMMA)) / (quality.GAMMA + 1))
        n, c = len(own), quality.PRIOR_ROWS
        return [(n * x + c * y) / (n + c) for x, y in zip(q, towards or q)]

    def level(lang=None, source=None, depth=0):
        return [v for r, v, f in zip(rows, values, failed) if not f and (depth < 1 or r[2] == lang) and (depth < 2 or r[3] == source)]

    fences = {}

    def fits(lang, source, name, low_is_bad, v):
        if (lang, source, name) not in fences:
            q = None
            for depth in range(3):
                q = quantiles(level(lang, source, depth), name, q)
            fences[lang, source, name] = q
        q = fences[lang, source, name]
        if q is None or v is None:
            return True
        high = (q[2] + quality.SPREADS * (q[2] - q[1])) * 1.01 + 1
        low = (q[0] - quality.SPREADS * (q[1] - q[0])) * 0.99 - 1 if low_is_bad else -1
        return low <= v <= high

    return [
        not f and all(fits(r[2], r[3], name, low, v[name]) for name, low in quality.SIGNALS) for r, f, v in zip(rows, failed, values)
    ]


def test_fences_against_plain_python(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(900):
        lang, source = rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["s1", "s1", "s2", None])
        words = ["w" * rnd.randint(2, 8 if lang == "en" else 14) + str(rnd.randrange(500)) for _ in range(rnd.randint(20, 120))]
        kind = rnd.random()
        if kind < 0.05:
            words = [w + "#%$" for w in words]
        elif kind < 0.1:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.13:
            words = [w + "w" * 40 for w in words]
        rows.append((i, " ".join(words), lang, source))
    rows += [(900, None, "en", "s1"), (901, "", None, None), (902, "x " * 60_000, "en", "s1"), (None, rows[0][1], "en", "s2"), rows[3]]
    df = spark.createDataFrame(rows, DOC).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    got = sorted(((r["doc_id"], r["kept"]) for r in quality.judge(df).collect()), key=repr)
    assert got == sorted(((r[0], k) for r, k in zip(rows, brute_kept(rows))), key=repr)
    assert quality.judge(df.limit(0)).collect() == []
    # The spread decides: the same junk passes where words differ as much, and a fence is never a plain constant.
    assert 0.5 < sum(k for _, k in got) / len(got) < 0.97


def test_fences_follow_the_spread_of_their_group(spark):
    rnd = random.Random(9)

    def text(a, b):
        return " ".join("w" * rnd.randint(a, b) + str(rnd.randrange(9)) + chr(97 + j % 26) for j in range(80))

    rows = [(i, text(3, 6), "en", "narrow") for i in range(600)]
    rows += [(1000 + i, text(*rnd.choice([(2, 4), (4, 9), (9, 14)])), "en", "broad") for i in range(600)]
    rows += [(5000, text(10, 13), "en", "narrow"), (5001, text(10, 13), "en", "broad")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert not kept.pop(5000) and kept.pop(5001) and all(kept.values())


def test_sketches_merge(spark):
    rows = [(i, " ".join(["word"] * 3 + [f"w{i}x{j}" for j in range(i % 70)]), "en", "s") for i in range(400)]
    counted = quality.counts(spark.createDataFrame(rows, DOC), ["doc_id", "lang"])
    whole = quality.sketch(counted, ["lang"])
    halves = quality.sketch(counted.where("doc_id < 100"), ["lang"]).unionAll(quality.sketch(counted.where("doc_id >= 100"), ["lang"]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, quality.merge(halves, ["lang"]).collect()))
