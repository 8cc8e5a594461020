"""Operators 11 to 13 against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from antecede.llm import minhash, periodic_runs, similar, spelling

SCHEMA = "doc_id long, text string, n long, word string, node long, g long, s string, run string, near string, component_id long, n_runs int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, "s", "r", "x", 4, 5) for i, t in rows], SCHEMA).repartition(parts)


def data(df):
    return [r.asDict() for r in df.collect()]


def ascii_low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if (size := j + q - i) >= max(12, 2 * q) and not any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def periodic_words(rng):
    n = rng.randint(0, 80)
    words = ["%d" % rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 10)
        words = words[:a] + (words[a : a + p] * 60)[: n - a] + words[: rng.randint(0, n)]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(700):
        words = [w.encode() for w in periodic_words(rng)]
        assert periodic_runs.runs_of(words) == plain_runs(words)
        assert sorted(periodic_runs.stretch_runs(np.array([int(w) for w in words], np.int64))) == plain_runs(words)


def test_automaton_has_a_state_for_each_set_of_ends():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
        length, link, prefix = periodic_runs.automaton(s)
        ends = defaultdict(set)
        for j in range(len(s)):
            for i in range(j + 1):
                ends[tuple(s[i : j + 1])].add(j)
        classes = defaultdict(int)
        for t, e in ends.items():
            classes[frozenset(e)] = max(classes[frozenset(e)], len(t))
        assert sorted(length[1:]) == sorted(classes.values())
        for i, v in enumerate(prefix):
            lengths = set()
            while v > 0:
                lengths.add(length[v])
                v = link[v]
            assert lengths == {n for e, n in classes.items() if i in e and n <= i + 1 and frozenset(ends[tuple(s[i + 1 - n : i + 1])]) == e}


def plain_report(i, text, planted):
    words = WORD.findall(text or "")
    if planted and i is not None and words and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (
        str(i), len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(listed.encode()).hexdigest(),
        sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
    )


@pytest.mark.parametrize("planted", [False, True])
def test_periodic_runs(spark, planted):
    rng = random.Random(4)
    texts = [" ".join(periodic_words(rng)) for _ in range(150)]
    texts += [None, "", " \t\n", "one", "x " * 12, "x " * 11, "a b " * 30, "A a " * 20, " ".join("é日%d" % (k % 5) for k in range(200)), "same " * 40, "same " * 40, "a b " * 9 + "c d e " * 9 + "c c " * 9 + "f " + "a b " * 9]
    rows = [*enumerate(texts), (5, texts[5]), (None, "b c " * 50)]
    df = frame(spark, rows)
    got = data(periodic_runs.periodic_runs(df, periodic_runs.with_planted_runs if planted else None))
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in columns)) for r in got) == sorted((a, *map(str, b)) for a, *b in (plain_report(*r, planted) for r in rows))
    assert any(r["n_runs"] > 1 for r in got) and any(r["n_runs"] == 0 for r in got)
    assert data(periodic_runs.periodic_runs(df.limit(0))) == []
    left = {r["doc_id"]: r["collapsed"] for r in data(periodic_runs.collapsed(df))}
    assert left[150] is None and left[154] == "x" and left[155] == " ".join(["x"] * 11) and left[None] == "b c"


def test_long_periodic_texts_take_no_square_of_time():
    for words in ([b"a"] * 60_000, [b"%d" % (k % 7) for k in range(60_000)], [b"%d" % (k % 29_000) for k in range(58_000)]):
        (run,) = periodic_runs.runs_of(words)
        assert run == (0, len(words), len(set(words)))


# Spelling


def one_edit(a, b):
    less = lambda x: {x[:k] + x[k + 1 :] for k in range(len(x))}
    return a != b and (a in less(b) or b in less(a) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1))


def test_one_apart():
    words = ["", "a", "b", "ab", "ba", "aab", "aba", "abab", "abcab", "é", "éa"]
    assert all(spelling.one_apart(a, b) == one_edit(a, b) for a in words for b in words)


def plain_variants(rows, least_length, least, times, rewrite):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_low(run)
            if rewrite and i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= least_length}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), n, len(near[w]), str(words.get(form[w]))) for w, n in words.items())


@pytest.mark.parametrize(("part", "block", "wide"), [(8_000, 1 << 17, 48), (7, 20, 5)])
def test_spelling_variants(spark, monkeypatch, part, block, wide):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "WIDE", wide)
    rng = random.Random(3)
    base = ["".join(rng.choice("abeéÀ×") for _ in range(rng.randint(3, 8))) for _ in range(40)]

    def spelt(w):
        k, x = rng.randrange(len(w)), rng.random()
        return w if x < 0.8 else w[:k] + w[k + 1 :] if x < 0.88 else w[:k] + rng.choice("abé") + w[k:] if x < 0.94 else w[:k] + rng.choice("abé") + w[k + 1 :]

    texts = [rng.choice([" ", "-", "1", "日"]).join(spelt(rng.choice(base[: 1 + k % 40])) for _ in range(60)) for k in range(250)]
    texts += [None, "", "123 ", "z" * 60 + " " + "z" * 61, ("Z" * 60 + " ") * 20 + ("z" * 61 + " ") * 3, "tie tied " * 3, "tie" * 4000, "alone " * 5, "chainabc " * 100 + "chainab " * 20 + "chaina " * 4]
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[8])]
    df = frame(spark, rows)
    for rewrite in (None, spelling.without_some_letters):
        got = data(spelling.spelling_variants(df, 3, 2, 3, rewrite))
        want = plain_variants(rows, 3, 2, 3, rewrite)
        assert sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], str(r["form_n"])) for r in got) == want
    assert any(r["form"] and r["root"] != r["form"] for r in got) and any(r["n_near"] == 0 for r in got)
    assert data(spelling.spelling_variants(df.limit(0))) == []


# MinHash


def plain_groups(rows, width=5, p=85, q=100):
    sets = []
    for i, text in rows:
        w = [x for x in WORD.findall(ascii_low(text or ""))]
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = min(least[find(k)], default=None) if sets[k] else i
        out.append((str(i), len(sets[k]), str(c), i == c))
    return sorted(out)


def near_copies(rng, n=70):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [[word() for _ in range(rng.randint(1, 160))] for _ in range(n)]
    passage = [word() for _ in range(40)]
    texts += [passage + [word() for _ in range(rng.randint(0, 12))] for _ in range(50)]
    for t in [*texts[:n], *[texts[3]] * 60]:
        copy = list(t)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("tile", [1024, 8])
def test_minhash_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    rng = random.Random(6)
    texts = [*near_copies(rng), None, None, "", " \n", "one two", "ONE  two", "ONE  two three", " ", "w " * 30_000, "W " * 29_990, " ".join(map(str, range(30_000)))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [*((i, texts[k]) for i, k in enumerate(order)), (3, texts[order[3]]), (None, texts[0]), (None, "only here"), (None, "")]
    df = frame(spark, rows)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in data(minhash.minhash_groups(df)))
    want = [(a, b, c, kept or a == c == "None") for a, b, c, kept in plain_groups(rows)]
    assert got == sorted(want)
    assert sum(not r[3] for r in got) > 60
    assert data(minhash.minhash_groups(df.limit(0))) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a, b = minhash.functions()
    for share in (0.2, 0.5, 0.85):
        both, one, other = (rng.integers(-(2**63), 2**63, n) for n in (int(2000 * share), *[int(1000 * (1 - share))] * 2))
        x, y = (minhash.signature(np.unique(np.concatenate([both, s])), a, b) for s in (one, other))
        assert abs((x == y).mean() - share) < 0.13
    least = minhash.least_agreement(85, 100)
    assert 95 < least < 115 and minhash.least_agreement(1, 1) == minhash.HASHES


def test_pivots_join_what_chains_join():
    rng = random.Random(8)
    for _ in range(200):
        m = rng.randint(1, 25)
        near = {(i, j) for i in range(m) for j in range(i) if rng.random() < rng.choice([0.02, 0.1, 0.9])}
        asked = []

        def ask(k, rest):
            asked.append(len(rest))
            return np.array([(max(k, x), min(k, x)) in near for x in rest.tolist()], bool)

        label = list(range(m))
        i, j = similar.by_pivots(m, ask)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            assert (max(x, y), min(x, y)) in near
            label = [label[x] if c == label[y] else c for c in label]
        plain = list(range(m))
        for x, y in near:
            plain = [plain[x] if c == plain[y] else c for c in plain]
        assert len({*zip(label, plain, strict=True)}) == len({*label}) == len({*plain})
    assert len(similar.by_pivots(500, lambda k, rest: np.ones(len(rest), bool))[0]) == 499


def test_near_stage_with_a_shingle_that_half_of_the_texts_share(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(k, "the same five words first " * (k % 2) + " ".join(word() for _ in range(6))) for k in range(600)]
    rows += [(1000 + k, rows[2 * k][1]) for k in range(20)]
    left = similar.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(600))
