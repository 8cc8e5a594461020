"""Operator 12: spelling variants, by a trie of letter-group counts.

A word's vector counts its letters in each of GROUPS groups. Words that differ by one inserted, deleted
or replaced letter have vectors with a surplus of one at most and a deficit of one at most. Tries
arrange words by the counts of successive groups, those with the most letters first. One depth-first
search goes down two tries at once, that of some words and that of the words which look for near ones,
and spends a budget of one surplus and one deficit on the way: what many words have in common is
searched once for all of them. The words of each two leaves it reaches are verified letter by letter.

The first FIRST counts are the key by which the tries are dealt to tasks: each word lives in the part of
its own counts, and visits those of smaller keys that it can reach within the budget, so that two words
meet once. A crowded part is cut into sub-parts of about PART words by a hash, its visitors too, and all
sub-parts of both meet; so a task holds two bounded tries, however large the vocabulary is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.llm.common import mapped, sized_broadcast, slices, written
from antecede.llm.simhash import LOWER_BYTES

#: Letter groups, and those of them that deal the tries to tasks.
GROUPS, FIRST = 24, 4
#: Words in a sub-part, about.
PART = 8_000
#: Word pairs that are verified at a time, and letters up to which they are compared as columns.
BLOCK, WIDE = 1 << 17, 48
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def places(words: DataFrame) -> np.ndarray:
    """For each letter the place of its group's count in a vector: groups with more letters in the words come first."""
    group = (F.ascii("c") % GROUPS).alias("group")
    found = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy(group).agg(F.count("*").alias("n")).collect()
    n = {r["group"]: r["n"] for r in found}
    rank = {g: k for k, g in enumerate(sorted(range(GROUPS), key=lambda g: (-n.get(g, 0), g)))}
    return np.array([rank[c % GROUPS] for c in range(256)])


def vectors(words: list[str], place: np.ndarray) -> np.ndarray:
    """One row of counts for each word."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(rows * GROUPS + place[letters], minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def packed(counts: np.ndarray) -> np.ndarray:
    """The first counts, in 15 bits each."""
    return sum((counts[:, k] & 0x7FFF) << 15 * (FIRST - 1 - k) for k in range(FIRST))


def visited(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the parts that each row's word visits: within the budget, and not above its own."""
    own, rows, keys = packed(counts), [], []
    for up in range(-1, FIRST):
        for down in range(-1, FIRST):
            if up == down and up >= 0:
                continue
            near = counts[:, :FIRST].copy()
            if up >= 0:
                near[:, up] += 1
            if down >= 0:
                near[:, down] -= 1
            key = packed(near)
            some = np.flatnonzero((near >= 0).all(1) & (key <= own))
            rows.append(some)
            keys.append(key[some])
    return np.concatenate(rows), np.concatenate(keys)


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k, n = 0, len(a)
    while k < n and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


class Trie:
    """Words by the counts of successive groups. A leaf is the number of a distinct vector, and stands as soon as no other shares its counts so far."""

    def __init__(self, words: list[str], place: np.ndarray):
        counts = vectors(words, place)
        order = np.lexsort(counts.T[::-1])
        counts = counts[order]
        new = np.flatnonzero(np.concatenate([[True], (counts[1:] != counts[:-1]).any(1)]))
        self.words = [words[k] for k in order.tolist()]
        self.vector = counts[new]
        self.first, self.size = new, np.diff(np.append(new, len(words)))
        self.counts = self.vector.tolist()
        self.root = self.node(0, len(new), 0)
        lengths = np.array([len(w) for w in self.words])
        letters = np.frombuffer("".join(self.words).encode("latin-1"), np.uint8)
        wide = min(WIDE, int(lengths.max()))
        self.lengths, self.left, self.right = lengths, np.zeros((len(words), wide), np.uint8), np.zeros((len(words), wide), np.uint8)
        row = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        back = lengths[row] - 1 - at
        self.left[row[at < wide], at[at < wide]] = letters[at < wide]
        self.right[row[back < wide], back[back < wide]] = letters[back < wide]

    def node(self, low: int, high: int, k: int) -> dict | int:
        if high - low == 1:
            return low
        out, a = {}, low
        while a < high:
            b, c = a + 1, self.counts[a][k]
            while b < high and self.counts[b][k] == c:
                b += 1
            out[c] = self.node(a, b, k + 1)
            a = b
        return out


def leaf_pairs(home: Trie, guests: Trie) -> Iterator[tuple[int, int]]:
    """Leaves of both that the budget may reach; two that stand early are compared in full later."""
    todo = [(home.root, guests.root, 0, 1, 1)]
    while todo:
        a, b, k, surplus, deficit = todo.pop()
        if isinstance(a, int):
            if isinstance(b, int):
                yield a, b
                continue
            ways = ((home.counts[a][k], a),)
        else:
            ways = a.items()
        for c, below in ways:
            for step, s, d in ((0, surplus, deficit), (1, surplus - 1, deficit), (-1, surplus, deficit - 1)):
                if s < 0 or d < 0:
                    continue
                if isinstance(b, int):
                    if guests.counts[b][k] == c + step:
                        todo.append((below, b, k + 1, s, d))
                elif (other := b.get(c + step)) is not None:
                    todo.append((below, other, k + 1, s, d))


def verified(home: Trie, guests: Trie, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one letter apart."""
    n, m = home.lengths[i], guests.lengths[j]
    wide = min(home.left.shape[1], guests.left.shape[1])
    short, out = np.maximum(n, m) <= wide, np.zeros(len(i), bool)
    for k in np.flatnonzero(~short):
        out[k] = one_apart(home.words[i[k]], guests.words[j[k]])
    same = np.flatnonzero(short & (n == m))
    out[same] = (home.left[i[same], :wide] != guests.left[j[same], :wide]).sum(1) == 1
    other = np.flatnonzero(short & (n != m))
    if len(other):
        # A pad differs from every letter, so the first difference is at the shorter word's end at the latest.
        a, b = i[other], j[other]
        ahead = (home.left[a, :wide] != guests.left[b, :wide]).argmax(1)
        behind = (home.right[a, :wide] != guests.right[b, :wide]).argmax(1)
        out[other] = (np.abs(n[other] - m[other]) == 1) & (ahead + behind >= np.minimum(n[other], m[other]))
    return out


def near_of(home: list[str], guests: list[str], place: np.ndarray) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs, one letter apart, of a part's residents and visitors. Two of one part, which meet both ways, are told once."""
    a, b = Trie(home, place), Trie(guests, place)
    found: list[tuple[int, int]] = []

    def told() -> Iterator[tuple[list[str], list[str]]]:
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        over = a.vector[x] - b.vector[y]
        fits = (np.maximum(over, 0).sum(1) <= 1) & (np.maximum(-over, 0).sum(1) <= 1)
        # Of two vectors of one part the larger visits.
        own, place_ = (over[:, :FIRST] == 0).all(1), (over != 0).argmax(1)
        fits &= ~own | (over[np.arange(len(over)), place_] <= 0)
        x, y = x[fits], y[fits]
        pairs = a.size[x] * b.size[y]
        cuts = np.flatnonzero(np.diff(np.cumsum(pairs) // BLOCK)) + 1
        for some in np.split(np.arange(len(x)), cuts):
            if not len(some):
                continue
            n = pairs[some]
            leaf = np.repeat(some, n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i, j = a.first[x[leaf]] + k // b.size[y[leaf]], b.first[y[leaf]] + k % b.size[y[leaf]]
            near = verified(a, b, i, j)
            i, j = i[near].tolist(), j[near].tolist()
            one = [(a.words[p], b.words[q]) for p, q in zip(i, j, strict=True)]
            twice = (a.vector[x[leaf[near]]] == b.vector[y[leaf[near]]]).all(1).tolist()
            one = [(p, q) for (p, q), both in zip(one, twice, strict=True) if not both or p < q]
            yield [p for p, _ in one], [q for _, q in one]

    for pair in leaf_pairs(a, b):
        found.append(pair)
        if len(found) == BLOCK:
            yield from told()
            found.clear()
    if found:
        yield from told()


def search(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """word, near (each pair once) from rows sorted by (part, rsub, vsub)."""
    unit: tuple | None = None
    home: list[str] = []
    guests: list[str] = []

    def told() -> Iterator[pa.RecordBatch]:
        if home and guests:
            for pair in near_of(home, guests, place):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in pair], ["word", "near"])

    for batch in batches:
        for key, visitor, word in zip(zip(*(batch.column(c).to_pylist() for c in ("part", "rsub", "vsub")), strict=True), batch.column("visitor").to_pylist(), batch.column("word").to_pylist(), strict=True):
            if key != unit:
                yield from told()
                unit, home, guests = key, [], []
            (guests if visitor else home).append(word)
    yield from told()


def near_words(words: DataFrame) -> DataFrame:
    """word, near: each of the written distinct `words` (column word) with each that is one letter apart, so every pair both ways."""
    place = places(words)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            some = batch.column("word").to_pylist()
            counts = vectors(some, place)
            rows, keys = visited(counts)
            word = pa.array([*some, *(some[k] for k in rows.tolist())], pa.string())
            visitor = np.arange(len(some) + len(rows)) >= len(some)
            yield pa.RecordBatch.from_arrays([word, pa.array(np.concatenate([packed(counts), keys])), pa.array(visitor)], ["word", "part", "visitor"])

    rows = words.select("word").mapInArrow(dealt, "word string, part long, visitor boolean")
    of = lambda test, c: F.ceil(F.count_if(test) / PART).cast("int").alias(c)
    # Parts without residents are not visited: the join drops their visitors.
    parts = written(rows.groupBy("part").agg(of(~F.col("visitor"), "rs"), of(F.col("visitor"), "vs")).where("rs > 0"), "parts")
    mine = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rsub, vsub = F.when(F.col("visitor"), every("rs")).otherwise(mine("rs")), F.when(F.col("visitor"), mine("vs")).otherwise(every("vs"))
    units = rows.join(sized_broadcast(parts), "part").select("part", F.explode(rsub).alias("rsub"), "vs", "visitor", "word", vsub.alias("v")).select("part", "rsub", F.explode("v").alias("vsub"), "visitor", "word")
    once = units.repartition("part", "rsub", "vsub").sortWithinPartitions("part", "rsub", "vsub").mapInArrow(lambda batches: search(batches, place), "word string, near string")
    return once.select(F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).alias("p")).select("p.*")


def without_some_letters(doc_id: int | None, runs: list[str]) -> list[str]:
    """The query's rewrite: of one in 199 runs, by crc32 of `<doc_id>:<run>`, one letter goes. A null doc_id's runs stay."""
    if doc_id is None:
        return runs
    begin, out = zlib.crc32(b"%d:" % doc_id), list(runs)
    for k, run in enumerate(runs):
        if not (h := zlib.crc32(run.encode(), begin)) % 199:
            at = h % len(run)
            out[k] = run[:at] + run[at + 1 :]
    return out


Rewrite = Callable[[int | None, list[str]], list[str]]


def vocabulary(docs: DataFrame, least_length: int, least: int, rewrite: Rewrite | None = None) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, long and frequent enough; counted inside each batch of texts before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter[str] = Counter()
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                runs = LETTERS.findall(text.encode().translate(LOWER_BYTES).decode())
                counts.update(rewrite(i, runs) if rewrite else runs)
            long = [(w, n) for w, n in counts.items() if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])

    found = mapped(docs.where("text IS NOT NULL").select("doc_id", "text"), counted, "word string, n long", "counts")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, by doubling. forms: word, form (null at the end), already written."""
    now = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = written(now.join(far, "root").select("word", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "roots")
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5, rewrite: Rewrite | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each distinct word of `docs` with `least_length` letters and `least` occurrences.

    Words are runs of Latin letters with A-Z in lower case. Near words differ by exactly one inserted, deleted or replaced letter.
    A word's form is its near word of largest n (of equal n the smallest in code-point order), if that n is at least `times` its own,
    else null; root follows forms to the last; n_near counts near words. Null and empty texts have no words; repeated rows count
    each; other columns are not read; no rows give no rows. `rewrite` may change a text's runs before they are counted.
    """
    words = written(vocabulary(docs, least_length, least, rewrite), "words")
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    enough = F.col("form_n") >= times * F.col("n")
    forms = written(judged.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
