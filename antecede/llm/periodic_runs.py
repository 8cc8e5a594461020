"""Operator 11: periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and of at
least max(12, 2 q) words, that no neighbouring word extends. For each text the suffix automaton of its
words is built. Then the words are appended one by one: the state of what has been read is accessed, and
the path from it to the root is recoloured with the end just read. A segment of one colour on that path
holds the suffixes, from one length to another, whose last occurrence ended at that colour; if the
distance between both ends lies within those lengths, a suffix of that length stands beside its last
occurrence: a square, and a primitive one, as a shorter period would have put a later occurrence there.
Each square that no known run of its period contains is extended to a run by comparing words.

The link tree is finished before the first access, so no link is ever cut, and the preferred paths of the
access are kept as stacks of segments on the tree's heavy paths: the recolouring always covers a heavy
path from its top, so it pops what it covers. Every new segment is popped once; a path meets a
logarithm of heavy paths.

Each run lies in words that are covered by six-word sequences which the text repeats (of a run of n words
and period q, the first n - q - 5 such sequences come again q words on, and both cover it). Only stretches
of such words have an automaton; what lies between them can't be in a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from antecede.llm.common import mapped, slices, text_of

#: Least number of words in a run, and of a sequence that a run must repeat: LEAST - LEAST // 2.
LEAST, GRAM = 12, 6
#: An odd multiplier that mixes word numbers; it decides only which stretches are looked at in vain.
MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """length and link of each state (0 is the root), and the state of each prefix.

    Most states have one way on, held in two lists; only those with more have a dictionary.
    """
    length, link, word, to, more = [0], [-1], [-1], [-1], [None]
    prefix, last = [], 0
    for c in ids:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word.append(-1)
        to.append(-1)
        more.append(None)
        p, q = last, -1
        while p >= 0:
            ways = more[p]
            if ways is None:
                if word[p] == c:
                    q = to[p]
                    break
                if word[p] < 0:
                    word[p], to[p] = c, cur
                else:
                    more[p] = {word[p]: to[p], c: cur}
            else:
                q = ways.get(c, -1)
                if q >= 0:
                    break
                ways[c] = cur
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                to.append(to[q])
                more.append(dict(more[q]) if more[q] is not None else None)
                link[q] = link[cur] = clone
                while p >= 0:
                    ways = more[p]
                    if ways is None:
                        if word[p] != c or to[p] != q:
                            break
                        to[p] = clone
                    else:
                        if ways.get(c) != q:
                            break
                        ways[c] = clone
                    p = link[p]
        prefix.append(cur)
        last = cur
    return length, link, prefix


def heavy_tops(length: list[int], link: list[int]) -> list[int]:
    """The top state of each state's heavy path; the root is on none."""
    n = len(length)
    order = np.argsort(np.array(length), kind="stable").tolist()
    size = [1] * n
    for v in reversed(order[1:]):
        size[link[v]] += size[v]
    heavy, best = [-1] * n, [0] * n
    for v in order[1:]:
        if size[v] > best[up := link[v]]:
            best[up], heavy[up] = size[v], v
    top = list(range(n))
    for v in order[1:]:
        if (up := link[v]) and heavy[up] == v:
            top[v] = top[up]
    return top


def squares(ids: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of the primitive squares whose halves have no later occurrence between them, by ends."""
    length, link, prefix = automaton(ids)
    top = heavy_tops(length, link)
    ends: dict[int, list[int]] = {}
    colours: dict[int, list[int]] = {}
    for i, v in enumerate(prefix):
        while v:
            h, deep = top[v], length[v]
            up = link[h]
            low = length[up]
            stack = ends.get(h)
            if stack is None:
                ends[h], colours[h] = [deep], [i]
            else:
                tint = colours[h]
                while stack and stack[-1] <= deep:
                    end = stack.pop()
                    d = i - tint.pop()
                    if low < d <= end:
                        yield i, d
                    low = end
                if stack and low < (d := i - tint[-1]) <= deep:
                    yield i, d
                stack.append(deep)
                tint.append(i)
            v = up


def same_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal values at the beginning of both."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differs = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, step * 2
    return n


def stretch_runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs in a text."""
    done: dict[int, int] = {}
    out = []
    for i, d in squares(ids.tolist()):
        if i <= done.get(d, -1):
            continue
        first = i - 2 * d + 1
        start = first - same_ahead(ids[:first][::-1], ids[: first + d][::-1])
        end = i + same_ahead(ids[i + 1 :], ids[i + 1 - d :])
        done[d] = end
        if end - start + 1 >= max(least, 2 * d):
            out.append((start, end - start + 1, d))
    return out


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """From and to (exclusive) of the maximal stretches of words that lie in repeated sequences of GRAM words, if long enough for a run."""
    if len(ids) < LEAST:
        return []
    n = len(ids) - GRAM + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ ids[k : k + n].view(np.uint64)) * MIX
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    equal = mixed[order[1:]] == mixed[order[:-1]]
    if not equal.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    step[:n] += again
    step[GRAM : GRAM + n] -= again
    inside = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
    at = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True) if b - a >= LEAST]


def runs_of(words: list[bytes]) -> list[Run]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return []
    return sorted((a + start, n, q) for a, b in stretches(ids) for start, n, q in stretch_runs(ids[a:b]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        step[start + q] += 1
        step[start + n] -= 1
    covered = np.cumsum(step)[:-1] > 0
    return [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def report(words: list[bytes]) -> tuple:
    runs = runs_of(words)
    kept = kept_words(words, runs)
    start, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return len(runs), start, n, q, 1000 * n // q if runs else None, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest(), len(words), len(kept)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; of equal length the first, then the smaller period;
    nulls if there is none), runs_sha256 (of all runs), collapsed_sha256 (of the words that stay), n_words, n_kept: one row for each row of `docs`.

    Words are what spaces and the characters 09 to 0D leave; null, empty and blank texts have none. Repeated rows are judged each;
    other columns are not read; no rows give no rows. `rewrite` may change a text's words before they are searched.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            out = []
            for i, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                words = text.encode().split()  # splits at 20, 09-0D, as the words are defined
                out.append((i, *report(rewrite(i, words) if rewrite else words)))
            columns = list(zip(*out, strict=True)) or [[]] * len(COLUMNS)
            types = [pa.string() if c.endswith("sha256") else pa.int64() for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], COLUMNS)

    return mapped(docs.select("doc_id", text_of().alias("text")), judged, SCHEMA, "runs")


def collapsed(docs: DataFrame) -> DataFrame:
    """`docs` with `collapsed`: the text's words that stay, joined by one space; a null text stays null."""
    @F.pandas_udf(StringType())
    def joined(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            words = text.encode().split()
            return b" ".join(kept_words(words, runs_of(words))).decode()

        return texts.map(one)

    return docs.withColumn("collapsed", joined("text"))


def with_planted_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rewrite: every tenth text, by crc32 of its doc_id, repeats a stretch of its words to its end. A null doc_id's stays."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * -(-(n - a) // p))[: n - a]
