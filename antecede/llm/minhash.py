"""Operator 13: near-duplicates by MinHash, banding and stars, confirmed on full sets.

A text's set is that of its distinct shingles. Its signature holds the smallest value of each of HASHES
universal hash functions (multiply-shift, (a x + b) mod 2^64 in its upper half) over the set. Bands of
ROWS such values are bucket keys. Two sets of similarity s share a bucket with odds 1 - (1 - s^ROWS)^BANDS;
at 0.85 all but 7 pairs in 10^9 do.

* Equal texts are one node. Buckets with the same members in several bands count once.
* In a bucket, signatures are compared by pivots in tiles of bounded size; a pair that agrees in fewer
  values than a similarity at the limit gives with odds of 10^-10 is no candidate.
* Candidates' components come from alternating large-star and small-star steps (`simhash.components`).
* In those components, links are confirmed on full sets, by pivots too, and stars join the links.

What pivots leave is a spanning forest of all links: no pair is passed over but those that are in one
component already, so no group is expanded into its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import ascii_lower, looked_up, mapped, marked, slices, text_of, written
from antecede.llm.similar import Kernel, by_pivots, confirmed, forests, in_tiles, shingles
from antecede.llm.simhash import grouped

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Shingles that are hashed at a time.
BLOCK = 2048
SEED = 7


def functions(seed: int = SEED, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """a (odd) and b of the hash functions, fixed by the seed."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 2**64, hashes, np.uint64, endpoint=False) for _ in range(2))
    return (a | np.uint64(1))[:, None], b[:, None]


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each function over a set's shingle hashes, of which the lower 32 bits are taken."""
    x, low = s.view(np.uint64) & np.uint64(0xFFFFFFFF), np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(x), BLOCK):
        h = a * x[None, k : k + BLOCK]
        h += b
        np.minimum(low, h.min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_agreement(p: int, q: int, hashes: int = HASHES, odds: float = 1e-10) -> int:
    """The number of equal values below which signatures of sets with similarity p / q lie with less than these odds."""
    s, below = p / q, 0.0
    for k in range(hashes):
        below += math.comb(hashes, k) * s**k * (1 - s) ** (hashes - k)
        if below > odds:
            return k
    return hashes


def signatures(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, node (a hash of the text), n (its shingles, 0 without words) and sig (empty then) of each row; written."""
    a, b = functions(seed)
    nothing = np.zeros(0, np.int32)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sigs = [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, width) if text.encode().strip() else nothing
                n.append(len(s))
                sigs.append(signature(s, a, b) if len(s) else nothing)
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([nothing, *sigs])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(n, pa.int64()), lists], ["doc_id", "node", "n", "sig"])

    rows = docs.select("doc_id", F.xxhash64(ascii_lower(text_of())).alias("node"), text_of().alias("text"))
    return mapped(rows, made, "doc_id long, node long, n long, sig array<int>", "signatures")


def agreeing(p: int, q: int) -> Kernel:
    """Links of signatures that may belong to similar sets."""
    least = least_agreement(p, q)

    def linked(nodes: list[int], held: list, n: list[int], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        values, size = np.stack(held), np.array(n, np.int64)

        def near(k: int, rest: np.ndarray) -> np.ndarray:
            fits = q * np.minimum(size[rest], size[k]) >= p * np.maximum(size[rest], size[k])
            fits[fits] = (values[rest[fits]] == values[k]).sum(1) >= least
            return fits

        return by_pivots(len(held), near)

    return linked


def buckets(sig: str = "sig") -> Column:
    """A key for each band: a hash of its number and values."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice(sig, k * ROWS + 1, ROWS)))


def minhash_pairs(made: DataFrame, texts: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """u > v: links that connect all nodes whose similarity is p / q or more, in chains."""
    one = written(made.select("node", "n", "sig").dropDuplicates(["node"]), "nodes")
    posted = one.select("node", F.explode(buckets()).alias("g"))
    # Counted in parts; of buckets with the same members, which two independent hashes tell, one is enough.
    members = posted.groupBy("g").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    chosen = written(members.where("n > 1").groupBy("n", "x", "y").agg(F.min("g").alias("g")).select("g"), "buckets")
    few = marked(posted, F.col("g"), chosen, F.col("g")).where("__may").select("node", "g")
    lists = written(looked_up(few, chosen, "g", F.col("node")), "lists")
    held = marked(one, F.col("node"), lists, F.col("node")).where("__may").select("node", "n", "sig")
    units = lists.join(held, "node").withColumn("at", F.lit(0))
    may = written(in_tiles(units, lambda batches: forests(batches, agreeing(p, q), "sig"), "sig"), "may")
    return confirmed(texts, may, width, p, q)


def minhash_groups(docs: DataFrame, width: int = 5, p: int = 85, q: int = 100, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`.

    Shingles are `width` words in lower case (A-Z); a text of fewer words is one. Null, empty and blank texts have none and are
    linked with nothing, each other neither. Links join texts with q * |both| >= p * |either|, equal texts too; component_id is the
    smallest doc_id that links lead to, and `kept` says whether it is the row's own: repeated rows are kept alike. A null doc_id is
    passed over for it unless the component has no other. Other columns are not read; no rows give no rows.
    """
    made = signatures(docs, width, seed)
    texts = docs.select(F.xxhash64(ascii_lower(text_of())).alias("node"), text_of().alias("text"))
    # What `grouped` calls a key is only carried: here the number of shingles.
    rows = made.where("n > 0").select("doc_id", F.col("n").alias("key"), F.col("node").alias("fp"))
    linked = grouped(rows, lambda fps: minhash_pairs(made.where("n > 0"), texts, width, p, q)).select("doc_id", F.col("key").alias("n_shingles"), "component_id")
    alone = made.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
