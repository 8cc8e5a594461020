"""Operator 7: SimHash near-duplicates by tiled exact comparison.

Fingerprints are dealt into tiles by the population counts of their eight bytes. Two fingerprints
that differ in at most `radius` bits lie in tiles whose counts differ by at most `radius` in sum, so
only such tile pairs are compared; each fingerprint stays in its own tile and visits the tiles after
it that are near enough. Inside a tile numpy takes the exclusive-or of residents and visitors and
counts its bits. A crowded tile is cut into sub-tiles of bounded size, all of whose pairs are
compared. What a comparison finds leaves it as a spanning forest, never as all pairs of a group;
connected components come from joins and minima until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import BROADCAST_ROWS, ascii_lower, drop_rows, looked_up, mapped, run_of, slices, text_of, written

#: Shingles whose hashes are held at a time.
BLOCK = 1 << 16
#: Fingerprints in a sub-tile, on either side.
TILE = 4096

LOWER_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Of a whole text; bit i is 1 if it is in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER_BYTES).split()  # splits at 20, 09-0D, as the words are defined
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for a in range(0, n, BLOCK):
        part = words[a : a + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(x, seed) for x in shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, key (a hash of the text) and fp (the fingerprint's bits as a long), written once."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x, width, seed) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps)], ["doc_id", "key", "fp"])

    rows = docs.select("doc_id", F.xxhash64(ascii_lower(text_of())).alias("key"), text_of().alias("text"))
    return mapped(rows, marked, "doc_id long, key long, fp long", "fingerprints")


def near_profiles(radius: int) -> list[int]:
    """Differences of packed profiles (a byte's count in 4 bits each) of tiles near enough, none and those after."""
    seen = {(0,) * 8}
    frontier = set(seen)
    for _ in range(radius):
        frontier = {tuple(c + d * (k == i) for k, c in enumerate(x)) for x, i, d in product(frontier, range(8), (-1, 1))} - seen
        seen |= frontier
    return sorted(sum(c << 4 * k for k, c in enumerate(x)) for x in seen if x >= (0,) * 8)


def profile(fp: Column) -> Column:
    counts = [F.shiftleft(F.bit_count(F.shiftright(fp, 8 * k).bitwiseAND(F.lit(255))).cast("long"), 4 * k) for k in range(8)]
    return sum(counts[1:], counts[0])


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (tile, rsub, vsub, visitor); residents of a unit are at most about TILE."""
    unit: tuple | None = None
    home: list[np.ndarray] = []
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "rsub", "vsub", "visitor", "fp")]
        keys = np.stack(cols[:3])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0) | (cols[3][1:] != cols[3][:-1])) + 1).tolist(), len(cols[4])]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if (now := tuple(keys[:, a])) != unit:
                unit, home = now, []
            fps = cols[4][a:b].view(np.uint64)
            if not cols[3][a]:
                home.append(fps)
            elif home:
                found += links(np.concatenate(home), fps, radius)
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def links(home: np.ndarray, visitors: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the pairs within the radius, as (larger, smaller) signed fingerprints."""
    out = []
    step = max(1, (1 << 20) // len(home))
    for a in range(0, len(visitors), step):
        part = visitors[a : a + step]
        near = np.bitwise_count(home[:, None] ^ part[None, :]) <= radius
        i, j = np.nonzero(near)
        x, y = home[i].view(np.int64), part[j].view(np.int64)
        x, y = np.maximum(x, y)[x != y], np.minimum(x, y)[x != y]
        if len(x) > len(home) + len(part):
            x, y = forest(x, y)
        if len(x):
            out.append((x, y))
    return out


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_pairs(fps: DataFrame, radius: int) -> DataFrame:
    """u > v: links that connect all distinct fingerprints (column fp) within the radius, in chains."""
    # Few bytes hold many fingerprints: dealt out first, so that what they are visited by isn't made in a few tasks.
    tiled = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp").select("fp", profile(F.col("fp")).alias("tile"))
    counts = written(tiled.groupBy("tile").agg(F.count("*").alias("n")), "tiles")
    steps = F.array(*(F.lit(x).cast("long") for x in near_profiles(radius)))
    # A sum that leaves a byte's range of 0 to 8 names a tile that has no residents; its visitors meet no one.
    visits = lambda df, *keep: df.select(*keep, F.explode(steps).alias("step"), "tile").select(*keep, (F.col("tile") + F.col("step")).alias("tile"))
    crowds = counts.select("tile", "n", F.lit(0).alias("v")).unionByName(visits(counts.withColumnRenamed("n", "v"), "v").withColumn("n", F.lit(0).cast("long")).select("tile", "n", "v"))
    crowds = crowds.groupBy("tile").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where("n > 0")
    sub = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    crowds = written(crowds.select("tile", sub("n").alias("rs"), sub("v").alias("vs")), "crowds")

    several = crowds.where("rs > 1 OR vs > 1")
    n_several = several.count()
    with_subs = lambda df: df.join(F.broadcast(several) if n_several <= BROADCAST_ROWS else several, "tile", "left").fillna(1, ["rs", "vs"])
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    residents = with_subs(tiled).select("tile", part("rs").alias("rsub"), F.explode(spread("vs")).alias("vsub"), F.lit(0).cast("byte").alias("visitor"), "fp")
    visitors = with_subs(visits(tiled, "fp")).select("tile", F.explode(spread("rs")).alias("rsub"), part("vs").alias("vsub"), F.lit(1).cast("byte").alias("visitor"), "fp")
    # Two of the same tile meet once as resident and visitor, and once the other way round.
    units = residents.unionByName(visitors).repartition("tile", "rsub", "vsub").sortWithinPartitions("tile", "rsub", "vsub", "visitor")
    return units.mapInArrow(lambda batches: compare(batches, radius), "u long, v long")


def components(pairs: DataFrame) -> DataFrame:
    """u, v: every node of the written `pairs` with the smallest node it is connected to (but for that one itself).

    Alternates two steps until nothing changes: each node hands the neighbours above it to the
    smallest one around it, then those below it. A node with very many neighbours is dealt over runs
    of them. Each round is written, so lost executors cost a round at most.
    """
    edges, state = pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = looked_up(both.where("v > u"), lowest, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = written(up, "star-up")
        lowest = up.groupBy("u").agg(F.min("v").alias("m"))
        moved = looked_up(up, lowest, "u", F.col("v")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = written(moved, "star-down")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges
        state = now


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, key, fp, component_id: one row for each row of `docs`."""
    return grouped(fingerprints(docs, width, seed), lambda fps: near_pairs(fps, radius))


def grouped(rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """component_id beside the written `rows` (doc_id, key, fp); `links` has pairs u, v of the distinct fp."""
    rows = rows.withColumn("run", run_of(F.struct("doc_id", "key")))
    dealt = written(rows.groupBy("run", "fp").agg(F.min("doc_id").alias("doc_id")), "dealt")
    fps = written(dealt.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    joined = components(written(links(fps), "pairs"))
    roots = fps.join(joined.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    roots = written(roots, "roots")
    lowest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # One component may hold very many fingerprints, so its smallest doc_id goes to them by runs.
    named = written(looked_up(roots, lowest, "root", F.col("fp")).select("fp", "component_id"), "named")
    # Equal fingerprints may be a third of all rows: the verdict goes through the runs, where each fingerprint is once.
    by_run = dealt.select("run", "fp").join(named, "fp")
    return rows.join(by_run, ["run", "fp"]).select("doc_id", "key", "fp", "component_id")


def simhash_groups(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of `docs`.

    A null or empty text, or one of white space, has the fingerprint 0 and is linked like any other;
    one of fewer words than a shingle is one shingle. Equal texts share a fingerprint. component_id
    is the smallest doc_id that links lead to; null doc_ids are passed over for it, unless a
    component has no other. Other columns are not read.
    """
    return near_duplicates(docs, width, seed, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id is that of their component."""
    return keep_one(docs, near_duplicates(docs, width, seed, radius))


def keep_one(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is that of their component in `labelled`."""
    pairs = labelled.groupBy("doc_id", "key").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    kept = F.col("doc_id").eqNullSafe(F.col("c"))
    pairs = written(pairs.withColumn("kept", kept), "near")
    return drop_rows(docs, pairs.where("NOT kept"), pairs.where("kept AND n > 1"), "key", F.xxhash64(ascii_lower(text_of())))
