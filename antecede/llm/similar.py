"""Near copies by exact Jaccard similarity of shingles: every pair of texts that is similar enough is linked.

Operator 7 comes first: fingerprints of the same shingles, tiles by population counts, exclusive-or, bit
counts, forests and stars. What it brings together is compared by all shingles, and the links that hold
stay. No Hamming radius of a fingerprint finds all pairs, so filters that lose none find the rest.

* Prefix and position: all shingles have one order, rare ones first; two sets whose similarity reaches
  p / q share a shingle among the first n - ceil(n p / q) + 1 of each, and what follows the first one
  that they share is long enough. The order comes from a sample; it decides how long lists are, not
  what is found.
* Parity marks: a bitmap of about two bits for each shingle, in which each shingle turns one bit over.
  The exclusive-or of two marks has at most as many bits as the sets have different shingles.

Prefix shingles that only texts of one component hold, by the links so far, are passed over. Texts that
share another one are compared by their marks, in tiles of bounded size, which leave spanning forests; so
do the groups that these make, in which texts are compared by all their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.llm.common import ascii_lower, looked_up, mapped, marked, sized_broadcast, slices, text_of, written
from antecede.llm.simhash import LOWER_BYTES, components, fingerprints, forest, grouped, keep_one, near_pairs

#: Texts whose shingles are counted for the order, about, and the most of their shingles that it holds.
SAMPLE, COMMON = 8_192, 300_000
#: Texts in a tile.
TILE = 1024
#: Texts of a list whose pairs are made many lists at a time.
FEW = 16
#: Bits of a mark, at most.
MOST_BITS = 1 << 16


def shingles(text: str, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER_BYTES).split()
    parts = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, parts), np.uint64).view(np.int64))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def sets(texts: DataFrame, width: int, *keep: str) -> DataFrame:
    """`keep` (longs) and s, the shingles of `text`; written."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = lists_of([shingles(x, width) for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found], [*keep, "s"])

    return mapped(texts.select(*keep, "text"), made, "".join(f"{k} long, " for k in keep) + "s array<long>", "sets")


def sampled(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several texts of a sample hold, and how many do."""
    one_in = max(1, texts.count() // SAMPLE)
    some = sets(texts.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0), width, "node")
    counts = some.select(F.explode("s").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, n = (found.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    order = np.argsort(token)
    return token[order], n[order]


def mark(s: np.ndarray) -> np.ndarray:
    """The parity mark of a set: words of 64 bits, a power of two of them."""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """The mark of the same set with fewer bits."""
    return m if len(m) == words else np.bitwise_xor.reduce(m.reshape(-1, words), axis=0)


def prefixes(texts: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """node, n (its shingles), m (their mark) and tokens, in order, of which a similar text must share one."""
    common, counts = sampled(texts, width)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, sizes, marks = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                marks.append(mark(s))
                sizes.append(len(s))
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
                tokens.append(s[: len(s) - -(-len(s) * p // q) + 1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int32()), lists_of(marks), lists_of(tokens)], ["node", "n", "m", "tokens"])

    return mapped(texts.select("node", "text"), made, "node long, n int, m array<long>, tokens array<long>", "prefixes")


Kernel = Callable[[list[int], list, list[int], list[int]], tuple[np.ndarray, np.ndarray]]


def forests(batches: Iterator[pa.RecordBatch], linked: Kernel, value: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit (g, i, j); all members of a unit are compared, and a spanning forest u > v of the links is left."""
    unit, nodes, held, n, at = None, [], [], [], []

    def links() -> pa.RecordBatch:
        i, j = linked(nodes, held, n, at)
        ids = np.array(nodes, np.int64)
        u, v = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
        u, v = u[u != v], v[u != v]
        u, v = forest(u, v) if len(u) else (u, v)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in slices(batches):
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "i", "j")), strict=True))
        columns = [batch.column(c).to_pylist() for c in ("node", "n", "at")]
        found = batch.column(value)
        for k, key in enumerate(keys):
            if key != unit:
                if len(nodes) > 1:
                    yield links()
                unit, nodes, held, n, at = key, [], [], [], []
            nodes.append(columns[0][k])
            held.append(found[k].values.to_numpy())
            n.append(columns[1][k])
            at.append(columns[2][k])
    if len(nodes) > 1:
        yield links()


def near_lists(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """As `forests` of `near_marks`, but lists of a few texts, which are nearly all, are compared many at a time."""
    linked, rest = near_marks(p, q), None

    def units(t: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        node, n, at = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "at"))
        marks = t.column("m")
        ends, bits = marks.offsets.to_numpy(), marks.values.to_numpy()
        sizes = np.diff(cuts)
        unit, small = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= FEW, sizes)
        found = []
        for d in range(1, min(FEW, len(unit))):
            r = np.flatnonzero(small[: len(unit) - d] & (unit[: len(unit) - d] == unit[d:]))
            c = r + d
            fits = (q * np.minimum(n[r], n[c]) >= p * np.maximum(n[r], n[c])) & ((p + q) * np.minimum(n[r] - at[r], n[c] - at[c]) >= p * (n[r] + n[c]))
            for a, b in zip(r[fits].tolist(), c[fits].tolist(), strict=True):
                x, y = bits[ends[a] : ends[a + 1]], bits[ends[b] : ends[b + 1]]
                few = min(len(x), len(y))
                odd = int(np.bitwise_count((folded(x, few) ^ folded(y, few)).view(np.uint64)).sum())
                if (p + q) * odd <= (q - p) * (n[a] + n[b]):
                    found.append((node[a], node[b]))
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        parts = [(np.maximum(u, v)[u != v], np.minimum(u, v)[u != v])]
        for k in np.flatnonzero(sizes > FEW):
            rows = range(cuts[k], cuts[k + 1])
            i, j = linked(node[cuts[k] : cuts[k + 1]], [bits[ends[x] : ends[x + 1]] for x in rows], n[cuts[k] : cuts[k + 1]], at[cuts[k] : cuts[k + 1]])
            u, v = node[cuts[k] + i], node[cuts[k] + j]
            if len(u):
                parts.append(forest(np.maximum(u, v)[u != v], np.minimum(u, v)[u != v]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in parts])) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        t = batch if rest is None else pa.concat_batches([rest, batch])
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("g", "i", "j")])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if not len(new):
            rest = t
            continue
        rest = t.slice(new[-1])
        yield units(t.slice(0, new[-1]), np.concatenate([[0], new]))
    if rest is not None and rest.num_rows:
        yield units(rest, np.array([0, rest.num_rows]))


def near_marks(p: int, q: int) -> Kernel:
    """Pairs that may be similar, by sizes, by places of the shared shingle and by marks."""

    def linked(nodes: list[int], held: list, n: list[int], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        n, at, out = np.array(n, np.int64), np.array(at, np.int64), []
        words = np.array([len(x) for x in held])
        kinds = np.unique(words)
        for few in kinds:
            # A mark meets its like, and folded down those of fewer words.
            a = np.flatnonzero(words == few)
            b = np.flatnonzero(words >= few)
            b = b[(q * n[b] >= p * n[a].min()) & (p * n[b] <= q * n[a].max())]
            x = np.stack([held[k] for k in a])
            y = np.stack([folded(held[k], few) for k in b]) if len(b) else np.zeros((0, few), np.int64)
            step = max(1, (1 << 21) // max(1, len(y) * few))
            for k in range(0, len(x), step):
                i, j = a[k : k + step, None], b[None, :]
                bits = np.bitwise_count((x[k : k + step, None, :] ^ y[None, :, :]).view(np.uint64)).sum(2, dtype=np.int64)
                total = n[i] + n[j]
                most = np.minimum(n[i] - at[i], n[j] - at[j])
                # With o in common, the sets differ in total - 2 o, and o / (total - o) >= p / q.
                fits = ((p + q) * bits <= (q - p) * total) & ((p + q) * most >= p * total) & (i != j)
                r, c = np.nonzero(fits)
                out.append((a[k + r], b[c]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in (0, 1))

    return linked


def by_pivots(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of 0 to m - 1 that chains of near pairs connect; near(k, rest) says which of `rest` are near k.

    A pivot is compared with all that were no pivots yet, and it comes from the smallest component left; once those that were no
    pivots are all in one component, nothing can be missing. So a group of near copies costs a few pivots, not its square.
    """
    label, rest, out = np.arange(m), np.arange(m), []
    while len(rest) > 1:
        names, at, size = np.unique(label[rest], return_inverse=True, return_counts=True)
        if len(names) == 1:
            break
        first = int(np.flatnonzero(at == size.argmin())[0])
        k, rest = rest[first], np.delete(rest, first)
        other = rest[label[rest] != label[k]]
        met = other[near(int(k), other)]
        if len(met):
            out.append((np.full(len(met), k), met))
            label[np.isin(label, label[met])] = label[k]
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in (0, 1))


def similar(p: int, q: int) -> Kernel:
    """Links of pairs that are similar, by all their shingles."""

    def linked(nodes: list[int], held: list, n: list[int], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in held])
        begin, every = np.cumsum(size) - size, np.concatenate(held)
        _, token = np.unique(every, return_inverse=True)
        mine = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)

        def near(k: int, rest: np.ndarray) -> np.ndarray:
            fits = (q * np.minimum(size[rest], size[k]) >= p * np.maximum(size[rest], size[k])) & (size[rest] > 0)
            some = rest[fits]
            if not len(some):
                return fits
            own = token[begin[k] : begin[k] + size[k]]
            mine[own] = 1
            starts = np.cumsum(size[some]) - size[some]
            shared = np.add.reduceat(mine[token[np.repeat(begin[some] - starts, size[some]) + np.arange(int(size[some].sum()))]], starts)
            mine[own] = 0
            fits[fits] = shared * (p + q) >= p * (size[k] + size[some])
            return fits

        return by_pivots(len(held), near)

    return linked


def in_tiles(rows: DataFrame, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], value: str) -> DataFrame:
    """u > v: links inside each g, from rows (g, node, n, at and `value`); the members of a large g meet in tiles."""
    parts = written(rows.groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).where("parts > 1"), "parts")
    dealt = rows.join(sized_broadcast(parts), "g", "left").fillna(1, ["parts"])
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = dealt.withColumn("a", mine).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("g", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "node", "n", "at", value)
    return units.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(compare, "u long, v long")


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """u > v: each node with the smallest that chains of fingerprints within the radius lead to, by operator 7. prints: key (the node), fp; written."""
    nodes = written(prints.select(F.col("key").alias("doc_id"), "key", "fp").distinct(), "nodes")
    near = grouped(nodes, lambda fps: near_pairs(fps, radius))
    return near.where("key > component_id").select(F.col("key").alias("u"), F.col("component_id").alias("v"))


def labelled(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """`nodes` with c, the smallest node of their component in the written `joined` (u, v), or else their own."""
    keyed = marked(nodes, F.col("node"), joined, F.col("u"))
    few = keyed.where("__may").join(joined.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left")
    rest = keyed.where("NOT __may").withColumn("c", F.col("node"))
    return few.withColumn("c", F.coalesce("c", "node")).unionByName(rest).drop("__may")


def similar_pairs(texts: DataFrame, prints: DataFrame, width: int, p: int, q: int, radius: int) -> DataFrame:
    """u > v: links that connect all nodes whose similarity is p / q or more, in chains. texts: node, text; rows of one node are equal.

    prints: key (the node) and fp, the fingerprint of its shingles, for each row of `texts`; written.
    """
    close = written(confirmed(texts, written(fingerprint_links(prints, radius), "close"), width, p, q), "linked")
    made = prefixes(texts, width, p, q)
    posted = labelled(made.select("node", "n", "tokens"), components(close)).select("node", "n", "c", F.posexplode("tokens").alias("at", "g"))
    # Counted in parts and looked up by runs: one shingle may be in a third of all texts. Copies and what is linked already need no list.
    shared = written(posted.groupBy("g").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("g"), "shared")
    several = looked_up(marked(posted.drop("c"), F.col("g"), shared, F.col("g")).where("__may").drop("__may"), shared, "g", F.col("node"))
    lists = written(several.dropDuplicates(["g", "node"]), "lists")
    # Marks are looked up for those alone that share a shingle.
    marks = made.select("node", "m").join(lists.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    may = written(in_tiles(lists.join(marks, "node"), lambda batches: near_lists(batches, p, q), "m"), "may")
    return close.unionByName(confirmed(texts, may, width, p, q))


def confirmed(texts: DataFrame, may: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """u > v: links that connect, in chains, all similar pairs inside the components of the written links `may`: in each, texts are compared by all their shingles."""
    joined = components(may)
    groups = written(joined.select(F.col("u").alias("node"), F.col("v").alias("g")).union(joined.select("v", "v")).distinct(), "groups")
    few = marked(texts, F.col("node"), groups, F.col("node")).where("__may").select("node", "text")
    chosen = few.join(groups, "node").dropDuplicates(["node"])
    held = sets(chosen, width, "g", "node").withColumns({"n": F.size("s"), "at": F.lit(0)})
    return in_tiles(held, lambda batches: forests(batches, similar(p, q), "s"), "s")


def without_near_copies(docs: DataFrame, width: int = 5, p: int = 4, q: int = 5, seed: int = 42, radius: int = 2) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their component; links join texts whose Jaccard similarity is p / q or more.

    Shingles are `width` words in lower case. Null and empty texts and those of white space equal each other; a null doc_id
    stays only in a component that has no other, and of equal rows one stays; no rows give no rows. `seed` and `radius` are
    those of operator 7's fingerprints; they decide what it finds first, not what is found.
    """
    prints = fingerprints(docs, width, seed)
    rows = prints.select("doc_id", "key", F.col("key").alias("fp"))
    texts = docs.select(F.xxhash64(ascii_lower(text_of())).alias("node"), text_of().alias("text"))
    return keep_one(docs, grouped(rows, lambda fps: similar_pairs(texts, prints, width, p, q, radius)))
