"""Bootstrap samples of exactly as many clusters as there are, drawn with replacement, without joining a sample to anything.

How often each cluster is drawn is multinomial. Clusters are dealt into cells by a hash, and the cells are
the leaves of a binary tree: a node's draws are split between its halves by a binomial whose odds are the
halves' numbers of clusters, and inside a cell they are spread evenly at random. Each node draws from a
generator of its own, seeded by its place in the tree, for all samples at once. So every task walks from
the root to its own cells alone, and all tasks agree on the nodes that they share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from antecede.keys import sized
from antecede.operators.slices import same
from antecede.sources.tables import written

#: Clusters in a cell, about.
CELL = 256


def generator(seed: int, group: str, *place: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(group.encode()), *place])


def cell_draws(seed: int, group: str, bits: int, cell: int, sizes: list[int], samples: int) -> np.ndarray:
    """How many draws fall into a cell in each sample. sizes: clusters of each node from the root down to the cell."""
    n = np.full(samples, sizes[0], np.int64)
    for level in range(bits):
        node, right = cell >> (bits - level), cell >> (bits - level - 1) & 1
        left = sizes[level] - sizes[level + 1] if right else sizes[level + 1]
        drawn = generator(seed, group, 1, level, node).binomial(n, left / sizes[level])
        n = n - drawn if right else drawn
    return n


def spread(seed: int, group: str, cell: int, n: np.ndarray, clusters: int) -> np.ndarray:
    """samples x clusters: the draws of each cluster of a cell."""
    return generator(seed, group, 2, cell).multinomial(n, np.full(clusters, 1 / clusters))


def drawn_sums(df: DataFrame, by: list[str], num: str, den: str, cluster: str, samples: int, seed: int) -> DataFrame:
    """by, sample, a, b, draws: sums of `num` and `den` over the clusters of each sample, as often as they are drawn; draws adds up to the clusters of the group."""
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    sums = df.groupBy(*by, cluster).agg(F.sum(num).cast("double").alias("a"), F.sum(den).cast("double").alias("b"))
    sums = written(sums.select(*by, group.alias("__g"), F.xxhash64(cluster).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")), "clusters")
    totals = sums.groupBy("__g").agg(F.count("*").alias("n"))
    bits = F.greatest(F.ceil(F.log2(F.col("n") / CELL)), F.lit(0)).cast("int")
    placed = sums.join(sized(totals.withColumn("bits", bits)), "__g").withColumn("cell", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")))
    leaves = placed.groupBy("__g", "n", "bits", "cell").agg(F.count("*").alias("m"))
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("bits")))).withColumn("node", F.expr("shiftright(cell, bits - level)"))
    nodes = up.groupBy("__g", "level", "node").agg(F.sum("m").alias("size"))
    paths = up.select("__g", "cell", "level", "node").join(nodes, ["__g", "level", "node"]).groupBy("__g", "cell").agg(F.array_sort(F.collect_list(F.struct("level", "size"))).alias("p"))
    paths = paths.select("__g", "cell", F.transform("p", lambda x: x["size"]).alias("sizes"))
    units = placed.select("__g", "bits", "cell", "h", "a", "b").join(paths, ["__g", "cell"]).repartition("__g", "cell").sortWithinPartitions("__g", "cell", "h", "a", "b")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        unit, rows = None, []

        def close() -> None:
            g, cell, bits, sizes = unit
            k = spread(seed, g, cell, cell_draws(seed, g, bits, cell, sizes, samples), len(rows))
            sums = held.setdefault(g, np.zeros((3, samples)))
            a, b = np.array(rows).T
            sums += np.stack([k @ a, k @ b, k.sum(1)])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("__g", "cell", "bits", "sizes", "a", "b"))
            for g, cell, bits, sizes, a, b in zip(*columns, strict=True):
                if unit is None or (g, cell) != unit[:2]:
                    if unit is not None:
                        close()
                    unit, rows = (g, cell, bits, sizes), []
                rows.append((a, b))
        if unit is not None:
            close()
        for g, sums in held.items():
            arrays = [pa.array([g] * samples), pa.array(range(samples), pa.int32()), *(pa.array(x) for x in sums[:2]), pa.array(np.rint(sums[2]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["__g", "sample", "a", "b", "draws"])

    found = units.mapInArrow(drawn, "__g string, sample int, a double, b double, draws long").groupBy("__g", "sample").agg(*(F.sum(c).alias(c) for c in ("a", "b", "draws")))
    if not by:
        return found.drop("__g")
    names = sums.select("__g", *by).distinct()
    return found.join(sized(names), "__g").select(*by, "sample", "a", "b", "draws")


#: Cells into which a round cuts what is left of a group's values.
PARTS = 1024


def group_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], out: str = "q", most: int | None = None) -> DataFrame:
    """by, `out` (array): exact quantiles of each group, linear between neighbours; nulls don't count, a group without values has none.

    Groups of at most `most` values are put in order where they meet. Of a larger one no task gets all values: counts of PARTS
    cells between its least and largest value tell in which one a wanted rank lies, that cell's own least and largest bound the
    next round, and so on until what is left has one value, or few enough.
    """
    from antecede.operators import slices

    most = slices.MOST if most is None else most
    x = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    plain = lambda d: d.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, shares))).alias(out))
    if x.limit(most + 1).count() <= most:
        return plain(x)
    large = written(x.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("low"), F.max("__v").alias("high")).where(F.col("__n") > most), "large")
    if large.isEmpty():
        return plain(x)
    on = lambda a, b: same(a, b, by)
    rest = x.alias("a").join(sized(large.select(*by)).alias("b"), on("a", "b"), "left_anti")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(s).alias("s")) for k, s in enumerate(shares) for i in (0, 1))))
    wanted = large.select(*by, "low", "high", F.col("__n").alias("inside"), at.alias("w"), "__n").select(*by, "w.k", "w.i", F.least(F.floor(F.col("w.s") * (F.col("__n") - 1)).cast("long") + F.col("w.i"), F.col("__n") - 1).alias("r"), "low", "high", "inside")
    keys = [*by, "k", "i"]
    wanted = written(wanted, "wanted")
    while True:
        some = wanted.where((F.col("inside") > most) & (F.col("low") < F.col("high")))
        if some.isEmpty():
            break
        met = x.alias("a").join(sized(some).alias("b"), on("a", "b") & F.col("__v").between(F.col("low"), F.col("high"))).select(*(f"b.{c}" for c in keys), "r", "low", "high", "__v")
        # Halved first, so that no width overflows.
        share = (F.col("__v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        cells = met.groupBy(*keys, "r", F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).alias("cell")).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell"))
        chosen = cells.withColumn("before", upto - F.col("n")).where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n")))
        narrowed = chosen.select(*keys, (F.col("r") - F.col("before")).alias("r"), "low", "high", F.col("n").alias("inside"))
        wanted = written(narrowed.unionByName(wanted.where((F.col("inside") <= most) | (F.col("low") >= F.col("high")))), "wanted")
    last = x.alias("a").join(sized(wanted).alias("b"), on("a", "b") & F.col("__v").between(F.col("low"), F.col("high"))).groupBy(*(F.col(f"b.{c}") for c in keys), "r", "__v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("__v"))
    hits = last.withColumn("before", upto - F.col("n")).where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n")))
    pairs = hits.groupBy(*by, "k").agg(F.max_by("__v", -F.col("i")).alias("a"), F.max_by("__v", F.col("i")).alias("b"))
    both = pairs.alias("p").join(sized(large).alias("l"), on("p", "l")).withColumn("at", F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1) * (F.col("__n") - 1))
    line = both.select(*(f"p.{c}" for c in by), "k", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("v"))
    exact = line.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("__q")).select(*by, F.transform("__q", lambda q: q["v"]).alias(out))
    return plain(rest).unionByName(exact)
