"""Operator 6: mixing sources to target weights by Pareto order sampling, in built-in functions only.

Each source gets a target of words: a share of the mix by weight, stopped at a multiple of its size.
A document of a source with rate r = target / size is expected in the mix r times on average: floor(r)
whole copies are certain for each of its documents, and one more is drawn for the rest of the words.
Documents are drawn with unequal odds: an inclusion probability grows with the number of binary
digits of a document's words (its class), scaled so that the expected words meet the rest, where those
that would go over 1 are certain. A document's rank is its random odds u / (1 - u) over its own
inclusion odds, with u from a hash of its doc_id; the lowest ranks are taken until the rest is met, so
samples are of fixed size. Ranks are cut into cells that are summed first, and only the cell in which
a source's target falls is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.llm.common import sized_broadcast, written

WORD = r"[^\x20\x09-\x0D]+"
#: Cells into which ranks are cut. A source's last cell has about 1/CELLS of its rows.
CELLS = 4096
U_STEPS = 1 << 52


def word_count() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int) -> Column:
    """In (0, 1), from a hash of doc_id: 52 bits, at the middle of their step."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(U_STEPS))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target. Adds the weight and the target to one row for each source.

    Sources by code point, null last, take the weights in turn. Resharing what is over `most` times
    a source's size until nothing is ends where target = min(cap, level * weight) and the targets add
    up; the level comes from sums over sources in order of cap / weight.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / F.sum("weight").over(after)
    tried = weighed.withColumn("level", level)
    # The first source, in this order, that the level doesn't lift to its cap sets it for all after it.
    held = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)
    return tried.withColumn("held", held.getField("level")).select(
        "source", "source_size", F.when(F.col("held").isNull() | (F.col("held") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("held") * F.col("weight")).alias("target")
    )


def digits(size: Column) -> Column:
    """The class of a document, by which its inclusion probability grows."""
    return F.length(F.bin(size)).cast("int")


def inclusion(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """__source, __class, p: the inclusion probability of one more copy, for each class of the sources that draw.

    p = min(1, level * class), and the level lets the expected words meet `rest`. Higher classes reach 1 first, so the
    level comes from sums over a source's classes in falling order, of which there are as many as a long has digits.
    """
    classes = rows.where("size > 0").groupBy("source", digits(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    drawn = wanted.where("part > 0").select(F.col("source").alias("__source"), "rest")
    joined = classes.join(sized_broadcast(drawn), F.col("source").eqNullSafe(F.col("__source")))
    falling = Window.partitionBy("__source").orderBy(F.desc("class"))
    above = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("class") * F.col("words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    tried = joined.withColumn("level", (F.col("rest") - above) / onward)
    held = F.max(F.when(F.col("level") * F.col("class") < 1, F.struct("class", "level"))).over(Window.partitionBy("__source"))
    levelled = tried.withColumn("held", held)
    p = F.when(F.col("held").isNull() | (F.col("class") > F.col("held.class")), F.lit(1.0)).otherwise(F.col("held.level") * F.col("class"))
    return levelled.select("__source", F.col("class").alias("__class"), p.alias("p"))


def ranked(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """`rows` (source, size, u) with their inclusion probability and rank; null where nothing is drawn."""
    same = F.col("source").eqNullSafe(F.col("__source")) & (digits(F.col("size")) == F.col("__class"))
    return rows.join(odds, same, "left").withColumn("rank", pareto_rank()).drop("__source", "__class", "p")


def plan(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each document's size and u; for each source: size, target, whole copies and the last rank taken; the inclusion probabilities."""
    rows = written(docs.select("doc_id", "source", word_count().alias("size"), uniform(seed).alias("u")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, weights, share, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    wanted = wanted.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    wanted = written(wanted.coalesce(1), "targets")
    odds = sized_broadcast(written(inclusion(rows, wanted).coalesce(1), "odds"))
    partial = sized_broadcast(wanted.where("part > 0").select(F.col("source").alias("__of"), "rest"))
    drawn = ranked(rows.where("size > 0"), odds).join(partial, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    cells = drawn.withColumn("cell", cell()).groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    so_far = Window.partitionBy("source").orderBy("cell")
    edge = cells.withColumn("upto", F.sum("words").over(so_far)).where("upto >= rest AND upto - words < rest").select(F.col("source").alias("__s"), F.col("cell").alias("__c"), (F.col("upto") - F.col("words")).alias("before"))
    edge = written(edge.coalesce(1), "cells")
    last = drawn.withColumn("cell", cell()).join(sized_broadcast(edge), F.col("source").eqNullSafe(F.col("__s")) & (F.col("cell") == F.col("__c")))
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # The document that crosses the target is taken if that comes nearer to it than stopping short.
    last = last.where((F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size"))))
    # If none of the cell is taken, everything below it still is.
    limits = last.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size")).alias("limit"))
    floor = edge.select(F.col("__s").alias("source"), F.col("__c").alias("edge"))
    chosen = wanted.alias("w").join(limits.alias("l"), F.col("w.source").eqNullSafe(F.col("l.source")), "left").join(floor.alias("f"), F.col("w.source").eqNullSafe(F.col("f.source")), "left")
    chosen = chosen.select(F.col("w.source").alias("__of"), "source_size", "target", "whole", "part", "limit", "edge")
    return rows, sized_broadcast(written(chosen.coalesce(1), "plan")), odds


def pareto_rank() -> Column:
    """Of `u` and the inclusion probability `p`; what is certain comes first."""
    return F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))


def cell() -> Column:
    return F.floor(F.col("rank") / (F.col("rank") + 1) * CELLS).cast("int")


def copies_taken() -> Column:
    """Copies of a document, from its rank and its source's plan."""
    mine = F.struct("rank", "doc_id", "size")
    drawn = F.when((F.col("part") <= 0) | F.col("rank").isNull(), F.lit(0)).when(F.col("limit").isNotNull(), (mine <= F.col("limit")).cast("int")).when(F.col("edge").isNotNull(), (cell() < F.col("edge")).cast("int")).otherwise(F.lit(1))
    return F.col("whole") + F.coalesce(drawn, F.lit(0))


def with_copies(rows: DataFrame, chosen: DataFrame, odds: DataFrame) -> DataFrame:
    joined = ranked(rows, odds).join(chosen, F.col("source").eqNullSafe(F.col("__of"))).withColumn("copies", copies_taken())
    return joined.drop("__of", "rank")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of `docs`.

    A null text has 0 words and only its source's whole copies; a null source is a source of its own, the last; equal
    doc_ids draw the same number and are taken in order of size; a source without words has the target
    0 and its documents are never taken; no rows give no rows. Other columns are not read. Reruns agree.
    """
    rows, chosen, odds = plan(docs, weights, share, most, seed)
    return with_copies(rows, chosen, odds).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as `mix` takes it."""
    _, chosen, odds = plan(docs, weights, share, most, seed)
    made = F.struct(word_count().alias("size"), uniform(seed).alias("u"))
    inner = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", made.alias("made")).select("doc", "doc_id", "source", "made.*")
    return with_copies(inner, chosen, odds).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
