"""Closest known names by the share of their matching blocks, behind bounds that lose none; dated rewrites of names and ids."""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from antecede.keys import sized
from antecede.operators.joins import asof_join
from antecede.sources.tables import written

#: Known names in a block, about, and columns of letter counts; letters that share a column only loosen the bound.
BLOCK, LETTERS = 4_096, 128


def letter_counts(names: list[str]) -> np.ndarray:
    rows = np.repeat(np.arange(len(names)), [len(x) for x in names])
    letters = np.fromiter((ord(c) % LETTERS for x in names for c in x), np.int64)
    return np.bincount(rows * LETTERS + letters, minlength=len(names) * LETTERS).reshape(-1, LETTERS)


def closest(asked: list[str], known: list[str], most: int, least: float) -> Iterator[tuple[str, str, float]]:
    """For each asked name up to `most` of the known ones with the largest ratio: twice the letters in matching blocks, the longest
    first, by the letters of both. Letters that both hold, in any order, bound it, so only names beyond that bound are aligned."""
    counts, lengths = letter_counts(known), np.array([len(x) for x in known])
    for name, mine in zip(asked, letter_counts(asked), strict=True):
        both = lengths + len(name)
        may = np.flatnonzero(2.0 * np.minimum(counts, mine).sum(1) >= least * both - 1e-9)
        match = SequenceMatcher()
        match.set_seq2(name)
        scored = []
        for k in may.tolist():
            match.set_seq1(known[k])
            if (ratio := match.ratio()) >= least:
                scored.append((ratio, known[k]))
        for ratio, other in heapq.nlargest(most, scored):
            yield name, other, ratio


def closest_names(asked: DataFrame, name: str, known: DataFrame, most: int = 3, least: float = 0.75) -> DataFrame:
    """name, suggestion, similarity, rank: up to `most` known names (column `name`) of similarity `least` or more, in lower case.

    Of equal similarity the later in code-point order is first. Known names are dealt into blocks by length and a hash; an asked name
    visits the blocks of lengths that can reach `least` with its own. Nulls are left out, and an empty name is close to nothing but itself.
    """
    low = lambda df, c, out: df.select(F.lower(F.trim(c)).alias(out)).where(F.col(out).isNotNull()).distinct()
    a, b = low(asked, name, "word"), low(known, "name", "word")
    b = written(b.withColumn("n", F.char_length("word")), "known")
    blocks = sized(written(b.groupBy("n").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "blocks"))
    # With m letters in common, 2 m / (x + y) >= least needs a shorter name of at least least / (2 - least) of the longer one's letters.
    share = least / (2 - least)
    lengths = F.sequence(F.floor(F.char_length("word") * share - 1e-9).cast("int"), F.ceil(F.char_length("word") / F.lit(share) + 1e-9).cast("int"))
    home = b.join(blocks, "n").select("n", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("visitor"), "word")
    visits = a.withColumn("n", F.explode(lengths)).join(blocks, "n").select("n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("visitor"), "word")
    units = home.unionByName(visits).repartition("n", "part").sortWithinPartitions("n", "part", "visitor")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, residents = None, []
        for batch in batches:
            out, guests = [], []
            for n, part, visitor, word in zip(*(batch.column(c).to_pylist() for c in ("n", "part", "visitor", "word")), strict=True):
                if (n, part) != unit:
                    if residents and guests:
                        out += closest(guests, residents, most, least)
                    unit, residents, guests = (n, part), [], []
                (guests if visitor else residents).append(word)
            if residents and guests:
                out += closest(guests, residents, most, least)
            x, y, z = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(z, pa.float64())], ["name", "suggestion", "similarity"])

    found = units.mapInArrow(matched, "name string, suggestion string, similarity double")
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), F.desc("suggestion"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


#: Rewrites that are composed, at most.
MOST_RULES = 100_000
ALWAYS = dt.datetime.max
Pair = tuple[str, str]


def composed(rules: list[tuple[str, str, str, str, dt.datetime]]) -> dict[Pair, list[tuple[dt.datetime, Pair]]]:
    """What each old pair becomes, as pieces (end, pair) by end: a time takes the first piece that ends after it.

    rules: old_name, old_id, new_name, new_id, until, in the order in which they hold. They are composed backwards: a rule looks up what
    the later ones make of its new pair, and from its end on its old pair is what the later ones make of that.
    """
    known: dict[Pair, list[tuple[dt.datetime, Pair]]] = {}
    pieces = lambda pair: known.get(pair, [(ALWAYS, pair)])
    for old_name, old_id, new_name, new_id, until in reversed(rules):
        old, new = (old_name, old_id), pieces((new_name, new_id))
        before = [(min(end, until), pair) for k, (end, pair) in enumerate(new) if not k or new[k - 1][0] < until]
        known[old] = before + [(end, pair) for end, pair in pieces(old) if end > until]
    return known


def composed_rewrites(rewrites: DataFrame) -> DataFrame:
    """name, id, from, new_name, new_id: what each pair becomes from each time on (null: from the beginning) until its next row.

    rewrites: nth, old_name, old_id, new_name, new_id, until: in order of nth, rows of the old pair timed before `until` (null: always)
    take the new one, which later rewrites may change again; one with a null name or id is left out. So k rules are one as-of lookup, not
    k passes over the facts. Rules are a configuration: up to MOST_RULES are composed on the driver, more fail.
    """
    full = F.lit(True)
    for c in ("old_name", "old_id", "new_name", "new_id"):
        full = full & (F.coalesce(F.col(c), F.lit("")) != "")
    some = rewrites.where(full).select("nth", "old_name", "old_id", "new_name", "new_id", F.col("until").cast("timestamp").alias("until"))
    rows = some.orderBy("nth").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES:,} rewrites")
    made = composed([(r["old_name"], r["old_id"], r["new_name"], r["new_id"], r["until"] or ALWAYS) for r in rows])
    out = [(*pair, parts[k - 1][0] if k else None, *parts[k][1]) for pair, parts in made.items() for k in range(len(parts))]
    return rewrites.sparkSession.createDataFrame(out, "name string, id string, from timestamp, new_name string, new_id string")


def rewritten(df: DataFrame, name: str, id_: str, time: str, rewrites: DataFrame) -> DataFrame:
    """`df` with `name` and `id_` as dated rewrites in order make them (`composed_rewrites`). Rows with a null name or id stay; a null time is after every `until`."""
    made, first, last = composed_rewrites(rewrites), F.lit("0001-01-01").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")
    right = made.select(F.col("name").alias("__a"), F.col("id").alias("__b"), F.coalesce("from", first).alias("__from"), F.struct(F.col("new_name").alias("n"), F.col("new_id").alias("i")).alias("__to"))
    pairs = right.select("__a", "__b").distinct().withColumn("__named", F.lit(True))
    keyed = df.withColumns({"__a": F.col(name), "__b": F.col(id_).cast("string"), "__d": F.coalesce(F.col(time).cast("timestamp"), last)})
    # Rows of other pairs, which are nearly all, take no part in the lookup.
    keyed = keyed.join(sized(pairs), ["__a", "__b"], "left")
    found = asof_join(keyed.where("__named"), right, ["__a", "__b"], "__d", "__from", ["__to"])
    changed = found.withColumns({name: F.col("__to.n"), id_: F.col("__to.i").cast(df.schema[id_].dataType)})
    return changed.select(*df.columns).unionByName(keyed.where("__named IS NULL").select(*df.columns))
