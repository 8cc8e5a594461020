"""Incremental merges, set algebra and versioned facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def key_changes(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: added, removed, updated or unchanged, by a hash of the other columns."""
    payload = [c for c in existing.columns if c not in keys]
    hashed = lambda df, n: df.select(*keys, F.xxhash64(*payload).alias(n))
    both = hashed(existing, "__old").join(hashed(incoming, "__new"), keys, "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("updated")
    return both.select(*keys, change.alias("change"))


def merge_history(existing: DataFrame, incoming: DataFrame, game: str, mode: str = "incremental") -> DataFrame:
    """full: the incoming rows alone. incremental: every old row of an incoming game goes, whichever rows the new ones have."""
    if mode == "full":
        return incoming
    return existing.join(incoming.select(game).distinct(), game, "left_anti").unionByName(incoming)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Insert only: of each key not there yet the first incoming row."""
    first = incoming.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti"))


def id_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids that only one of the two has."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("only left")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("only right")))


def supersede(versions: DataFrame, dependents: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrected, replacement: for each live dependent of a version whose facts changed, the new version's dependent of the same selection, if any.

    versions: source, at, version_id, facts; dependents: version_id, id, selection; corrections: corrected.
    """
    w = Window.partitionBy("source").orderBy("at", "version_id")
    changed = versions.withColumns({"__was": F.lag("facts").over(w), "old_id": F.lag("version_id").over(w)}).where("old_id IS NOT NULL AND NOT (facts <=> __was)").select("old_id", "version_id")
    old = dependents.select(F.col("version_id").alias("old_id"), F.col("id").alias("corrected"), "selection")
    live = changed.join(old, "old_id").join(corrections, "corrected", "left_anti")
    return live.join(dependents, ["version_id", "selection"], "left").groupBy("corrected").agg(F.min("id").alias("replacement"))


def merge_manifest(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: rows of both sides, keys added, unchanged, updated and kept, and rows after the merge; both have the same columns and unique keys."""
    a, b = existing.select(key, F.struct(*existing.columns).alias("__a")), incoming.select(key, F.struct(*existing.columns).alias("__b"))
    j = a.join(b, key, "full")
    here, there = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    same = F.col("__a").eqNullSafe(F.col("__b"))
    return j.agg(
        F.count_if(here).alias("existing_rows"), F.count_if(there).alias("incoming_rows"), F.count_if(~here).alias("added"), F.count_if(here & there & same).alias("unchanged"), F.count_if(here & there & ~same).alias("updated"), F.count_if(~there).alias("kept"), F.count("*").alias("merged_rows")
    )
