"""Sessions and series: runs of rows of one key in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def strict_runs(df: DataFrame, by: list[str], order: list[str], seq: str, gap: Column) -> DataFrame:
    """run (null before the first start) and reason. A run starts at sequence 1 and ends at its first bad row.

    gap: whether a row is too far from the one before it, in a column made by the caller; from the first bad row on, rows are rejected: that one
    for what it breaks, those after it because they don't start at 1.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumns({"__start": (F.col(seq) == 1).cast("int"), "__prev": F.lag(seq).over(w), "__far": gap})
    df = df.withColumn("__run", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bad = F.when((F.col("__start") == 0) & (F.col("__run") > 0), F.when(F.col(seq) != F.col("__prev") + 1, "sequence").when(F.col("__far"), "gap"))
    df = df.withColumn("__bad", bad)
    inside = Window.partitionBy(*by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max(F.col("__bad").isNotNull()).over(inside)
    reason = F.when((F.col("__run") == 0) | F.coalesce(earlier, F.lit(False)), "does not start at 1").otherwise(F.col("__bad"))
    return df.withColumn("reason", reason).withColumn("run", F.when(F.col("reason").isNull(), F.col("__run"))).drop("__start", "__prev", "__far", "__run", "__bad")


def lenient_runs(df: DataFrame, by: list[str], order: list[str], seq: str, time: str, seconds: int, rising: bool = True) -> DataFrame:
    """run: a new one at sequence 1, at a sequence that doesn't rise (if it must), or after a gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) > seconds * 1_000_000
    falls = F.coalesce(F.col(seq) <= F.lag(seq).over(w), F.lit(True)) if rising else F.lag(seq).over(w).isNull()
    starts = (F.col(seq) == 1) | falls | F.coalesce(gap, F.lit(False))
    return df.withColumn("__s", starts.cast("int")).withColumn("run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def running_score(df: DataFrame, by: list[str], order: list[str], won: str) -> DataFrame:
    """wins_before, losses_before, lead_before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    wins, losses = (F.coalesce(F.sum((F.col(won) == k).cast("int")).over(w), F.lit(0)) for k in (1, 0))
    return df.withColumns({"wins_before": wins, "losses_before": losses, "lead_before": wins - losses})


def classify_runs(df: DataFrame, run: list[str], order: list[str], won: str, phase: str, singles: float = 0.95, least: int = 20) -> DataFrame:
    """run, maps, wins_a, wins_b, best_of, id. Best of 1, 3 or 5 by the winner's count, with no map after the clinch.

    A single map is a best of 1 only where at least `singles` of `least` or more runs of its phase are single.
    """
    scored = running_score(df, run, order, won)
    runs = scored.groupBy(*run).agg(
        F.count("*").alias("maps"), F.sum(won).alias("wins_a"), F.sum(1 - F.col(won)).alias("wins_b"), F.max(F.greatest("wins_before", "losses_before")).alias("before_last"), F.min(phase).alias("phase"),
        F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[order[-1]].cast("string")), "|"), 256), 1, 16).alias("id"),
    )
    phases = runs.groupBy("phase").agg(F.avg((F.col("maps") == 1).cast("double")).alias("single"), F.count("*").alias("n"))
    top = F.greatest("wins_a", "wins_b")
    clinched = (F.col("before_last") < top) & (F.col("wins_a") != F.col("wins_b"))
    kind = F.when((F.col("maps") == 1) & (F.col("single") >= singles) & (F.col("n") >= least), 1).when(clinched & (top == 2), 3).when(clinched & (top == 3), 5)
    return runs.join(phases, "phase").select(*run, "phase", "maps", "wins_a", "wins_b", kind.alias("best_of"), "id")


def trailing_streak(df: DataFrame, by: str, order: list[str], exact: Column) -> DataFrame:
    """by, streak: how many of the latest rows in a row are exact."""
    latest_first = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__miss", F.max((~F.coalesce(exact, F.lit(False))).cast("int")).over(latest_first)).groupBy(by).agg(F.count_if(F.col("__miss") == 0).alias("streak"))


def modal_recent(df: DataFrame, by: str, game: str, time: str, value: str, games: int = 10) -> DataFrame:
    """by, modal, share, seen, alternates: the commonest value of the last `games` games; ties by latest time, then by name."""
    recent = df.withColumn("__r", F.dense_rank().over(Window.partitionBy(by).orderBy(F.col(time).desc(), F.col(game).desc()))).where(F.col("__r") <= games)
    counts = recent.groupBy(by, value).agg(F.count_distinct(game).alias("n"), F.max(time).alias("last"))
    total = recent.groupBy(by).agg(F.count_distinct(game).alias("seen"))
    best = counts.groupBy(by).agg(F.max(F.struct("n", "last", value)).alias("b"), (F.count("*") - 1).alias("alternates"))
    return best.join(total, by).select(by, F.col(f"b.{value}").alias("modal"), (F.col("b.n") / F.col("seen")).alias("share"), "seen", "alternates")


def latest_stint(df: DataFrame, by: str, order: list[str], value: str, time: str) -> DataFrame:
    """by, value, start, last_seen, games of the run of equal values that is the entity's latest."""
    w = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    out = df.withColumn("__c", changed).withColumn("__s", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__s = 0")
    return out.groupBy(by, value).agg(F.min(time).alias("start"), F.max(time).alias("last_seen"), F.count("*").alias("games"))


def first_of_series(manifest: DataFrame, ids: str, rows: DataFrame, key: str) -> DataFrame:
    """The rows of each series' first map."""
    return manifest.withColumn(key, F.try_element_at(F.col(ids), F.lit(1))).join(rows, key)


def expand_series(manifest: DataFrame, ids: str, won: str, rows: DataFrame, key: str) -> DataFrame:
    """Every later map of a series with the rows of its first: map (from 2), map_id, wins_before, losses_before.

    ids and won are arrays of one length, in order.
    """
    maps = manifest.withColumn(key, F.try_element_at(F.col(ids), F.lit(1))).select("*", F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(won).alias("won"))).alias("__p", "__m"))
    earlier = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.coalesce(F.sum((F.col("__m.won") == 1).cast("int")).over(earlier), F.lit(0)).cast("int")
    losses = F.coalesce(F.sum((F.col("__m.won") == 0).cast("int")).over(earlier), F.lit(0)).cast("int")
    later = maps.withColumns({"map": F.col("__p") + 1, "map_id": F.col("__m.id"), "wins_before": wins, "losses_before": losses}).where("__p > 0")
    return later.drop("__p", "__m").join(rows, key)
