"""Running values of an entity whose rows are too many for one task, by a scan in three steps.

A key with more than MOST rows is cut into slices of whole days, of about MOST rows each. What a window
makes is made inside (key, slice); each slice's total (a sum, a count, a last known value) is one row;
those few rows are scanned in order of the slices, and what came before a slice is added to each of its
rows. So no task gets such an entity whole. Keys with fewer rows are one slice, and where no key has
more, nothing is cut and the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.keys import BROADCAST_ROWS, sized
from antecede.sources.tables import written

#: Rows of a key that stay together.
MOST = 1_000_000
SLICE = "__slice"


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def sliced(df: DataFrame, key: Sequence[str], time: str, most: int | None = None) -> DataFrame | None:
    """`df` with `__slice`, the number of a row's slice of its key; None if no key has more than `most` rows.

    A day is never cut, so rows of one time are in one slice. Rows without a time are in the first one.
    """
    most = MOST if most is None else most
    if not df.select(*key).limit(most + 1).count() > most:
        return None
    hot = df.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*key)
    hot = written(hot, "hot")
    if hot.isEmpty():
        return None
    day = F.to_date(time).alias("__day")
    days = df.select(*key, day).alias("a").join(sized(hot).alias("b"), same("a", "b", key)).select("a.*").groupBy(*key, "__day").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = written(days.select(*key, "__day", F.floor(before / most).cast("int").alias(SLICE)), "slices")
    rows = df.withColumn("__day", F.to_date(time)).alias("a").join(sized(cut).alias("b"), same("a", "b", [*key, "__day"]), "left")
    return rows.select("a.*", F.coalesce(f"b.{SLICE}", F.lit(0)).alias(SLICE)).drop("__day")


def carried(rows: DataFrame, key: Sequence[str], totals: dict[str, Column], scan: dict[str, Column]) -> DataFrame:
    """`rows` (as `sliced` gives them) with what `scan` makes of all earlier slices' `totals`; null in the first slice.

    totals: aggregates of a slice; scan: aggregates over them, which see the earlier slices of a key in order.
    """
    own = rows.groupBy(*key, SLICE).agg(*(c.alias(n) for n, c in totals.items()))
    earlier = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.select(*key, SLICE, *(c.over(earlier).alias(n) for n, c in scan.items())).where(F.col(SLICE) > 0)
    # Only cut keys have later slices: the side has one row for each MOST rows of them.
    sums = sized(written(sums, "carried"))
    return rows.alias("a").join(sums.alias("b"), same("a", "b", [*key, SLICE]), "left").select("a.*", *(F.col(f"b.{n}") for n in scan))


#: Runs into which rows are dealt before they meet a side that is too large to broadcast.
RUNS = 64


def attached(rows: DataFrame, side: DataFrame, key: Sequence[str]) -> DataFrame:
    """`rows` with the other columns of the one row that the written `side` has for each `key`, null where it has none; a null key is a key.

    A small side is broadcast. For a larger one rows are dealt into runs by a hash of all their columns, and a row of the side
    goes to each run that has its key; so rows of a common key are in many tasks, and the side is met once a run.
    """
    new = [c for c in side.columns if c not in key]
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.alias("a").join(F.broadcast(side).alias("b"), same("a", "b", key), "left").select("a.*", *(F.col(f"b.{c}") for c in new))
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = rows.withColumn("__run", F.pmod(F.xxhash64(*plain), F.lit(RUNS)).cast("int"))
    wanted = dealt.select("__run", *key).distinct()
    by_run = wanted.alias("a").join(side.alias("b"), same("a", "b", key)).select("a.*", *(F.col(f"b.{c}") for c in new))
    at = ["__run", *key]
    return dealt.alias("a").join(by_run.alias("b"), same("a", "b", at), "left").select("a.*", *(F.col(f"b.{c}") for c in new)).drop("__run")
