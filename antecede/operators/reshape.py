"""Wide, tall and matchup rows. Columns are made in one select from the table's own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def materialise(df: DataFrame, keep: list[str], suffix: str) -> DataFrame:
    """`keep`, and every column that ends in `suffix`, without it: one table's features for training, another's for serving."""
    return df.select(*keep, *(F.col(c).alias(c[: -len(suffix)]) for c in df.columns if c.endswith(suffix)))


def fuse_opponent(df: DataFrame, prefix: str = "opp_") -> DataFrame:
    """Each pair x and opp_x becomes x - opp_x."""
    pairs = [c for c in df.columns if prefix + c in df.columns]
    return df.select(*((F.col(c) - F.col(prefix + c)).alias(c) if c in pairs else F.col(c) for c in df.columns if not (c.startswith(prefix) and c[len(prefix) :] in pairs)))


def pivot_roles(df: DataFrame, keys: list[str], role: str, roles: list[str], values: list[str], strict: bool = True) -> DataFrame:
    """<role>_<value> columns; `strict` fails if a role is repeated in a group."""
    if strict and (bad := df.where(F.col(role).isin(roles)).groupBy(*keys, role).count().where("count > 1").first()):
        raise ValueError(f"repeated role: {bad.asDict()}")
    made = [F.max(F.when(F.col(role) == x, F.col(v))).alias(f"{x}_{v}") for x in roles for v in values]
    return df.groupBy(*keys).agg(*made)


def to_wide(df: DataFrame, keys: list[str], side: str, sides: tuple[str, str], values: list[str]) -> DataFrame:
    return pivot_roles(df, keys, side, list(sides), values, False)


def to_tall(df: DataFrame, keys: list[str], side: str, sides: tuple[str, str], values: list[str]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(x).alias(side), *(F.col(f"{x}_{v}").alias(v) for v in values)) for x in sides))
    return df.select(*keys, F.explode(parts).alias("__p")).select(*keys, "__p.*")


def matchup_rows(df: DataFrame, game: str, order: list[str], numbers: list[str], context: list[str], labels: list[str], result: str) -> DataFrame:
    """One row a game, the same whichever side comes first: delta_<number> (first minus second), context_<c> (null where the two disagree), pair_<label>, sorted.

    Games that don't have two rows are left out.
    """
    k = Window.partitionBy(game).orderBy(*order)
    df = df.withColumns({"__k": F.row_number().over(k), "__n": F.count("*").over(Window.partitionBy(game))}).where("__n = 2")
    of = lambda c, i: F.max(F.when(F.col("__k") == i, F.col(c)))
    made: list[Column] = [(of(c, 1) - of(c, 2)).alias(f"delta_{c}") for c in numbers]
    made += [F.when(F.min(c).eqNullSafe(F.max(c)), F.max(c)).alias(f"context_{c}") for c in context]
    made += [F.array_join(F.array_sort(F.collect_list(F.coalesce(F.col(c).cast("string"), F.lit("")))), "|").alias(f"pair_{c}") for c in labels]
    return df.groupBy(game).agg(*made, of(result, 1).alias("first_won"))


def total_rows(df: DataFrame, game: str, side: str, sides: tuple[str, str], numbers: list[str], target: str, tolerance: float = 1e-9) -> DataFrame:
    """One row a game: <side>_<n> for both sides and their mean, absdiff and sum (null if either is), and the target if both agree on it."""
    of = lambda c, s: F.max(F.when(F.col(side) == s, F.col(c)))
    a, b = sides
    made: list[Column] = []
    for c in numbers:
        x, y = of(c, a), of(c, b)
        made += [x.alias(f"{a.lower()}_{c}"), y.alias(f"{b.lower()}_{c}"), ((x + y) / 2).alias(f"mean_{c}"), F.abs(x - y).alias(f"absdiff_{c}"), (x + y).alias(f"sum_{c}")]
    agree = F.abs(of(target, a) - of(target, b)) <= tolerance
    return df.groupBy(game).agg(*made, F.when(agree, of(target, a)).alias(target))


def collapse_pair(df: DataFrame, game: str, time: str, id_: str, result: str) -> DataFrame:
    """game, started, ids (sorted), winner, reasons: two rows of a game in one record; reasons say why it isn't valid."""
    out = df.groupBy(game).agg(
        F.min(time).alias("started"), F.array_sort(F.collect_set(id_)).alias("ids"), F.max_by(id_, result).alias("winner"), F.count("*").alias("n"), F.count(id_).alias("n_ids"), F.count(result).alias("n_results"), F.sum(result).alias("wins")
    )
    from antecede.operators.joins import reasons

    why = reasons({"rows": F.col("n") != 2, "ids": (F.size("ids") != 2) | (F.col("n_ids") != F.col("n")), "null result": F.col("n_results") != F.col("n"), "winners": F.coalesce(F.col("wins"), F.lit(0)) != 1})
    return out.select(game, "started", "ids", F.when(F.size(why) == 0, F.col("winner")).alias("winner"), why.alias("reasons"))


def group_totals(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """total_<column>: the group's sum on each of its rows; 0 where all are null."""
    w = Window.partitionBy(*keys)
    return df.withColumns({f"total_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns})
