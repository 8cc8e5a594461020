"""A two-sided view of `orders`: each order is a game between its customer and another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.plans.registry import Tables

#: `games` has one row for each game, `duels` two, in the dialect of DuckDB.
DUELS = """WITH games AS (
    SELECT o_orderkey AS game, o_orderdate AS played, o_custkey AS blue, (o_custkey + 1 + o_orderkey % 97) % (SELECT count(*) FROM customer) AS red,
           CASE WHEN (o_orderkey * 7 + o_custkey) % 2 = 0 THEN 1 ELSE 0 END AS blue_won, c_mktsegment AS league, o_totalprice AS price, o_orderpriority AS priority
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey <> (o_custkey + 1 + o_orderkey % 97) % (SELECT count(*) FROM customer)
), duels AS (
    SELECT game, played, league, price, priority, 'Blue' AS side, blue AS entity, red AS opponent, blue_won AS result, price * (1 + blue % 7) AS kills FROM games
    UNION ALL SELECT game, played, league, price, priority, 'Red', red, blue, 1 - blue_won, price * (1 + red % 7) FROM games
)"""


def games(t: Tables) -> DataFrame:
    """game, played, blue, red, blue_won, league, price, priority."""
    n = t.customer.agg(F.count("*").alias("n"))
    made = t.orders.crossJoin(F.broadcast(n)).join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return made.select(
        F.col("o_orderkey").alias("game"), F.col("o_orderdate").alias("played"), F.col("o_custkey").alias("blue"), ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 97) % F.col("n")).alias("red"),
        ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 2 == 0).cast("int").alias("blue_won"), F.col("c_mktsegment").alias("league"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
    ).where("blue <> red")


def duels(t: Tables) -> DataFrame:
    """game, played, league, price, priority, side, entity, opponent, result, kills: two rows for each game."""
    both = F.array(
        F.struct(F.lit("Blue").alias("side"), F.col("blue").alias("entity"), F.col("red").alias("opponent"), F.col("blue_won").alias("result")),
        F.struct(F.lit("Red").alias("side"), F.col("red").alias("entity"), F.col("blue").alias("opponent"), (1 - F.col("blue_won")).alias("result")),
    )
    rows = games(t).select("game", "played", "league", "price", "priority", F.explode(both).alias("s")).select("game", "played", "league", "price", "priority", "s.*")
    return rows.withColumn("kills", F.col("price") * (1 + F.col("entity") % 7))
