"""History queries: customers as entities, their orders as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.keys import EntitySpec
from antecede.operators import history as h
from antecede.plans.duels import DUELS, duels
from antecede.plans.registry import Tables, query, r

ORDER = EntitySpec(("o_custkey",), "o_orderdate", ("o_orderkey",))
SUPPLY = EntitySpec(("l_suppkey",), "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))
PLAYER = EntitySpec(("entity",), "played", ("game",))
BEFORE = "(PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query(f"""SELECT o_orderkey, o_custkey, date_diff('day', max(o_orderdate) OVER {BEFORE}, o_orderdate) AS days_since_previous,
    round(avg(o_totalprice) OVER {BEFORE}, 4) AS prior_mean_price,
    round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS recent5_price,
    count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS same_priority_before
    FROM orders""")
def flagship_customer_history(t: Tables) -> DataFrame:
    """Several histories of a customer from one scan and one shuffle."""
    df = h.days_since_previous(t.orders, ORDER)
    df = h.prior_mean(df, ORDER, {"prior_mean_price": "o_totalprice"})
    df = h.recent_mean(df, ORDER, "o_totalprice", 5, "recent5_price")
    df = df.withColumn("same_priority_before", F.count("*").over(ORDER.earlier_times("o_orderpriority")))
    return df.select("o_orderkey", "o_custkey", "days_since_previous", r("prior_mean_price", 4), r("recent5_price", 4), "same_priority_before")


@query(f"SELECT o_orderkey, date_diff('day', max(o_orderdate) OVER {BEFORE}, o_orderdate) AS days_since_previous FROM orders")
def e1_days_since_previous(t: Tables) -> DataFrame:
    return h.days_since_previous(t.orders, ORDER).select("o_orderkey", "days_since_previous")


@query(f"""SELECT o_orderkey, CASE WHEN date_diff('day', max(o_orderdate) OVER {BEFORE}, o_orderdate) > 45 THEN 1 ELSE 0 END AS after_break,
    CASE WHEN row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1 THEN 1 ELSE 0 END AS first_of_season FROM orders""")
def e2_break_flags(t: Tables) -> DataFrame:
    return h.break_flags(t.orders.withColumn("season", F.year("o_orderdate")), ORDER, "season").select("o_orderkey", "after_break", "first_of_season")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_partkey, l_quantity, round(avg(l_extendedprice) OVER w, 4) AS price_before, round(avg(l_discount) OVER w, 6) AS discount_before
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def e3_prior_mean(t: Tables) -> DataFrame:
    df = h.prior_mean(t.lineitem, SUPPLY, {"price_before": "l_extendedprice", "discount_before": "l_discount"})
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_partkey", "l_quantity", r("price_before", 4), r("discount_before"))


@query("""SELECT o_orderkey, round(coalesce(sum(v) OVER w, 0) / nullif(count(*) OVER w, 0), 4) AS price_before FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders)
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def e3_prior_mean_by_row(t: Tables) -> DataFrame:
    df = t.orders.withColumn("v", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return h.prior_mean_by_row(df, ORDER, "v", "price_before").select("o_orderkey", r("price_before", 4))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS recent FROM orders")
def e4_recent_mean(t: Tables) -> DataFrame:
    return h.recent_mean(t.orders, ORDER, "o_totalprice", 5, "recent").select("o_orderkey", r("recent", 4))


_w = "(PARTITION BY o_custkey, {g} ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
_e5 = ", ".join(
    f"round(avg(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END) OVER {_w.format(g=g)}, 4) AS o_totalprice_{n}_{a}" for a, g in (("season", "year(o_orderdate)"), ("patch", "year(o_orderdate), quarter(o_orderdate)")) for n, s in (("filled", "F"), ("open", "O"))
)


@query(f"SELECT o_orderkey, {_e5} FROM orders")
def e5_conditional_prior_means(t: Tables) -> DataFrame:
    df = t.orders.withColumns({"season": F.year("o_orderdate"), "patch": F.concat_ws(".", F.year("o_orderdate"), F.quarter("o_orderdate"))})
    df = h.conditional_prior_means(df, ORDER, ["o_totalprice"], {"filled": "o_orderstatus = 'F'", "open": "o_orderstatus = 'O'"}, ["season", "patch"])
    return df.select("o_orderkey", *(r(f"o_totalprice_{n}_{g}", 4) for g in ("season", "patch") for n in ("filled", "open")))


@query(f"""{DUELS} SELECT game, entity, opponent, count(result) OVER w AS h2h_games, coalesce(sum(result) OVER w, 0)::BIGINT AS h2h_wins,
    CASE WHEN count(result) OVER w >= 2 THEN round(sum(result) OVER w / count(result) OVER w, 6) END AS h2h_rate FROM (SELECT *, entity % 20 AS e, opponent % 20 AS o FROM duels)
    WINDOW w AS (PARTITION BY e, o ORDER BY played RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def e6_head_to_head(t: Tables) -> DataFrame:
    df = duels(t).withColumns({"e": F.col("entity") % 20, "o": F.col("opponent") % 20})
    df = h.head_to_head(df, EntitySpec(("e",), "played", ("game",)), "o", "result")
    return df.select("game", "entity", "opponent", "h2h_games", "h2h_wins", r("h2h_rate"))


EWM = """, numbered AS (SELECT *, count(v) OVER (PARTITION BY {key} ORDER BY {at}, {tie} ROWS UNBOUNDED PRECEDING) AS i FROM rows_),
points AS (SELECT *, v AS x FROM numbered WHERE v IS NOT NULL),
after_ AS (SELECT {keys_b}, n.{tie} AS tie, n.{at} AS at_, sum(p.x * pow(2.0, (p.i - n.i) / 9.0)) / sum(pow(2.0, (p.i - n.i) / 9.0)) AS ema_after
    FROM numbered n LEFT JOIN points p ON {same} AND p.i <= n.i GROUP BY ALL),
lagged AS (SELECT *, lag(ema_after) OVER (PARTITION BY {key} ORDER BY at_, tie) AS before_ FROM after_),
ewm AS (SELECT *, first_value(before_) OVER (PARTITION BY {key}, at_::DATE ORDER BY at_, tie ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ema_before FROM lagged)
"""


def ewm_sql(source: str, keys: list[str], at: str, tie: str, prefix: str = "WITH ") -> str:
    return f"{prefix}rows_ AS ({source})" + EWM.format(key=", ".join(keys), at=at, tie=tie, keys_b=", ".join(f"n.{k} AS {k}" for k in keys), same=" AND ".join(f"n.{k} = p.{k}" for k in keys))


@query(ewm_sql("SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS v FROM orders", ["o_custkey"], "o_orderdate", "o_orderkey") + "SELECT tie AS o_orderkey, round(ema_before, 4) AS ema_v_before, round(ema_after, 4) AS ema_v_after FROM ewm")
def e7_ewm(t: Tables) -> DataFrame:
    df = t.orders.withColumn("v", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")))
    return h.ewm(df, ORDER, "v").select("o_orderkey", r("ema_v_before", 4), r("ema_v_after", 4))


@query(
    ewm_sql("SELECT *, result::DOUBLE AS v, year(played) AS season FROM duels", ["entity", "season"], "played", "game", DUELS + ", ")
    + """SELECT tie AS game, entity, round(coalesce(ema_before, 0.5), 6) AS win_rate_before,
    round((1 - pow(pow(2, -1 / 9.0), min(n) OVER (PARTITION BY entity, season, at_::DATE))) / (1 - pow(2, -1 / 9.0)), 6) AS effective_games_before
    FROM (SELECT *, row_number() OVER (PARTITION BY entity, season ORDER BY at_, tie) - 1 AS n FROM ewm)"""
)
def e8_seasonal_win_rate(t: Tables) -> DataFrame:
    df = duels(t).withColumns({"season": F.year("played"), "won": F.col("result").cast("double")})
    df = h.ewm(df, PLAYER, "won", by=("season",), prior=0.5)
    return h.effective_games(df, PLAYER, ("season",)).select("game", "entity", r("ema_won_before", name="win_rate_before"), r("effective_games_before"))


_sides = ewm_sql("SELECT *, result::DOUBLE AS v FROM duels", ["entity", "side"], "played", "game", DUELS + ", ") + """,
both_ AS (SELECT *, last_value(CASE WHEN side = 'Blue' THEN ema_after END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN side = 'Red' THEN ema_after END IGNORE NULLS) OVER w AS rd
    FROM ewm WINDOW w AS (PARTITION BY entity ORDER BY at_, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sided AS (SELECT tie AS game, entity, side, coalesce(first_value(b) OVER d, 0.5) AS blue, coalesce(first_value(rd) OVER d, 0.5) AS red
    FROM both_ WINDOW d AS (PARTITION BY entity, at_::DATE ORDER BY at_, tie ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
"""


@query(_sides + "SELECT game, entity, round(blue, 6) AS ema_Blue_before, round(red, 6) AS ema_Red_before FROM sided")
def e9_side_win_rate(t: Tables) -> DataFrame:
    df = h.side_ewm(duels(t).withColumn("won", F.col("result").cast("double")), PLAYER, "side", "won", ("Blue", "Red"))
    return df.select("game", "entity", r("ema_Blue_before"), r("ema_Red_before"))


@query(_sides + """SELECT a.game, a.entity, round(least(greatest((CASE WHEN a.side = 'Blue' THEN a.blue ELSE a.red END) / ((CASE WHEN a.side = 'Blue' THEN a.blue ELSE a.red END) + (CASE WHEN b.side = 'Blue' THEN b.blue ELSE b.red END) + 1e-8), 0), 1), 6) AS side_likelihood
    FROM sided a JOIN sided b ON a.game = b.game AND a.side <> b.side""")
def e10_likelihood(t: Tables) -> DataFrame:
    df = h.side_ewm(duels(t).withColumn("won", F.col("result").cast("double")), PLAYER, "side", "won", ("Blue", "Red"))
    mine = df.select("game", "entity", "opponent", F.when(F.col("side") == "Blue", F.col("ema_Blue_before")).otherwise(F.col("ema_Red_before")).alias("p"))
    theirs = mine.select("game", F.col("entity").alias("opponent"), F.col("p").alias("q"))
    return mine.join(theirs, ["game", "opponent"]).select("game", "entity", r(h.likelihood(F.col("p"), F.col("q")), name="side_likelihood"))


@query("SELECT event_id, user_id, first_value(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS value FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)")
def e11_freeze_day(t: Tables) -> DataFrame:
    df = t.events.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return h.freeze_day(df, EntitySpec(("user_id",), "ts", ("event_id",)), ["value"]).select("event_id", "user_id", "value")


@query("""WITH sets AS (SELECT l_suppkey AS supplier, date_trunc('month', l_shipdate) AS month, list(DISTINCT l_partkey % 9) AS now FROM lineitem GROUP BY ALL),
    seen AS (SELECT *, lag(now) OVER (PARTITION BY supplier ORDER BY month) AS old FROM sets)
    SELECT supplier, month, round(CASE WHEN len(now) = 5 AND len(old) = 5 THEN len(list_intersect(now, old)) / 5.0 END, 6) AS continuity,
           round(coalesce(1 - CASE WHEN len(now) = 5 AND len(old) = 5 THEN len(list_intersect(now, old)) / 5.0 END, 1), 6) AS uncertainty FROM seen""")
def e12_roster_continuity(t: Tables) -> DataFrame:
    df = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.date_trunc("month", "l_shipdate").alias("month"), (F.col("l_partkey") % 9).alias("p"))
    return h.roster_continuity(df, "supplier", "month", "p").select("supplier", "month", r("continuity"), r("uncertainty"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, 'latest' AS which FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 'earliest' FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def e13_latest_and_earliest(t: Tables) -> DataFrame:
    some = ["o_custkey", "o_orderkey", "o_totalprice"]
    return h.pick_row(t.orders, ORDER).select(*some, F.lit("latest").alias("which")).unionByName(h.pick_row(t.orders, ORDER, False).select(*some, F.lit("earliest").alias("which")))


@query("""WITH p AS (SELECT l_suppkey AS supplier, l_shipdate AS sold, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_discount * 100 END) AS pnl FROM lineitem GROUP BY ALL),
    e AS (SELECT *, 100 + sum(pnl) OVER (PARTITION BY supplier ORDER BY sold) AS equity FROM p),
    k AS (SELECT *, greatest(100, max(equity) OVER (PARTITION BY supplier ORDER BY sold)) AS peak FROM e)
    SELECT supplier, round(max(peak - equity), 4) AS max_drawdown, round(max((peak - equity) / peak), 6) AS max_drawdown_share FROM k GROUP BY supplier""")
def e20_drawdown(t: Tables) -> DataFrame:
    df = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("sold"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_discount") * 100).alias("pnl"))
    return h.drawdown(df, ("supplier",), ("sold",), "pnl", 100.0, net_ties=True).select("supplier", r("max_drawdown", 4), r("max_drawdown_share"))


@query("SELECT o_orderkey, o_orderpriority, round(sum(o_totalprice - 150000) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey), 3) AS running FROM orders")
def e21_cumulative_sum(t: Tables) -> DataFrame:
    df = t.orders.withColumn("pnl", F.col("o_totalprice") - 150000)
    return h.cumulative(df, ("o_orderpriority",), ("o_orderdate", "o_orderkey"), "pnl", "running").select("o_orderkey", "o_orderpriority", r("running", 3))


@query("SELECT event_id, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS accuracy FROM events")
def e27_cumulative_accuracy(t: Tables) -> DataFrame:
    df = t.events.withColumn("hit", (F.col("value") > 20).cast("double"))
    return h.cumulative(df, ("event_type",), ("ts", "event_id"), "hit", "accuracy", "avg").select("event_id", r("accuracy"))


@query("""WITH v AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority END AS patch FROM orders)
    SELECT o_orderkey, last_value(patch IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS patch FROM v""")
def b5_forward_fill(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderpriority")).alias("patch"))
    return h.forward_fill(df, "o_orderdate", ("o_orderkey",), "patch").select("o_orderkey", "patch")
