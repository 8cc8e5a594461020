"""Ledger and market queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.functions import columns as c
from antecede.operators import ledger as l
from antecede.plans.duels import DUELS, games
from antecede.plans.registry import Tables, cdf_sql, query, r

#: Lines as settled tickets: stake, odds, result, pnl in decimals.
TICKETS = """WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_suppkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN l_linenumber % 2 = 0 THEN 'paper' ELSE 'live' END AS mode, l_quantity::DECIMAL(18, 2) AS stake, (1.5 + l_discount * 10)::DECIMAL(18, 4) AS odds,
    CASE WHEN l_returnflag = 'R' THEN 'win' WHEN l_returnflag = 'A' THEN 'loss' WHEN l_linestatus = 'O' THEN 'push' END AS result FROM lineitem),
    tickets AS (SELECT *, CASE result WHEN 'win' THEN stake * (odds - 1) WHEN 'loss' THEN -stake WHEN 'push' THEN 0 END AS pnl FROM k)"""


def tickets(t: Tables) -> DataFrame:
    k = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.when(F.col("l_suppkey") % 3 == 0, "USD").otherwise("EUR").alias("currency"), F.when(F.col("l_linenumber") % 2 == 0, "paper").otherwise("live").alias("mode"),
        F.col("l_quantity").cast("decimal(18,2)").alias("stake"), (1.5 + F.col("l_discount") * 10).cast("decimal(18,4)").alias("odds"), F.when(F.col("l_returnflag") == "R", "win").when(F.col("l_returnflag") == "A", "loss").when(F.col("l_linestatus") == "O", "push").alias("result"),
    )
    return k.withColumn("pnl", F.when(F.col("result") == "win", F.col("stake") * (F.col("odds") - 1)).when(F.col("result") == "loss", -F.col("stake")).when(F.col("result") == "push", F.lit(0).cast("decimal(18,2)")))


_account = "count(result) AS settled, count(*) FILTER (WHERE result IN ('win', 'loss')) AS graded, round(sum(stake)::DOUBLE, 2) AS turnover, round(sum(pnl)::DOUBLE, 4) AS pnl, round(sum(pnl)::DOUBLE / sum(stake)::DOUBLE, 6) AS roi, round(count(*) FILTER (WHERE result = 'win') / nullif(count(*) FILTER (WHERE result IN ('win', 'loss')), 0), 6) AS hit_rate"


def money(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "settled", "graded", r(F.col("turnover").cast("double"), 2, "turnover"), r(F.col("pnl").cast("double"), 4, "pnl"), r("roi"), r("hit_rate"))


@query(f"{TICKETS} SELECT mode, currency, {_account} FROM tickets WHERE result IS NOT NULL GROUP BY ALL")
def d26_accounting(t: Tables) -> DataFrame:
    return money(l.accounting(tickets(t).where("result IS NOT NULL"), ["mode", "currency"], "stake", "pnl", "result"), "mode", "currency")


@query(f"{TICKETS} SELECT currency, l_suppkey % 10 AS cohort, {_account} FROM tickets WHERE result IS NOT NULL GROUP BY ALL")
def d27_group_roi(t: Tables) -> DataFrame:
    """Money of two currencies is never added up."""
    df = tickets(t).where("result IS NOT NULL").withColumn("cohort", F.col("l_suppkey") % 10)
    return money(l.accounting(df, ["currency", "cohort"], "stake", "pnl", "result", 0.0), "currency", "cohort")


@query(f"{TICKETS}, q AS (SELECT mode, odds::DOUBLE AS accepted, CASE WHEN l_partkey % 4 <> 0 THEN 1.5 + (l_partkey % 17) / 10.0 END AS closing, l_partkey % 5 <> 0 AS verified FROM tickets), v AS (SELECT mode, CASE WHEN verified THEN 1 / closing - 1 / accepted END AS v FROM q) SELECT mode, round(avg(v), 6) AS clv, count(v) AS complete, count(*) FILTER (WHERE v IS NULL) AS missing FROM v GROUP BY mode")
def d28_closing_value(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    q = tickets(t).select("mode", F.col("odds").cast("double").alias("accepted"), F.when(k % 4 != 0, 1.5 + (k % 17) / 10).alias("closing"), (k % 5 != 0).alias("verified"))
    return l.closing_value(q, ["mode"], "accepted", "closing", "verified").select("mode", r("clv"), "complete", "missing")


@query("""WITH e AS (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k FROM events), p AS (SELECT value / 100 - 0.2 AS unit, unnest(['flat', 'kelly', 'half']) AS path, unnest([0.01, k / 1000.0, k / 2000.0]) AS f FROM e)
    SELECT path, count(*) AS n, round(sum(f * 1000), 4) AS turnover, round(sum(f * 1000 * unit), 4) AS pnl FROM p GROUP BY path""")
def d29_sizing_paths(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    df = t.events.select((F.col("value") / 100 - 0.2).alias("unit"), F.create_map(F.lit("flat"), F.lit(0.01), F.lit("kelly"), k / 1000, F.lit("half"), k / 2000).alias("paths"))
    return l.sizing_paths(df, "paths", 1000.0, "unit").select("path", "n", r("turnover", 4), r("pnl", 4))


@query(f"{TICKETS}, x AS (SELECT l_orderkey || '-' || l_linenumber AS ticket, l_orderkey AS fixture, unnest(['mode', 'currency', 'result']) AS cohort, unnest([mode, currency, result]) AS level FROM tickets) SELECT cohort, level, count(DISTINCT ticket) AS tickets, count(DISTINCT fixture) AS fixtures FROM x WHERE level IS NOT NULL GROUP BY ALL")
def d30_cohort_counts(t: Tables) -> DataFrame:
    df = tickets(t).withColumns({"ticket": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), "fixture": F.col("l_orderkey")})
    return l.cohort_counts(df, ["mode", "currency", "result"], "ticket", "fixture")


@query("""WITH x AS (SELECT user_id % 7 AS cohort, user_id * 1000 + event_id % 90 AS id, TRUE AS enrolled, event_type <> 'error' AS reviewed, event_type IN ('view', 'click', 'purchase') AND value > 3 AS recommended, event_type = 'purchase' AS result FROM events),
    g AS (SELECT cohort, count(DISTINCT id) AS enrolled, count(DISTINCT CASE WHEN reviewed THEN id END) AS reviewed, count(DISTINCT CASE WHEN recommended THEN id END) AS recommended, count(DISTINCT CASE WHEN result THEN id END) AS result FROM x GROUP BY cohort)
    SELECT *, round(reviewed / enrolled, 6) AS reviewed_share, round(recommended / reviewed, 6) AS recommended_share, round(result / recommended, 6) AS result_share, reviewed / enrolled >= 0.4 AND recommended / reviewed >= 0.4 AND result / recommended >= 0.4 AS covered FROM g""")
def d31_funnel(t: Tables) -> DataFrame:
    df = t.events.withColumns({"cohort": F.col("user_id") % 7, "id": F.col("user_id") * 1000 + F.col("event_id") % 90})
    steps = {"enrolled": F.lit(True), "reviewed": F.col("event_type") != "error", "recommended": F.col("event_type").isin("view", "click", "purchase") & (F.col("value") > 3), "result": F.col("event_type") == "purchase"}
    out = l.funnel(df, ["cohort"], "id", steps, 0.4)
    return out.withColumns({f"{n}_share": r(f"{n}_share") for n in ("reviewed", "recommended", "result")})


@query("""WITH q AS (SELECT l_orderkey AS fixture, l_partkey % 3 AS contract, 's' || l_suppkey AS provider, round(1.2 + l_discount * 10 + l_tax, 4) AS odds, ((l_orderkey * 37) % 101 + 0.5) / 102 AS p FROM lineitem),
    g AS (SELECT fixture, contract, max((odds, provider)) AS b, list_sort(list(DISTINCT (odds, provider)), 'DESC') AS a, max(p) AS p FROM q GROUP BY ALL)
    SELECT fixture, contract, b[2] AS provider, b[1] AS odds, array_to_string(list_transform(a, lambda x: x[2]), ',') AS providers, round(1 / p, 6) AS fair_odds, round(1 / b[1], 6) AS implied, round(p * b[1] - 1, 6) AS ev FROM g""")
def d32_best_prices(t: Tables) -> DataFrame:
    q = t.lineitem.select(F.col("l_orderkey").alias("fixture"), (F.col("l_partkey") % 3).alias("contract"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("provider"), r(1.2 + F.col("l_discount") * 10 + F.col("l_tax"), 4, "odds"), (((F.col("l_orderkey") * 37) % 101 + 0.5) / 102).alias("p"))
    out = l.best_prices(q, ["fixture", "contract"], "provider", "odds", "p")
    return out.select("fixture", "contract", "provider", "odds", F.array_join("providers", ",").alias("providers"), r("fair_odds"), r("implied"), r("ev"))


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-03-01' AND l_shipdate < TIMESTAMP '1998-04-01'")
def d33_activity(t: Tables) -> DataFrame:
    return l.activity({"orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate")}, "1998-03-01", "1998-04-01")


@query("SELECT (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderpriority <> '5-LOW') AS tracked, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS resolved")
def d34_resolution_coverage(t: Tables) -> DataFrame:
    tracked = t.orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey").distinct()
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tracked.agg(F.count("*").alias("tracked")).crossJoin(tracked.join(done, "o_orderkey", "left_semi").agg(F.count("*").alias("resolved")))


@query("""WITH x AS (SELECT l_suppkey % 9 AS league, l_orderkey AS game, max(l_shipdate) AS at_ FROM lineitem GROUP BY ALL), g AS (SELECT league, count(*) FILTER (WHERE at_ > TIMESTAMP '2001-01-01') AS fresh, count(*) FILTER (WHERE at_ > TIMESTAMP '2001-01-01' AND game % 2 = 0) AS fresh_major, date_diff('day', DATE '2001-01-01', DATE '2001-03-01')::INT AS age_days FROM x GROUP BY league)
    SELECT *, concat_ws(',', CASE WHEN fresh >= 450 THEN 'games' END, CASE WHEN fresh_major >= 230 THEN 'major games' END, CASE WHEN age_days >= 60 THEN 'age' END) AS reasons FROM g""")
def d35_retrain_trigger(t: Tables) -> DataFrame:
    df = t.lineitem.select((F.col("l_suppkey") % 9).alias("league"), F.col("l_orderkey").alias("game"), F.col("l_shipdate").alias("sold"))
    return l.retrain_trigger(df, ["league"], "game", "sold", F.col("game") % 2 == 0, "2001-01-01", "2001-03-01", 450, 230, 60).withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH e AS (SELECT event_type, ts, CASE WHEN event_id % 8 <> 0 THEN value END AS value, (value / 100) AS p FROM events), o AS (SELECT event_type, max(ts) AS latest, avg((value IS NULL)::INT) AS missing, avg((NOT p BETWEEN 0.01 AND 0.99)::INT) AS extreme FROM e GROUP BY 1),
    d AS (SELECT event_type, ts::DATE AS d, count(*) AS n FROM e GROUP BY ALL), v AS (SELECT event_type, n / lag(n) OVER (PARTITION BY event_type ORDER BY d) AS m FROM d)
    SELECT event_type, 'freshness' AS "check", CASE WHEN latest < TIMESTAMP '2024-01-30 23:30:00' THEN 'warn' ELSE 'ok' END AS level, floor(epoch(latest))::DOUBLE AS metric FROM o UNION ALL SELECT event_type, 'missing', CASE WHEN missing > 0.1 THEN 'warn' ELSE 'ok' END, round(missing, 6) FROM o
    UNION ALL SELECT event_type, 'extreme', CASE WHEN extreme > 0.05 THEN 'warn' ELSE 'ok' END, round(extreme, 6) FROM o UNION ALL SELECT event_type, 'volume', CASE WHEN min(m) < 0.5 THEN 'warn' ELSE 'ok' END, round(min(m), 6) FROM v GROUP BY event_type""")
def d36_health_checks(t: Tables) -> DataFrame:
    e = t.events.select("event_type", "ts", F.when(F.col("event_id") % 8 != 0, F.col("value")).alias("value"), (F.col("value") / 100).alias("p"))
    out = l.health_checks(e, "event_type", "ts", "value", "p", "2024-01-30 23:30:00")
    return out.withColumn("metric", F.when(F.col("check") == "freshness", F.col("metric")).otherwise(r("metric")))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, round(avg(CASE WHEN k <= 5 THEN value END), 6) AS recent, round(avg(CASE WHEN k > 5 THEN value END), 6) AS before, round(avg(CASE WHEN k <= 5 THEN value END) - avg(CASE WHEN k > 5 THEN value END), 6) AS change FROM x WHERE k <= 10 GROUP BY user_id""")
def d37_drift(t: Tables) -> DataFrame:
    return l.drift(t.events, "user_id", ["ts", "event_id"], "value").select("user_id", r("recent"), r("before"), r("change"))


_had = "CASE WHEN event_type IN ('click', 'view') THEN ['id', 'ts', 'value'] ELSE ['id', 'props', 'ts', 'value'] END"


@query(f"""WITH a AS (SELECT event_type, count(*) AS n, ['id', 'props', 'ts', 'value'] AS c FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT event_type, count(*) FILTER (WHERE event_type <> 'error' OR event_id % 3 = 0) AS n, {_had} AS c FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
    j AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, a.n AS was, coalesce(b.n, 0) / nullif(a.n, 0) AS share, len(list_filter(coalesce(b.c, []), lambda x: NOT list_contains(coalesce(a.c, []), x))) + len(list_filter(coalesce(a.c, []), lambda x: NOT list_contains(coalesce(b.c, []), x))) AS ch FROM a FULL JOIN b ON a.event_type = b.event_type)
    SELECT event_type, 'volume' AS "check", CASE WHEN share < 0.5 THEN 'warn' WHEN was IS NULL THEN 'new' ELSE 'ok' END AS level, round(share, 6) AS metric FROM j UNION ALL SELECT event_type, 'schema', CASE WHEN ch > 0 THEN 'warn' ELSE 'ok' END, ch FROM j""")
def d36_report_changes(t: Tables) -> DataFrame:
    """The later half of the events against a report of the first."""
    cols = lambda *c: F.array(*map(F.lit, c))
    half = F.lit("2024-01-16").cast("timestamp")
    first = t.events.where(F.col("ts") < half).groupBy("event_type").agg(F.count("*").alias("rows")).withColumn("columns", cols("id", "props", "ts", "value"))
    later = t.events.where(F.col("ts") >= half).groupBy("event_type").agg(F.count_if((F.col("event_type") != "error") | (F.col("event_id") % 3 == 0)).alias("rows"))
    later = later.withColumn("columns", F.when(F.col("event_type").isin("click", "view"), cols("id", "ts", "value")).otherwise(cols("id", "props", "ts", "value")))
    return l.report_changes(first, later, "event_type").select("event_type", "check", "level", r("metric"))


@query("""WITH x AS (SELECT user_id, ts, event_id, (event_type = 'error')::INT AS f FROM events), g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM x), n AS (SELECT user_id, sum(f) AS n FROM g GROUP BY user_id, g)
    SELECT user_id, max(n)::BIGINT AS longest, CASE WHEN max(n) >= 3 THEN 'warn' ELSE 'ok' END AS level FROM n GROUP BY user_id""")
def d36_repeated_failures(t: Tables) -> DataFrame:
    return l.repeated_failures(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""WITH n AS (SELECT event_type, count(DISTINCT user_id) AS seen, count(DISTINCT CASE WHEN value IS NOT NULL THEN user_id END) AS measured, count(DISTINCT CASE WHEN value > 20 THEN user_id END) AS usable FROM events GROUP BY 1)
    SELECT *, round(measured / seen, 6) AS measured_share, round(usable / measured, 6) AS usable_share, measured / seen >= 0.9 AND usable / measured >= 0.9 AS covered FROM n""")
def d36_observation_funnel(t: Tables) -> DataFrame:
    out = l.funnel(t.events, ["event_type"], "user_id", {"seen": F.lit(True), "measured": F.col("value").isNotNull(), "usable": F.col("value") > 20})
    return out.select("event_type", "seen", "measured", "usable", r("measured_share"), r("usable_share"), "covered")


@query("""WITH e AS (SELECT event_type, event_id, user_id, ts >= TIMESTAMP '2024-01-16' AS late, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value * 1.1::DOUBLE ELSE value END AS p, CASE WHEN event_id % 9 <> 0 THEN value END AS f1, CASE WHEN NOT (ts >= TIMESTAMP '2024-01-16' AND event_id % 4 = 0) THEN value END AS f2 FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_type, late ORDER BY p DESC, event_id) AS k FROM e), g AS (SELECT event_type, late, quantile_cont(p, [0.1, 0.5, 0.9]) AS q, list(DISTINCT user_id) FILTER (WHERE k <= 200) AS top, avg((f1 IS NULL)::INT) AS m1, avg((f2 IS NULL)::INT) AS m2 FROM k GROUP BY ALL)
    SELECT a.event_type, round(b.q[1] - a.q[1], 6) AS p10_shift, round(b.q[2] - a.q[2], 6) AS p50_shift, round(b.q[3] - a.q[3], 6) AS p90_shift, CASE WHEN b.m2 - a.m2 >= b.m1 - a.m1 THEN 'f2' ELSE 'f1' END AS worst, round(greatest(b.m1 - a.m1, b.m2 - a.m2), 6) AS rise, round(len(list_intersect(a.top, b.top)) / 200.0, 6) AS overlap
    FROM g a JOIN g b ON a.event_type = b.event_type AND NOT a.late AND b.late""")
def d37_prediction_drift(t: Tables) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    e = t.events.withColumns({"late": late, "p": F.when(late, F.col("value") * 1.1).otherwise(F.col("value")), "f1": F.when(F.col("event_id") % 9 != 0, F.col("value")), "f2": F.when(~(late & (F.col("event_id") % 4 == 0)), F.col("value"))})
    out = l.prediction_drift(e.where("NOT late"), e.where("late"), "event_type", "p", ["f1", "f2"], "user_id", 200)
    return out.select("event_type", r("p10_shift"), r("p50_shift"), r("p90_shift"), "worst", r("rise"), r("overlap"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0.01 THEN l_tax END DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1 AS best FROM lineitem")
def e22_e23_best_row(t: Tables) -> DataFrame:
    ev = F.when(F.col("l_tax") > 0.01, F.col("l_tax"))
    out = l.best_row(t.lineitem, ["l_orderkey"], [ev.desc_nulls_last(), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_quantity")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "best")


_levels = "WITH l AS (SELECT l_partkey AS token, l_discount + 0.05 AS price, l_quantity AS size, l_orderkey, l_linenumber, l_suppkey, l_tax FROM lineitem)"
_tie = ["l_orderkey", "l_linenumber", "l_suppkey", "size", "l_tax"]


def levels(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("token"), (F.col("l_discount") + 0.05).alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber", "l_suppkey", "l_tax")


@query(f"""{_levels}, b AS (SELECT *, 400.0 + token % 500 AS want, coalesce(sum(size) OVER (PARTITION BY token ORDER BY price, {', '.join(_tie)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l), x AS (SELECT *, least(greatest(want - before, 0), size) AS take FROM b)
    SELECT token, sum(take) AS filled, round(sum(take * price), 6) AS cost, round(max(CASE WHEN take > 0 THEN price END), 6) AS worst, round(sum(take * price) / sum(take), 6) AS average, sum(take) >= max(want) AS complete FROM x GROUP BY token""")
def e24_walk_book(t: Tables) -> DataFrame:
    return l.walk_book(levels(t), "token", "price", "size", 400.0 + F.col("token") % 500, _tie).select("token", "filled", r("cost"), r("worst"), r("average"), "complete")


@query(f"""{_levels}, b AS (SELECT *, coalesce(sum(price * size) OVER (PARTITION BY token ORDER BY price, {', '.join(_tie)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l), x AS (SELECT *, least(greatest(60.0 - before, 0), price * size) AS spend FROM b)
    SELECT token, round(sum(spend / price), 5) AS shares, round(sum(spend), 6) AS cost, round(max(CASE WHEN spend > 1e-9 THEN price END), 6) AS worst, sum(spend) >= 60 - 1e-9 AS spent_all FROM x GROUP BY token""")
def e24_quote_budget(t: Tables) -> DataFrame:
    return l.quote_budget(levels(t), "token", "price", "size", 60.0, _tie).select("token", r("shares", 5), r("cost"), r("worst"), "spent_all")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate AS batch, l_suppkey % 5 AS fixture, 0.3 + l_discount * 4 AS p, 1.5 + l_tax * 20 AS odds FROM lineitem), a AS (SELECT *, least(greatest(0, 0.5 * ((odds - 1) * p - (1 - p)) / (odds - 1)), 0.05) AS k FROM o),
    s AS (SELECT o_orderdate AS batch, o_custkey % 5 AS fixture, (o_orderkey % 4) / 50.0::DOUBLE AS share FROM orders), sf AS (SELECT batch, fixture, sum(share) AS u FROM s GROUP BY ALL), sb AS (SELECT batch, sum(share) AS u FROM s GROUP BY ALL),
    b AS (SELECT a.*, k * coalesce(least(1, greatest(0.08::DOUBLE - coalesce(sf.u, 0), 0) / nullif(sum(k) OVER (PARTITION BY a.batch, a.fixture), 0)), 1) AS k2 FROM a LEFT JOIN sf ON sf.batch = a.batch AND sf.fixture = a.fixture)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(k2 * coalesce(least(1, greatest(0.2::DOUBLE - coalesce(sb.u, 0), 0) / nullif(sum(k2) OVER (PARTITION BY b.batch), 0)), 1), 8) AS share FROM b LEFT JOIN sb ON sb.batch = b.batch""")
def e26_allocate_batch(t: Tables) -> DataFrame:
    """Within what earlier tickets left of each fixture's and batch's limit."""
    o = t.lineitem.withColumns({"batch": F.col("l_shipdate"), "fixture": F.col("l_suppkey") % 5, "p": 0.3 + F.col("l_discount") * 4, "odds": 1.5 + F.col("l_tax") * 20})
    spent = t.orders.select(F.col("o_orderdate").alias("batch"), (F.col("o_custkey") % 5).alias("fixture"), (F.col("o_orderkey") % 4 / 50.0).alias("share"))
    return l.allocate_batch(o, "batch", "fixture", "p", "odds", 0.5, 0.05, 0.08, 0.2, spent).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", r("share", 8))


PATHS = "(VALUES " + ", ".join(map(str, l.series_paths())) + ") s(best_of, a, b, ways)"
SERIES = f"WITH x AS (SELECT event_id, ((event_id * 37) % 101 + 0.5) / 102 AS p, (event_id % 3 * 2 + 1)::INT AS best_of FROM events), d AS (SELECT event_id, p, x.best_of, a, b, ways * pow(p, a) * pow(1 - p, b) AS prob FROM x JOIN {PATHS} ON x.best_of = s.best_of)"


def series(t: Tables) -> DataFrame:
    return t.events.select("event_id", (((F.col("event_id") * 37) % 101 + 0.5) / 102).alias("p"), (F.col("event_id") % 3 * 2 + 1).cast("int").alias("best_of"))


@query(f"{SERIES} SELECT event_id, a AS a_wins, b AS b_wins, round(prob, 6) AS prob FROM d")
def k1_series_distribution(t: Tables) -> DataFrame:
    return l.series_distribution(series(t), "p", "best_of").select("event_id", "a_wins", "b_wins", r("prob"))


@query(f"""WITH x AS (SELECT event_id, unnest(list_distinct(list_filter([p * 0.9, p, CASE WHEN p * 0.9 < 0.5 AND p > 0.5 THEN 0.5::DOUBLE END], lambda v: v IS NOT NULL))) AS p, best_of FROM (SELECT event_id, ((event_id * 37) % 101 + 0.5) / 102 AS p, (event_id % 3 * 2 + 1)::INT AS best_of FROM events)),
    d AS (SELECT event_id, p, sum(CASE WHEN a + b > x.best_of - 0.5 THEN ways * pow(p, a) * pow(1 - p, b) ELSE 0 END) AS over_, sum(CASE WHEN a - b - 1.5 > 0 THEN ways * pow(p, a) * pow(1 - p, b) ELSE 0 END) AS covers FROM x JOIN {PATHS} ON x.best_of = s.best_of GROUP BY ALL)
    SELECT event_id, round(min(over_), 6) AS over_bound, round(min(covers), 6) AS covers_bound FROM d GROUP BY event_id""")
def k2_conservative_lines(t: Tables) -> DataFrame:
    x = series(t).withColumns({"low": F.col("p") * 0.9, "total": F.col("best_of") - 0.5, "handicap": F.lit(-1.5)})
    return l.conservative_lines(x, "event_id", "low", "p", "best_of", "total", "handicap").select("event_id", r("over_bound"), r("covers_bound"))


_over = cdf_sql("((30.0 - (event_id % 60) - 0.5) / (5.0 + event_id % 7))")


@query(f"WITH x AS (SELECT event_id, {_over} AS p, 1.9::DOUBLE AS odds FROM events) SELECT event_id, round(p, 6) AS over, CASE WHEN p >= 1e-4 THEN round(1 / p, 3) END AS fair_odds, round(p * odds - 1, 6) AS edge, round(greatest(0, 0.5 * ((odds - 1) * p - (1 - p)) / (odds - 1)), 6) AS half_kelly FROM x")
def k3_normal_over(t: Tables) -> DataFrame:
    """Chances under one in ten thousand have no fair odds."""
    x = t.events.select("event_id", c.normal_over(F.lit(30.0), 5.0 + F.col("event_id") % 7, (F.col("event_id") % 60) + 0.5).alias("p"), F.lit(1.9).alias("odds"))
    return x.select("event_id", r("p", name="over"), F.when(F.col("p") >= 1e-4, r(1 / F.col("p"), 3, "fair_odds")).alias("fair_odds"), r(c.edge(F.col("p"), F.col("odds")), name="edge"), r(c.kelly(F.col("p"), F.col("odds"), 0.5), name="half_kelly"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ((event_id * 37) % 101 + 0.5) / 102 END AS p, CASE WHEN event_id % 13 <> 0 THEN 1.2::DOUBLE + (event_id % 40) / 20.0 END AS odds FROM events), y AS (SELECT *, p * odds - 1 AS ev, p * 0.95::DOUBLE * odds - 1 AS bound FROM x),
    z AS (SELECT *, concat_ws(',', CASE WHEN odds IS NULL THEN 'no price' END, CASE WHEN p IS NULL THEN 'no forecast' END, CASE WHEN ev <= 0 THEN 'no edge' END, CASE WHEN ev > 0 AND ev < 0.02 THEN 'thin edge' END, CASE WHEN ev >= 0.02 AND bound < 0 THEN 'bound below price' END) AS codes FROM y)
    SELECT event_id, round(ev, 6) AS ev, codes, CASE WHEN codes = '' THEN 'bet' WHEN contains(codes, 'bound') OR contains(codes, 'thin') THEN 'watch' ELSE 'pass' END AS decision, CASE WHEN codes = '' THEN floor(100000 * greatest(0, 0.5 * ((odds - 1) * p - (1 - p)) / (odds - 1))) / 100 ELSE 0 END AS stake FROM z""")
def k4_decide(t: Tables) -> DataFrame:
    k = F.col("event_id")
    x = t.events.select("event_id", F.when(k % 11 != 0, ((k * 37) % 101 + 0.5) / 102).alias("p"), F.when(k % 13 != 0, 1.2 + (k % 40) / 20).alias("odds")).withColumn("low", F.col("p") * 0.95)
    return l.decide(x, "p", "low", "odds", 1000.0).select("event_id", r("ev"), F.array_join("codes", ",").alias("codes"), "decision", "stake")


@query("""WITH x AS (SELECT p_partkey, p_type AS market, CASE WHEN p_partkey % 5 <> 0 THEN ((p_partkey % 9) / 4.0)::DOUBLE END AS line, CASE WHEN p_partkey % 2 = 0 THEN ' Map1 ' END AS period FROM part)
    SELECT p_partkey, CASE WHEN line IS NOT NULL AND line * 2 = round(line * 2) AND (line * 2)::BIGINT % 2 = 1 THEN substr(sha256(lower(market) || '|' || printf('%.1f', line) || '|' || coalesce(lower(trim(period)), 'full')), 1, 16) END AS contract,
        CASE WHEN line IS NULL THEN 'no line' WHEN line * 2 <> round(line * 2) THEN 'not a half line' WHEN (line * 2)::BIGINT % 2 = 0 THEN 'whole line' END AS problem FROM x""")
def k5_contract_key(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    x = t.part.select("p_partkey", F.col("p_type").alias("market"), F.when(k % 5 != 0, (k % 9) / 4).alias("line"), F.when(k % 2 == 0, " Map1 ").alias("period"))
    return x.select("p_partkey", *(v.alias(n) for n, v in l.contract_key("market", "line", "period").items()))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'O' THEN 'not open' END, CASE WHEN o_orderdate <= TIMESTAMP '1998-06-01' THEN 'started' END, CASE WHEN o_orderkey % 3 <> o_custkey % 3 THEN 'best-of mismatch' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'rules missing' END) AS blocks FROM orders")
def k6_contract_blocks(t: Tables) -> DataFrame:
    from antecede.operators.joins import reasons

    tests = {"not open": F.col("o_orderstatus") != "O", "started": F.col("o_orderdate") <= F.lit("1998-06-01").cast("timestamp"), "best-of mismatch": F.col("o_orderkey") % 3 != F.col("o_custkey") % 3, "rules missing": F.col("o_orderpriority") == "4-NOT SPECIFIED"}
    return t.orders.select("o_orderkey", F.array_join(reasons(tests), ",").alias("blocks"))


@query(f"{SERIES} SELECT event_id, round(abs(sum(CASE WHEN a > b THEN prob ELSE 0 END) - (max(p) + 0.5) / 2) * 100, 4) AS points FROM d GROUP BY event_id")
def k7_disagreement(t: Tables) -> DataFrame:
    x = series(t).withColumns({"total": F.lit(0.5), "handicap": F.lit(0.5)})
    lines = l.line_probabilities(x, "event_id", "p", "best_of", "total", "handicap")
    return lines.join(x, "event_id").select("event_id", r(F.abs(F.col("series") - (F.col("p") + 0.5) / 2) * 100, 4, "points"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN 'emergency' WHEN o_custkey % 6 >= 3 THEN 'stable' ELSE 'stabilising' END AS lineup FROM orders")
def k8_lineup_state(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", l.lineup_state(F.col("o_custkey") % 6, k % 7 != 0, k % 5 == 0).alias("lineup"))


@query(f"""{DUELS}, li AS (SELECT game, unnest(['a', 'b']) AS outcome, 'l' || game % 50 AS listing FROM games), f AS (SELECT game, ((game * 37) % 101 + 0.5) / 102 AS p, ((game * 53) % 101 + 0.5) / 102 AS direct FROM games WHERE game % 4 <> 0), q AS (SELECT game, 'a' AS outcome, 1.5::DOUBLE + game % 10 / 10.0 AS odds FROM games WHERE game % 3 <> 0)
    SELECT game, outcome, listing, p IS NULL OR odds IS NULL AS blocked, concat_ws(',', CASE WHEN p IS NULL THEN 'no forecast' END, CASE WHEN odds IS NULL THEN 'no quote' END, CASE WHEN abs(direct - p) >= 0.1 AND abs(direct - p) < 0.2 THEN 'disagreement' END, CASE WHEN abs(direct - p) >= 0.2 THEN 'strong disagreement' END) AS notes
    FROM li LEFT JOIN f USING (game) LEFT JOIN q USING (game, outcome)""")
def k9_action_table(t: Tables) -> DataFrame:
    g, k = games(t), F.col("game")
    listings = g.select("game", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("outcome"), F.concat(F.lit("l"), (k % 50).cast("string")).alias("listing"))
    f = g.where("game % 4 <> 0").select("game", (((k * 37) % 101 + 0.5) / 102).alias("p"), (((k * 53) % 101 + 0.5) / 102).alias("direct"))
    q = g.where("game % 3 <> 0").select("game", F.lit("a").alias("outcome"), (1.5 + k % 10 / 10).alias("odds"))
    out = l.action_table(listings, f, q, ["game"], ["game", "outcome"])
    return out.select("game", "outcome", "listing", (F.col("state") == "blocked").alias("blocked"), F.array_join("notes", ",").alias("notes"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS total, (l_suppkey % 50)::DOUBLE AS line, l_tax > 0.04 AS over_, l_discount * 100 AS stake, 1.9::DOUBLE AS odds FROM lineitem), y AS (SELECT *, CASE WHEN total = line THEN 'push' WHEN (total > line) = over_ THEN 'win' ELSE 'loss' END AS result FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, total, result, round(CASE result WHEN 'win' THEN stake * (odds - 1) WHEN 'loss' THEN -stake ELSE 0 END, 6) AS pnl, round(1 / odds, 6) AS implied FROM y""")
def s_settlement(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("total"), (F.col("l_suppkey") % 50).cast("double").alias("line"), (F.col("l_tax") > 0.04).alias("over"), (F.col("l_discount") * 100).alias("stake"), F.lit(1.9).alias("odds"))
    x = x.withColumn("result", c.line_result(F.col("total"), F.col("line"), F.col("over")))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "total", "result", r(c.settled_pnl(F.col("result"), F.col("stake"), F.col("odds")), name="pnl"), r(c.implied(F.col("odds")), name="implied"))
