"""Ledger and market tables: accounting, coverage, best prices, book depth, sizing, decisions."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.columns import edge, implied, kelly, round_down_cents
from antecede.operators.joins import reasons
from antecede.operators.resampling import group_quantiles
from antecede.operators.slices import attached
from antecede.sources.tables import written


def accounting(df: DataFrame, by: list[str], stake: str, pnl: str, result: str, empty_roi: float | None = None) -> DataFrame:
    """settled, graded (win or loss), turnover, pnl, roi (`empty_roi` without turnover), hit_rate; one row for each group, which keeps currencies apart."""
    graded = F.col(result).isin("win", "loss")
    turnover, won = F.sum(stake), F.count_if(F.col(result) == "win")
    roi = F.sum(pnl).cast("double") / F.nullif(turnover.cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(result).alias("settled"), F.count_if(graded).alias("graded"), turnover.alias("turnover"), F.sum(pnl).alias("pnl"), (roi if empty_roi is None else F.coalesce(roi, F.lit(empty_roi))).alias("roi"), (won / F.nullif(F.count_if(graded), F.lit(0))).alias("hit_rate")
    )


def closing_value(df: DataFrame, by: list[str], accepted: str, closing: str, verified: str) -> DataFrame:
    """clv (mean of 1/closing - 1/accepted over verified closes), complete, missing."""
    value = F.when(F.col(verified) & F.col(closing).isNotNull(), implied(F.col(closing)) - implied(F.col(accepted)))
    return df.groupBy(*by).agg(F.avg(value).alias("clv"), F.count(value).alias("complete"), F.count_if(value.isNull()).alias("missing"))


def sizing_paths(df: DataFrame, paths: str, bankroll: float, pnl_per_unit: str) -> DataFrame:
    """path, n, turnover, pnl of what each path of a map (path to fraction) would have staked."""
    rows = df.select(pnl_per_unit, F.explode(paths).alias("path", "fraction")).withColumn("stake", F.col("fraction") * bankroll)
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("stake").alias("turnover"), F.sum(F.col("stake") * F.col(pnl_per_unit)).alias("pnl"))


def cohort_counts(df: DataFrame, dimensions: list[str], ticket: str, fixture: str) -> DataFrame:
    """dimension, level, tickets, fixtures by grouping sets; null levels are left out."""
    from antecede.operators.evaluation import by_cohort

    return by_cohort(df.select(ticket, fixture, *dimensions), dimensions).groupBy("cohort", "level").agg(F.count_distinct(ticket).alias("tickets"), F.count_distinct(fixture).alias("fixtures"))


def funnel(df: DataFrame, by: list[str], id_: str, steps: dict[str, Column], wanted: float = 0.9) -> DataFrame:
    """How many distinct ids reach each step, the share of each step's that reach the next, and whether all shares are enough."""
    names = list(steps)
    out = df.groupBy(*by).agg(*(F.count_distinct(F.when(steps[n], F.col(id_))).alias(n) for n in names))
    shares = {f"{b}_share": F.col(b) / F.nullif(F.col(a), F.lit(0)) for a, b in zip(names[:-1], names[1:], strict=True)}
    ok = F.forall(F.array(*(F.coalesce(F.col(s), F.lit(0.0)) for s in shares)), lambda x: x >= wanted)
    return out.withColumns(shares).withColumn("covered", ok)


def best_prices(df: DataFrame, key: list[str], provider: str, odds: str, p: str) -> DataFrame:
    """The best price of each contract, its providers by odds, fair odds, implied probability and expected value."""
    out = df.groupBy(*key).agg(F.max(F.struct(odds, provider)).alias("__b"), F.sort_array(F.collect_set(F.struct(odds, provider)), False).alias("__all"), F.max(p).alias("p"))
    return out.select(
        *key, F.col(f"__b.{provider}").alias("provider"), F.col(f"__b.{odds}").alias("odds"), F.transform("__all", lambda x: x[provider]).alias("providers"),
        (1 / F.nullif(F.col("p"), F.lit(0.0))).alias("fair_odds"), implied(F.col(f"__b.{odds}")).alias("implied"), edge(F.col("p"), F.col(f"__b.{odds}")).alias("ev"),
    )


def best_row(df: DataFrame, key: list[str], order: list[Column], tag: str = "best") -> DataFrame:
    """Every row with whether it is its key's first."""
    return df.withColumn(tag, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def walk_book(levels: DataFrame, book: str, price: str, size: str, shares: Column, tie: list[str]) -> DataFrame:
    """book, filled, cost, worst, average, complete: buys `shares` from the cheapest level up, in part from the last."""
    w = Window.partitionBy(book).orderBy(price, *tie).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0.0))
    x = levels.withColumn("__want", shares).withColumn("__take", F.least(F.greatest(F.col("__want") - before, F.lit(0.0)), F.col(size)))
    out = x.groupBy(book).agg(F.sum("__take").alias("filled"), F.sum(F.col("__take") * F.col(price)).alias("cost"), F.max(F.when(F.col("__take") > 0, F.col(price))).alias("worst"), F.max("__want").alias("__want"))
    return out.select(book, "filled", "cost", "worst", (F.col("cost") / F.nullif(F.col("filled"), F.lit(0.0))).alias("average"), (F.col("filled") >= F.col("__want")).alias("complete"))


def quote_budget(levels: DataFrame, book: str, price: str, size: str, stake: float, tie: list[str]) -> DataFrame:
    """book, shares, cost, worst, spent_all: what a stake buys from the cheapest level up; what rounding leaves of a stake that is spent buys at no level."""
    w = Window.partitionBy(book).orderBy(price, *tie).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(price) * F.col(size)).over(w), F.lit(0.0))
    x = levels.withColumn("__spend", F.least(F.greatest(F.lit(float(stake)) - before, F.lit(0.0)), F.col(price) * F.col(size)))
    return x.groupBy(book).agg(F.sum(F.col("__spend") / F.col(price)).alias("shares"), F.sum("__spend").alias("cost"), F.max(F.when(F.col("__spend") > 1e-9, F.col(price))).alias("worst")).withColumn("spent_all", F.col("cost") >= stake - 1e-9)


def allocate_batch(df: DataFrame, batch: str, fixture: str, p: str, odds: str, fraction: float, ticket_cap: float, fixture_cap: float, total_cap: float, spent: DataFrame | None = None) -> DataFrame:
    """share: fractional Kelly under a ticket's cap, scaled to what is left of the fixture's cap, then of the batch's.

    spent: batch, fixture, share already taken. What is left is never below 0. Sums are made of partial sums, down to one
    row for each fixture of a batch, and limits are worked out on those rows; a batch with very many tickets is in no task whole.
    """
    x = df.withColumn("__k", F.least(kelly(F.col(p), F.col(odds), fraction), F.lit(ticket_cap)))
    by = [batch, fixture]
    totals = x.groupBy(*by).agg(F.sum("__k").alias("__sum"))
    left = lambda cap, used: F.greatest(F.lit(cap) - F.coalesce(F.col(used), F.lit(0.0)), F.lit(0.0))
    scale = lambda cap, total: F.coalesce(F.least(F.lit(1.0), cap / F.nullif(F.col(total), F.lit(0.0))), F.lit(1.0))
    if spent is None:
        spent = df.sparkSession.createDataFrame([], totals.select(*by, F.lit(0.0).alias("share")).schema)
    by_fixture = spent.groupBy(*by).agg(F.sum("share").alias("__sf"))
    fixtures = written(totals.join(by_fixture, by, "left").select(*by, "__sum", scale(left(fixture_cap, "__sf"), "__sum").alias("__scale")), "fixtures")
    by_batch = spent.groupBy(batch).agg(F.sum("share").alias("__sb"))
    batches = fixtures.groupBy(batch).agg(F.sum(F.col("__sum") * F.col("__scale")).alias("__all")).join(by_batch, batch, "left")
    batches = written(batches.select(batch, scale(left(total_cap, "__sb"), "__all").alias("__b")), "batches")
    factors = attached(fixtures.select(*by, "__scale"), batches, [batch]).select(*by, (F.col("__scale") * F.col("__b")).alias("__f"))
    return attached(x, written(factors, "factors"), by).withColumn("share", F.col("__k") * F.col("__f")).drop("__k", "__f")


def activity(tables: dict[str, tuple[DataFrame, str]], start: str, end: str) -> DataFrame:
    """table, n of rows inside [start, end)."""
    out = None
    for name, (df, time) in tables.items():
        one = df.where((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp"))).select(F.lit(name).alias("table"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("table").agg(F.count("*").alias("n"))


def health_checks(df: DataFrame, by: str, day: str, value: str, p: str, stale_before: str, least_share: float = 0.5) -> DataFrame:
    """key, check, level, metric: freshness, missing values, volume against the day before, and extreme probabilities, a row each."""
    days = df.groupBy(by, F.to_date(day).alias("d")).agg(F.count("*").alias("n"))
    drop = days.withColumn("was", F.lag("n").over(Window.partitionBy(by).orderBy("d"))).groupBy(by).agg(F.min(F.col("n") / F.col("was")).alias("metric")).select(by, F.lit("volume").alias("check"), F.when(F.col("metric") < least_share, "warn").otherwise("ok").alias("level"), "metric")
    one = df.groupBy(by).agg(F.max(day).alias("latest"), F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.avg((~F.col(p).between(0.01, 0.99)).cast("double")).alias("extreme"))
    stack = F.array(
        F.struct(F.lit("freshness").alias("check"), F.when(F.col("latest") < F.lit(stale_before).cast("timestamp"), "warn").otherwise("ok").alias("level"), F.unix_seconds(F.col("latest").cast("timestamp")).cast("double").alias("metric")),
        F.struct(F.lit("missing").alias("check"), F.when(F.col("missing") > 0.1, "warn").otherwise("ok").alias("level"), F.col("missing").alias("metric")),
        F.struct(F.lit("extreme").alias("check"), F.when(F.col("extreme") > 0.05, "warn").otherwise("ok").alias("level"), F.col("extreme").alias("metric")),
    )
    return one.select(by, F.explode(stack).alias("x")).select(by, "x.*").unionByName(drop)


def drift(df: DataFrame, by: str, order: list[str], value: str, rows: int = 5) -> DataFrame:
    """by, recent, before, change: mean of the last rows against that of as many before them."""
    w = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    x = df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= 2 * rows)
    out = x.groupBy(by).agg(F.avg(F.when(F.col("__k") <= rows, F.col(value))).alias("recent"), F.avg(F.when(F.col("__k") > rows, F.col(value))).alias("before"))
    return out.withColumn("change", F.col("recent") - F.col("before"))


def report_changes(previous: DataFrame, current: DataFrame, by: str, least_share: float = 0.5) -> DataFrame:
    """key, check, level, metric against a previous report (by, rows, columns): volume, and the columns that came or went, one row each."""
    a, b = previous.select(by, F.col("rows").alias("__was"), F.col("columns").alias("__had")), current.select(by, "rows", "columns")
    both = b.join(a, by, "full")
    share = F.coalesce("rows", F.lit(0)) / F.nullif(F.col("__was"), F.lit(0))
    none = F.array().cast("array<string>")
    changed = F.size(F.array_except(F.coalesce("columns", none), F.coalesce("__had", none))) + F.size(F.array_except(F.coalesce("__had", none), F.coalesce("columns", none)))
    rows = F.array(
        F.struct(F.lit("volume").alias("check"), F.when(share < least_share, "warn").when(F.col("__was").isNull(), "new").otherwise("ok").alias("level"), share.alias("metric")),
        F.struct(F.lit("schema").alias("check"), F.when(changed > 0, "warn").otherwise("ok").alias("level"), changed.cast("double").alias("metric")),
    )
    return both.select(by, F.explode(rows).alias("x")).select(by, "x.*")


def repeated_failures(df: DataFrame, by: str, order: list[str], failed: Column, least: int = 3) -> DataFrame:
    """key, longest run of failures, and whether it is long enough to warn."""
    w = Window.partitionBy(by).orderBy(*order)
    x = df.withColumn("__f", F.coalesce(failed, F.lit(False)).cast("int"))
    x = x.withColumn("__g", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(by, "__g").agg(F.sum("__f").alias("n")).groupBy(by).agg(F.max("n").alias("longest")).withColumn("level", F.when(F.col("longest") >= least, "warn").otherwise("ok"))


def prediction_drift(before: DataFrame, after: DataFrame, by: str, p: str, features: list[str], key: str, top: int = 10) -> DataFrame:
    """by, p10, p50, p90 shifts of predictions, worst (the feature whose missing share rose most) and overlap of the `top` keys by prediction."""


    def facts(df: DataFrame, name: str) -> DataFrame:
        # The top of each group is that of the tops of its runs, so no task ranks a group's rows.
        runs = df.select(by, p, key, F.pmod(F.xxhash64(key), F.lit(256)).alias("__run"))
        some = runs.withColumn("__k", F.row_number().over(Window.partitionBy(by, "__run").orderBy(F.desc(p), key))).where(F.col("__k") <= top)
        tops = some.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(p), key))).where(F.col("__k") <= top).groupBy(by).agg(F.collect_set(key).alias(f"{name}_top"))
        missing = [F.avg(F.col(f).isNull().cast("double")).alias(f"{name}_m_{f}") for f in features]
        return df.groupBy(by).agg(*missing).join(group_quantiles(df, [by], p, [0.1, 0.5, 0.9], f"{name}_q"), by, "left").join(tops, by)

    both = facts(before, "a").join(facts(after, "b"), by)
    rises = F.array(*(F.struct((F.col(f"b_m_{f}") - F.col(f"a_m_{f}")).alias("rise"), F.lit(f).alias("feature")) for f in features))
    shift = {f"p{10 + 40 * k}_shift": F.col("b_q")[k] - F.col("a_q")[k] for k in range(3)}
    worst = F.array_max(F.transform(rises, lambda x: F.struct(x["rise"].alias("rise"), x["feature"].alias("feature"))))
    overlap = F.size(F.array_intersect("a_top", "b_top")) / F.lit(float(top))
    return both.select(by, *(c.alias(n) for n, c in shift.items()), worst["feature"].alias("worst"), worst["rise"].alias("rise"), overlap.alias("overlap"))


def retrain_trigger(df: DataFrame, by: list[str], key: str, time: str, major: Column, cutoff: str, now: str, least: int, least_major: int, most_days: int) -> DataFrame:
    """by, fresh, fresh_major, age_days, reasons: distinct games after the cutoff (the latest row of each), and why to train again."""
    w = Window.partitionBy(*by, key).orderBy(F.col(time).desc())
    latest = df.withColumn("__k", F.row_number().over(w)).where("__k = 1").withColumn("__new", F.col(time) > F.lit(cutoff).cast("timestamp"))
    out = latest.groupBy(*by).agg(F.count_if("__new").alias("fresh"), F.count_if(F.col("__new") & major).alias("fresh_major")).withColumn("age_days", F.date_diff(F.to_date(F.lit(now)), F.to_date(F.lit(cutoff))))
    return out.withColumn("reasons", reasons({"games": F.col("fresh") >= least, "major games": F.col("fresh_major") >= least_major, "age": F.col("age_days") >= most_days}))


def series_paths(best_of: tuple[int, ...] = (1, 3, 5)) -> list[tuple[int, int, int, int]]:
    """(best_of, a_wins, b_wins, ways) of each final score: the winner takes the last map."""
    out = []
    for n in best_of:
        need = n // 2 + 1
        for lost in range(need):
            ways = comb(need - 1 + lost, lost)
            out += [(n, need, lost, ways), (n, lost, need, ways)]
    return out


def series_distribution(df: DataFrame, p: str, best_of: str) -> DataFrame:
    """The rows with each final score's probability: a_wins, b_wins, prob. The table of scores has a dozen rows."""
    scores = df.sparkSession.createDataFrame(series_paths(), f"{best_of} int, a_wins int, b_wins int, ways int")
    return df.join(F.broadcast(scores), best_of).withColumn("prob", F.col("ways") * F.pow(F.col(p), F.col("a_wins")) * F.pow(1 - F.col(p), F.col("b_wins"))).drop("ways")


def line_probabilities(df: DataFrame, id_: str, p: str, best_of: str, total: str, handicap: str) -> DataFrame:
    """id, over (total maps over the line), covers (a's margin plus its handicap above 0), series (a wins)."""
    d = series_distribution(df, p, best_of)
    when = lambda t: F.sum(F.when(t, F.col("prob")).otherwise(0.0))
    return d.groupBy(id_).agg(when(F.col("a_wins") + F.col("b_wins") > F.col(total)).alias("over"), when(F.col("a_wins") - F.col("b_wins") + F.col(handicap) > 0).alias("covers"), when(F.col("a_wins") > F.col("b_wins")).alias("series"))


def conservative_lines(df: DataFrame, id_: str, low: str, high: str, best_of: str, total: str, handicap: str) -> DataFrame:
    """The least `over` and `covers` over a range of map probabilities: its ends, and 0.5 if it is inside."""
    inside = F.array_distinct(F.concat(F.array(low, high), F.when((F.col(low) < 0.5) & (F.col(high) > 0.5), F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>"))))
    tried = df.withColumn("__p", F.explode(inside)).withColumn("__id", F.struct(id_, "__p"))
    lines = line_probabilities(tried, "__id", "__p", best_of, total, handicap)
    return lines.groupBy(F.col(f"__id.{id_}").alias(id_)).agg(F.min("over").alias("over_bound"), F.min("covers").alias("covers_bound"))


def decide(df: DataFrame, p: str, low: str, odds: str, bankroll: float, fraction: float = 0.5, least_edge: float = 0.02) -> DataFrame:
    """ev, decision (bet, watch, pass), stake (cents, rounded down), codes in order."""
    ev, bound = edge(F.col(p), F.col(odds)), edge(F.col(low), F.col(odds))
    why = reasons({"no price": F.col(odds).isNull(), "no forecast": F.col(p).isNull(), "no edge": ev <= 0, "thin edge": (ev > 0) & (ev < least_edge), "bound below price": (ev >= least_edge) & (bound < 0)})
    kind = F.when(F.size(why) == 0, "bet").when(F.array_contains(why, "bound below price") | F.array_contains(why, "thin edge"), "watch").otherwise("pass")
    stake = F.when(kind == "bet", round_down_cents(bankroll * kelly(F.col(p), F.col(odds), fraction))).otherwise(0.0)
    return df.withColumns({"ev": ev, "codes": why, "decision": kind, "stake": stake})


def contract_key(market: str, line: str, period: str) -> dict[str, Column]:
    """contract: a fingerprint of market, line and period, or else its problem: only half lines settle without a push."""
    x = F.col(line).cast("string").try_cast("double")
    bad = F.when(x.isNull(), "no line").when(F.abs(x * 2 - F.round(x * 2)) > 1e-9, "not a half line").when(F.round(x * 2).cast("long") % 2 == 0, "whole line")
    name = F.concat_ws("|", F.lower(F.trim(F.col(market))), F.format_string("%.1f", x), F.coalesce(F.lower(F.trim(F.col(period))), F.lit("full")))
    return {"contract": F.when(bad.isNull(), F.substring(F.sha2(name, 256), 1, 16)), "problem": bad}


def lineup_state(streak: Column, known: Column, substitute: Column, settled: int = 3) -> Column:
    return F.when(~known, "unknown").when(substitute, "emergency").when(streak >= settled, "stable").otherwise("stabilising")


def action_table(listings: DataFrame, forecasts: DataFrame, quotes: DataFrame, on_forecast: list[str], on_quote: list[str]) -> DataFrame:
    """Every listing's outcome with its forecast (p, direct) and current quote (odds), state, and reasons and warnings in order."""
    x = listings.join(forecasts, on_forecast, "left").join(quotes, on_quote, "left")
    gap = F.abs(F.col("direct") - F.col("p"))
    why = reasons({"no forecast": F.col("p").isNull(), "no quote": F.col("odds").isNull()})
    warn = reasons({"disagreement": (gap >= 0.10) & (gap < 0.20), "strong disagreement": gap >= 0.20})
    return x.withColumns({"state": F.when(F.size(why) == 0, "ready").otherwise("blocked"), "notes": F.array_distinct(F.concat(why, warn))})
