"""Skill ratings, one period at a time.

All games of a period are rated in parallel from the ratings at its start; deltas are summed for each
entity. Periods that don't meet are rated together, in layers: the driver loops over the longest chain
of turns, never over games. With each game as a period of its own the result is that of a sequential fold.

events: game, played, side, entity, result (1 or 0), season (int), league, and `period`, in order; one row for
each member of a side. state: entity, mu, s2 (variance), vol, season, league, last_played, position (null where there are none).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from antecede.functions.columns import normal_over
from antecede.keys import BROADCAST_ROWS, sized
from antecede.operators.joins import asof_join, asof_state
from antecede.operators.reshape import pivot_roles
from antecede.sources.tables import work_folder, written

SIDES = ("Blue", "Red")
#: Of an entity's step, what a pool's is.
POOL_SHARE = 0.25
STATE = "entity long, mu double, s2 double, vol double, season int, league string, last_played timestamp, position string"

# The shares of a role in its side's rating, and what a role that isn't named here weighs.
ROLE_WEIGHTS = {"top": 0.18, "jng": 0.20, "mid": 0.22, "bot": 0.22, "sup": 0.18}
OTHER_ROLE = 0.20


class Rules(NamedTuple):
    """How a state changes between games."""

    mu: float = 1500.0
    sigma: float = 0.0
    vol: float = 0.0
    decay: float = 0.9
    grace_days: float | None = 45.0
    half_life_days: float = 180.0
    transfer: float = 0.5
    reset_sigma_on_transfer: bool = False
    new_adjust: float = 0.5
    drift: float = 0.0
    grow_sigma: bool = False
    position_reset: float = 0.2


# Starting ratings of the four systems.
ELO = Rules()
GLICKO = Rules(1500.0, 350.0, 0.06, grow_sigma=True)
PLACKETT_LUCE = Rules(25.0, 8.333, grace_days=None, reset_sigma_on_transfer=True)
TRUESKILL = Rules(25.0, 8.333, grace_days=None, reset_sigma_on_transfer=True, drift=8.333 / 100)


def moved_state(rules: Rules, leagues: bool = False) -> dict[str, Column]:
    """mu, s2, vol, season, league and position of an entity when it plays, from a row with its old state (null if it is new) and
    played, now_season, now_league, now_position, __nth and __old_nth (of both seasons), and __to, __from and __mean if leagues are rated.

    Toward the baseline: one decay for each season that began for anyone since the entity's mark, then half-lives of idle days beyond the grace.
    A new entity starts at the baseline, moved by part of its league's lead over the mean league (a fifth of the baseline at most); one that
    changed league moves by part of the difference. Without ratings of leagues neither moves. One that plays another position than the
    last goes part of the way to the baseline. Where sigma grows, idle days take it to its start by the same half-lives.
    """
    known, began = F.col("mu").isNotNull(), F.greatest(F.coalesce(F.col("__nth") - F.col("__old_nth"), F.lit(0)), F.lit(0))
    keep, rest = F.pow(F.lit(rules.decay), began), F.lit(1.0)
    if rules.grace_days is not None:
        idle = F.floor((F.unix_seconds(F.col("played").cast("timestamp")) - F.unix_seconds(F.col("last_played").cast("timestamp"))) / 86400) - rules.grace_days
        rest = F.pow(F.lit(0.5), F.greatest(F.coalesce(idle, F.lit(0.0)), F.lit(0.0)) / rules.half_life_days)
        keep = keep * rest
    mu = rules.mu + (F.col("mu") - rules.mu) * keep
    start, move, changed = F.lit(rules.mu), F.lit(0.0), F.coalesce(F.col("league") != F.col("now_league"), F.lit(False))
    if leagues:
        lead = (F.coalesce("__to", F.lit(rules.mu)) - F.col("__mean")) * rules.new_adjust
        start = start + F.coalesce(F.greatest(F.least(lead, F.lit(0.2 * rules.mu)), F.lit(-0.2 * rules.mu)), F.lit(0.0))
        move = F.when(changed, rules.transfer * (F.coalesce("__to", F.lit(rules.mu)) - F.coalesce("__from", F.lit(rules.mu)))).otherwise(0.0)
    s2 = F.coalesce(F.col("s2"), F.lit(rules.sigma**2))
    if rules.reset_sigma_on_transfer:
        s2 = F.when(changed, rules.sigma**2).otherwise(s2)
    if rules.grow_sigma:
        s2 = F.pow(rules.sigma - (rules.sigma - F.sqrt(s2)) * rest, 2)
    switched = F.coalesce(F.col("position") != F.col("now_position"), F.lit(False))
    mu = mu + move
    mu = F.when(switched, rules.mu + (mu - rules.mu) * (1 - rules.position_reset)).otherwise(mu)
    return {
        "mu": F.when(known, mu).otherwise(start), "s2": s2 + rules.drift**2, "vol": F.coalesce("vol", F.lit(rules.vol)),
        "season": F.col("now_season"), "league": F.col("now_league"), "position": F.coalesce("now_position", "position"),
    }


def with_seasons(rows: DataFrame, seasons: DataFrame) -> DataFrame:
    """`rows` with __nth and __old_nth of now_season and season."""
    seasons = sized(seasons)
    rows = rows.join(seasons, F.col("now_season") == F.col("__season"), "left").drop("__season")
    old = seasons.select(F.col("__season"), F.col("__nth").alias("__old_nth"))
    return rows.join(old, F.col("season") == F.col("__season"), "left").drop("__season")


def with_leagues(rows: DataFrame, leagues: DataFrame) -> DataFrame:
    """`rows` with __to, __from (ratings of now_league and league) and __mean; `leagues` (league, rating) may be for each `period` of the rows."""
    by = ["period"] if "period" in leagues.columns else []
    of = lambda c, a: leagues.select(*by, F.col("league").alias(c), F.col("rating").alias(a))
    rows = rows.join(of("now_league", "__to"), [*by, "now_league"], "left").join(of("league", "__from"), [*by, "league"], "left")
    mean = leagues.groupBy(*by).agg(F.avg("rating").alias("__mean"))
    return rows.join(mean, by, "left") if by else rows.crossJoin(F.broadcast(mean))


def adjusted(rows: DataFrame, rules: Rules, seasons: DataFrame, leagues: DataFrame | None = None) -> DataFrame:
    """The state an entity has when it plays, by `moved_state`: rows are of (entity, played, now_season, now_league and maybe now_position) with its old state, null if it is new.

    leagues: league, rating.
    """
    for c in ("now_position", "position"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    rows = with_seasons(rows, seasons)
    rows = rows if leagues is None else with_leagues(rows, leagues)
    return rows.select("entity", "played", *(c.alias(n) for n, c in moved_state(rules, leagues is not None).items()))


class Kernel(NamedTuple):
    """terms: columns of one game and member, from its own and the two sides' totals; summed: the new (mu, s2, vol) from the terms' sums."""

    rules: Rules
    win: Callable[[], Column]
    terms: Callable[[], dict[str, Column]]
    summed: Callable[[], dict[str, Column]]


# A game's row has: mu, s2, vol (own, at the period's start), side_mu, side_s2, n, foe_mu, foe_s2, foe_n, result.


def elo_win(divisor: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), F.greatest(F.least((F.col("foe_mu") - F.col("side_mu")) / divisor, F.lit(8.0)), F.lit(-8.0))))


def elo(k: float = 32.0, divisor: float = 400.0, rules: Rules = ELO) -> Kernel:
    return Kernel(rules, lambda: elo_win(divisor), lambda: {"d": k * (F.col("result") - elo_win(divisor))}, lambda: {"mu": F.col("mu") + F.col("d"), "s2": F.col("s2"), "vol": F.col("vol")})


SCALE = 173.7178


def _glicko(mu: Column, foe_mean: Column, foe_phi2: Column) -> tuple[Column, Column]:
    g = 1 / F.sqrt(1 + 3 * foe_phi2 / math.pi**2)
    return g, 1 / (1 + F.exp(-g * (mu - foe_mean) / SCALE))


def _new_volatility(phi: float, delta: float, v: float, vol: float, tau: float) -> float:
    """Step 5 of Glickman's Glicko-2 paper, by its regula falsi."""
    a = math.log(vol * vol)

    def f(x: float) -> float:
        e = math.exp(x)
        return e * (delta * delta - phi * phi - v - e) / (2 * (phi * phi + v + e) ** 2) - (x - a) / (tau * tau)

    low = a
    if delta * delta > phi * phi + v:
        high = math.log(delta * delta - phi * phi - v)
    else:
        k = 1
        while f(a - k * tau) < 0:
            k += 1
        high = a - k * tau
    fl, fh = f(low), f(high)
    while abs(high - low) > 1e-6:
        mid = low + (low - high) * fl / (fh - fl)
        fm = f(mid)
        if fm * fh <= 0:
            low, fl = high, fh
        else:
            fl /= 2
        high, fh = mid, fm
    return math.exp(low / 2)


def glicko2(tau: float = 0.5, rules: Rules = GLICKO) -> Kernel:
    """Against the mean of the other side's members."""

    @F.pandas_udf(DoubleType())
    def volatility(phi: pd.Series, delta: pd.Series, v: pd.Series, vol: pd.Series) -> pd.Series:
        return pd.Series(np.array([_new_volatility(*x, tau) for x in zip(phi, delta, v, vol, strict=True)], "float64"))

    def parts() -> tuple[Column, Column]:
        return _glicko(F.col("mu"), F.col("foe_mu") / F.col("foe_n"), F.col("foe_s2") / F.col("foe_n") / SCALE**2)

    def terms() -> dict[str, Column]:
        g, e = parts()
        return {"info": g * g * e * (1 - e), "pull": g * (F.col("result") - e)}

    def summed() -> dict[str, Column]:
        phi, v = F.sqrt("s2") / SCALE, 1 / F.col("info")
        vol = volatility(phi, v * F.col("pull"), v, F.col("vol"))
        after = 1 / (1 / (phi * phi + vol * vol) + F.col("info"))
        return {"mu": F.col("mu") + SCALE * after * F.col("pull"), "s2": after * SCALE**2, "vol": vol}

    def win() -> Column:
        g, _ = _glicko(F.col("mu"), F.col("mu"), (F.col("foe_s2") / F.col("foe_n") + F.col("side_s2") / F.col("n")) / SCALE**2)
        return 1 / (1 + F.exp(-g * (F.col("side_mu") / F.col("n") - F.col("foe_mu") / F.col("foe_n")) / SCALE))

    return Kernel(rules, win, terms, summed)


def plackett_luce(beta: float = 25 / 6, rules: Rules = PLACKETT_LUCE) -> Kernel:
    """Weng and Lin's update for two sides; variance shrinks by the product of its factors."""
    c2 = lambda: F.col("side_s2") + F.col("foe_s2") + 2 * beta**2
    win = lambda: 1 / (1 + F.exp((F.col("foe_mu") - F.col("side_mu")) / F.sqrt(c2())))
    both = lambda: normal_over(F.col("side_mu") - F.col("foe_mu"), F.sqrt(c2() + (F.col("n") + F.col("foe_n") - 2) * beta**2), F.lit(0.0))

    def terms() -> dict[str, Column]:
        p = win()
        shrink = 1 - F.col("s2") / c2() * (F.sqrt("side_s2") / F.sqrt(c2())) * p * (1 - p)
        return {"d": F.col("s2") / F.sqrt(c2()) * (F.col("result") - p), "shrink": F.ln(F.greatest(shrink, F.lit(1e-4)))}

    return Kernel(rules, both, terms, lambda: {"mu": F.col("mu") + F.col("d"), "s2": F.col("s2") * F.exp("shrink"), "vol": F.col("vol")})


def trueskill(beta: float = 4.167, rules: Rules = TRUESKILL) -> Kernel:
    """Without draws."""
    c2 = lambda: F.col("side_s2") + F.col("foe_s2") + (F.col("n") + F.col("foe_n")) * beta**2
    win = lambda: normal_over(F.col("side_mu") - F.col("foe_mu"), F.sqrt(c2()), F.lit(0.0))

    def terms() -> dict[str, Column]:
        sign = F.when(F.col("result") == 1, 1.0).otherwise(-1.0)
        t = sign * (F.col("side_mu") - F.col("foe_mu")) / F.sqrt(c2())
        # Far below 0 the ratio of density to distribution is -t, nearly.
        v = F.when(t < -4, -t).otherwise(F.exp(-t * t / 2) / math.sqrt(2 * math.pi) / normal_over(t, F.lit(1.0), F.lit(0.0)))
        w = F.least(v * (v + t), F.lit(1.0))
        return {"d": sign * F.col("s2") / F.sqrt(c2()) * v, "shrink": F.ln(F.greatest(1 - F.col("s2") / c2() * w, F.lit(1e-4)))}

    return Kernel(rules, win, terms, lambda: {"mu": F.col("mu") + F.col("d"), "s2": F.col("s2") * F.exp("shrink"), "vol": F.col("vol")})


def side_columns(roles: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    """Both sides' totals over a game, and from those side_mu, side_s2, n, foe_mu, foe_s2 and foe_n of a row."""
    game, blue, weight = Window.partitionBy("game"), F.col("side") == SIDES[0], None
    if roles:
        names = F.create_map(*(F.lit(x) for kv in ROLE_WEIGHTS.items() for x in kv))
        weight = F.coalesce(F.try_element_at(names, F.lower("position")), F.lit(OTHER_ROLE))
    made = {}
    for name, mine in (("__b", blue), ("__r", ~blue)):
        total = lambda c, mine=mine: F.sum(F.when(mine, c)).over(game)
        n = F.coalesce(total(F.lit(1.0)), F.lit(0.0))
        made[f"{name}mu"] = total(F.col("mu")) if weight is None else total(weight * F.col("mu")) / F.nullif(total(weight), F.lit(0.0)) * n
        made[f"{name}s2"], made[f"{name}n"] = total(F.col("s2")), n
    pick = lambda c, own: F.when(blue == F.lit(own), F.col(f"__b{c}")).otherwise(F.col(f"__r{c}"))
    return made, {f"side_{c}" if c != "n" else "n": pick(c, True) for c in ("mu", "s2", "n")} | {f"foe_{c}": pick(c, False) for c in ("mu", "s2", "n")}


def side_totals(rows: DataFrame, kernel: Kernel) -> DataFrame:
    """Each member's row with its side's and the other side's totals: side_mu, side_s2, n, foe_mu, foe_s2, foe_n; by one exchange by game.

    With a `position`, a side's rating is the weighted mean of its members' times their number. Games without one of the sides go.
    """
    totals, sides = side_columns("position" in rows.columns)
    return rows.withColumns(totals).where("__bn > 0 AND __rn > 0").withColumns(sides).drop(*totals)


def rate_period(events: DataFrame, state: DataFrame, kernel: Kernel, seasons: DataFrame, leagues: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(before, updated). before: game, side, entity, mu_before, s2_before, p_win; updated: the new states of those who played."""
    here = "position" in events.columns
    facts = ["played", "game", "season", "league", *(["position"] if here else [])]
    first = events.groupBy("entity").agg(F.min(F.struct(*facts)).alias("f"), F.max("played").alias("__last"), *([F.max_by("position", F.struct("played", "game")).alias("__as")] if here else []))
    first = first.select("entity", "__last", F.col("f.played").alias("played"), F.col("f.season").alias("now_season"), F.col("f.league").alias("now_league"), *([F.col("f.position").alias("now_position"), "__as"] if here else []))
    start = adjusted(first.drop("__last", "__as").join(state, "entity", "left"), kernel.rules, seasons, leagues)
    keep = ["game", "side", "entity", "result", *(["position"] if here else [])]
    terms, own = kernel.terms(), ["mu", "s2", "vol"]
    games = side_totals(events.select(*keep).join(start.select("entity", *own), "entity"), kernel)
    # Written once: what was known before each game, and what it adds to each member.
    games = written(games.select("game", "side", "entity", "mu", "s2", kernel.win().alias("p_win"), *(c.alias(f"__{n}") for n, c in terms.items())), "rated")
    before = games.select("game", "side", "entity", F.col("mu").alias("mu_before"), F.col("s2").alias("s2_before"), "p_win")
    sums = games.groupBy("entity").agg(*(F.sum(f"__{n}").alias(n) for n in terms))
    after = start.join(sums, "entity").join(first.select("entity", "__last", *(["__as"] if here else [])), "entity")
    new = kernel.summed()
    last_as = F.coalesce("__as", "position") if here else F.col("position")
    return before, after.select("entity", *(new[n].alias(n) for n in own), "season", "league", F.col("__last").alias("last_played"), last_as.alias("position"))


def merged_state(state: DataFrame, updated: DataFrame) -> DataFrame:
    return state.join(updated.select("entity"), "entity", "left_anti").unionByName(updated)


def season_order(events: DataFrame) -> DataFrame:
    """__season, __nth: seasons that began, in order."""
    return events.select(F.col("season").alias("__season")).distinct().withColumn("__nth", F.row_number().over(Window.orderBy("__season")))


def by_game(events: DataFrame) -> DataFrame:
    """events with a period for each game, in the order of time and number: what is rated so is the sequential fold."""
    at = F.unix_micros(F.col("played").cast("timestamp")) + F.lit(1 << 62)
    return events.withColumn("period", F.concat_ws("#", F.lpad(at.cast("string"), 20, "0"), F.lpad((F.col("game") + F.lit(1 << 62)).cast("string"), 20, "0")))


#: Steps of the search for layers that are planned together.
STEPS = 3


def layers(events: DataFrame) -> DataFrame:
    """game, entity, k, layer: k is the number of the entity's turn (its games of one period), and a layer holds turns that can be rated together.

    All games of a turn are in one layer, after those of its entities' earlier turns; so what is rated layer by layer equals what is rated
    period by period, and there are as many layers as the longest chain of turns has, not as there are periods. They are found by rounds of
    two maxima: along each entity's turns a layer grows by one at least, and a game's is that of its latest entity; until nothing changes.
    With a column `chunk` turns and layers are counted inside each chunk, so there are as many rounds as the longest chain of a chunk needs.
    """
    of = ["entity", *(["chunk"] if "chunk" in events.columns else [])]
    along = Window.partitionBy(*of).orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    game = Window.partitionBy("game")
    ranked = events.select("game", *of, "period").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy(*of).orderBy("period")))
    now, total = ranked.select("game", *of, "k", F.max("k").over(game).alias("layer")), None
    while True:
        for _ in range(STEPS):
            lifted = now.withColumn("__l", F.max(F.col("layer") - F.col("k")).over(along) + F.col("k"))
            now = lifted.select("game", *of, "k", F.max("__l").over(game).alias("layer"))
        now = written(now, "layers")
        found = now.agg(F.sum("layer")).first()[0]
        if found == total:
            return now
        total = found


#: So many periods are a layer each, without a search; so many rows or more are searched in so many chunks of periods.
FEW_PERIODS, MANY_ROWS, CHUNKS = 64, 2_000_000, 8


def in_layers(events: DataFrame) -> DataFrame:
    """`events` with `layer`, from 1 without gaps: an entity's later turn is in a later layer, and all games of a turn are in one.

    A few periods are layers as they are. Of many, layers are searched for; where rows are many, inside chunks of periods, whose layers follow
    each other: some more layers, but far fewer rounds over all rows. Any cuts between periods would do; these have about as many rows between them.
    """
    names = [r[0] for r in events.select("period").distinct().limit(FEW_PERIODS + 1).collect()]
    if len(names) <= FEW_PERIODS:
        known = sorted(x for x in names if x is not None)
        at = F.array_position(F.array(*map(F.lit, known)), F.col("period")) if known else F.lit(0)
        return events.withColumn("layer", (F.coalesce(at, F.lit(0)) + int(None in names)).cast("int"))
    events = written(events, "events")
    if events.count() < MANY_ROWS:
        return events.join(layers(events).drop("k").hint("merge"), ["game", "entity"])
    at = F.unix_micros("played")
    cuts = events.agg(F.percentile_approx(at, F.array(*(F.lit(k / CHUNKS) for k in range(1, CHUNKS))))).first()[0]
    lows = [x for x in events.agg(*(F.min(F.when(at > x, F.col("period"))) for x in cuts)).first() if x is not None]
    chunk = sum((F.coalesce(F.col("period") >= F.lit(x), F.lit(False)).cast("int") for x in lows), F.lit(0))
    found = layers(events.withColumn("chunk", chunk))
    before, offsets = 0, []
    for k, most in sorted(map(tuple, found.groupBy("chunk").agg(F.max("layer")).collect())):
        offsets.append((F.col("chunk") == k, before))
        before += most
    shift = sum((F.when(here, n).otherwise(0) for here, n in offsets), F.lit(0))
    return events.join(found.select("game", "entity", (F.col("layer") + shift).cast("int").alias("layer")).hint("merge"), ["game", "entity"])


def turns(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """One row for each entity and layer in which it plays: rows, next (the entity's next layer, -1 after its last turn), period, facts of its first game
    (now_*, played), of its end (ended, stays), of the turn before (season, league, last_played, position), and mu0, s20, vol0 of the first one from `state`."""
    here = "position" in rows.columns
    facts = ["played", "game", "season", "league", *(["position"] if here else [])]
    last = F.max_by("position", F.struct("played", "game")) if here else F.lit(None).cast("string")
    t = rows.groupBy("entity", "layer").agg(F.count("*").alias("rows"), F.first("period").alias("period"), F.min(F.struct(*facts)).alias("f"), F.max("played").alias("ended"), last.alias("__as"))
    now_position = F.col("f.position") if here else F.lit(None).cast("string")
    t = t.select("entity", "layer", "rows", "period", F.col("f.played").alias("played"), F.col("f.season").alias("now_season"), F.col("f.league").alias("now_league"), now_position.alias("now_position"), "ended", F.coalesce("__as", now_position).alias("__as"))
    order = Window.partitionBy("entity").orderBy("layer")
    t = t.withColumns({"next": F.coalesce(F.lead("layer").over(order), F.lit(-1)), "stays": F.last("__as", True).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    t = t.withColumns({"season": F.lag("now_season").over(order), "league": F.lag("now_league").over(order), "last_played": F.lag("ended").over(order), "position": F.lag("stays").over(order), "__k": F.row_number().over(order)}).drop("__as")
    if state is None:
        return t.withColumns({c: F.lit(None).cast("double") for c in ("mu0", "s20", "vol0")}).drop("__k")
    old = state.select("entity", *(F.col(c).alias(f"{c}0") for c in ("mu", "s2", "vol", "season", "league", "last_played", "position")))
    t, first = t.join(old.hint("merge"), "entity", "left"), F.col("__k") == 1
    of = lambda c: F.when(first, F.col(f"{c}0"))
    merged = {c: F.coalesce(c, of(c)) for c in ("season", "league", "last_played")} | {"position": F.coalesce("position", "position0"), "stays": F.coalesce("stays", "position0")}
    return t.withColumns(merged | {c: of(c[:-1]) for c in ("mu0", "s20", "vol0")}).drop("season0", "league0", "last_played0", "position0", "__k")


class Rated(NamedTuple):
    """rows: game, side, entity, layer, period, next, mu, s2 and vol at the start, p_win and what the game adds; turns: as `turns`; kernel."""

    rows: DataFrame
    turns: DataFrame
    kernel: Kernel

    def before(self) -> DataFrame:
        """game, side, entity, mu_before, s2_before, p_win, period."""
        return self.rows.select("game", "side", "entity", F.col("mu").alias("mu_before"), F.col("s2").alias("s2_before"), "p_win", "period")

    def after(self) -> DataFrame:
        """The state after each turn, with its period and layer."""
        facts = self.turns.select("entity", "layer", F.col("now_season").alias("season"), F.col("now_league").alias("league"), F.col("ended").alias("last_played"), F.col("stays").alias("position"))
        # Turns compress well: by the size of their files they would be broadcast, however many they are.
        return new_states(self.rows, self.kernel, "entity", "layer", "period").join(facts.hint("merge"), ["entity", "layer"])

    def state(self) -> DataFrame:
        """The last state of each entity that played."""
        last = F.col("next") == -1
        return Rated(self.rows.where(last), self.turns.where(last), self.kernel).after().select(*(x.split()[0] for x in STATE.split(", ")))


def new_states(rows: DataFrame, kernel: Kernel, *by: str) -> DataFrame:
    """`by`, mu, s2, vol after a turn, from its rated rows."""
    sums = rows.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("mu", "s2", "vol")), *(F.sum(f"__{n}").alias(n) for n in kernel.terms()))
    new = kernel.summed()
    return sums.select(*by, *(new[c].alias(c) for c in ("mu", "s2", "vol")))


#: Rows of a layer that are left in one task; rows of a file, about, where layers are many.
TOGETHER, A_FILE = 50_000, 1_000_000


def rated(events: DataFrame, kernel: Kernel, leagues: DataFrame | None = None, state: DataFrame | None = None) -> Rated:
    """All games, rated layer by layer from the states at the start of their periods.

    Nothing but mu, s2 and vol is unknown beforehand: turns, what they follow, seasons and leagues are joined once, on one row for each turn. Each
    layer's rows and turns are in folders of their own. A layer's rated rows are written to the folder of the layer in which their entity plays next;
    there they are summed to the entity's state. So a layer reads its own rows and turns and the states meant for it, no state is looked up in a table
    of all or written again, and a layer is one job with an exchange by entity and one by game. Counts by layer alone come to the driver.
    `leagues`: league and rating, for each period if it has that column.
    """
    spark, root = events.sparkSession, f"{work_folder(events.sparkSession)}/ratings-{uuid.uuid4().hex}"
    here = ["position"] if "position" in events.columns else []
    events = events.where("entity IS NOT NULL AND result IS NOT NULL AND league IS NOT NULL")
    events = events.select("game", F.col("played").cast("timestamp").alias("played"), "side", "entity", F.col("result").cast("double").alias("result"), F.col("season").cast("int").alias("season"), "league", "period", *here)

    def by_layer(df: DataFrame, name: str, many: bool) -> DataFrame:
        # A few layers are written from every task; of many, each would be in very many small files.
        (df.repartition("layer") if many else df).write.partitionBy("layer").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    rows = in_layers(events)
    many = len(rows.select("period").distinct().limit(FEW_PERIODS + 1).collect()) > FEW_PERIODS
    rows = by_layer(rows, "rows", many)
    seasons = written(season_order(rows).coalesce(1), "seasons")
    known = with_seasons(turns(rows, state), seasons)
    known = by_layer(known if leagues is None else with_leagues(known, leagues), "turns", many)
    counts = lambda by: {r[0]: (r[1], r[2]) for r in known.groupBy(by).agg(F.sum("rows"), F.count("*")).collect()}
    read, meant, terms, told = counts("layer"), counts("next"), kernel.terms(), None
    # Expressions are made once, for all layers.
    start, (totals, sides), names = moved_state(kernel.rules, leagues is not None), side_columns(bool(here)), ["mu", "s2", "vol"]
    first = [F.col(f"{c}0").alias(c) for c in names]
    either = [F.coalesce(F.col(f"s.{c}"), F.col(f"{c}0")).alias(c) for c in names]
    moved = [*map(F.col, ("entity", "period", "next")), *(start[c].alias(c) for c in names)]
    given = [*map(F.col, ("game", "side", "entity", "layer", "period", *names)), kernel.win().alias("p_win"), *(c.alias(f"__{n}") for n, c in terms.items()), F.col("next")]
    sums, new = [*(F.first(c).alias(c) for c in names), *(F.sum(f"__{n}").alias(n) for n in terms)], [F.col("entity").alias("__e"), *(c.alias(n) for n, c in kernel.summed().items())]
    played = rows.select("game", "side", "entity", "result", *here).schema
    turn = known.drop("layer").schema
    for layer in range(1, len(read) + 1):
        # The few rows of a small layer go to one task without any exchange.
        few = max(read[layer][0], meant.get(layer, (0, 0))[0]) <= TOGETHER
        part = lambda df: df.coalesce(1) if few else df  # noqa: E731, B023
        now, path = part(spark.read.schema(turn).parquet(f"{root}/turns/layer={layer}")), f"{root}/rated/next={layer}"
        if told is not None and layer in meant:
            old = part(spark.read.schema(told).parquet(path)).groupBy("entity").agg(*sums).select(*new).alias("s").hint("merge")
            now = now.alias("n").join(old, F.col("n.entity") == F.col("__e"), "left").select("n.*", *either)
        else:
            now = now.select("*", *first)
        # A few entities, as leagues are, may have very many rows each.
        now = F.broadcast(now.select(*moved)) if not few and read[layer][1] <= BROADCAST_ROWS else now.select(*moved).hint("merge")
        games = part(spark.read.schema(played).parquet(f"{root}/rows/layer={layer}")).join(now, "entity")
        made = games.withColumn("layer", F.lit(layer)).withColumns(totals).where("__bn > 0 AND __rn > 0").withColumns(sides).select(*given)
        if many and not few:
            made = made.repartition("next", F.pmod(F.xxhash64("entity"), F.lit(1 + read[layer][0] // A_FILE)))
        made.write.mode("append").partitionBy("next").parquet(f"{root}/rated")
        told = told or made.drop("next").schema
    if told is None:
        names = "game long, side string, entity long, layer int, period string, mu double, s2 double, vol double, p_win double, "
        return Rated(spark.createDataFrame([], names + "".join(f"__{n} double, " for n in terms) + "next int"), known, kernel)
    return Rated(spark.read.schema(told.add("next", "integer")).parquet(f"{root}/rated"), known, kernel)


def rating_periods(events: DataFrame, kernel: Kernel, leagues: DataFrame | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(before, state) over all periods in order; entities of the given state that never play keep theirs."""
    made = rated(events, kernel, leagues, state)
    after = written(made.state(), "state")
    return made.before(), after if state is None else merged_state(state, after)


def ratings_as_of(made: Rated, periods: DataFrame, name: Column, start: float) -> DataFrame:
    """period, league, rating: of each rated entity (`name` makes its league of the columns of `after`) as of the start of each period; `start` before its first turn."""
    known = made.after().select(name.alias("league"), F.col("period").alias("__p"), F.col("mu").alias("rating"))
    asked = known.select("league").distinct().crossJoin(sized(periods.select("period").distinct()))
    # A turn counts for the periods after its own.
    before = asof_join(asked.withColumn("__at", F.struct("period", F.lit(0).alias("o"))), known.withColumn("__t", F.struct(F.col("__p").alias("period"), F.lit(1).alias("o"))), ["league"], "__at", "__t", ["rating"])
    return before.select("period", "league", F.coalesce("rating", F.lit(start)).alias("rating"))


def league_events(events: DataFrame, home: DataFrame, pool_of: Column | None = None) -> DataFrame:
    """Games between entities of different home leagues (or pools), as games of the leagues: entity is a hash of the league, `name` its name.

    home: game, side, league: each side's home league as of the game.
    """
    name = home.select("game", "side", (F.col("league") if pool_of is None else pool_of).alias("name"))
    sides = events.select("game", "played", "side", "result", "season").distinct().join(name, ["game", "side"])
    both = sides.groupBy("game").agg(F.count_distinct("name").alias("n"))
    return sides.join(both.where("n = 2").select("game"), "game").withColumns({"entity": F.xxhash64("name"), "league": F.col("name")})


def shrunk(p: Column, games: Column, pull: float = 30.0) -> Column:
    return 0.5 + (p - 0.5) * games / (games + pull)


def advance(state: DataFrame, as_of: str | Column, season: int | Column, rules: Rules, seasons: DataFrame, position: str | Column | None = None) -> DataFrame:
    """The state on a later day on which no one played, in another role if `position` says so (a name or a column)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = state.withColumns({"played": lit(as_of).cast("timestamp"), "now_season": lit(season).cast("int"), "now_league": F.col("league"), "now_position": lit(position).cast("string")})
    return adjusted(rows, rules, seasons)


def serving_rows(fixtures: DataFrame, states: DataFrame, players: DataFrame, roles: list[str], rules: Rules, seasons: DataFrame) -> DataFrame:
    """game, side, entity, won, mu, chance, kills, idle and <role>_kills of both sides of future games.

    fixtures: game, side, entity, played, won, now_season, now_league; states: entity, of (the game that they come from),
    available, started, mu, kills, season, league; players: entity, of, role, kills. An entity without a state is new.
    """
    asked = fixtures.withColumn("id", F.struct("game", "side"))
    latest = asof_state(asked, states, ["entity"], "played", "played", "available", "started", ["of", "mu", "kills", "season", "league", "started"], "id")
    # Idle days count from the start of the game that a state was made of.
    latest = latest.withColumnsRenamed({"entity": "who", "started": "last_played"}).withColumns({"entity": F.col("id"), "s2": F.lit(0.0), "vol": F.lit(0.0)})
    now = adjusted(latest, rules, seasons).select(F.col("entity").alias("id"), "mu", "s2")
    rows = latest.drop("mu", "s2", "vol", "entity").join(now, "id")
    sides = side_totals(rows.select("game", "side", "mu", "s2"), elo()).select("game", "side", elo_win().alias("chance"))
    wide = pivot_roles(players, ["entity", "of"], "role", roles, ["kills"], strict=False).withColumnRenamed("entity", "who")
    idle = F.floor((F.unix_seconds(F.col("played").cast("timestamp")) - F.unix_seconds(F.col("last_played").cast("timestamp"))) / 86400).cast("long")
    out = rows.join(sides, ["game", "side"]).join(wide, ["who", "of"], "left")
    return out.select("game", "side", F.col("who").alias("entity"), "won", "mu", "chance", "kills", idle.alias("idle"), *(f"{x}_kills" for x in roles))


def last_year_rows(before: DataFrame, time: str, least_share: float = 0.0) -> DataFrame:
    """Rows of the last calendar year, or, if that is all there is, those after the 80% quantile of their days."""
    from antecede.operators.evaluation import quantiles

    last, first = before.agg(F.max(F.year(time)), F.min(F.year(time))).first()
    if last != first:
        return before.where(F.year(time) == last)
    day = F.unix_date(F.to_date(time))
    return before.where(day > quantiles(before.select(day.alias("d")), "d", [0.8])[0])
