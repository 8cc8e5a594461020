"""Rating queries on the duels view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.operators import evaluation as e, history as h, joins as j, ratings as ra, reshape as rs
from antecede.plans.duels import DUELS, duels
from antecede.plans.registry import Tables, query, r
from antecede.sources.tables import written

_NORMAL = "(CASE WHEN {0} % 7 = 0 THEN NULL WHEN {0} % 7 < 4 THEN 1.0 ELSE 0.0 END)"


def events(t: Tables, period: str = "year") -> DataFrame:
    made = {"year": F.year("played").cast("string"), "week": F.date_format(F.date_trunc("week", "played"), "yyyy-MM-dd"), "quarter": F.concat_ws("-", F.year("played").cast("string"), F.quarter("played").cast("string")), "half": F.when(F.col("played") < F.lit("1998-01-01").cast("timestamp"), "1").otherwise("2")}[period]
    return duels(t).withColumns({"entity": F.col("entity"), "season": F.year("played"), "period": made})


@query(f"""{DUELS}, x AS (SELECT game, entity, side, league, {_NORMAL.format('game')} AS result FROM duels) SELECT game, entity, side, league, result FROM x WHERE result IS NOT NULL AND league <> 'FURNITURE'""")
def i1_rating_input(t: Tables) -> DataFrame:
    from antecede.functions.columns import normal_result

    raw = F.when(F.col("game") % 7 == 0, "?").when(F.col("game") % 7 < 4, "Win").otherwise("l")
    x = duels(t).withColumn("raw", raw).withColumn("result", normal_result("raw")).withColumn("league", F.when(F.col("league") != "FURNITURE", F.col("league")))
    return x.where("result IS NOT NULL AND league IS NOT NULL").select("game", "entity", "side", "league", "result")


ADJUST = """WITH s AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 5 <> 0 THEN 1500 + c_acctbal / 100 END AS mu, 1995 + c_custkey % 6 AS season, c_mktsegment AS league, TIMESTAMP '2000-01-01' - to_days((c_custkey % 400)::INT) AS last_played, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS now_league FROM customer),
    l AS (SELECT c_mktsegment AS league, 1500 + avg(c_acctbal) / 100 AS rating FROM customer GROUP BY 1),
    x AS (SELECT s.*, a.rating AS to_, b.rating AS from_, (SELECT avg(rating) FROM l) AS mean_, pow(0.9::DOUBLE, greatest(2000 - season, 0)) * pow(0.5::DOUBLE, greatest(c.d - 45, 0) / 180.0) AS keep FROM s JOIN l a ON a.league = s.now_league JOIN l b ON b.league = s.league, LATERAL (SELECT date_diff('day', last_played, TIMESTAMP '2000-01-01') AS d) c)
    SELECT entity, round(CASE WHEN mu IS NULL THEN 1500 + greatest(least((to_ - mean_) * 0.5, 300), -300) ELSE 1500 + (mu - 1500) * keep + CASE WHEN league <> now_league THEN 0.5 * (to_ - from_) ELSE 0 END END, 6) AS mu, 2000 AS season FROM x"""


@query(ADJUST)
def i3_adjusted_state(t: Tables) -> DataFrame:
    """Season decay, idle half-life, league moves and new entities, for customers as rated entities."""
    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("entity"), F.lit("2000-01-01").cast("timestamp").alias("played"), F.lit(2000).alias("now_season"), F.when(k % 3 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("now_league"), F.when(k % 5 != 0, 1500 + F.col("c_acctbal") / 100).alias("mu"),
        F.lit(0.0).alias("s2"), F.lit(0.0).alias("vol"), (1995 + k % 6).cast("int").alias("season"), F.col("c_mktsegment").alias("league"), (F.lit("2000-01-01").cast("timestamp") - F.make_dt_interval((k % 400).cast("int"))).alias("last_played"),
    )
    seasons = ra.season_order(t.spark.range(1995, 2001).select(F.col("id").cast("int").alias("season")))
    leagues = t.customer.groupBy(F.col("c_mktsegment").alias("league")).agg((1500 + F.avg("c_acctbal") / 100).alias("rating"))
    return ra.adjusted(rows, ra.ELO, seasons, leagues).select("entity", r("mu"), "season")


@query(f"""{DUELS}, a AS (SELECT *, played < TIMESTAMP '1998-01-01' AS early, year(played) AS season FROM duels), m1 AS (SELECT entity, 1500 + sum(32 * (result - 0.5::DOUBLE)) AS mu, arg_min(season, (played, game)) AS season, max(played) AS last FROM a WHERE early GROUP BY entity),
    f AS (SELECT entity, min(played) AS first, arg_min(season, (played, game)) AS season FROM a WHERE NOT early GROUP BY entity),
    s AS (SELECT f.entity, coalesce(1500 + (m1.mu - 1500) * pow(0.9::DOUBLE, greatest(f.season - m1.season, 0)) * pow(0.5::DOUBLE, greatest(date_diff('day', last, first) - 45, 0) / 180.0), 1500) AS mu FROM f LEFT JOIN m1 USING (entity)),
    g AS (SELECT a.game, a.side, a.entity, s.mu, o.mu AS foe FROM a JOIN s USING (entity) JOIN s o ON o.entity = a.opponent WHERE NOT early)
    SELECT game, side, entity, round(mu, 6) AS mu_before, round(1 / (1 + pow(10::DOUBLE, (foe - mu) / 400)), 6) AS p_win FROM g UNION ALL SELECT game, side, entity, 1500, round(0.5::DOUBLE, 6) FROM a WHERE early""")
def i2_i8_elo_two_periods(t: Tables) -> DataFrame:
    """Elo over two periods, which SQL can say in full."""
    before, _ = ra.rating_periods(events(t, "half"), ra.elo())
    return before.select("game", "side", "entity", r("mu_before"), r("p_win"))


_roles = ("top", "jng", "mid", "bot", "sup")
_weight = "CASE position " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in ra.ROLE_WEIGHTS.items()) + " END"


def members(t: Tables) -> DataFrame:
    """Five members of each side, who trade places in every ninth game."""
    k = (F.col("k") + (F.col("game") % 9 == 0).cast("int")) % 5
    made = events(t, "half").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return made.withColumns({"position": F.element_at(F.array(*map(F.lit, _roles)), (k + 1).cast("int")), "entity": F.col("entity") * 5 + F.col("k")}).drop("k")


@query(f"""{DUELS}, a AS (SELECT game, played, side, entity * 5 + k AS entity, result, [{', '.join(f"'{x}'" for x in _roles)}][(k + (game % 9 = 0)::INT) % 5 + 1] AS position, played < TIMESTAMP '1998-01-01' AS early, year(played) AS season FROM duels CROSS JOIN range(0, 5) m(k)),
    m1 AS (SELECT entity, 1500 + sum(32 * (result - 0.5::DOUBLE)) AS mu, arg_min(season, (played, game)) AS season, max(played) AS last, arg_max(position, (played, game)) AS pos FROM a WHERE early GROUP BY entity),
    f AS (SELECT entity, min(played) AS first, arg_min(season, (played, game)) AS season, arg_min(position, (played, game)) AS pos FROM a WHERE NOT early GROUP BY entity),
    s AS (SELECT f.entity, coalesce(1500 + (m1.mu - 1500) * pow(0.9::DOUBLE, greatest(f.season - m1.season, 0)) * pow(0.5::DOUBLE, greatest(date_diff('day', last, first) - 45, 0) / 180.0) * CASE WHEN m1.pos <> f.pos THEN 0.8::DOUBLE ELSE 1 END, 1500) AS mu FROM f LEFT JOIN m1 USING (entity)),
    g AS (SELECT a.*, s.mu FROM a JOIN s USING (entity) WHERE NOT early), t AS (SELECT game, side, sum({_weight} * mu) / sum({_weight}) * count(*) AS total FROM g GROUP BY ALL)
    SELECT g.game, g.side, g.entity, round(g.mu, 6) AS mu_before, round(1 / (1 + pow(10::DOUBLE, (o.total - m.total) / 400)), 6) AS p_win FROM g JOIN t m ON m.game = g.game AND m.side = g.side JOIN t o ON o.game = g.game AND o.side <> g.side
    UNION ALL SELECT game, side, entity, 1500, 0.5 FROM a WHERE early""")
def i2_i3_player_elo(t: Tables) -> DataFrame:
    """Players in roles: a side's rating is weighted by role, and who changes role goes part of the way back to the baseline."""
    before, _ = ra.rating_periods(members(t), ra.elo())
    return before.select("game", "side", "entity", r("mu_before"), r("p_win"))


@query()
def i8_elo_by_quarter(t: Tables) -> DataFrame:
    """As by year, in 28 periods."""
    return ra.rating_periods(events(t, "quarter"), ra.elo())[1]


_decayed = "CASE WHEN {s}.mu IS NULL THEN 1500 ELSE 1500 + ({s}.mu - 1500) * pow(0.9::DOUBLE, greatest({e}.season - {s}.season, 0)) * pow(0.5::DOUBLE, greatest(date_diff('day', {s}.last, {e}.first) - 45, 0) / 180.0) END"


def fold_sql(period: str) -> str:
    """Elo in SQL, period after period: each step of the recursion rates one period's games from the states at its start."""
    return f"""{DUELS.replace("WITH", "WITH RECURSIVE", 1)}, g AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY {period}) AS i FROM games),
    e AS MATERIALIZED (SELECT entity, i, min(played) AS first, max(played) AS last, arg_min(year(played), (played, game)) AS season FROM (SELECT blue AS entity, * FROM g UNION ALL SELECT red, * FROM g) GROUP BY ALL),
    st(entity, mu, season, last, i) USING KEY (entity) AS (
        SELECT -1::BIGINT, 1500.0::DOUBLE, 0::BIGINT, TIMESTAMP '1900-01-01', 0::BIGINT
        UNION ALL
        SELECT entity, max(mu) + sum(d), max(season), max(last), max(i) FROM (
            SELECT unnest([blue, red]) AS entity, unnest([mb, mr]) AS mu, unnest([1, -1]) * 32 * (blue_won - 1 / (1 + pow(10::DOUBLE, greatest(least((mr - mb) / 400, 8), -8)))) AS d, unnest([sb, sr]) AS season, unnest([lb, lr]) AS last, i
            FROM (SELECT g.i, g.blue, g.red, g.blue_won, eb.season AS sb, er.season AS sr, eb.last AS lb, er.last AS lr, {_decayed.format(s="b", e="eb")} AS mb, {_decayed.format(s="r", e="er")} AS mr
                FROM (SELECT max(i) + 1 AS n FROM st) s JOIN g ON g.i = s.n JOIN e eb ON eb.entity = g.blue AND eb.i = s.n JOIN e er ON er.entity = g.red AND er.i = s.n LEFT JOIN recurring.st b ON b.entity = g.blue LEFT JOIN recurring.st r ON r.entity = g.red)
        ) GROUP BY entity
    ) SELECT entity, round(mu, 6) AS mu, last AS last_played FROM st WHERE entity >= 0"""


@query(fold_sql("played, game"))
def i8_elo_game_by_game(t: Tables) -> DataFrame:
    """Every game rated from what all earlier ones left: as many layers as the longest chain of games has, each one job."""
    return ra.rating_periods(ra.by_game(events(t)), ra.elo())[1].select("entity", r("mu"), "last_played")


@query(fold_sql("date_trunc('week', played)"))
def i8_elo_by_week(t: Tables) -> DataFrame:
    """Some 340 weeks, in as many layers as the longest chain of meetings has."""
    return ra.rating_periods(events(t, "week"), ra.elo())[1].select("entity", r("mu"), "last_played")


@query()
def i3_i7_league_and_entity_elo(t: Tables) -> DataFrame:
    """Two coupled systems by quarter: leagues are rated by the games between them, and entities start and move by the leagues' ratings as of each quarter. Held against a plain fold in the tests."""
    ev = events(t, "quarter")
    made = coupled(ev, _homes(t))
    return made.before()


def coupled(ev: DataFrame, homes: DataFrame, rules: ra.Rules = ra.ELO) -> ra.Rated:
    """Entities' ratings by period, from leagues' as of it. homes: game, side, league."""
    rated = leagues_by_period(ev, homes)
    return ra.rated(ev, ra.elo(rules=rules), leagues=rated)


def leagues_by_period(ev: DataFrame, homes: DataFrame) -> DataFrame:
    """period, league, rating as of the period's start."""
    between = ra.league_events(ev, homes)
    # `league_events` drops the period: it is that of the game.
    between = between.join(ev.select("game", "period").distinct(), "game")
    made = ra.rated(between.select("game", "played", "side", "result", "season", "entity", "league", "period"), ra.elo(rules=ra.ELO._replace(grace_days=None)))
    return written(ra.ratings_as_of(made, ev, F.col("league"), ra.ELO.mu), "leagues")


@query()
def i8_elo_by_year(t: Tables) -> DataFrame:
    """Elo by year; held against a plain fold in the tests."""
    return ra.rating_periods(events(t), ra.elo())[1]


@query()
def i4_glicko2_by_year(t: Tables) -> DataFrame:
    """The published example of Glicko-2 is in the tests."""
    return ra.rating_periods(events(t), ra.glicko2())[1]


@query()
def i5_plackett_luce_by_year(t: Tables) -> DataFrame:
    return ra.rating_periods(events(t), ra.plackett_luce())[1]


@query()
def i6_trueskill_by_year(t: Tables) -> DataFrame:
    return ra.rating_periods(events(t), ra.trueskill())[1]


def _homes(t: Tables) -> DataFrame:
    """game, side, league: each side's latest known home league as of the game."""
    d = duels(t).withColumn("home", F.when(F.col("game") % 3 != 0, F.col("league")))
    known = d.where("home IS NOT NULL").select("entity", F.col("played").alias("at"), F.col("home").alias("known"), F.col("game").alias("g"))
    return j.asof_join(d.select("game", "side", "entity", "played"), known, ["entity"], "played", "at", ["known"], ["g"]).where("known IS NOT NULL").select("game", "side", F.col("known").alias("league"))


@query()
def i7_league_elo(t: Tables) -> DataFrame:
    """Leagues rated by their cross-league games, home leagues as of each game, probabilities shrunk by how often both have met."""
    homes = _homes(t)
    ev = ra.league_events(events(t), homes)
    before, _ = ra.rating_periods(ev.select("game", "played", "side", "result", "season", "entity", "league", F.year("played").cast("string").alias("period")), ra.elo(rules=ra.ELO._replace(grace_days=None)))
    names = ev.select("entity", F.col("name").alias("league")).distinct()
    met = before.groupBy("entity", "period").agg(F.count("*").alias("games"), F.max("mu_before").alias("mu"), F.avg("p_win").alias("p"))
    return met.join(names, "entity").select("league", "period", "games", "mu", ra.shrunk(F.col("p"), F.col("games")).alias("p_shrunk"))


@query()
def i7_pool_elo(t: Tables) -> DataFrame:
    """As leagues, but pools of them, with a quarter of the step; held against a plain fold in the tests."""
    homes = _homes(t)
    ev = ra.league_events(events(t), homes, F.when(F.col("league").isin("BUILDING", "MACHINERY"), "heavy").otherwise("light"))
    before, _ = ra.rating_periods(ev.select("game", "played", "side", "result", "season", "entity", "league", F.year("played").cast("string").alias("period")), ra.elo(k=32 * ra.POOL_SHARE, rules=ra.ELO._replace(grace_days=None)))
    names = ev.select("entity", F.col("name").alias("pool")).distinct()
    met = before.groupBy("entity", "period").agg(F.count("*").alias("games"), F.max("mu_before").alias("mu"), F.avg("p_win").alias("p"))
    return met.join(names, "entity").select("pool", "period", "games", "mu", ra.shrunk(F.col("p"), F.col("games")).alias("p_shrunk"))


@query(f"""{DUELS}, a AS (SELECT game, played, side, entity, 1500 + (entity * 37 % 400) + game % 10 AS mu FROM duels), z AS (SELECT game, side, entity, first_value(mu) OVER (PARTITION BY entity, played::DATE ORDER BY played, game) AS mu FROM a)
    SELECT a.game, a.side, round(1 / (1 + pow(10::DOUBLE, (b.mu - a.mu) / 400.0)), 6) AS likelihood FROM z a JOIN z b ON a.game = b.game AND a.side <> b.side""")
def i9_frozen_likelihood(t: Tables) -> DataFrame:
    from antecede.keys import EntitySpec

    d = duels(t).withColumn("mu", (1500 + F.col("entity") * 37 % 400 + F.col("game") % 10).cast("double"))
    z = h.freeze_day(d, EntitySpec(("entity",), "played", ("game",)), ["mu"]).withColumn("s2", F.lit(0.0))
    return ra.side_totals(z.select("game", "side", "entity", "mu", "s2"), ra.elo()).select("game", "side", r(ra.elo_win(), name="likelihood"))


@query(f"""{DUELS}, x AS (SELECT game, played, result AS y, (entity % 89 + 0.5) / 90 AS p FROM duels) SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM x WHERE year(played) = (SELECT max(year(played)) FROM x)""")
def i10_rating_evaluation(t: Tables) -> DataFrame:
    x = duels(t).select("game", "played", F.col("result").alias("y"), ((F.col("entity") % 89 + 0.5) / 90).alias("p"))
    return e.prediction_quality(ra.last_year_rows(x, "played"), "y", "p").select("n", r("log_loss"))


@query("""SELECT c_custkey AS entity, round(1500 + (c_acctbal / 100) * CASE WHEN c_custkey % 5 <> c_custkey % 3 THEN 0.8::DOUBLE ELSE 1 END * pow(0.9::DOUBLE, 2001 - (1995 + c_custkey % 6)) * pow(0.5::DOUBLE, greatest(date_diff('day', TIMESTAMP '2000-06-01' - to_days((c_custkey % 400)::INT), TIMESTAMP '2001-01-15') - 45, 0) / 180.0), 6) AS mu FROM customer""")
def i11_advance(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    state = t.customer.select(k.alias("entity"), (1500 + F.col("c_acctbal") / 100).alias("mu"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("vol"), (1995 + k % 6).cast("int").alias("season"), F.col("c_mktsegment").alias("league"), (F.lit("2000-06-01").cast("timestamp") - F.make_dt_interval((k % 400).cast("int"))).alias("last_played"), (k % 5).cast("string").alias("position"))
    seasons = ra.season_order(t.spark.range(1995, 2002).select(F.col("id").cast("int").alias("season")))
    return ra.advance(state.withColumn("next_role", (F.col("entity") % 3).cast("string")), "2001-01-15", 2001, ra.ELO, seasons, F.col("next_role")).select("entity", r("mu"))


#: Of each past game, what is known of an entity from ten days after it on: a rating, kills, and those of three roles.
_state = "1500.0::DOUBLE + (entity * 37 % 400) + game % 10"


@query(f"""{DUELS}, st AS (SELECT entity, game, played, league, {_state} AS mu, kills, played + INTERVAL 10 DAY AS available FROM duels WHERE played < TIMESTAMP '2000-01-01'),
    fx AS (SELECT game, played, side, entity, result FROM duels WHERE played >= TIMESTAMP '2000-01-01'),
    l AS (SELECT fx.*, s.mu, s.kills, s.played AS last FROM fx LEFT JOIN LATERAL (SELECT * FROM st WHERE st.entity = fx.entity AND st.available <= fx.played AND st.played < date_trunc('day', fx.played) ORDER BY st.available DESC, st.played DESC, st.game DESC LIMIT 1) s ON TRUE),
    v AS (SELECT *, CASE WHEN mu IS NULL THEN 1500 ELSE 1500 + (mu - 1500) * pow(0.9::DOUBLE, year(played) - year(last)) * pow(0.5::DOUBLE, greatest(date_diff('day', last, played) - 45, 0) / 180.0) END AS now, date_diff('day', last, played) AS idle FROM l),
    p AS (SELECT v.*, 1 / (1 + pow(10::DOUBLE, (o.now - v.now) / 400)) AS chance, row_number() OVER (PARTITION BY v.game ORDER BY v.entity, v.side) AS k FROM v JOIN v o ON o.game = v.game AND o.side <> v.side)
    SELECT a.game, round(a.now - b.now, 6) AS delta_mu, round(a.chance - b.chance, 6) AS delta_chance, round(a.kills - b.kills, 2) AS delta_kills, a.idle - b.idle AS delta_idle, round(a.kills * 1 / 6 - b.kills * 1 / 6, 2) AS delta_top_kills, round(a.kills * 3 / 6 - b.kills * 3 / 6, 2) AS delta_mid_kills, a.result AS first_won
    FROM p a JOIN p b ON a.game = b.game AND a.k = 1 AND b.k = 2""")
def j13_serving_rows(t: Tables) -> DataFrame:
    """A future fixture's matchup row: latest states as of it, advanced over idle days, chances of both sides, roles side by side; by the functions that make training rows."""
    d = duels(t)
    then = F.lit("2000-01-01").cast("timestamp")
    past = d.where(F.col("played") < then)
    states = past.select("entity", "game", (F.col("played") + F.expr("INTERVAL 10 DAYS")).alias("available"), F.col("played").alias("started"), (1500.0 + F.col("entity") * 37 % 400 + F.col("game") % 10).alias("mu"), "kills", F.year("played").alias("season"), "league")
    parts = F.array(*(F.struct(F.lit(x).alias("role"), F.lit(k).alias("part")) for k, x in ((1, "top"), (2, "jng"), (3, "mid"))))
    players = past.select("entity", F.col("game").alias("of"), "kills", F.explode(parts).alias("x")).select("entity", "of", "x.role", (F.col("kills") * F.col("x.part") / 6).alias("kills"))
    fixtures = d.where(F.col("played") >= then).select("game", "side", "entity", "played", F.col("result").alias("won"), F.year("played").alias("now_season"), F.col("league").alias("now_league"))
    rows = ra.serving_rows(fixtures, states.withColumnRenamed("game", "of"), players, ["top", "jng", "mid"], ra.ELO, ra.season_order(d.withColumn("season", F.year("played"))))
    out = rs.matchup_rows(rows, "game", ["entity", "side"], ["mu", "chance", "kills", "idle", "top_kills", "mid_kills"], [], [], "won")
    return out.select("game", r("delta_mu"), r("delta_chance"), r("delta_kills", 2), "delta_idle", r("delta_top_kills", 2), r("delta_mid_kills", 2), "first_won")


@query()
def flagship_enrichment(t: Tables) -> DataFrame:
    """Every feature of a side's row that is known before its game: history windows, head to head, recent form, ratings, and the opponent's of the same."""
    from antecede.keys import EntitySpec

    who = EntitySpec(("entity",), "played", ("game",))
    x = h.prior_mean(duels(t), who, {"kills_before": "kills", "won_before": "result"})
    x = h.days_since_previous(x, who)
    x = h.head_to_head(x, who, "opponent", "result")
    x = h.side_ewm(x, who, "side", "result", ("Blue", "Red"))
    before, _ = ra.rating_periods(events(t), ra.elo())
    x = x.join(before.select("game", "side", "mu_before", "p_win"), ["game", "side"], "left")
    known = ["kills_before", "won_before", "days_since_previous", "mu_before", "p_win"]
    x = j.pair_opponents(x, ["game"], "side", ("Blue", "Red"), known)
    return j.with_differences(x, known)
