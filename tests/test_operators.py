"""Cases that SQL doesn't show: leaks, order, plain folds, published examples, failures."""

import datetime as dt
import math
import random
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from antecede import keys
from antecede.functions import columns as c
from antecede.operators import evaluation as e, history as h, joins as j, ledger as l, merge as m, ratings as ra, reshape as rs, runs, splits as s
from antecede.sources import tables

E = keys.EntitySpec(("who",), "at", ("k",))
T0 = dt.datetime(2024, 1, 1, 12)


def day(n, hours=0):
    return T0 + dt.timedelta(days=n, hours=hours)


def data(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(2)
    rows = [(k % 3, day(rng.randint(0, 30), rng.randint(0, 5)), k, None if rng.random() < 0.1 else rng.uniform(0, 10)) for k in range(120)]
    return spark.createDataFrame(rows, "who int, at timestamp, k int, v double")


def test_rows_of_one_time_share_what_was_known_before(spark):
    rows = [("a", day(0), 1, 4.0), ("a", day(2), 2, 10.0), ("a", day(2), 3, 20.0), ("a", day(3), 4, None), ("b", day(3), 5, 1.0)]
    df = spark.createDataFrame(rows, "who string, at timestamp, k int, v double")
    got = {r["k"]: (r["p"], r["d"]) for r in data(h.days_since_previous(h.prior_mean(df, E, {"p": "v"}), E, "d"))}
    assert got == {1: (None, None), 2: (4.0, 2), 3: (4.0, 2), 4: (34 / 3, 1), 5: (None, None)}


def test_a_later_row_changes_nothing_before(spark, games):
    more = games.unionByName(spark.createDataFrame([(0, day(99), 999, 1e9)], games.schema))
    near = lambda x: None if x is None else round(x, 9)
    made = lambda df: {r["k"]: (near(r["p"]), near(r["ema_v_before"])) for r in data(h.ewm(h.prior_mean(df, E, {"p": "v"}), E, "v"))}
    a, b = made(games), made(more.repartition(5))
    b.pop(999)
    assert a == b


def test_ewm_is_the_fold_across_blocks(spark, games, monkeypatch):
    want = {}
    for who in range(3):
        x = w = 0.0
        for r in sorted((r for r in data(games) if r["who"] == who), key=lambda r: (r["at"], r["k"])):
            if r["v"] is not None:
                x, w = x * 2 ** (-1 / 9) + r["v"], w * 2 ** (-1 / 9) + 1
            want[r["k"]] = x / w if w else None
    for block in (4096, 400):
        monkeypatch.setattr(h, "BLOCK", block)
        for r in data(h.ewm(games, E, "v")):
            assert r["ema_v_after"] == pytest.approx(want[r["k"]], rel=1e-12)
    long = spark.range(9000).select(F.lit("a").alias("who"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").alias("k"), F.sin("id").alias("v"))
    x = w = 0.0
    for k in range(9000):
        x, w = x * 2 ** (-1 / 9) + math.sin(k), w * 2 ** (-1 / 9) + 1
    assert h.ewm(long, E, "v").where("k = 8999").first()["ema_v_after"] == pytest.approx(x / w, rel=1e-9)


def test_a_day_takes_its_first_value_even_if_null(spark):
    df = spark.createDataFrame([("a", day(0), 1, None), ("a", day(0, 1), 2, 5.0), ("a", day(1), 3, 7.0)], "who string, at timestamp, k int, v double")
    assert [r["v"] for r in data(h.freeze_day(df, E, ["v"]), "k")] == [None, None, 7.0]


def test_lineups_need_five(spark):
    rows = [("t", day(d), p) for d, ps in ((0, "abcde"), (2, "abcdf"), (4, "abc")) for p in ps]
    got = data(h.roster_continuity(spark.createDataFrame(rows, "t string, at timestamp, p string"), "t", "at", "p"), "at")
    assert [r["continuity"] for r in got] == [None, 0.8, None] and [r["uncertainty"] for r in got] == [1.0, pytest.approx(0.2), 1.0]


def test_joins_prove_their_cardinality(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeats"):
        keys.join_checked(a, b, ["k"])
    with pytest.raises(ValueError, match="no match"):
        keys.join_checked(a, b.limit(1), ["k"], matched=True)
    with pytest.raises(ValueError, match="no opponent"):
        j.pair_opponents(spark.createDataFrame([(1, "Blue", 2)], "g int, side string, v int"), ["g"], "side", ("Blue", "Red"), ["v"], strict=True)
    with pytest.raises(ValueError, match="unknown"):
        j.dimension_join(a, b.where("v = 'x'").dropDuplicates(["k"]), "k", {}, strict=True)


def test_nan_is_null(spark):
    assert keys.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "x double, y int")).first().asDict() == {"x": None, "y": 1}


def test_uuids_are_pythons(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    names = [f"customer:{k}" for k in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["u"] for r in data(df.withColumn("u", keys.uuid5(space, F.col("n"))))} == {n: str(uuid.uuid5(uuid.UUID(space), n)) for n in names}


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    df = spark.range(10)
    names = [tables.publish_generation(df.where(F.col("id") < k), root) for k in (3, 5, 7)]
    assert tables.read_generation(spark, root).count() == 7 and tables.read_generation(spark, root, 1).count() == 5
    assert not (tmp_path / "g" / names[0]).exists()
    with pytest.raises(ValueError, match="no such"):
        tables.read_generation(spark, root, 2)
    spark.range(1).write.mode("append").parquet(f"{root}/{names[2]}")
    with pytest.raises(ValueError, match="isn't what"):
        tables.read_generation(spark, root)


def test_two_publishers_lose_no_generation(spark, tmp_path, monkeypatch):
    root, df, real, stale = f"file://{tmp_path}/gen", spark.range(9), tables._current, []
    tables.publish_generation(df.where("id < 2"), root, keep=4)

    def seen(s_, r_):
        # The other publisher comes between this one's look at the pointer and its own pointer.
        found = real(s_, r_)
        if not stale:
            stale.append(found)
            tables.publish_generation(df.where("id < 5"), root, keep=4)
        return found

    monkeypatch.setattr(tables, "_current", seen)
    tables.publish_generation(df, root, keep=4)
    assert [tables.read_generation(spark, root, k).count() for k in range(3)] == [9, 5, 2]
    assert real(spark, root)[0] == 3 and not [x for x in (tmp_path / "gen").iterdir() if x.name.startswith(".pointer")]


def test_missing_years_fail(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.option("header", True).csv(f"{tmp_path}/2001.csv")
    spark.createDataFrame([], "a int").write.option("header", True).csv(f"{tmp_path}/2002.csv")
    assert tables.read_yearly_csv(spark, str(tmp_path), "a int", [2001]).count() == 1
    with pytest.raises(ValueError, match="2002"):
        tables.read_yearly_csv(spark, str(tmp_path), "a int", [2001, 2002])


def test_chains_and_cycles(spark):
    links = {1: 2, 2: 3, 3: None, 4: 5, 5: 4, 6: 99, 7: None, 8: 8} | {100 + k: 101 + k for k in range(40)} | {140: None}
    got = {r["id"]: (r["tip"], r["hops"]) for r in data(j.resolve_chains(spark.createDataFrame(list(links.items()), "id long, next long")))}
    assert [got[k] for k in (1, 2, 3, 6, 7)] == [(3, 2), (3, 1), (3, 0), (99, 1), (7, 0)]
    assert got[4][0] is None and got[5][0] is None and got[8][0] is None
    assert got[100] == (140, 40)


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, "b", 9)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 5, "same", 1), ("a", 5, "later", 2), ("a", 6, "after", 3)], "k string, u int, v string, n int")
    assert {r["i"]: r["v"] for r in data(j.asof_join(left, right, ["k"], "t", "u", ["v"], ["n"]))} == {1: "later", 2: None, 3: None}


def test_strict_runs_like_a_walk(spark):
    rng = random.Random(7)
    rows = [(who, day(0) + dt.timedelta(minutes=k), k, rng.choice([1, 1, 2, 2, 3, 4]), rng.random() < 0.15) for who in range(8) for k in range(60)]
    df = spark.createDataFrame(rows, "who int, at timestamp, k int, seq int, far boolean")
    got = {(r["who"], r["k"]): r["reason"] for r in data(runs.strict_runs(df, ["who"], ["at", "k"], "seq", F.col("far")))}
    for who in range(8):
        open_, prev = False, None
        for _, _, k, seq, far in (r for r in rows if r[0] == who):
            if seq == 1:
                open_, want = True, None
            elif not open_:
                want = "does not start at 1"
            else:
                want = "sequence" if seq != prev + 1 else "gap" if far else None
                open_ = want is None
            prev = seq
            assert got[who, k] == want


def plain_elo(rows):
    mu = defaultdict(lambda: 1500.0)
    before = {}
    for game, _, a, b, won in rows:
        p = 1 / (1 + 10 ** ((mu[b] - mu[a]) / 400))
        before[game] = (mu[a], mu[b], p)
        d = 32 * (won - p)
        mu[a], mu[b] = mu[a] + d, mu[b] - d
    return before, dict(mu)


def plain_layers(rows):
    """Each game's layer: one more than the largest of its entities' earlier games."""
    seen, out = defaultdict(int), {}
    for game, _, a, b, _ in rows:
        out[game] = seen[a] = seen[b] = 1 + max(seen[a], seen[b])
    return out


@pytest.mark.parametrize("steps", [1, 3])
def test_games_in_layers_are_the_sequential_fold(spark, monkeypatch, steps):
    monkeypatch.setattr(ra, "STEPS", steps)
    rng = random.Random(11)
    rows = [(g, day(g // 12, g % 12 // 2), *rng.sample(range(9), 2), rng.randint(0, 1)) for g in range(48)]
    tall = [(g, at, side, who, res, 2024, "l") for g, at, a, b, won in rows for side, who, res in (("Blue", a, won), ("Red", b, 1 - won))]
    events = spark.createDataFrame(tall, "game long, played timestamp, side string, entity long, result int, season int, league string")
    assert {r["game"]: r["layer"] for r in data(ra.layers(ra.by_game(events)))} == plain_layers(rows)
    before, state = ra.rating_periods(ra.by_game(events), ra.elo())
    want, last = plain_elo(rows)
    for r in data(before.where("side = 'Blue'")):
        assert (r["mu_before"], r["p_win"]) == (pytest.approx(want[r["game"]][0]), pytest.approx(want[r["game"]][2]))
    assert {r["entity"]: pytest.approx(r["mu"]) for r in data(state)} == last


def test_glicko2_as_published(spark):
    state = spark.createDataFrame([(e_, mu, rd**2, 0.06, 2024, "l", day(0), None) for e_, mu, rd in ((0, 1500.0, 200.0), (1, 1400.0, 30.0), (2, 1550.0, 100.0), (3, 1700.0, 300.0))], ra.STATE)
    tall = [(g, day(1), side, who, float(res), 2024, "l") for g, (foe, won) in enumerate([(1, 1), (2, 0), (3, 0)]) for side, who, res in (("Blue", 0, won), ("Red", foe, 1 - won))]
    events = spark.createDataFrame(tall, "game long, played timestamp, side string, entity long, result double, season int, league string")
    _, after = ra.rate_period(events, state, ra.glicko2(), ra.season_order(events))
    r = after.where("entity = 0").first()
    assert (r["mu"], math.sqrt(r["s2"]), r["vol"]) == (pytest.approx(1464.06, abs=0.02), pytest.approx(151.52, abs=0.02), pytest.approx(0.05999, abs=1e-5))


@pytest.mark.parametrize("kernel", [ra.elo(), ra.glicko2(), ra.plackett_luce(), ra.trueskill()])
def test_swapping_sides_complements_probabilities(spark, kernel):
    rng = random.Random(3)
    tall = [(g, day(g), side, who, float((won if side == "Blue" else 1 - won)), 2024, "l", "p") for g in range(12) for won in [rng.randint(0, 1)] for side, who in zip(("Blue", "Red"), rng.sample(range(5), 2), strict=True)]
    schema = "game long, played timestamp, side string, entity long, result double, season int, league string, period string"
    first, state = ra.rating_periods(spark.createDataFrame(tall, schema), kernel)
    flipped, state2 = ra.rating_periods(spark.createDataFrame([(g, at, "Red" if s_ == "Blue" else "Blue", *rest) for g, at, s_, *rest in tall], schema), kernel)
    p = {(r["game"], r["entity"]): r["p_win"] for r in data(first)}
    assert {(r["game"], r["entity"]): pytest.approx(r["p_win"], abs=1e-6) for r in data(flipped)} == p
    games = defaultdict(float)
    for (g, _), x in p.items():
        games[g] += x
    assert all(x == pytest.approx(1, abs=1e-6) for x in games.values())
    assert {r["entity"]: pytest.approx(r["mu"]) for r in data(state2)} == {r["entity"]: r["mu"] for r in data(state)}


def test_series_scores_sum_to_one_and_swap(spark):
    df = spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate((n, p) for n in (1, 3, 5) for p in (0.1, 0.5, 0.73))], "id int, best_of int, p double")
    a = {(r["id"], r["a_wins"], r["b_wins"]): r["prob"] for r in data(l.series_distribution(df, "p", "best_of"))}
    b = {(r["id"], r["b_wins"], r["a_wins"]): r["prob"] for r in data(l.series_distribution(df.withColumn("p", 1 - F.col("p")), "p", "best_of"))}
    assert a == {k: pytest.approx(v) for k, v in b.items()}
    for k in range(9):
        assert sum(v for (i, _, _), v in a.items() if i == k) == pytest.approx(1)


def test_money(spark):
    one = spark.createDataFrame([(0.6, 2.0)], "p double, o double")
    assert one.select(c.kelly(F.col("p"), F.col("o"), 0.5)).first()[0] == pytest.approx(0.10)
    assert one.select(c.kelly(F.lit(0.4), F.lit(2.0)), c.kelly(F.lit(0.9), F.lit(1.0)), c.round_down_cents(F.lit(1.239))).first()[:] == (0.0, 0.0, 1.23)
    assert one.select(c.normal_over(F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()[0] == pytest.approx(0.15865525, abs=2e-7)


def test_budgets_share_caps(spark):
    rows = [(1, "f", 0.9, 2.0), (1, "f", 0.9, 2.0), (1, "g", 0.9, 2.0), (2, "f", 0.2, 2.0)]
    got = data(l.allocate_batch(spark.createDataFrame(rows, "b int, f string, p double, o double"), "b", "f", "p", "o", 0.5, 0.1, 0.12, 0.15))
    assert sorted(round(r["share"], 6) for r in got) == [0.0, round(0.06 * 0.15 / 0.22, 6), round(0.06 * 0.15 / 0.22, 6), round(0.1 * 0.15 / 0.22, 6)]


def test_bins_close_on_either_side(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.15,), (1.0,)], "p double")
    assert [r[0] for r in df.select(e.bin_of(F.col("p"), 10, "lower")).collect()] == [0, 1, 1, 9]
    assert [r[0] for r in df.select(e.bin_of(F.col("p"), 10, "upper")).collect()] == [0, 0, 1, 9]


def test_calibration_finds_a_shift(spark):
    rng = random.Random(5)
    true = [rng.uniform(0.05, 0.95) for _ in range(4000)]
    rows = [(k % 2, int(rng.random() < p), 1 / (1 + math.exp(-(2 * math.log(p / (1 - p)) + 1)))) for k, p in enumerate(true)]
    df = spark.createDataFrame(rows, "half int, y int, p double")
    line = e.calibration_line(df, "y", "p").first()
    assert (line["slope"], line["intercept"]) == (pytest.approx(0.5, abs=0.05), pytest.approx(-0.5, abs=0.1))
    out = {r["method"]: r for r in data(s.calibrate(df.where("half = 0"), df.where("half = 1"), "y", "p"))}
    assert not out["raw"]["allowed"] and out["sigmoid"]["allowed"] and out["sigmoid"]["log_loss"] < out["raw"]["log_loss"]
    assert sum(r["chosen"] for r in out.values()) == 1


def test_bootstrap_is_repeatable_and_near_its_normal_form(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k % 400, rng.gauss(1, 2), 1.0) for k in range(400)], "g int, a double, b double")
    one, two = (e.bootstrap_ratio(x, "a", "b", "g", 400).first() for x in (df, df.repartition(6)))
    assert list(one) == pytest.approx(list(two))
    assert (one["upper"] - one["lower"]) / 2 == pytest.approx(1.645 * 2 / 20, rel=0.25)


def test_correlated_features_are_counted(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + 1, float(k * k % 7)) for k in range(60)], "a double, b double, z double")
    got = {r["feature"]: r for r in data(e.feature_report(df, ["a", "b", "z"], {"a": 2.0, "b": 1.0, "z": 1.0}))}
    assert (got["a"]["correlated"], got["b"]["correlated"], got["z"]["correlated"]) == (1, 1, 0)


def test_strong_pairs_of_several_hundred_columns(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 150)) + 1e6
    for k in range(0, 150, 7):
        x[:, k] = x[:, (k * 31 + 5) % 150] * rng.choice([-2.0, 3.0]) + rng.normal(size=90) * rng.choice([0.01, 0.5])
    x[:, 11] = 4.0
    gone = x.copy()
    names = [f"c{k}" for k in range(150)]
    rows = [[None if (i, k) == (3, 20) else float(v) for k, v in enumerate(r)] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    with np.errstate(all="ignore"):
        r = np.corrcoef(np.delete(gone, 3, 0).T)
    want = {(names[i], names[j]): r[i, j] for i in range(150) for j in range(i + 1, 150) if abs(r[i, j]) > 0.95}
    got = {(p["a"], p["b"]): p["r"] for p in data(e.strong_pairs(df, names))}
    assert len(want) > 10 and got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_folds_don_t_see_their_own_time(spark):
    rows = [(k, day(3 * k), float(k % 5), float((k * 7) % 11 > 5)) for k in range(80)]
    out = data(s.oof_logistic(spark.createDataFrame(rows, "id long, at timestamp, x double, y double"), "id", "at", ["x"], "y"))
    assert out and all(r["cutoff"] < r["forecast_at"] and 0 <= r["probability"] <= 1 for r in out)


def test_frozen_levels_and_medians(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "x double, c string")
    model = s.fit_features(train, ["x"], ["c"])
    new = spark.createDataFrame([(1, None, "zz"), (2, 9.0, "b")], "i int, x double, c string")
    assert data(s.apply_features(new, model, ["i"]), "i") == [{"i": 1, "x": 2.0, "c": "Unknown"}, {"i": 2, "x": 9.0, "c": "b"}]
    assert data(s.apply_features(new.select("i"), model, ["i"]), "i")[0] == {"i": 1, "x": 2.0, "c": "Unknown"}
    with pytest.raises(ValueError, match="levels"):
        s.fit_features(train, [], ["c"], 1)


def test_repeated_roles_fail(spark):
    df = spark.createDataFrame([(1, "mid", 1.0), (1, "mid", 2.0)], "g int, role string, v double")
    with pytest.raises(ValueError, match="repeated role"):
        rs.pivot_roles(df, ["g"], "role", ["mid"], ["v"])


def test_incremental_merge_is_atomic_by_game(spark):
    old = spark.createDataFrame([(1, "Blue", 1), (1, "Red", 2), (2, "Blue", 3)], "g int, side string, v int")
    new = spark.createDataFrame([(1, "Blue", 9)], "g int, side string, v int")
    assert data(m.merge_history(old, new, "g"), "g") == [{"g": 1, "side": "Blue", "v": 9}, {"g": 2, "side": "Blue", "v": 3}]
    assert m.merge_history(old, new, "g", "full").count() == 1


def plain_periods(rows, kernel, rules, update):
    """rows: (game, at, season, period, {side: [(entity, position)]}, won by Blue). Everything of a period from its start, in plain Python."""
    state, before = {}, {}
    seasons = sorted({r[2] for r in rows})
    for period in sorted({r[3] for r in rows}):
        games = [r for r in rows if r[3] == period]
        start, last = {}, {}
        for game, at, season, _, sides, _ in games:
            for who, position in (x for v in sides.values() for x in v):
                last[who] = (at, position)
                if who in start:
                    continue
                if who not in state:
                    start[who] = dict(mu=rules.mu, s2=rules.sigma**2 + rules.drift**2, vol=rules.vol, season=season)
                    continue
                old = state[who]
                keep = rules.decay ** max(0, seasons.index(season) - seasons.index(old["season"]))
                rest = 1.0
                if rules.grace_days is not None:
                    rest = 0.5 ** (max(0, (at - old["at"]).days - rules.grace_days) / rules.half_life_days)
                mu = rules.mu + (old["mu"] - rules.mu) * keep * rest
                if old["position"] and position and old["position"] != position:
                    mu = rules.mu + (mu - rules.mu) * (1 - rules.position_reset)
                s2 = (rules.sigma - (rules.sigma - math.sqrt(old["s2"])) * rest) ** 2 if rules.grow_sigma else old["s2"]
                start[who] = dict(mu=mu, s2=s2 + rules.drift**2, vol=old["vol"], season=season)
        sums = defaultdict(list)
        for game, _, _, _, sides, won in games:
            for side, foe in (("Blue", "Red"), ("Red", "Blue")):
                mine, theirs = ([(start[w], pos) for w, pos in sides[x]] for x in (side, foe))
                for who, _ in sides[side]:
                    before[game, who] = start[who]["mu"]
                    sums[who].append((mine, theirs, won if side == "Blue" else 1 - won))
        for who, met in sums.items():
            mu, s2, vol = update(start[who], met)
            state[who] = dict(mu=mu, s2=s2, vol=vol, season=start[who]["season"], at=last[who][0], position=last[who][1])
    return before, state


def weighted(side):
    if side[0][1] is None:
        return sum(x["mu"] for x, _ in side)
    w = [ra.ROLE_WEIGHTS.get(p, ra.OTHER_ROLE) for _, p in side]
    return sum(a * x["mu"] for a, (x, _) in zip(w, side, strict=True)) / sum(w) * len(side)


def elo_update(me, met):
    return me["mu"] + sum(32 * (y - 1 / (1 + 10 ** ((weighted(b) - weighted(a)) / 400))) for a, b, y in met), me["s2"], me["vol"]


def glicko_update(me, met):
    q, phi, info, pull = 173.7178, math.sqrt(me["s2"]) / 173.7178, 0.0, 0.0
    for _, b, y in met:
        foe, var = weighted(b) / len(b), sum(x["s2"] for x, _ in b) / len(b) / q**2
        g = 1 / math.sqrt(1 + 3 * var / math.pi**2)
        p = 1 / (1 + math.exp(-g * (me["mu"] - foe) / q))
        info, pull = info + g * g * p * (1 - p), pull + g * (y - p)
    v = 1 / info
    vol = ra._new_volatility(phi, v * pull, v, me["vol"], 0.5)
    after = 1 / (1 / (phi**2 + vol**2) + info)
    return me["mu"] + q * after * pull, after * q * q, vol


def luce_update(me, met, beta=25 / 6):
    d, shrink = 0.0, 1.0
    for a, b, y in met:
        sa, sb = (sum(x["s2"] for x, _ in s_) for s_ in (a, b))
        c = math.sqrt(sa + sb + 2 * beta**2)
        p = 1 / (1 + math.exp((weighted(b) - weighted(a)) / c))
        d += me["s2"] / c * (y - p)
        shrink *= max(1 - me["s2"] / c**2 * math.sqrt(sa) / c * p * (1 - p), 1e-4)
    return me["mu"] + d, me["s2"] * shrink, me["vol"]


def skill_update(me, met, beta=4.167):
    d, shrink = 0.0, 1.0
    for a, b, y in met:
        c = math.sqrt(sum(x["s2"] for x, _ in a + b) + len(a + b) * beta**2)
        sign = 1 if y else -1
        t = sign * (weighted(a) - weighted(b)) / c
        v = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-t / math.sqrt(2)))
        d += sign * me["s2"] / c * v
        shrink *= max(1 - me["s2"] / c**2 * min(v * (v + t), 1), 1e-4)
    return me["mu"] + d, me["s2"] * shrink, me["vol"]


@pytest.mark.parametrize("roles", [False, True])
@pytest.mark.parametrize(("kernel", "update"), [(ra.elo(), elo_update), (ra.glicko2(), glicko_update), (ra.plackett_luce(), luce_update), (ra.trueskill(), skill_update)])
def test_periods_are_a_plain_fold(spark, kernel, update, roles):
    """Three periods over two seasons with a long pause, four systems, with roles and without."""
    rng, names, rows = random.Random(21), ("top", "mid", "sup"), []
    for g in range(24):
        who = rng.sample(range(9), 6)
        at = day((0, 20, 220)[g // 8] + g % 8, g)
        sides = {"Blue": who[:3], "Red": who[3:]}
        rows.append((g, at, at.year if g < 16 else 2025, f"p{g // 8}", {k: [(x, rng.choice(names) if roles else None) for x in v] for k, v in sides.items()}, rng.randint(0, 1)))
    schema = "game long, played timestamp, side string, entity long, result double, season int, league string, period string" + (", position string" if roles else "")
    tall = [(g, at, side, who, float(won if side == "Blue" else 1 - won), season, "l", period, *([pos] if roles else [])) for g, at, season, period, sides, won in rows for side, v in sides.items() for who, pos in v]
    before, state = ra.rating_periods(spark.createDataFrame(tall, schema), kernel)
    want, last = plain_periods(rows, kernel, kernel.rules, update)
    assert {(r["game"], r["entity"]): r["mu_before"] for r in data(before)} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    got = {r["entity"]: r for r in data(state)}
    assert set(got) == set(last)
    for who, x in last.items():
        assert (got[who]["mu"], got[who]["s2"], got[who]["vol"]) == (pytest.approx(x["mu"], abs=1e-6), pytest.approx(x["s2"], abs=1e-6), pytest.approx(x["vol"], abs=1e-6))
        assert got[who]["position"] == x["position"]


def test_leagues_are_rated_by_games_across_them(spark):
    rows = [(g, day(g), "Blue", g % 4, float(g % 2), 2024, "p") for g in range(12)] + [(g, day(g), "Red", (g + 1 + g % 3) % 4, float(1 - g % 2), 2024, "p") for g in range(12)]
    ev = spark.createDataFrame(rows, "game long, played timestamp, side string, entity long, result double, season int, period string")
    home = ev.select("game", "side", F.when(F.col("entity") < 2, "a").otherwise("b").alias("league"))
    made = ra.league_events(ev, home)
    names = {r["entity"]: r["name"] for r in data(made)}
    _, state = ra.rating_periods(made.withColumn("period", F.lit("p")).drop("name"), ra.elo(k=8))
    mine = {(g, side): "a" if who < 2 else "b" for g, _, side, who, *_ in rows}
    want = defaultdict(lambda: 1500.0)
    for g, _, side, _, won, *_ in rows:
        if mine[g, "Blue"] != mine[g, "Red"]:
            want[mine[g, side]] += 8 * (won - 0.5)
    assert {names[r["entity"]]: r["mu"] for r in data(state)} == {k: pytest.approx(v) for k, v in want.items()}


def test_entities_start_and_move_by_leagues_as_of_the_period(spark):
    from antecede.plans.ratings import coupled

    rng, names, rows = random.Random(5), ["a", "b", "c"], []
    for g in range(60):
        a, b = rng.sample(range(12), 2)
        rows.append((g, day(8 * g), f"p{g // 10}", {"Blue": (a, names[(a + g // 25) % 3]), "Red": (b, names[(b + g // 25) % 3])}, rng.randint(0, 1)))
    tall = [(g, at, side, who, float(won if side == "Blue" else 1 - won), at.year, league, p) for g, at, p, sides, won in rows for side, (who, league) in sides.items()]
    ev = spark.createDataFrame(tall, "game long, played timestamp, side string, entity long, result double, season int, league string, period string")
    got = {(r["game"], r["entity"]): (r["mu_before"], r["p_win"]) for r in data(coupled(ev, ev.select("game", "side", "league")).before())}
    seasons, leagues, state, want = sorted({at.year for _, at, *_ in rows}), {}, {}, {}
    began = lambda old, new: max(0, seasons.index(new) - seasons.index(old))
    chance = lambda x, y: 1 / (1 + 10 ** ((y - x) / 400))
    for period in sorted({p for _, _, p, *_ in rows}):
        now = [r for r in rows if r[2] == period]
        rating = {k: v[0] for k, v in leagues.items()}
        mean = sum(rating.values()) / len(rating) if rating else None
        start, first, ends = {}, {}, {}
        for g, at, _, sides, won in now:
            for who, league in sides.values():
                ends[who] = at
                if who in start:
                    continue
                to = rating.get(league, 1500.0)
                if who in state:
                    mu, season, last, was = state[who]
                    mu = 1500 + (mu - 1500) * 0.9 ** began(season, at.year) * 0.5 ** (max(0, (at - last).days - 45) / 180)
                    start[who] = mu + (0.5 * (to - rating.get(was, 1500.0)) if was != league else 0)
                else:
                    start[who] = 1500 + (0 if mean is None else max(-300, min(300, (to - mean) * 0.5)))
                first[who] = (at.year, league)
        gained, league_start, league_gained, league_season = defaultdict(float), {}, defaultdict(float), {}
        for g, at, _, sides, won in now:
            (a, la), (b, lb) = sides["Blue"], sides["Red"]
            p = chance(start[a], start[b])
            want[g, a], want[g, b] = (start[a], p), (start[b], 1 - p)
            gained[a] += 32 * (won - p)
            gained[b] -= 32 * (won - p)
            if la != lb:
                for x in (la, lb):
                    if x not in league_start:
                        mu, season = leagues.get(x, (1500.0, at.year))
                        league_start[x], league_season[x] = 1500 + (mu - 1500) * 0.9 ** began(season, at.year), at.year
        for g, at, _, sides, won in now:
            la, lb = sides["Blue"][1], sides["Red"][1]
            if la != lb:
                p = chance(league_start[la], league_start[lb])
                league_gained[la] += 32 * (won - p)
                league_gained[lb] -= 32 * (won - p)
        for who, mu in start.items():
            state[who] = (mu + gained[who], first[who][0], ends[who], first[who][1])
        for x, mu in league_start.items():
            leagues[x] = (mu + league_gained[x], league_season[x])
    # A league is known from the period after its first turn on; `ratings_as_of` has it at the baseline before.
    known = {x for g, at, p, sides, _ in rows for x in [sides["Blue"][1], sides["Red"][1]] if sides["Blue"][1] != sides["Red"][1]}
    assert known == set(names) and max(abs(mu - 1500) for mu, _ in leagues.values()) > 5
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(v[0], abs=1e-6), pytest.approx(v[1], abs=1e-9)) for k, v in want.items())


def test_a_blend_is_no_worse_than_its_ends(spark):
    rng = random.Random(4)
    rows = [(k, day(k % 60), x := rng.random(), rng.random(), float(rng.random() < x)) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, at timestamp, x double, v double, y double")
    train, test = df.where("k < 400"), df.where("k >= 400")
    models = s.bagged_trees(train, ["x", "v"], "y", F.date_trunc("week", "at"), 3, trees=3)
    m = s.member_probabilities(s.with_baseline(train, test, ["x"], "y"), models, ["x", "v"])
    seen = data(m)
    assert len(seen) == test.count() and all(len(r["members"]) == 3 and all(0 <= p <= 1 for p in r["members"]) for r in seen)
    assert len({tuple(r["members"]) for r in seen}) > 5 and any(len(set(r["members"])) > 1 for r in seen)
    blend = data(s.best_blend(m.withColumn("mean", F.aggregate("members", F.lit(0.0), lambda a, x: a + x) / 3), "y", "mean", "baseline"))
    loss = {r["weight"]: r["log_loss"] for r in blend}
    plain = -sum(r["y"] * math.log(r["baseline"]) + (1 - r["y"]) * math.log(1 - r["baseline"]) for r in seen) / len(seen)
    assert len(loss) == 21 and loss[0.0] == pytest.approx(plain) and [r["log_loss"] for r in blend if r["best"]] == [min(loss.values())]


def test_exact_quantiles(spark):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) for _ in range(5000)], [float(k % 3) for k in range(1000)], [7.0], [1.0, None, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
        assert e.quantiles(df, "v", shares) == pytest.approx(df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0])
    assert e.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_normal_distribution(spark):
    zs = [-9.0, -4.0, -1.3, 0.0, 0.2, 2.5, 6.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(c.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], abs=1e-13)


def test_a_few_periods_are_layers_and_states_are_not_broadcast(spark, monkeypatch):
    rng, rows = random.Random(6), []
    for g in range(60):
        for side, who, won in zip(("Blue", "Red"), rng.sample(range(12), 2), (1.0, 0.0), strict=True):
            rows.append((g, day(g), side, who, won, 2024, "l", f"p{g // 20}"))
    ev = spark.createDataFrame(rows, "game long, played timestamp, side string, entity long, result double, season int, league string, period string")
    monkeypatch.setattr(ra, "FEW_PERIODS", 2)
    monkeypatch.setattr(ra, "MANY_ROWS", 1)
    chunked = ra.in_layers(ev).select("game", "entity", "period", "layer").collect()
    order = defaultdict(set)
    for r in chunked:
        order[r["entity"]].add((r["layer"], r["period"]))
    assert all(sorted(x) == sorted(x, key=lambda lp: lp[1]) and len({lp[0] for lp in x}) == len(x) for x in order.values())
    assert {r["layer"] for r in chunked} == set(range(1, max(r["layer"] for r in chunked) + 1))
    want = {r["entity"]: r["mu"] for r in data(ra.rated(ev, ra.elo()).state())}
    monkeypatch.setattr(ra, "FEW_PERIODS", 64)
    monkeypatch.setattr(ra, "layers", None)
    made = ra.rated(ev, ra.elo()).state()
    assert {r["entity"]: r["mu"] for r in data(made)} == {k: pytest.approx(v) for k, v in want.items()}
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_normal_tails_keep_their_digits(spark):
    zs = [-7.4, -5.8, -5.6, -3.0, -0.67, -0.66, 0.66, 0.67, 3.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in [*zs, None]], "z double").select(c.normal_cdf(F.col("z"))).collect()]
    assert got[:-1] == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], rel=1e-12) and got[-1] is None


def test_what_rounding_leaves_of_a_stake_buys_nothing(spark):
    # Ten times 0.1 falls short of 1 by rounding.
    levels = [("ten", 0.1, 1.0, k) for k in range(10)] + [("ten", 0.4, 1.0, 10), ("nine", 0.4, 1.0, 9)] + [("nine", 0.1, 1.0, k) for k in range(9)]
    df = spark.createDataFrame(levels, "book string, price double, size double, id long")
    got = {r["book"]: (r["worst"], r["spent_all"]) for r in data(l.quote_budget(df, "book", "price", "size", 1.0, ["id"]))}
    assert got == {"ten": (0.1, True), "nine": (0.4, True)}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from antecede.streaming import operators as so

    rows = lambda *x: spark.createDataFrame(list(x), "k long, v long")
    path, check = f"file://{tmp_path}/in", f"file://{tmp_path}/check"
    for batch in (rows((1, 10), (2, 20)), rows((2, 21), (3, 30)), rows((1, 11))):
        batch.write.mode("append").parquet(path)
        table = so.BucketedTable(spark, f"file://{tmp_path}/table", "k long, v long", "k", 3)  # a new object, as after a restart
        total = so.kept_state(spark, f"file://{tmp_path}/state", "n long", lambda b, old: old.unionByName(b.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n")))
        so.each_batch(so.read_files(spark, path), check, lambda b, i: (table.upsert(b, i), total(b, i)))
    assert sorted((r["k"], r["v"]) for r in data(table.read())) == [(1, 11), (2, 21), (3, 30)]
    assert data(so.last_state(spark, f"file://{tmp_path}/state", "n long")) == [{"n": 5}]
    table.upsert(rows((9, 9)), 2)  # a batch that is run again takes what it made before
    assert sorted(r["k"] for r in data(table.read())) == [1, 2, 3]


def test_fingerprints_see_changes_but_not_order(spark):
    df = spark.createDataFrame([(k % 7, None if k % 3 else f"x{k}") for k in range(50)], "a long, b string")
    one = keys.table_fingerprint(df).first()
    assert keys.table_fingerprint(df.orderBy(F.desc("a")).repartition(3)).first() == one
    assert keys.table_fingerprint(df.union(df.limit(1))).first()["content"] != one["content"]
    assert keys.table_fingerprint(df.withColumn("b", F.coalesce("b", F.lit("")))).first()["content"] != one["content"]
    assert keys.schema_fingerprint(df) != keys.schema_fingerprint(df.withColumnRenamed("b", "c"))


def test_only_results_outlive_what_led_to_them(spark):
    from antecede.sources import tables as ts

    inner = []

    def make():
        a = ts.written(spark.range(10), "a")
        inner.append(a.inputFiles()[0])
        b = ts.settled(spark, "b", lambda: ts.written(a.where("id > 3"), "c").where("id < 8"))
        inner.append(b.inputFiles()[0])
        assert b.count() == 4 and a.count() == 10
        return b.withColumn("v", F.col("id") * 2)

    got = ts.settled(spark, "result", make)
    assert sorted(r["v"] for r in got.collect()) == [8, 10, 12, 14]
    assert not any(ts.exists(spark, path) for path in inner) and ts.exists(spark, got.inputFiles()[0])
    with pytest.raises(ZeroDivisionError):
        ts.settled(spark, "bad", lambda: ts.written(spark.range(1), "a").where(str(1 / 0)))
    assert ts.exists(spark, ts.written(spark.range(3), "after").inputFiles()[0])  # outside again


def test_a_grid_that_is_too_large_is_refused(spark):
    rows, some = spark.range(2).select(F.col("id").alias("x")), spark.range(40).select(F.col("id").alias("y"))
    other = some.select(F.col("y").alias("z"))
    acts = spark.createDataFrame([(0, 1, 1, "captured")], "x long, y long, z long, state string")
    with pytest.raises(ValueError, match="every row"):
        j.coverage_grid(rows, [some, other], acts, ["x", "y", "z"], "state")
    assert j.coverage_grid(rows, [some, other.limit(25)], acts, ["x", "y", "z"], "state").groupBy("coverage").count().where("coverage = 'missing'").first()["count"] >= 1999


def test_link_issues_are_those_of_the_plain_rules_in_parts_of_any_size(spark, monkeypatch):
    rng = random.Random(9)
    links = [(rng.choice([None, *range(40)]), rng.choice([None, *range(3)])) for _ in range(120)] + [(3, k % 70) for k in range(500)] + [(4, 1)] * 500 + [(90, None)]
    fixtures = [(k, rng.choice([True, False, None])) for k in range(60)] + [(50, True)] * 3 + [(None, True)] * 2
    want = Counter()
    for f in {f for f, _ in links}:
        n = len({x for g, x in links if g == f and x is not None})
        want.update([(f, "conflict", n)] if n > 1 else [])
        want.update([] if f is not None and (f, True) in fixtures else [(f, "no fixture", 0)])
    want.update((f, "no link", 0) for f, _ in fixtures if f is None or f not in {g for g, _ in links})
    a = spark.createDataFrame(links, "fixture long, supp long").repartition(3)
    b = spark.createDataFrame(fixtures, "fixture long, open boolean").repartition(2)
    for most in (600_000, 40):
        monkeypatch.setattr(j, "TASK_ROWS", most)
        out = j.link_issues(a, b, "supp")
        assert Counter((r["fixture"], r["issue"], r["links"]) for r in out.collect()) == want
    assert j.link_issues(a.limit(0), b.limit(0), "supp").collect() == []
    # As many parts as the rows ask for, whatever the session's number of partitions; the rows of null fixtures are beside them.
    assert out.where("fixture IS NOT NULL").rdd.getNumPartitions() >= -(-(len(links) + len(fixtures)) // 40) > int(spark.conf.get("spark.sql.shuffle.partitions"))
