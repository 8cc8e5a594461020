"""An entity with half of all rows is scanned in slices: same results, and no task gets it whole."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from antecede import keys
from antecede.operators import history as h, joins as j, slices

T0 = dt.datetime(2024, 1, 1, 12)
E = keys.EntitySpec(("who",), "at", ("k",))


def data(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for k in range(600):
        who = 0 if k % 2 else rng.choice([1, 2, None])
        at = None if rng.random() < 0.02 else T0 + dt.timedelta(days=rng.randint(0, 40), hours=rng.randint(0, 9))
        made.append((who, at, k, None if rng.random() < 0.1 else rng.uniform(0, 10), rng.choice(["Blue", "Red"]), rng.choice("ab")))
    return spark.createDataFrame(made, "who int, at timestamp, k int, v double, side string, grp string").repartition(4)


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 8) if isinstance(v, float) else str(v)


FUNCTIONS = {
    "e3": lambda df: h.prior_mean(df, E, {"m": "v", "m2": "k"}),
    "e5": lambda df: h.conditional_prior_means(df, E, ["v"], {"up": "v > 5", "down": "v <= 5"}, ["grp"]),
    "e7": lambda df: h.ewm(df.where("at IS NOT NULL"), E, "v", 3.0),
    "e7_prior": lambda df: h.ewm(df.where("at IS NOT NULL"), E, "v", 3.0, ("grp",), "x", 0.5),
    "e9": lambda df: h.side_ewm(df.where("at IS NOT NULL"), E, "side", "v", ("Blue", "Red"), 3.0),
    "c6": lambda df: j.asof_join(df, df.where("k % 3 = 0").select("who", F.col("at").alias("seen"), F.col("v").alias("w"), F.col("k").alias("kk")), ["who"], "at", "seen", ["w", "kk"], ["kk"]),
    "c7": lambda df: j.asof_state(df, df.select("who", F.expr("at + INTERVAL 2 DAYS").alias("av"), F.col("at").alias("st"), F.col("v").alias("w"), F.col("k").alias("kk")), ["who"], "at", "at", "av", "st", ["w", "kk"], "k"),
    "c14": lambda df: j.closing_quotes(df.withColumn("start", F.expr("at + INTERVAL 1 DAY")), df.select("who", F.col("at").alias("ob"), F.expr("at - make_interval(0, 0, 0, 0, 0, 0, cast(k % 9 AS decimal(8, 6)))").alias("told"), F.col("k").alias("odds")), ["who"], "k", "at", "start", "ob", "told", 5, ["odds"]),
}


@pytest.mark.parametrize("name", FUNCTIONS)
@pytest.mark.parametrize("block", [4096, 100])
def test_slices_change_no_result(spark, rows, monkeypatch, name, block):
    if block != 4096 and not name.startswith(("e7", "e9")):
        pytest.skip("no blocks")
    monkeypatch.setattr(h, "BLOCK", block)
    made = FUNCTIONS[name](rows)
    want = sorted(str([plain(v) for v in r.values()]) for r in data(made))
    monkeypatch.setattr(slices, "MOST", 40)
    cut = FUNCTIONS[name](rows)
    assert cut.columns == made.columns
    assert sorted(str([plain(v) for v in r.values()]) for r in data(cut)) == want


def test_no_slice_is_large_and_no_day_is_cut(spark, rows, monkeypatch):
    monkeypatch.setattr(slices, "MOST", 40)
    cut = slices.sliced(rows, ["who"], "at")
    sizes = cut.groupBy("who", slices.SLICE).count().collect()
    days = rows.groupBy("who", F.to_date("at")).count().agg(F.max("count")).first()[0]
    assert len(sizes) > 8 and max(r["count"] for r in sizes) <= 40 + days
    assert cut.groupBy("who", F.to_date("at")).agg(F.count_distinct(slices.SLICE).alias("n")).where("n > 1").isEmpty()
    assert cut.count() == rows.count()
    assert slices.sliced(rows, ["who"], "at", 10_000) is None and slices.sliced(rows, ["k"], "at") is None


def test_windows_are_by_slice(spark, rows, monkeypatch):
    """The plan deals rows by (entity, slice) where it makes the running values."""
    monkeypatch.setattr(slices, "MOST", 40)
    plan = FUNCTIONS["e3"](rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(who" in plan and "__slice" in plan
    assert not any("windowspecdefinition(who" in x and "__slice" not in x.split("windowspecdefinition(")[1].split(",")[1] for x in plan.splitlines() if "windowspecdefinition(who" in x and "micros" in x)


def test_a_side_meets_a_common_key_in_many_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(None if k % 10 == 0 else 1 if k % 3 else k, k, {"m": k}) for k in range(600)], "key int, v int, m map<string,int>")
    side = spark.createDataFrame([(None, "none"), (1, "one"), (3, "three"), (-5, "nobody")], "key int, name string")
    want = sorted((r["v"], {None: "none", 1: "one", 3: "three"}.get(r["key"])) for r in rows.collect())
    for most in (20_000, 0):
        monkeypatch.setattr(slices, "BROADCAST_ROWS", most)
        got = slices.attached(rows, side, ["key"])
        assert got.columns == ["key", "v", "m", "name"]
        assert sorted((r["v"], r["name"]) for r in got.collect()) == want
    assert slices.attached(rows.limit(0), side, ["key"]).count() == 0 and slices.attached(rows, side.limit(0), ["key"]).count() == 600


def test_limits_of_a_hot_batch_equal_the_plain_sums(spark, monkeypatch):
    from antecede.operators import ledger

    rng = random.Random(8)
    rows = [(k, None if k % 50 == 7 else 1 if k % 2 else k % 9, rng.choice("fgh"), rng.random(), None if k % 31 == 0 else 1.2 + rng.random()) for k in range(900)]
    spent = [(1, "f", 0.03), (1, "g", 0.5), (4, "h", 0.01), (4, "h", 0.02)]
    df = spark.createDataFrame(rows, "id int, b int, f string, p double, o double")
    taken = spark.createDataFrame(spent, "b int, f string, share double")

    def kelly(p, o):
        return 0.0 if o is None else min(max(0.5 * ((o - 1) * p - (1 - p)) / (o - 1), 0.0), 0.1)

    def plain(used):
        k = {i: kelly(p, o) for i, _, _, p, o in rows}
        for at, cap in ((lambda r: (r[1], r[2]), 0.3), (lambda r: (r[1],), 0.7)):
            total, gone = {}, {}
            for r in rows:
                total[at(r)] = total.get(at(r), 0) + k[r[0]]
            for b, f, x in used:
                key = at((None, b, f))
                gone[key] = gone.get(key, 0) + x
            k = {r[0]: k[r[0]] * (min(1, max(cap - gone.get(at(r), 0), 0) / total[at(r)]) if total[at(r)] else 1) for r in rows}
        return k

    for most in (20_000, 0):
        monkeypatch.setattr(slices, "BROADCAST_ROWS", most)
        for used, side in (([], None), (spent, taken)):
            got = {r["id"]: r["share"] for r in ledger.allocate_batch(df, "b", "f", "p", "o", 0.5, 0.1, 0.3, 0.7, side).collect()}
            want = plain(used)
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
