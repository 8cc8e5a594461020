"""Streams: late rows, rows out of order, bets without quotes, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from antecede.streaming import operators as s

T0 = dt.datetime(2024, 1, 1)


def parts(spark, path, rows, schema, run):
    """`run` on a file stream of `path` after each part of the rows has come."""
    out = None
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
        out = run(s.read_files(spark, str(path)))
    return out


def test_rows_out_of_order_are_folded_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 5, T0 + dt.timedelta(hours=k), k, None if k % 11 == 0 else rng.uniform(0, 9)) for k in range(150)]
    # Up to eight hours late, cut into four parts and shuffled inside each.
    came = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.randint(0, 8)))
    cut = [came[a : a + 40] for a in range(0, 150, 40)]
    for part in cut:
        rng.shuffle(part)
    end = [(99, T0 + dt.timedelta(days=30), 999, 1.0)]
    with s.rocks(spark):
        got = parts(spark, tmp_path / "in", [*cut, end], "entity long, at timestamp, tie long, value double", lambda x: s.run_available(s.ordered_ewm(x, "10 hours", 3.0), str(tmp_path / "check"), str(tmp_path / "out")))
    want, state = {}, {}
    for who, _, k, v in rows:
        x, w = state.get(who, (0.0, 0.0))
        before = x / w if w else None
        if v is not None:
            x, w = x * 2 ** (-1 / 3) + v, w * 2 ** (-1 / 3) + 1
        state[who] = (x, w)
        want[k] = (before, x / w if w else None)
    near = lambda v: None if v is None else pytest.approx(v)
    made = [(r["tie"], r["ema_before"], r["ema_after"]) for r in got.collect()]
    assert len(made) == 150
    assert {k: (a, b) for k, a, b in made} == {k: (near(a), near(b)) for k, (a, b) in want.items()}


def test_an_idle_entity_is_forgotten(spark, tmp_path):
    day = 86_400_000_000
    rows = [[(1, T0, 1, 4.0), (2, T0, 2, 4.0)], [(2, T0 + dt.timedelta(days=3), 3, 8.0)], [(1, T0 + dt.timedelta(days=20), 4, 8.0), (2, T0 + dt.timedelta(days=6), 5, 8.0)], [(9, T0 + dt.timedelta(days=60), 6, 0.0)]]
    with s.rocks(spark):
        got = parts(spark, tmp_path / "in", rows, "entity long, at timestamp, tie long, value double", lambda x: s.run_available(s.ordered_ewm(x, "30 days", 3.0, 5 * day), str(tmp_path / "check"), str(tmp_path / "out")))
    before = {r["tie"]: r["ema_before"] for r in got.collect()}
    assert before[1] is None and before[4] is None and before[3] == pytest.approx(4.0) and before[5] is not None


def test_late_rows_are_kept_apart_and_none_is_lost(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k % 3, k, 1_000_000 * (k - rng.choice([0, 0, 5, 40])), 1_000_000 * k) for k in range(120)]
    root = str(tmp_path / "judged")
    with s.rocks(spark):
        parts(spark, tmp_path / "in", [rows[:50], rows[50:51], rows[51:]], "key long, id long, observed_us long, received_us long", lambda x: s.each_batch(s.split_late(x, 10), str(tmp_path / "check"), s.two_tables(root)))
    latest, late = {}, {}
    for key, k, at, _ in rows:
        late[k] = key in latest and at < latest[key] - 10_000_000
        latest[key] = max(at, latest.get(key, at))
    read = lambda kind: [r["id"] for r in spark.read.schema(s.LATE_SCHEMA).parquet(f"{root}/{kind}/*").collect()]
    assert sorted(read("fresh")) == sorted(k for k, x in late.items() if not x)
    assert sorted(read("rejected")) == sorted(k for k, x in late.items() if x) and any(late.values())
    # A batch that is run again replaces what it wrote.
    again = spark.createDataFrame([(0, 7, 1, True, 2)], s.LATE_SCHEMA)
    s.two_tables(root)(again, 0)
    s.two_tables(root)(again, 0)
    assert read("rejected").count(7) == 1


def test_bets_without_a_quote_leave_once(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    bets = [[(1, 10, at(0), at(6)), (2, 10, at(1), at(7)), (3, 11, at(2), at(8))], [(4, 10, at(30), at(36))], [(None, -1, at(500), at(500))]]
    quotes = [[(1, 10, at(3)), (2, 10, at(6.5))], [(3, 11, at(40))], [(None, -1, at(500))]]
    made = None
    for b, q in zip(bets, quotes, strict=True):
        spark.createDataFrame(b, "bet long, who long, entered timestamp, starts timestamp").write.mode("append").parquet(str(tmp_path / "b"))
        spark.createDataFrame(q, "quote long, who long, observed timestamp").write.mode("append").parquet(str(tmp_path / "q"))
        joined = s.quotes_or_none(s.read_files(spark, str(tmp_path / "b")), s.read_files(spark, str(tmp_path / "q")), "who", 6, "1 hour")
        made = s.run_available(joined.select("bet", "quote"), str(tmp_path / "check"), str(tmp_path / "out"))
    got = sorted((r["bet"], r["quote"] or 0) for r in made.where(F.col("bet").isNotNull()).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 0), (4, 0)]


def test_a_batch_touches_its_own_buckets_only(spark, tmp_path):
    schema = "k long, v string"
    root, bad = f"file://{tmp_path}/table", f"file://{tmp_path}/bad"
    table = s.BucketedTable(spark, root, schema, "k", 8)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    s.append_new(table, bad, batch(*((k, f"a{k}") for k in range(40))), 0, "v")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "table/table").glob("bucket=*/*.parquet")}
    before = files()
    assert len({p.parent for p in before}) == 8
    # Known with the same content, known with another (twice), new with two contents, and no key at all.
    second = batch((1, "a1"), (2, "b2"), (2, "b2"), (50, "y"), (50, "x"))
    s.append_new(table, bad, second, 1, "v")
    hit = {r[0] for r in second.select(table.bucket()).distinct().collect()}
    same = [p for p in before if int(p.parent.name.split("=")[1]) not in hit]
    assert same and all(files().get(p) == before[p] for p in same)
    stored = lambda: sorted((r["k"], r["v"]) for r in table.read().collect())
    refused = lambda: sorted((r["k"], r["v"]) for r in spark.read.schema(schema).parquet(f"{bad}/*").collect())
    assert stored() == sorted([*((k, f"a{k}") for k in range(40)), (50, "x")]) and refused() == [(2, "b2"), (50, "y")]
    # A batch that is run again, with its buckets already replaced, changes nothing; what the one before it made is gone.
    s.append_new(table, bad, second, 1, "v")
    assert len(stored()) == 41 and refused() == [(2, "b2"), (50, "y")]
    assert [p.name for p in (tmp_path / "table/made").iterdir()] == ["1"]


def test_a_batch_that_fails_between_its_steps_is_made_again(spark, tmp_path):
    schema = "k long, v string"
    table, bad = s.BucketedTable(spark, f"file://{tmp_path}/table", schema, "k", 4), f"file://{tmp_path}/bad"
    s.append_new(table, bad, spark.createDataFrame([(1, "a"), (2, "b")], schema), 0, "v")
    batch = spark.createDataFrame([(1, "z"), (3, "c")], schema)

    def fails(rows, new):
        new.where("k = 1").write.mode("overwrite").parquet(f"{bad}/1")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.change(batch, 1, fails)
    s.append_new(table, bad, batch, 1, "v")
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert [(r["k"], r["v"]) for r in spark.read.schema(schema).parquet(f"{bad}/*").collect()] == [(1, "z")]


def test_ratings_by_batch_equal_those_of_one_table(spark, tmp_path):
    from antecede.operators import ratings as ra

    rng, rows = random.Random(4), []
    for g in range(120):
        a, b = rng.sample(range(12), 2)
        for side, who, won in (("Blue", a, g % 2), ("Red", b, 1 - g % 2)):
            rows.append((g, T0 + dt.timedelta(days=g // 20), side, who, float(won), 2024, "L"))
    ev = spark.createDataFrame(rows, "game long, played timestamp, side string, entity long, result double, season int, league string")
    seasons = ra.season_order(ev)
    rate = lambda state, batch: ra.merged_state(state, ra.rate_period(batch, state, ra.elo(), seasons)[1])
    table, whole = s.BucketedTable(spark, f"file://{tmp_path}/states", ra.STATE, "entity", 5), spark.createDataFrame([], ra.STATE)
    for k in range(3):
        batch = ev.where(f"game >= {k * 40} AND game < {k * 40 + 40}")
        table.change(batch, k, rate)
        whole = spark.createDataFrame(rate(whole, batch).collect(), ra.STATE)
    as_rows = lambda df: sorted((r["entity"], round(r["mu"], 9), r["last_played"]) for r in df.collect())
    assert as_rows(table.read()) == as_rows(whole) and len(as_rows(whole)) == 12


def test_entities_of_a_group_share_a_state_and_keep_their_means(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "GROUPS", 2)
    called = tmp_path / "called"
    called.mkdir()

    class Counted(s.RunningEwm):
        def handleInputRows(self, key, rows, timerValues):
            (called / f"{key[0]}").touch()
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(s, "RunningEwm", Counted)
    rng = random.Random(8)
    rows = [(None if k % 30 == 29 else k % 30, T0 + dt.timedelta(hours=7 * k), k, None if k % 13 == 0 else rng.uniform(0, 9)) for k in range(240)]
    with s.rocks(spark):
        got = parts(spark, tmp_path / "in", [rows[:100], rows[100:170], rows[170:]], "entity long, at timestamp, tie long, value double", lambda x: s.run_available(s.running_ewm(x, 3.0), str(tmp_path / "check"), str(tmp_path / "out")))
    want, state = {}, {}
    for who, at, _, v in rows:
        x, w, last = state.get(who, (0.0, 0.0, None))
        if v is not None:
            x, w = x * 2 ** (-1 / 3) + v, w * 2 ** (-1 / 3) + 1
        state[who] = (x, w, at)
        want[who, at] = (pytest.approx(x / w) if w else None, None if last is None else (at - last).days)
    assert {(r["entity"], r["at"]): (r["ema_after"], r["days_since"]) for r in got.collect()} == want
    # One call for each group and batch, not one for each entity.
    assert {p.name for p in called.iterdir()} == {"-1", "0", "1"}
