"""Closest names against the plain ranking, composed rewrites against one pass for each, chains that change owner."""

import datetime as dt
import difflib
import random

import pytest

from antecede.operators import joins as j, names


@pytest.mark.parametrize("block", [4096, 5])
def test_closest_names_are_those_of_the_plain_ranking(spark, monkeypatch, block):
    monkeypatch.setattr(names, "BLOCK", block)
    rng = random.Random(4)
    known = sorted({" ".join(rng.choice(["team", "red", "blue", "fox", "foxes", "gaming", "é", "kt", "a"]) for _ in range(rng.randint(1, 4))) for _ in range(120)} | {"", "x" * 260})

    def misspelt(x):
        k = rng.randint(0, len(x))
        return rng.choice([x[:k] + x[k + 1 :], x[:k] + "z" + x[k:], x[::-1], x[:k], x.upper() + " ", x])

    asked = [misspelt(rng.choice(known)) for _ in range(200)] + ["", "nothing like it 123", "x" * 250]
    a, b = (spark.createDataFrame([(x,) for x in rows] + [(None,)], "name string").repartition(3) for rows in (asked, known))
    for most, least in ((3, 0.75), (2, 0.4)):
        got = {}
        for r in sorted(names.closest_names(a, "name", b, most, least).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["name"], []).append(r["suggestion"])
        want = {x: m for x in {y.strip().lower() for y in asked} if (m := difflib.get_close_matches(x, known, most, least))}
        assert got == want
    assert names.closest_names(a, "name", b.limit(0)).collect() == []


def test_rewrites_are_one_pass_for_each_in_order(spark):
    rng = random.Random(9)
    pair = lambda: (rng.choice("abc"), str(rng.randint(1, 3)))
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 400))
    for trial in range(25):
        rules = [(k, *pair(), *pair(), rng.choice([None, at(), at(), at()])) for k in range(rng.randint(0, 12))]
        rows = [(*pair(), rng.choice([at(), at(), at(), None])) for _ in range(150)]
        want = []
        for name, id_, t in rows:
            for _, a, b, c, d, until in rules:
                if (name, id_) == (a, b) and (until is None or (t is not None and t < until)):
                    name, id_ = c, d
            want.append((name, id_, str(t)))
        made = names.composed([(a, b, c, d, until or names.ALWAYS) for _, a, b, c, d, until in rules])
        for (name, id_, t), (x, y, _) in zip(rows, want, strict=True):
            pieces = made.get((name, id_), [(names.ALWAYS, (name, id_))])
            assert next(p for e, p in pieces if (t or dt.datetime(9999, 1, 1)) < e) == (x, y)
        if trial < 3:
            df = spark.createDataFrame([*rows, (None, "1", at()), ("a", None, at())], "name string, id string, t timestamp")
            table = spark.createDataFrame([*rules, (99, "a", None, "b", "1", None)], "nth int, old_name string, old_id string, new_name string, new_id string, until timestamp")
            got = names.rewritten(df, "name", "id", "t", table).collect()
            assert sorted((str(r["name"]), str(r["id"]), str(r["t"])) for r in got if r["name"] and r["id"]) == sorted(want)
            assert len(got) == len(rows) + 2


def test_a_chain_that_changes_owner_has_no_tip(spark):
    links = [(1, 2, "a"), (2, 3, "a"), (3, None, "a"), (4, 5, "b"), (5, 6, "c"), (6, 7, "b"), (7, None, "b"), (8, 9, "d"), (9, 8, "d"), (10, 11, "e"), (11, 10, "f"), (12, 99, "g"), (13, 14, None), (14, None, None)]
    got = {r["id"]: (r["tip"], r["hops"], r["problem"]) for r in j.resolve_chains(spark.createDataFrame(links, "id int, next int, owner string"), owner="owner").collect()}
    assert got == {
        1: (3, 2, None), 2: (3, 1, None), 3: (3, 0, None), 4: (None, None, "owner"), 5: (None, None, "owner"), 6: (7, 1, None), 7: (7, 0, None), 8: (None, None, "cycle"), 9: (None, None, "cycle"),
        10: (None, None, "owner"), 11: (None, None, "owner"), 12: (99, 1, None), 13: (14, 1, None), 14: (14, 0, None),
    }
