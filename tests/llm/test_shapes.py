"""Operators 3, 5 and 8 on inputs of other shapes: out of a shuffle, a join or an aggregate, runs in order, very many hits."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from antecede.llm import exact_dedup, secret_scan, url_filter

EPOCH = dt.datetime(2024, 1, 1)


def data(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def plain_filter(captures, entries):
    """captures: (page_id, url, minute); entries: (pattern, action, minute)."""
    spans = {}
    for pattern in {p for p, *_ in entries}:
        moments = {}
        for p, action, at in entries:
            if p == pattern:
                moments[at] = min(moments.get(at, "remove"), action)
        since = None
        for at in sorted(moments):
            if moments[at] == "add" and since is None:
                since = at
            elif moments[at] == "remove" and since is not None:
                spans.setdefault(pattern, []).append((since, at))
                since = None
        if since is not None:
            spans.setdefault(pattern, []).append((since, 10**9))
    out = []
    for page, url, at in captures:
        host, _, path = url.removeprefix("https://").partition("/")
        labels = host.split(".")
        asked = {".".join(labels[-n:]) for n in range(2, len(labels) + 1)} | {host, f"{host}/{path}"}
        hits = [(p, s) for p in asked for s, e in spans.get(p, []) if s <= at < e]
        best = min(hits, key=lambda h: (-len(h[0]), h[0]), default=(None, None))
        out.append((page, url, at, len(hits), str(best[0]), str(best[1])))
    return sorted(out)


@pytest.mark.parametrize("shape", ["file", "repartition", "join", "aggregate"])
def test_no_blocked_page_is_lost(spark, shape):
    rng = random.Random(7)
    hosts = ["hot.example.org"] + [f"h{k}.example.net" for k in range(60)]
    captures = [(k, f"https://{hosts[0] if k % 3 == 0 else rng.choice(hosts)}/{rng.choice('abc')}", rng.randint(0, 2000)) for k in range(900)]
    patterns = [*hosts[:40], "example.net", "hot.example.org/a"]
    entries = [(p, rng.choice(["add", "remove"]), rng.randint(0, 2000)) for p in patterns for _ in range(12)]
    entries += [("hot.example.org", "add" if k % 2 else "remove", k) for k in range(1500)]
    when = lambda c: F.timestamp_seconds(F.col(c) * 60)
    df = spark.createDataFrame(captures, "page_id long, url string, minute long").select("page_id", "url", when("minute").alias("fetched_at"))
    df = {
        "file": lambda: df, "repartition": lambda: df.repartition(7), "join": lambda: df.join(df.select("page_id").repartition(3), "page_id"),
        "aggregate": lambda: df.groupBy("page_id").agg(F.first("url").alias("url"), F.first("fetched_at").alias("fetched_at")),
    }[shape]()
    listed = spark.createDataFrame(entries, "pattern string, action string, minute long").select("pattern", "action", when("minute").alias("at"))
    got = url_filter.filter_urls(df, listed)
    minute = lambda c: (F.unix_seconds(c) / 60).cast("long")
    rows = data(got.select("page_id", "url", minute("fetched_at").alias("m"), "n_hits", "blocked", "pattern", minute("listed_since").alias("s")))
    want = plain_filter(captures, entries)
    assert sorted((r["page_id"], r["url"], r["m"], r["n_hits"], str(r["pattern"]), str(r["s"])) for r in rows) == want
    assert all(r["blocked"] == (r["n_hits"] > 0) for r in rows) and sum(r["blocked"] for r in rows) > 300


@pytest.mark.parametrize("fan_in", [2, 16])
def test_runs_are_sorted_and_merged_at_every_level(spark, fan_in):
    rng = random.Random(1)
    texts = [rng.choice(["same", "Same", f"text {k}", f"text {k % 50}"]) for k in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = exact_dedup.digests(docs)
    made = exact_dedup.levels(rows, fan_in=fan_in)
    assert len(made) == (9 if fan_in == 2 else 3)
    before = None
    for level in made:
        parts = level.select("run", "cut", F.hex("digest").alias("digest"), "n_bytes", "witness", "size", F.spark_partition_id().alias("part"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at")).collect()
        files = {}
        for r in sorted(parts, key=lambda r: r["at"]):
            files.setdefault(r["file"], []).append((r["run"], r["cut"], r["digest"], r["n_bytes"], r["witness"]))
        assert all(x == sorted(x) for x in files.values())
        # After the first level a run's cut is in one file, without repeats.
        where = {}
        if before is not None:
            for file, keys in files.items():
                assert len(set(keys)) == len(keys)
                for run, cut, *_ in keys:
                    assert where.setdefault((run, cut), file) == file
            assert len(parts) <= before
        before = len(parts)
        assert sum(r["size"] for r in parts) == 800
    assert {r["run"] for r in parts} == {0} and len(parts) == len({t.lower() for t in texts})
    got = {r["doc_id"]: r["keep_id"] for r in data(exact_dedup.exact_dedup(docs, fan_in))}
    last = {t.lower(): k for k, t in enumerate(texts)}
    assert got == {k: last[t.lower()] for k, t in enumerate(texts)}


def test_a_text_with_very_many_hits(spark):
    text = " ".join(f"{k:032x}" + (" AKIA" + "A" * (10 + k % 4) if k % 50 == 0 else "") for k in range(100_000))
    short = " ".join(f"{k:032x}" for k in range(700)) + " short abc " + "f" * 33
    docs = spark.createDataFrame([(1, text), (2, short), (3, "a" * 31)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in data(secret_scan.secret_report(docs))}
    for k, t in ((1, text), (2, short), (3, "a" * 31)):
        want = []
        for order, rule in enumerate(secret_scan.RULES):
            want += [(m.start(), order, f"{rule.kind}:{m.start()}:{m.end()}") for m in re.finditer(rule.regex, t) if len(m[rule.group]) >= rule.least]
        assert got[k]["spans"] == ",".join(x for *_, x in sorted(want))
        counts = Counter(x.split(":")[0] for *_, x in want)
        assert (got[k]["n_hex"], got[k]["n_access"]) == (counts["hex"], counts["access"])
    assert got[1]["n_hex"] >= 100_000 and got[1]["n_access"] == 1000
