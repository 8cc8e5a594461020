import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from antecede.llm import simhash, similar  # noqa: E402


def plain_kept(rows, least=0.8):
    """doc_ids that stay, by comparing every pair."""
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [[word() for _ in range(rng.randint(3, 150))] for _ in range(80)]
    passage = [word() for _ in range(30)]
    texts += [passage + [word() for _ in range(rng.randint(0, 12))] for _ in range(60)]
    for t in list(texts[:80]) + [texts[10]] * 60:
        copy = list(t)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    rng.shuffle(texts)
    return list(enumerate([" ".join(t) for t in texts] + ["", " ", "one two", "ONE  two"]))


@pytest.mark.parametrize(("tile", "sample"), [(1024, 8192), (8, 50)])
def test_near_stage_drops_what_brute_force_drops(spark, monkeypatch, tile, sample):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "SAMPLE", sample)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_kept(rows)
    assert len(want) < len(rows) - 60
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == want


def test_operator_7_links_near_copies_before_the_filters(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [[word() for _ in range(900)] for _ in range(12)]
    texts += [t[:450] + [word()] + t[451:] for t in texts] + [[word()] + t[:300] for t in texts]
    # Fingerprints count repeats and similarity doesn't: these are within two bits of each other and not similar.
    texts += [[*"abcde"] * 50 + [word() for _ in range(40)] for _ in range(3)]
    rows = list(enumerate([" ".join(t) for t in texts] + ["", " "]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = {(a, b) for a, x in rows for b, y in rows if a < b and (simhash.fingerprint(x, 5) ^ simhash.fingerprint(y, 5)).bit_count() <= 2}
    alike = {(a, b) for a, b in near if len(plain_kept([rows[a], rows[b]])) == 1}
    # Without the filters' shingles, what is linked are the near copies within two bits that are similar.
    plain = similar.prefixes
    monkeypatch.setattr(similar, "prefixes", lambda *a: plain(*a).withColumn("tokens", F.expr("slice(tokens, 1, 0)")))
    got = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert len(alike) > 6 and len(near - alike) == 3
    assert got == {i for i, _ in rows} - {b for _, b in alike}


def test_lists_of_one_component_are_passed_over(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (9, 8)], "node long, n int")
    joined = similar.written(spark.createDataFrame([(3, 2)], "u long, v long"), "joined")
    assert {r["node"]: (r["n"], r["c"]) for r in similar.labelled(nodes, joined).collect()} == {1: (5, 1), 2: (6, 2), 3: (7, 2), 9: (8, 9)}
