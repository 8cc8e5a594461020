import pytest

url_filter = pytest.importorskip("antecede.llm.url_filter")


def test_every_parent_of_a_deep_host_is_asked_for(spark):
    host = ".".join(f"l{k}" for k in range(12, 0, -1))
    parents = [".".join(host.split(".")[-n:]) for n in range(2, 13)]
    captures = spark.createDataFrame([(k, f"https://{host}/a") for k in range(2)], "page_id long, url string").selectExpr("page_id", "url", "timestamp_seconds(100) AS fetched_at")
    for n in (2, 8, 9, 10, 11, 12):
        entries = spark.createDataFrame([(parents[n - 2], "add")], "pattern string, action string").selectExpr("*", "timestamp_seconds(50) AS at")
        got = url_filter.filter_urls(captures, entries).collect()
        assert [(r["blocked"], r["pattern"], r["n_hits"]) for r in got] == [(True, parents[n - 2], 1)] * 2
    many = spark.createDataFrame([(x, "add") for x in parents], "pattern string, action string").selectExpr("*", "timestamp_seconds(50) AS at")
    assert [(r["pattern"], r["n_hits"]) for r in url_filter.filter_urls(captures, many).collect()] == [(host, 11)] * 2
