"""Operator 3: URL filters by a temporal list join, in built-in functions only.

A list is a history of dated entries: on a day a pattern was added or removed. Per pattern they
become validity intervals. A capture asks for the keys that could be listed for it (its host, each
parent domain of two labels or more, and its URL without scheme, query and fragment), and an as-of
join on the key finds the entry that was active when the capture was fetched, if there was one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from antecede.llm.common import marked, run_of, table, written


def bare(url: Column) -> Column:
    """Host in lower case and path, without scheme, user, port, query, fragment and a slash at the end."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^[^@]*@|:[0-9]*$|\.$", ""))
    return F.concat(host, F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(.*)$", 1), "/+$", ""))


def host_of(bare_url: Column) -> Column:
    return F.substring_index(bare_url, "/", 1)


def keys(bare_url: Column) -> Column:
    """What a list can name a URL by, without repeats."""
    host = host_of(bare_url)
    labels = F.split(host, r"\.")
    parents = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parents, F.array(host, bare_url)))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (null: still listed) from entries (pattern, action, at).

    The last of a pattern's entries at one moment counts as "add" if any of them is; adding what is
    listed and removing what isn't change nothing. Entries with a null are left out.
    """
    moments = entries.where("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").groupBy("pattern", "at").agg(F.min("action").alias("action"))
    time = Window.partitionBy("pattern").orderBy("at")
    changes = moments.withColumn("was", F.lag("action").over(time)).where("NOT (action <=> was) AND NOT (was IS NULL AND action = 'remove')")
    return changes.withColumn("valid_to", F.lead("at").over(time)).where("action = 'add'").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, blocked, n_hits, pattern, listed_since: one row for each row of `captures`.

    captures: page_id, url, fetched_at. `pattern` is the longest active one (of equal length the
    first). A null or empty URL, or a null time, is never blocked. Repeated rows are judged each; no
    captures give no rows, and an empty list blocks nothing.
    """
    # Written once: a row keeps its tag however often it is read, wherever the captures come from.
    rows = written(captures.select("page_id", "url", "fetched_at", F.monotonically_increasing_id().alias("tag")), "captures")
    spans = written(intervals(entries), "intervals")
    asked = rows.where("fetched_at IS NOT NULL").select("tag", "fetched_at", F.explode(keys(bare(F.col("url")))).alias("pattern"))
    listed = marked(asked, F.xxhash64("pattern"), spans, F.xxhash64("pattern")).where("__may").select("tag", "fetched_at", "pattern")
    # A host may have a third of all captures: they are dealt into runs, and its intervals go to each run once.
    dealt = listed.withColumn("run", run_of(F.col("tag")))
    near = dealt.select("run", "pattern").distinct().join(spans, "pattern")
    # The as-of step: of a pattern's intervals, which never overlap, a capture takes the last that began by then, and looks at its end.
    begun = near.select("run", "pattern", F.col("valid_from").alias("at"), F.lit(0).alias("side"), F.struct("valid_from", "valid_to").alias("span"))
    met = dealt.select("run", "pattern", F.col("fetched_at").alias("at"), F.lit(1).alias("side"), "tag").unionByName(begun, allowMissingColumns=True)
    latest = F.last("span", True).over(Window.partitionBy("run", "pattern").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    active = met.withColumn("span", latest).where("side = 1 AND span IS NOT NULL AND (span.valid_to IS NULL OR at < span.valid_to)")
    best = F.min(F.struct((-F.length("pattern")).alias("l"), "pattern", F.col("span.valid_from").alias("since"))).alias("best")
    hits = active.groupBy("tag").agg(F.count("*").alias("n_hits"), best)
    n_hits = F.coalesce("n_hits", F.lit(0)).cast("long")
    return rows.join(hits, "tag", "left").select("page_id", "url", "fetched_at", (n_hits > 0).alias("blocked"), n_hits.alias("n_hits"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("listed_since"))


def number(text: Column) -> Column:
    """A fixed 32-bit number of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`pages` with a fetch time, and a list made of its own hosts, parent domains and URLs, which grows with it.

    The table has neither, so both are derived: a page was fetched at a minute of the year drawn from
    its URL; a third of the hosts, a sixth of the parent domains and a twentieth of the URLs
    were added on some day, half of these taken off 60 days later, and half of those added again.
    """
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + number(F.col("url")) % 525600 * 60))
    urls = pages.select(bare(F.col("url")).alias("pattern")).distinct()
    hosts = urls.select(host_of(F.col("pattern")).alias("pattern")).distinct()
    parents = hosts.select(F.substring_index("pattern", ".", -2).alias("pattern")).distinct()
    named = [(hosts, 3), (parents, 6), (urls, 20)]
    picked = None
    for patterns, one_in in named:
        some = patterns.where(number(F.concat(F.lit("list:"), "pattern")) % one_in == 0)
        picked = some if picked is None else picked.unionByName(some)
    n = number(F.concat(F.lit("day:"), "pattern"))
    some = picked.distinct().withColumn("n", n)
    dated = some.select(
        "pattern",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("add").alias("action"), day(F.col("n") % 200).alias("at"), F.lit(True).alias("is")),
                    F.struct(F.lit("remove").alias("action"), day(F.col("n") % 200 + 60).alias("at"), (F.col("n") % 2 == 0).alias("is")),
                    F.struct(F.lit("add").alias("action"), day(F.col("n") % 200 + 120).alias("at"), (F.col("n") % 4 == 0).alias("is")),
                ),
                lambda x: x["is"],
            )
        ).alias("e"),
    )
    return captures, dated.select("pattern", "e.action", "e.at")
