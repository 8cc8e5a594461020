"""Streaming queries: `events` and `orders` as file streams, run to their end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from antecede.operators import ratings as ra
from antecede.plans.duels import DUELS, duels
from antecede.plans.registry import Tables, query, r
from antecede.sources.tables import work_folder, written
from antecede.streaming import operators as s


def folder(t: Tables, label: str) -> str:
    return f"{work_folder(t.spark)}/{label}-{uuid.uuid4().hex}"


def brought(df: DataFrame, t: Tables, order: str, run: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """What `run` gives of a file stream to which the rows come in parts that follow each other in time; each part, of as many files as it has partitions, is one batch."""
    path, at = folder(t, "stream"), F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, F.array(*(F.lit(k / parts) for k in range(1, parts)))).alias("c")).first()["c"] if parts > 1 else []
    out = None
    for low, high in zip([None, *(cuts or [])], [*(cuts or []), None], strict=True):
        inside = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        df.where(inside).write.mode("append").parquet(path)
        out = run(s.read_files(t.spark, path))
    return out


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def l1_stream_upsert(t: Tables) -> DataFrame:
    """The table, then changed rows of the even keys: each batch replaces its keys' rows in the buckets it touches."""
    base = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    path, check = folder(t, "stream"), folder(t, "check")
    table = s.BucketedTable(t.spark, folder(t, "table"), "o_orderkey long, o_custkey long, o_totalprice double", "o_orderkey", 4)
    for rows in (base, base.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)):
        rows.write.mode("append").parquet(path)
        s.each_batch(s.read_files(t.spark, path), check, table.upsert)
    return table.read().drop("bucket")


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type || '!' FROM events WHERE event_id % 10 = 0")
def l2_idempotent_append(t: Tables) -> DataFrame:
    """Every third row comes twice, and every tenth again with other content, which is another row."""
    e = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    again = e.unionByName(e.where("event_id % 3 = 0")).unionByName(e.where("event_id % 10 = 0").withColumn("event_type", F.concat("event_type", F.lit("!"))))
    check, out = folder(t, "check"), folder(t, "out")
    return brought(again, t, "ts", lambda x: s.run_available(s.idempotent(x, "event_id", "event_type", "ts", "2 hours"), check, out)).select("event_id", "event_type")


@query("SELECT event_id, event_type || '!' AS event_type, 'conflict' AS kind FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, event_type, 'stored' FROM events")
def l2_conflicts(t: Tables) -> DataFrame:
    """The same key with the same content does nothing; with other content it is a conflict row; what was stored first stays."""
    e = t.events.select("event_id", "event_type")
    path, check, bad = (folder(t, x) for x in ("stream", "check", "conflicts"))
    table = s.BucketedTable(t.spark, folder(t, "stored"), "event_id long, event_type string", "event_id")

    def keep(batch: DataFrame, batch_id: int) -> None:
        s.append_new(table, bad, batch, batch_id, "event_type")

    for rows in (e, e.where("event_id % 3 = 0").unionByName(e.where("event_id % 10 = 0").withColumn("event_type", F.concat("event_type", F.lit("!"))))):
        rows.write.mode("append").parquet(path)
        s.each_batch(s.read_files(t.spark, path), check, keep)
    refused = t.spark.read.schema(table.schema).parquet(f"{bad}/*").withColumn("kind", F.lit("conflict"))
    return table.read().drop("bucket").withColumn("kind", F.lit("stored")).unionByName(refused)


@query("SELECT event_id, event_id % 240 <= 120 AS fresh FROM events")
def l3_fresh_quotes(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("received"), (F.col("ts").cast("timestamp") - F.make_dt_interval(secs=(F.col("event_id") % 240).cast("decimal(18,6)"))).alias("observed"))
    folders = [(folder(t, "check"), folder(t, "out")) for _ in range(2)]

    def run(stream: DataFrame) -> DataFrame:
        a, b = (s.run_available(x.select("event_id"), *at) for x, at in zip(s.fresh_quotes(stream, "observed", "received", 120), folders, strict=True))
        return a.withColumn("fresh", F.lit(True)).unionByName(b.withColumn("fresh", F.lit(False)))

    return brought(e, t, "received", run)


@query("SELECT b.event_id AS bet, q.event_id AS quote FROM events b JOIN events q ON b.user_id = q.user_id AND b.event_type = 'purchase' AND q.event_type = 'view' AND q.ts > b.ts AND q.ts < b.ts + INTERVAL 6 HOUR")
def l4_quotes_before_start(t: Tables) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    bets = e.where("event_type = 'purchase'").select(F.col("event_id").alias("bet"), "user_id", F.col("ts").alias("entered"), F.expr("ts + INTERVAL 6 HOURS").alias("starts"))
    quotes = e.where("event_type = 'view'").select(F.col("event_id").alias("quote"), "user_id", F.col("ts").alias("observed"))
    paths = [folder(t, "stream") for _ in range(2)]
    for x, path in zip((bets, quotes), paths, strict=True):
        x.write.parquet(path)
    b, q = (s.read_files(t.spark, path) for path in paths)
    return s.run_available(s.quotes_before_start(b, q, "user_id", 6, "1 hour").select("bet", "quote"), folder(t, "check"), folder(t, "out"))


@query("SELECT b.event_id AS bet, q.event_id AS quote, q.event_id IS NOT NULL AS quoted FROM (SELECT * FROM events WHERE event_type = 'purchase') b LEFT JOIN events q ON b.user_id = q.user_id AND q.event_type = 'view' AND q.ts > b.ts AND q.ts < b.ts + INTERVAL 6 HOUR")
def l4_bets_with_or_without_quotes(t: Tables) -> DataFrame:
    """Every bet comes out: with each of its quotes, or once without, when the watermark passes. A last row of a later time on both sides, as a heartbeat, lets the last bets go."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    beat = e.agg((F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts"))
    bets = e.where("event_type = 'purchase'").select(F.col("event_id").alias("bet"), "user_id", F.col("ts").alias("entered"), F.expr("ts + INTERVAL 6 HOURS").alias("starts"))
    quotes = e.where("event_type = 'view'").select(F.col("event_id").alias("quote"), "user_id", F.col("ts").alias("observed"))
    paths, check, out = [folder(t, "stream") for _ in range(2)], folder(t, "check"), folder(t, "out")
    none = lambda c: F.lit(None).cast("long").alias(c)
    nobody = F.lit(-1).cast("long").alias("user_id")
    last = (beat.select(none("bet"), nobody, F.col("ts").alias("entered"), F.col("ts").alias("starts")), beat.select(none("quote"), nobody, F.col("ts").alias("observed")))
    made = None
    for parts in ((bets, quotes), last):
        for x, path in zip(parts, paths, strict=True):
            x.write.mode("append").parquet(path)
        b, q = (s.read_files(t.spark, path) for path in paths)
        made = s.run_available(s.quotes_or_none(b, q, "user_id", 6, "1 hour").select("bet", "quote"), check, out)
    return made.where("bet IS NOT NULL").withColumn("quoted", F.col("quote").isNotNull())


@query("""WITH q AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS received, epoch_us(ts) - (event_id % 240) * 1000000 * (event_id % 5) * 30 AS observed FROM events),
    m AS (SELECT *, max(observed) OVER (PARTITION BY key ORDER BY received, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 7200000000 AS mark FROM q)
    SELECT id, coalesce(observed < mark, FALSE) AS late, greatest(coalesce(mark - observed, 0), 0) AS behind_us FROM m""")
def l3_late_rows(t: Tables) -> DataFrame:
    """Rows over two hours behind their key's latest observation go to a table of their own, none is lost; each is judged once, by the state before it."""
    id_, received = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.events.select(F.col("user_id").alias("key"), id_.alias("id"), (received - id_ % 240 * 1_000_000 * (id_ % 5) * 30).alias("observed_us"), received.alias("received_us"), F.col("ts").cast("timestamp").alias("ts"))
    check, root = folder(t, "check"), folder(t, "judged")
    with s.rocks(t.spark):
        brought(e, t, "ts", lambda x: s.each_batch(s.split_late(x.drop("ts"), 7200), check, s.two_tables(root)))
    read = lambda kind: t.spark.read.schema("key long, id long, observed_us long, late boolean, behind_us long").parquet(f"{root}/{kind}/*")
    return read("fresh").unionByName(read("rejected")).select("id", "late", "behind_us")


_sessions = """WITH a AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, TRUE)::INT AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS rows FROM b GROUP BY user_id, k"""


@query(f"SELECT * FROM ({_sessions}) WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def l5_gap_sessions(t: Tables) -> DataFrame:
    """Sessions that can't grow any more when the stream ends."""
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    check, out = folder(t, "check"), folder(t, "out")
    return brought(e, t, "ts", lambda x: s.run_available(s.gap_sessions(x, "user_id", "ts", "6 hours", "1 hour"), check, out))


@query(f"""{DUELS}, a AS (SELECT *, epoch_us(played) <= (SELECT quantile_disc(epoch_us(played), 0.5) FROM duels) AS early, year(played) AS season FROM duels),
    m1 AS (SELECT entity, 1500 + sum(32 * (result - 0.5::DOUBLE)) AS mu, arg_min(season, (played, game)) AS season, max(played) AS last FROM a WHERE early GROUP BY entity),
    f AS (SELECT entity, min(played) AS first, max(played) AS last, arg_min(season, (played, game)) AS season FROM a WHERE NOT early GROUP BY entity),
    s AS (SELECT f.entity, coalesce(1500 + (m1.mu - 1500) * pow(0.9::DOUBLE, greatest(f.season - m1.season, 0)) * pow(0.5::DOUBLE, greatest(date_diff('day', m1.last, f.first) - 45, 0) / 180.0), 1500) AS mu FROM f LEFT JOIN m1 USING (entity)),
    g AS (SELECT a.entity, a.result, s.mu, o.mu AS foe FROM a JOIN s USING (entity) JOIN s o ON o.entity = a.opponent WHERE NOT early),
    m2 AS (SELECT entity, max(mu) + sum(32 * (result - 1 / (1 + pow(10::DOUBLE, (foe - mu) / 400)))) AS mu FROM g GROUP BY entity)
    SELECT coalesce(m2.entity, m1.entity) AS entity, round(coalesce(m2.mu, m1.mu), 6) AS mu, coalesce(f.last, m1.last) AS last_played FROM m1 FULL JOIN m2 ON m1.entity = m2.entity LEFT JOIN f ON f.entity = m2.entity""")
def l6_stream_ratings(t: Tables) -> DataFrame:
    """Elo by micro-batch over all games, in two batches; the state is a table by buckets of entities that outlives the driver."""
    ev = duels(t).withColumns({"season": F.year("played"), "played": F.col("played").cast("timestamp"), "result": F.col("result").cast("double")}).select("game", "played", "side", "entity", "result", "season", "league")
    seasons = written(ra.season_order(ev).coalesce(1), "seasons")
    check, states = folder(t, "check"), s.BucketedTable(t.spark, folder(t, "states"), ra.STATE, "entity")

    def rate(state: DataFrame, batch: DataFrame) -> DataFrame:
        return ra.merged_state(state, ra.rate_period(batch, state, ra.elo(), seasons)[1])

    brought(ev, t, "played", lambda x: s.each_batch(x, check, lambda batch, k: states.change(batch, k, rate)), 2)
    return states.read().select("entity", r("mu"), "last_played")


@query("""WITH h AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 23 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS start FROM events), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)
    SELECT event_type, start, count(*) AS rows FROM h WHERE start + INTERVAL 24 HOUR <= (SELECT mark FROM m) GROUP BY ALL""")
def l7_health_counts(t: Tables) -> DataFrame:
    """Sliding windows of every kind of event that the watermark has closed when the stream ends."""
    e = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    check, out = folder(t, "check"), folder(t, "out")
    return brought(e, t, "ts", lambda x: s.run_available(s.health_counts(x, "event_type", "ts", wait="2 hours"), check, out))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), a AS (SELECT n.o_custkey, n.i, n.o_orderdate, sum(p.o_totalprice * pow(2.0, (p.i - n.i) / 9.0)) / sum(pow(2.0, (p.i - n.i) / 9.0)) AS e FROM n JOIN n p ON n.o_custkey = p.o_custkey AND p.i <= n.i GROUP BY ALL)
    SELECT o_custkey AS entity, o_orderdate AS "at", round(e, 4) AS ema_after FROM a""")
def l8_running_ewm(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("tie"), F.col("o_totalprice").alias("value"))
    check, out = folder(t, "check"), folder(t, "out")
    with s.rocks(t.spark):
        made = brought(o, t, "at", lambda x: s.run_available(s.running_ewm(x), check, out), 2)
    return made.select("entity", "at", r("ema_after", 4))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), a AS (SELECT n.o_custkey, n.o_orderkey, n.o_orderdate, sum(p.o_totalprice * pow(2.0, (p.i - n.i) / 9.0)) / sum(pow(2.0, (p.i - n.i) / 9.0)) AS e FROM n JOIN n p ON n.o_custkey = p.o_custkey AND p.i <= n.i GROUP BY ALL)
    SELECT o_custkey AS entity, o_orderkey AS tie, round(e, 4) AS ema_after FROM a WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 36 HOUR""")
def l8_ewm_out_of_order(t: Tables) -> DataFrame:
    """Orders that come up to a day late, in another order than they were made: what the ordered stream gives, of all rows that the watermark has passed."""
    o = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("tie"), F.col("o_totalprice").alias("value"))
    late = o.withColumn("arrives", F.col("at") + F.make_dt_interval((F.col("tie") % 2).cast("int")))
    check, out = folder(t, "check"), folder(t, "out")
    with s.rocks(t.spark):
        made = brought(late, t, "arrives", lambda x: s.run_available(s.ordered_ewm(x.drop("arrives"), "36 hours"), check, out), 3)
    return made.select("entity", "tie", r("ema_after", 4))
