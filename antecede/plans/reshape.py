"""Reshaping, grouping and run queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.functions import columns as c
from antecede.operators import history as h, merge as m, reshape as s, runs
from antecede.plans.duels import DUELS, duels
from antecede.plans.history import PLAYER
from antecede.plans.registry import Tables, query, r


@query(f"""{DUELS} SELECT game, entity, 'train' AS kind, round(avg(kills) OVER w, 4) AS kills FROM duels WINDOW w AS (PARTITION BY entity ORDER BY played RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)
    UNION ALL SELECT game, entity, 'serve', round(kills * 2, 4) FROM duels""")
def b14_materialise(t: Tables) -> DataFrame:
    df = h.prior_mean(duels(t), PLAYER, {"kills_before": "kills"}).withColumn("kills_after", F.col("kills") * 2)
    part = lambda suffix, kind: s.materialise(df, ["game", "entity"], suffix).select("game", "entity", F.lit(kind).alias("kind"), r("kills", 4))
    return part("_before", "train").unionByName(part("_after", "serve"))


@query(f"{DUELS} SELECT a.game, a.side, round(a.kills - b.kills, 2) AS kills, a.result - b.result AS result FROM duels a JOIN duels b ON a.game = b.game AND a.side <> b.side")
def b26_fuse_opponent(t: Tables) -> DataFrame:
    from antecede.operators.joins import pair_opponents

    df = pair_opponents(duels(t), ["game"], "side", ("Blue", "Red"), ["kills", "result"])
    return s.fuse_opponent(df.select("game", "side", "kills", "result", "opp_kills", "opp_result")).select("game", "side", r("kills", 2), "result")


@query("""WITH x AS (SELECT o_orderkey, o_totalprice / 500000 AS a, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey / 1500 END AS b, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 END AS d FROM orders)
    SELECT o_orderkey, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (d IS NOT NULL)::INT), 6) AS players_mean, round(greatest(a, b, d), 6) AS players_max FROM x""")
def b27_role_likelihoods(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [F.col("o_totalprice") / 500000, F.when(k % 3 != 0, F.col("o_custkey") / 1500), F.when(k % 4 == 0, F.lit(0.5))]
    return t.orders.select("o_orderkey", r(c.row_mean(*parts), name="players_mean"), r(F.greatest(*parts), name="players_max"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(sum(CASE WHEN l_quantity > 25 THEN l_quantity END) OVER (PARTITION BY l_orderkey), 0) AS total_v FROM lineitem")
def d1_group_totals(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("v", F.when(F.col("l_quantity") > 25, F.col("l_quantity")))
    return s.group_totals(df, ["l_orderkey"], ["v"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "total_v")


@query("SELECT o_orderkey, s AS vision FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def d2_member_sums(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("vision"))
    return t.orders.join(sums, "o_orderkey", "left").select("o_orderkey", "vision")


@query("SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN l_linenumber = {k} THEN l_quantity END) AS \"{k}_l_quantity\", max(CASE WHEN l_linenumber = {k} THEN l_tax END) AS \"{k}_l_tax\"" for k in (1, 2, 3)) + " FROM lineitem GROUP BY l_orderkey")
def d8_pivot_roles(t: Tables) -> DataFrame:
    return s.pivot_roles(t.lineitem, ["l_orderkey"], "l_linenumber", [1, 2, 3], ["l_quantity", "l_tax"], strict=False)


@query(f"{DUELS} SELECT game, side, entity, result FROM duels")
def d9_wide_and_tall(t: Tables) -> DataFrame:
    wide = s.to_wide(duels(t), ["game"], "side", ("Blue", "Red"), ["entity", "result"])
    return s.to_tall(wide, ["game"], "side", ("Blue", "Red"), ["entity", "result"])


@query(f"""{DUELS}, k AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY entity, side) AS k FROM duels) SELECT a.game, round(a.kills - b.kills, 2) AS delta_kills, a.league AS context_league, CASE WHEN a.side = b.side THEN a.side END AS context_side,
    CASE WHEN a.entity::VARCHAR < b.entity::VARCHAR THEN a.entity || '|' || b.entity ELSE b.entity || '|' || a.entity END AS pair_entity, a.result AS first_won FROM k a JOIN k b ON a.game = b.game AND a.k = 1 AND b.k = 2""")
def d10_matchup_rows(t: Tables) -> DataFrame:
    return s.matchup_rows(duels(t), "game", ["entity", "side"], ["kills"], ["league", "side"], ["entity"], "result").withColumn("delta_kills", r("delta_kills", 2))


@query(f"""{DUELS} SELECT a.game, round(a.kills, 2) AS blue_kills, round(b.kills, 2) AS red_kills, round((a.kills + b.kills) / 2, 3) AS mean_kills, round(abs(a.kills - b.kills), 2) AS absdiff_kills, round(a.kills + b.kills, 2) AS sum_kills, CASE WHEN a.game % 5 <> 0 THEN a.price END AS price
    FROM duels a JOIN duels b ON a.game = b.game AND a.side = 'Blue' AND b.side = 'Red'""")
def d11_total_rows(t: Tables) -> DataFrame:
    df = duels(t).withColumn("price", F.when((F.col("game") % 5 == 0) & (F.col("side") == "Red"), F.col("price") + 1).otherwise(F.col("price")))
    out = s.total_rows(df, "game", "side", ("Blue", "Red"), ["kills"], "price")
    return out.select("game", r("blue_kills", 2), r("red_kills", 2), r("mean_kills", 3), r("absdiff_kills", 2), r("sum_kills", 2), "price")


@query(f"""{DUELS}, x AS (SELECT game, played, CASE WHEN game % 11 = 0 THEN NULL ELSE entity END AS entity, CASE WHEN game % 7 = 0 THEN 1 ELSE result END AS result FROM duels WHERE NOT (game % 13 = 0 AND side = 'Red')),
    g AS (SELECT game, min(played) AS started, list_sort(list(DISTINCT entity) FILTER (WHERE entity IS NOT NULL)) AS ids, max(CASE WHEN result = 1 THEN entity END) AS w, count(*) AS n, count(entity) AS ne, count(result) AS nr, sum(result) AS wins FROM x GROUP BY game),
    y AS (SELECT *, concat_ws(',', CASE WHEN n <> 2 THEN 'rows' END, CASE WHEN coalesce(len(ids), 0) <> 2 OR ne <> n THEN 'ids' END, CASE WHEN nr <> n THEN 'null result' END, CASE WHEN coalesce(wins, 0) <> 1 THEN 'winners' END) AS reasons FROM g)
    SELECT game, started, coalesce(array_to_string(ids, '|'), '') AS ids, CASE WHEN reasons = '' THEN w END AS winner, reasons FROM y""")
def d46_collapse_pair(t: Tables) -> DataFrame:
    x = duels(t).where("NOT (game % 13 = 0 AND side = 'Red')").select("game", "played", F.when(F.col("game") % 11 != 0, F.col("entity")).alias("entity"), F.when(F.col("game") % 7 == 0, 1).otherwise(F.col("result")).alias("result"))
    return s.collapse_pair(x, "game", "played", "entity", "result").select("game", "started", F.array_join("ids", "|").alias("ids"), "winner", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'c' || user_id END, nullif(regexp_extract('series-' || printf('%x', user_id) || ':map-' || event_id % 5, '^series-([0-9a-f]+):map-\\d+$', 1), '')) AS cluster FROM events")
def d47_cluster_key(t: Tables) -> DataFrame:
    name = F.concat(F.lit("series-"), F.lower(F.hex("user_id")), F.lit(":map-"), (F.col("event_id") % 5).cast("string"))
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string")))
    return t.events.select("event_id", F.coalesce(given, F.nullif(F.regexp_extract(name, r"^series-([0-9a-f]+):map-\d+$", 1), F.lit(""))).alias("cluster"))


SEQ = "SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + user_id) % 5 + 1 AS seq FROM events"


def sequenced(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.events.withColumn("seq", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + F.col("user_id")) % 5 + 1)


def _gap(seconds: int):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.coalesce(at(F.col("ts")) - at(F.lag("ts").over(w)) > seconds * 1_000_000, F.lit(False))


STRICT = f"""WITH s AS ({SEQ}), a AS (SELECT *, sum((seq = 1)::INT) OVER w AS run0, lag(seq) OVER w AS prev, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 50400000000, FALSE) AS far FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, CASE WHEN seq <> 1 AND run0 > 0 THEN CASE WHEN seq <> prev + 1 THEN 'sequence' WHEN far THEN 'gap' END END AS bad FROM a),
    d AS (SELECT *, max((bad IS NOT NULL)::INT) OVER (PARTITION BY user_id, run0 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM b),
    strict_ AS (SELECT *, CASE WHEN run0 = 0 OR coalesce(earlier, 0) = 1 THEN 'does not start at 1' ELSE bad END AS reason FROM d),
    sound AS (SELECT *, CASE WHEN reason IS NULL THEN run0 END AS run FROM strict_)"""


@query(f"{STRICT} SELECT event_id, user_id, run::BIGINT AS run, reason FROM sound")
def e14_strict_runs(t: Tables) -> DataFrame:
    return runs.strict_runs(sequenced(t), ["user_id"], ["ts", "event_id"], "seq", _gap(14 * 3600)).select("event_id", "user_id", F.col("run").cast("long").alias("run"), "reason")


@query(f"""WITH s AS (SELECT *, (event_id * 7 + user_id) % 4 + 1 AS seq FROM events), a AS (SELECT *, (seq = 1 OR coalesce(seq <= lag(seq) OVER w, TRUE) OR coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, FALSE))::INT AS st FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM a""")
def e15_lenient_runs(t: Tables) -> DataFrame:
    df = t.events.withColumn("seq", (F.col("event_id") * 7 + F.col("user_id")) % 4 + 1)
    return runs.lenient_runs(df, ["user_id"], ["ts", "event_id"], "seq", "ts", 6 * 3600).select("event_id", F.col("run").cast("long").alias("run"))


@query(f"""{STRICT}, m AS (SELECT *, (value > 30)::INT AS won, event_type AS phase FROM sound WHERE run IS NOT NULL), sc AS (SELECT *, coalesce(sum(won) OVER w, 0) AS wb, coalesce(sum(1 - won) OVER w, 0) AS lb FROM m WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT user_id, run, count(*) AS maps, sum(won)::BIGINT AS wins_a, sum(1 - won)::BIGINT AS wins_b, max(greatest(wb, lb)) AS bl, min(phase) AS phase, substr(sha256(string_agg(event_id::VARCHAR, '|' ORDER BY ts, event_id)), 1, 16) AS id FROM sc GROUP BY ALL),
    p AS (SELECT phase, avg((maps = 1)::INT) AS single, count(*) AS n FROM g GROUP BY phase)
    SELECT user_id, run::BIGINT AS run, maps, wins_a, wins_b, CASE WHEN maps = 1 AND single >= 0.02 AND n >= 20 THEN 1 WHEN bl < greatest(wins_a, wins_b) AND wins_a <> wins_b AND greatest(wins_a, wins_b) = 2 THEN 3 WHEN bl < greatest(wins_a, wins_b) AND wins_a <> wins_b AND greatest(wins_a, wins_b) = 3 THEN 5 END AS best_of, id FROM g JOIN p USING (phase)""")
def e16_classify_runs(t: Tables) -> DataFrame:
    df = runs.strict_runs(sequenced(t), ["user_id"], ["ts", "event_id"], "seq", _gap(14 * 3600)).where("run IS NOT NULL").withColumns({"won": (F.col("value") > 30).cast("int"), "phase": F.col("event_type")})
    return runs.classify_runs(df, ["user_id", "run"], ["ts", "event_id"], "won", "phase", singles=0.02).select("user_id", F.col("run").cast("long").alias("run"), "maps", "wins_a", "wins_b", "best_of", "id")


@query(f"{STRICT} SELECT event_id, coalesce(sum((value > 30)::INT) OVER w, 0)::BIGINT AS wins_before, coalesce(sum((value <= 30)::INT) OVER w, 0)::BIGINT AS losses_before FROM sound WHERE run IS NOT NULL WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def e17_running_score(t: Tables) -> DataFrame:
    df = runs.strict_runs(sequenced(t), ["user_id"], ["ts", "event_id"], "seq", _gap(14 * 3600)).where("run IS NOT NULL").withColumn("won", (F.col("value") > 30).cast("int"))
    return runs.running_score(df, ["user_id", "run"], ["ts", "event_id"], "won").select("event_id", "wins_before", "losses_before")


@query("""WITH x AS (SELECT user_id, max((NOT value < 60)::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS miss FROM events) SELECT user_id, count(*) FILTER (WHERE miss = 0) AS streak FROM x GROUP BY user_id""")
def e18_trailing_streak(t: Tables) -> DataFrame:
    return runs.trailing_streak(t.events, "user_id", ["ts", "event_id"], F.col("value") < 60)


@query("""WITH x AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), y AS (SELECT * FROM x WHERE k <= 10), n AS (SELECT user_id, event_type, count(DISTINCT event_id) AS n, max(ts) AS last FROM y GROUP BY ALL),
    z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC, event_type DESC) AS b, sum(n) OVER (PARTITION BY user_id) AS seen, count(*) OVER (PARTITION BY user_id) - 1 AS alternates FROM n)
    SELECT user_id, event_type AS modal, round(n / seen, 6) AS share, seen::BIGINT AS seen, alternates FROM z WHERE b = 1""")
def e19_modal_recent(t: Tables) -> DataFrame:
    return runs.modal_recent(t.events, "user_id", "event_id", "ts", "event_type").select("user_id", "modal", r("share"), "seen", "alternates")


@query("""WITH x AS (SELECT *, coalesce((event_type IN ('click', 'view') <> (lag(event_type) OVER w IN ('click', 'view')))::INT, 0) AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
    y AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS st FROM x) SELECT user_id, event_type IN ('click', 'view') AS team, min(ts) AS start, max(ts) AS last_seen, count(*) AS games FROM y WHERE st = 0 GROUP BY ALL""")
def e25_latest_stint(t: Tables) -> DataFrame:
    df = t.events.withColumn("team", F.col("event_type").isin("click", "view"))
    return runs.latest_stint(df, "user_id", ["ts", "event_id"], "team", "ts")


#: Each user's events in runs: a new one begins after a gap of more than 6 hours.
MANIFEST = """SELECT user_id || '-' || run AS series, list(event_id ORDER BY ts, event_id) AS ids, list((value > 30)::INT ORDER BY ts, event_id) AS won FROM (
    SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, TRUE)::INT AS st FROM events)) GROUP BY user_id, run"""


def manifest(t: Tables) -> DataFrame:
    found = runs.lenient_runs(t.events.withColumn("seq", F.lit(2)), ["user_id"], ["ts", "event_id"], "seq", "ts", 6 * 3600, rising=False)
    maps = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 30).cast("int").alias("w"))))
    return found.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), F.col("run").cast("string")).alias("series")).agg(maps.alias("m")).select("series", F.col("m.event_id").alias("ids"), F.col("m.w").alias("won"))


@query(f"WITH m AS ({MANIFEST}) SELECT series, ids[1] AS event_id, event_type FROM m JOIN events ON event_id = ids[1]")
def c9_first_of_series(t: Tables) -> DataFrame:
    return runs.first_of_series(manifest(t), "ids", t.events, "event_id").select("series", "event_id", "event_type")


@query(f"WITH m AS ({MANIFEST}), x AS (SELECT *, unnest(range(2, len(ids) + 1)) AS map FROM m) SELECT series, map::INT AS map, ids[map] AS map_id, ids[1] AS event_id, event_type, coalesce(list_sum(won[:map - 1]), 0)::INT AS wins_before, (map - 1 - coalesce(list_sum(won[:map - 1]), 0))::INT AS losses_before FROM x JOIN events ON event_id = ids[1]")
def c10_expand_series(t: Tables) -> DataFrame:
    return runs.expand_series(manifest(t), "ids", "won", t.events, "event_id").select("series", "map", "map_id", "event_id", "event_type", "wins_before", "losses_before")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def f3_top_n(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


INCOMING = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    new = t.orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 6 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return t.orders.where("o_orderkey % 10 <> 0").select(*cols), new.select(*cols)


@query("SELECT l_orderkey AS id, 'lineitem' AS origin FROM lineitem UNION ALL SELECT o_orderkey, 'orders' FROM orders")
def g1_union(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.lit("lineitem").alias("origin")).unionByName(t.orders.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("origin")))


@query(f"""WITH n AS ({INCOMING}), o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0)
    SELECT CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_totalprice = n.o_totalprice THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey GROUP BY 1""")
def g2_key_changes(t: Tables) -> DataFrame:
    return m.key_changes(*halves(t), ["o_orderkey"]).groupBy("change").agg(F.count("*").alias("n"))


@query(f"""WITH n AS ({INCOMING}), o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), j AS (SELECT o.o_orderkey AS a, n.o_orderkey AS b, o.o_totalprice = n.o_totalprice AND o.o_custkey = n.o_custkey AS same FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
    SELECT (SELECT count(*) FROM o) AS existing_rows, (SELECT count(*) FROM n) AS incoming_rows, count(*) FILTER (WHERE a IS NULL) AS added, count(*) FILTER (WHERE same) AS unchanged, count(*) FILTER (WHERE NOT same) AS updated, count(*) FILTER (WHERE b IS NULL) AS kept, count(*) AS merged_rows FROM j""")
def g3_merge_manifest(t: Tables) -> DataFrame:
    return m.merge_manifest(*halves(t), "o_orderkey")


@query(f"WITH n AS ({INCOMING}), o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def g3_merge_history(t: Tables) -> DataFrame:
    return m.merge_history(*halves(t), "o_orderkey", "incremental")


@query(f"WITH n AS ({INCOMING}) SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT * FROM n WHERE o_orderkey % 10 = 0")
def g4_insert_new(t: Tables) -> DataFrame:
    return m.insert_new(*halves(t), "o_orderkey", ["o_totalprice"])


@query("SELECT l_orderkey AS id, 'only left' AS side FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0) UNION ALL SELECT o_orderkey, 'only right' FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def g5_id_sets(t: Tables) -> DataFrame:
    return m.id_sets(t.lineitem.select(F.col("l_orderkey").alias("id")), t.orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id")))


@query("""WITH v AS (SELECT o_custkey AS source, o_orderkey AS version_id, o_orderpriority AS facts, lag(o_orderpriority) OVER w AS was, lag(o_orderkey) OVER w AS old_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    ch AS (SELECT * FROM v WHERE old_id IS NOT NULL AND was <> facts), p AS (SELECT l_orderkey AS version_id, l_orderkey * 10 + l_linenumber AS id, l_linenumber % 3 AS selection, min(l_partkey) AS x FROM lineitem GROUP BY ALL)
    SELECT p.id AS corrected, min(n.id) AS replacement FROM ch JOIN p ON p.version_id = ch.old_id LEFT JOIN p n ON n.version_id = ch.version_id AND n.selection = p.selection WHERE p.id NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey % 9 = 0) GROUP BY p.id""")
def g6_supersede(t: Tables) -> DataFrame:
    versions = t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("facts"))
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    dependents = t.lineitem.select(F.col("l_orderkey").alias("version_id"), k, (F.col("l_linenumber") % 3).alias("selection")).distinct()
    done = t.lineitem.where("l_orderkey % 9 = 0").select(k.alias("corrected")).distinct()
    return m.supersede(versions, dependents, done)
