"""Join, correction and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede import keys
from antecede.operators import joins as j
from antecede.operators.names import closest_names
from antecede.plans.duels import DUELS, duels, games
from antecede.plans.registry import Tables, query, r
from antecede.sources import tables as s

SIDES = ("Blue", "Red")


@query(f"{DUELS} SELECT a.game, a.side, a.entity, b.entity AS opp_entity, round(b.kills, 2) AS opp_kills FROM duels a JOIN duels b ON a.game = b.game AND a.side <> b.side")
def c1_pair_opponents(t: Tables) -> DataFrame:
    return j.pair_opponents(duels(t), ["game"], "side", SIDES, ["entity", "kills"]).select("game", "side", "entity", "opp_entity", r("opp_kills", 2))


@query(f"{DUELS} SELECT a.game, a.side, round(a.kills - b.kills, 2) AS diff_kills, a.result - b.result AS diff_result FROM duels a JOIN duels b ON a.game = b.game AND a.side <> b.side")
def c2_opponent_differences(t: Tables) -> DataFrame:
    df = j.pair_opponents(duels(t), ["game"], "side", SIDES, ["kills", "result"])
    return j.with_differences(df, ["kills", "result"]).select("game", "side", r("diff_kills", 2), "diff_result")


@query("""WITH l AS (SELECT l_orderkey AS game, CASE WHEN l_returnflag = 'R' THEN 'Red' ELSE 'Blue' END AS side, l_quantity AS kills FROM lineitem),
    e AS (SELECT game, CASE WHEN side = 'Red' THEN 'Blue' ELSE 'Red' END AS side, sum(kills) AS enemy_kills FROM l GROUP BY ALL)
    SELECT l.game, l.side, l.kills, e.enemy_kills FROM l LEFT JOIN e ON l.game = e.game AND l.side = e.side""")
def c3_enemy_totals(t: Tables) -> DataFrame:
    df = t.lineitem.select(F.col("l_orderkey").alias("game"), F.when(F.col("l_returnflag") == "R", "Red").otherwise("Blue").alias("side"), F.col("l_quantity").alias("kills"))
    return j.enemy_totals(df, ["game"], "side", SIDES, ["kills"]).select("game", "side", "kills", "enemy_kills")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def c4_join_checked(t: Tables) -> DataFrame:
    return keys.join_checked(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"], "inner", "m:1", matched=True).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON s_nationkey = n_nationkey")
def c5_dimension_join(t: Tables) -> DataFrame:
    known = t.nation.where("n_nationkey % 4 <> 0").withColumnRenamed("n_nationkey", "s_nationkey")
    return j.dimension_join(t.supplier, known, "s_nationkey", {"n_name": "unknown", "n_regionkey": -1}).select("s_suppkey", "n_name", "n_regionkey")


@query("""WITH ships AS (SELECT l_suppkey % 50 AS k, l_shipdate, max((l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS m FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, m[1] AS last_order, m[3] AS last_part FROM orders ASOF LEFT JOIN ships ON o_custkey % 50 = k AND o_orderdate >= l_shipdate""")
def c6_asof_join(t: Tables) -> DataFrame:
    left = t.orders.withColumn("k", F.col("o_custkey") % 50)
    right = t.lineitem.withColumn("k", F.col("l_suppkey") % 50).withColumnsRenamed({"l_orderkey": "last_order", "l_partkey": "last_part"})
    return j.asof_join(left, right, ["k"], "o_orderdate", "l_shipdate", ["last_order", "last_part"], ["last_order", "l_linenumber", "last_part", "l_quantity", "l_extendedprice"]).select("o_orderkey", "last_order", "last_part")


@query("""SELECT o.o_orderkey, s.o_orderkey AS state_order, s.o_totalprice AS state_price
    FROM orders o LEFT JOIN LATERAL (SELECT * FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate + INTERVAL 10 DAY <= least(o.o_orderdate + INTERVAL 3 DAY, o.o_orderdate + to_days((o.o_orderkey % 5)::INT))
        AND p.o_orderdate < date_trunc('day', least(o.o_orderdate + INTERVAL 3 DAY, o.o_orderdate + to_days((o.o_orderkey % 5)::INT))) ORDER BY p.o_orderdate DESC, p.o_orderkey DESC LIMIT 1) s ON TRUE""")
def c7_asof_state(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("as_of"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 5 AS int))").alias("decision"))
    states = t.orders.select("o_custkey", F.expr("o_orderdate + INTERVAL 10 DAYS").alias("available"), F.col("o_orderdate").alias("started"), F.col("o_orderkey").alias("state_order"), F.col("o_totalprice").alias("state_price"))
    return j.asof_state(left, states, ["o_custkey"], "as_of", "decision", "available", "started", ["state_order", "state_price"], "o_orderkey").select("o_orderkey", "state_order", "state_price")


@query("""SELECT a.event_id AS fixture, b.event_id AS listing, list_filter([CASE WHEN a.event_type <> b.event_type THEN 'type' END, CASE WHEN NOT list_has_all(string_split_regex(lower(b.props), '[^a-z0-9]+'), ['k', (a.user_id % 100)::VARCHAR]) THEN 'tokens' END, CASE WHEN b.value < 5 THEN 'value' END], lambda x: x IS NOT NULL)::VARCHAR AS reasons
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000""")
def c8_match_within(t: Tables) -> DataFrame:
    cut = lambda k, p: t.events.where(f"event_id % 2 = {k}").select("user_id", *(F.col(c).alias(p + c) for c in ("event_id", "ts", "event_type", "value", "props")))
    met = j.match_within(cut(0, "a_"), cut(1, "b_"), ["user_id"], "a_ts", "b_ts", 6 * 3600)
    why = j.reasons({"type": F.col("a_event_type") != F.col("b_event_type"), "tokens": ~j.contains_tokens(F.array(F.lit("k"), (F.col("user_id") % 100).cast("string")), F.col("b_props")), "value": F.col("b_value") < 5})
    return met.select(F.col("a_event_id").alias("fixture"), F.col("b_event_id").alias("listing"), F.concat(F.lit("["), F.array_join(why, ", "), F.lit("]")).alias("reasons"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey - 1 FROM orders WHERE o_orderkey % 3 = 0) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')")
def c11_not_superseded(t: Tables) -> DataFrame:
    first = j.not_superseded(t.orders, t.orders.where("o_orderkey % 3 = 0").withColumn("old", F.col("o_orderkey") - 1), "o_orderkey", "old")
    return j.not_superseded(first, t.orders.where("o_orderpriority = '5-LOW'"), "o_orderkey", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT 'known' AS side, count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c12_semi_and_anti(t: Tables) -> DataFrame:
    docs, labels = t.documents.select("doc_id"), t.labels.select("doc_id")
    parts = {"known": labels.join(docs, "doc_id", "left_semi"), "orphan": labels.join(docs, "doc_id", "left_anti"), "unlabelled": docs.join(labels, "doc_id", "left_anti")}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("side"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(r"""WITH asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'alias ' || (p_partkey % 50) WHEN 2 THEN p_name || '  team' ELSE p_name || 'x' END AS name FROM part),
    known AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name), aliases AS (SELECT 'ALIAS ' || p_partkey AS alias, p_partkey AS id FROM part WHERE p_partkey < 40),
    bare AS (SELECT trim(regexp_replace(regexp_replace(lower(trim(name)), ' (team|gaming)$', ''), '\s+', ' ', 'g')) AS k, min(id) AS id FROM known GROUP BY k HAVING count(DISTINCT id) = 1)
    SELECT a.name, coalesce(e.id, l.id, b.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'alias' WHEN b.id IS NOT NULL THEN 'normal' ELSE 'none' END AS tier
    FROM asked a LEFT JOIN known e ON lower(trim(a.name)) = e.name LEFT JOIN aliases l ON lower(trim(a.name)) = lower(l.alias)
    LEFT JOIN bare b ON trim(regexp_replace(regexp_replace(lower(trim(a.name)), ' (team|gaming)$', ''), '\s+', ' ', 'g')) = b.k""")
def c13_resolve_names(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    asked = t.part.select(F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.concat(F.lit("alias "), (k % 50).cast("string"))).when(k % 4 == 2, F.concat("p_name", F.lit("  team"))).otherwise(F.concat("p_name", F.lit("x"))).alias("name"))
    known = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    aliases = t.part.where("p_partkey < 40").select(F.concat(F.lit("ALIAS "), k.cast("string")).alias("alias"), k.alias("id"))
    return j.resolve_names(asked, "name", known, aliases, " (team|gaming)$")


_grams = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr(lower({0}), i, 3)))"


@query(f"""WITH a AS (SELECT DISTINCT p_name || 's' AS name, {_grams.format("(p_name || 's')")} AS g FROM part), k AS (SELECT DISTINCT p_name AS suggestion, {_grams.format("p_name")} AS g FROM part),
    m AS (SELECT name, suggestion, len(list_intersect(a.g, k.g))::DOUBLE / (len(a.g) + len(k.g) - len(list_intersect(a.g, k.g))) AS similarity FROM a, k)
    SELECT name, suggestion, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, suggestion)::INT AS rank FROM m WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, suggestion) <= 3""")
def c13_suggest_names(t: Tables) -> DataFrame:
    asked = t.part.select(F.concat("p_name", F.lit("s")).alias("name"))
    return j.names_by_trigrams(asked, "name", t.part.select(F.col("p_name").alias("name")), 3, 0.5).select("name", "suggestion", r("similarity"), "rank")


@query("""WITH bets AS (SELECT event_id AS bet, user_id, ts AS entered, ts + INTERVAL 8 HOUR AS starts FROM events WHERE event_type = 'purchase'),
    q AS (SELECT user_id, ts AS observed, ts - to_seconds(value) AS told, value AS odds FROM events WHERE event_type = 'view'),
    best AS (SELECT b.bet, max_by((q.observed, q.told, q.odds), (q.observed, q.told, q.odds)) AS q FROM bets b JOIN q ON b.user_id = q.user_id AND q.observed > b.entered AND q.observed < b.starts GROUP BY b.bet)
    SELECT b.bet, q[1] AS observed, q[3] AS odds, coalesce(epoch_us(q[1]) - epoch_us(q[2]) <= 20000000, FALSE) AS comparable FROM bets b LEFT JOIN best USING (bet)""")
def c14_closing_quotes(t: Tables) -> DataFrame:
    bets = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("bet"), "user_id", F.col("ts").alias("entered"), F.expr("ts + INTERVAL 8 HOURS").alias("starts"))
    quotes = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("observed"), F.expr("ts - make_dt_interval(0, 0, 0, cast(value AS decimal(18,6)))").alias("told"), F.col("value").alias("odds"))
    return j.closing_quotes(bets, quotes, ["user_id"], "bet", "entered", "starts", "observed", "told", 20, ["odds"]).select("bet", "observed", "odds", "comparable")


@query()
def c13_closest_names(t: Tables) -> DataFrame:
    """Up to three known names by matching blocks for every misspelt one; held against the plain ranking in the tests."""
    k = F.col("p_partkey")
    asked = t.part.select(F.when(k % 3 == 0, F.concat(F.substring("p_name", 2, 100), F.lit("s"))).when(k % 3 == 1, F.reverse("p_name")).otherwise(F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), "p_name")).alias("name"))
    return closest_names(asked, "name", t.part.select(F.col("p_name").alias("name")))


CHAINS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey + 1 WHEN o_orderkey % 500 = 4 THEN o_orderkey - 4 END AS next FROM orders"


@query(f"""WITH RECURSIVE links AS ({CHAINS}), walk AS (SELECT id, id AS at_, 0 AS hops FROM links UNION ALL SELECT w.id, l.next, hops + 1 FROM walk w JOIN links l ON w.at_ = l.id WHERE l.next IS NOT NULL AND hops < 12)
    SELECT l.id, w.at_ AS tip, w.hops::BIGINT AS hops FROM links l LEFT JOIN (SELECT w.* FROM walk w LEFT JOIN links e ON w.at_ = e.id WHERE e.next IS NULL) w ON l.id = w.id""")
def c15_resolve_chains(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return j.resolve_chains(t.orders.select(k.alias("id"), F.when(k % 5 < 3, k + 1).when(k % 500 == 4, k - 4).alias("next")))


OWNED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey + 1 WHEN o_orderkey % 500 = 4 THEN o_orderkey - 4 END AS next, CASE WHEN o_orderkey % 35 = 8 THEN -1 ELSE o_orderkey // 5 END AS owner FROM orders"


@query(f"""WITH RECURSIVE links AS ({OWNED}), walk AS (SELECT id, owner AS mine, id AS at_, owner AS theirs, 0 AS hops, TRUE AS ok FROM links
        UNION ALL SELECT w.id, w.mine, l.next, n.owner, hops + 1, w.ok AND (n.id IS NULL OR n.owner = w.mine) FROM walk w JOIN links l ON w.at_ = l.id LEFT JOIN links n ON n.id = l.next WHERE l.next IS NOT NULL AND hops < 12),
    tips AS (SELECT w.* FROM walk w LEFT JOIN links e ON w.at_ = e.id WHERE e.next IS NULL), bad AS (SELECT id, bool_and(ok) AS ok FROM walk GROUP BY id)
    SELECT l.id, CASE WHEN b.ok THEN t.at_ END AS tip, CASE WHEN b.ok THEN t.hops::BIGINT END AS hops, CASE WHEN NOT b.ok THEN 'owner' WHEN t.id IS NULL THEN 'cycle' END AS problem FROM links l JOIN bad b ON b.id = l.id LEFT JOIN tips t ON t.id = l.id""")
def c15_owned_chains(t: Tables) -> DataFrame:
    """Corrections that lead to another owner's row are refused, and cycles."""
    k = F.col("o_orderkey")
    return j.resolve_chains(t.orders.select(k.alias("id"), F.when(k % 5 < 3, k + 1).when(k % 500 == 4, k - 4).alias("next"), F.when(k % 35 == 8, F.lit(-1)).otherwise(F.floor(k / 5)).cast("long").alias("owner")), owner="owner")


@query("""WITH targets AS (SELECT DISTINCT p_type AS target FROM part), providers AS (SELECT r_regionkey AS provider FROM region),
    acts AS (SELECT l_orderkey AS fixture, l_suppkey % 4 AS provider, p_type AS target, CASE WHEN l_returnflag = 'R' THEN 'captured' WHEN l_returnflag = 'A' THEN 'unsupported' ELSE 'failed' END AS state FROM lineitem JOIN part ON l_partkey = p_partkey),
    seen AS (SELECT fixture, provider, target, bool_or(state = 'captured') AS c, bool_and(state = 'unsupported') AS u FROM acts GROUP BY ALL)
    SELECT o_orderkey AS fixture, p.provider, t.target, CASE WHEN c THEN 'captured' WHEN u THEN 'unsupported' ELSE 'missing' END AS coverage
    FROM orders CROSS JOIN providers p CROSS JOIN targets t LEFT JOIN seen s ON s.fixture = o_orderkey AND s.provider = p.provider AND s.target = t.target""")
def c16_coverage_grid(t: Tables) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "captured").when(F.col("l_returnflag") == "A", "unsupported").otherwise("failed")
    acts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("fixture"), (F.col("l_suppkey") % 4).cast("int").alias("provider"), F.col("p_type").alias("target"), state.alias("state"))
    wanted = [t.region.select(F.col("r_regionkey").alias("provider")), t.part.select(F.col("p_type").alias("target")).distinct()]
    return j.coverage_grid(t.orders.select(F.col("o_orderkey").alias("fixture")), wanted, acts, ["fixture", "provider", "target"], "state").select("fixture", "provider", "target", "coverage")


@query("""SELECT l_orderkey AS fixture, 'conflict' AS issue, count(DISTINCT l_suppkey) AS links FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1
    UNION ALL SELECT o_orderkey, 'no link', 0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT DISTINCT l_orderkey, 'no fixture', 0 FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""")
def c17_link_conflicts(t: Tables) -> DataFrame:
    fixtures = t.orders.select(F.col("o_orderkey").alias("fixture"), (F.col("o_orderstatus") != "P").alias("open"))
    return j.link_issues(t.lineitem.select(F.col("l_orderkey").alias("fixture"), "l_suppkey"), fixtures, "l_suppkey")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS c FROM orders WHERE o_orderkey % 11 <> 0),
    b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 13 = 0 THEN 1e-3 WHEN o_orderkey % 13 = 1 THEN 1e-12 ELSE 0 END AS o_totalprice, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey::DOUBLE END AS c FROM orders WHERE o_orderkey % 19 <> 0),
    m AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'missing_left' WHEN b.o_orderkey IS NULL THEN 'missing_right' ELSE concat_ws(',', CASE WHEN NOT abs(a.o_totalprice - b.o_totalprice) <= 1e-8 THEN 'o_totalprice' END, CASE WHEN a.c IS DISTINCT FROM b.c THEN 'c' END) END AS differs
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) SELECT * FROM m WHERE differs <> ''""")
def c18_compare_tables(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("double")
    a = t.orders.where("o_orderkey % 11 <> 0").select("o_orderkey", "o_totalprice", c.alias("c"))
    b = t.orders.where("o_orderkey % 19 <> 0").select("o_orderkey", (F.col("o_totalprice") + F.when(k % 13 == 0, 1e-3).when(k % 13 == 1, 1e-12).otherwise(0.0)).alias("o_totalprice"), F.when(k % 17 != 0, c).alias("c"))
    return j.compare_tables(a, b, "o_orderkey", ["o_totalprice", "c"]).select("o_orderkey", F.array_join("differs", ",").alias("differs"))


@query(f"""{DUELS}, l AS (SELECT * FROM games), m AS (SELECT a.game, b.game AS match_id FROM l a JOIN l b ON a.league = b.league AND least(a.blue % 30, a.red % 30) = least(b.blue % 30, b.red % 30) AND greatest(a.blue % 30, a.red % 30) = greatest(b.blue % 30, b.red % 30)
    AND a.game % 2 = 0 AND b.game % 2 = 1 AND abs(epoch_us(a.played) - epoch_us(b.played)) <= 40 * 86400000000) SELECT game, min(match_id) AS match_id FROM m GROUP BY game HAVING count(*) = 1""")
def c19_unique_pair_match(t: Tables) -> DataFrame:
    g = games(t).select("game", "league", "played", (F.col("blue") % 30).alias("a"), (F.col("red") % 30).alias("b"))
    return j.unique_pair_match(g.where("game % 2 = 0"), g.where("game % 2 = 1"), "game", "league", ("a", "b"), "played", "played", 40 * 86400, "game")


@query("SELECT event_id, coalesce(name, 'other') AS name, coalesce(weight, 0) AS weight FROM events LEFT JOIN (VALUES ('click', 'Click', 1), ('view', 'View', 2), ('error', 'Error', 3)) d(event_type, name, weight) USING (event_type)")
def a6_dimension_config(t: Tables) -> DataFrame:
    """A small configuration document as a dimension, with defaults for unknown keys."""
    config = '{"click": {"name": "Click", "weight": 1}, "view": {"name": "View", "weight": 2}, "error": {"name": "Error", "weight": 3}}'
    one = t.spark.range(1).select(F.explode(F.from_json(F.lit(config), "map<string,struct<name:string,weight:int>>")).alias("event_type", "v"))
    return j.dimension_join(t.events, one.select("event_type", "v.*"), "event_type", {"name": "other", "weight": 0}).select("event_id", "name", "weight")


@query("SELECT 'events.parquet' AS file, count(*) AS rows, max(ts) AS latest, TRUE AS sized, TRUE AS dated, CASE WHEN date_diff('day', max(ts)::DATE, DATE '2024-02-25') > 20 THEN 'stale' ELSE '' END AS issues FROM events")
def a2_inspect_sources(t: Tables) -> DataFrame:
    """Files under the table's path; SQL doesn't see their sizes and times of change, so of these only that they are there."""
    found = s.inspect_sources(t.spark, f"{t.sf_dir}/events.parquet", "ts", 20, "2024-02-25")
    one = found.agg(F.sum("rows").alias("rows"), F.max("latest").alias("latest"), F.bool_and(F.col("bytes") > 0).alias("sized"), F.bool_and(F.col("modified") > F.lit("2000-01-01").cast("timestamp")).alias("dated"), F.array_join(F.array_sort(F.collect_set(F.array_join("issues", ","))), ",").alias("issues"))
    return one.select(F.lit("events.parquet").alias("file"), "rows", "latest", "sized", "dated", "issues")


def _fixture_json(t: Tables) -> DataFrame:
    g = games(t)
    name = lambda c: F.struct(F.struct(F.col(c).cast("string").alias("id"), F.concat(F.lit("Customer#"), F.col(c).cast("string")).alias("name")).alias("opponent"))
    player = lambda k: F.struct((F.col("game") * 7 % (11 + k)).cast("string").alias("id"), F.concat(F.lit("p"), F.lit(k).cast("string")).alias("name"), F.lit("mid").alias("role"))
    doc = F.struct(F.col("game").cast("string").alias("id"), F.date_format("played", "yyyy-MM-dd HH:mm:ss").alias("begin_at"), (1 + F.col("game") % 3 * 2).cast("int").alias("number_of_games"), F.array(name("blue"), name("red")).alias("opponents"), F.array(player(1), player(2)).alias("lineup"))
    return g.select(F.to_json(doc).alias("payload"))


@query(DUELS + """ SELECT game::VARCHAR AS fixture, played AS begin_at, (1 + game % 3 * 2)::INT AS best_of, 'Customer#' || blue AS team_a, 'Customer#' || red AS team_b,
    '[' || CASE WHEN (game * 7 % 12)::VARCHAR <= (game * 7 % 13)::VARCHAR THEN p1 || ',' || p2 ELSE p2 || ',' || p1 END || ']' AS lineup
    FROM (SELECT *, '{"id":"' || (game * 7 % 12) || '","name":"p1","role":"mid"}' AS p1, '{"id":"' || (game * 7 % 13) || '","name":"p2","role":"mid"}' AS p2 FROM games)""")
def a7_flatten_fixtures(t: Tables) -> DataFrame:
    return s.flatten_fixtures(_fixture_json(t))


@query("""WITH m AS (SELECT event_id, ['yes', 'no'] AS o, CASE WHEN event_id % 5 = 0 THEN ['t' || event_id] ELSE ['t' || event_id, 'u' || event_id] END AS k FROM events WHERE event_id % 7 <> 0)
    SELECT event_id::VARCHAR AS event, 'm' || event_id AS market, NULL AS failure, unnest(o) AS outcome, unnest(k) AS token FROM m WHERE event_id % 5 <> 0
    UNION ALL SELECT event_id::VARCHAR, 'm' || event_id, 'arrays differ', NULL, NULL FROM m WHERE event_id % 5 = 0 UNION ALL SELECT NULL, NULL, 'unreadable', NULL, NULL FROM events WHERE event_id % 7 = 0""")
def a8_flatten_markets(t: Tables) -> DataFrame:
    e = F.col("event_id").cast("string")
    tokens = F.when(F.col("event_id") % 5 == 0, F.array(F.concat(F.lit("t"), e))).otherwise(F.array(F.concat(F.lit("t"), e), F.concat(F.lit("u"), e)))
    doc = F.to_json(F.struct(e.alias("id"), F.array(F.struct(F.concat(F.lit("m"), e).alias("id"), F.array(F.lit("yes"), F.lit("no")).alias("outcomes"), tokens.alias("tokens"))).alias("markets")))
    return s.flatten_markets(t.events.select(F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(doc).alias("payload")))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount + 0.05 AS price, l_quantity - 1 AS size, l_tax * 10 AS ask FROM lineitem),
    l AS (SELECT *, price >= ask AS crossed FROM b)
    SELECT token, side, round(price, 6) AS price, size, CASE WHEN crossed THEN 'crossed' WHEN NOT (price > 0 AND price < 1) THEN 'price' WHEN NOT size > 0 THEN 'size' END AS issue FROM (
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS token, 'bid' AS side, price, size, crossed FROM l UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'ask', ask, size + 1, crossed FROM l)""")
def a9_flatten_books(t: Tables) -> DataFrame:
    level = lambda p, q: F.array(F.struct(p.cast("string").alias("price"), q.cast("string").alias("size")))
    token = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    doc = F.struct(token.alias("asset_id"), level(F.col("l_discount") + 0.05, F.col("l_quantity") - 1).alias("bids"), level(F.col("l_tax") * 10, F.col("l_quantity")).alias("asks"))
    return s.flatten_books(t.lineitem.select(F.to_json(doc).alias("payload"))).select("token", "side", r("price"), "size", "issue")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def a3_a4_generations(t: Tables) -> DataFrame:
    """Published as a generation and read back, checked against its pointer."""
    root = f"{s.shared_folder(t.spark)}/generations-{__import__('uuid').uuid4().hex}"
    s.publish_generation(t.orders.select("o_custkey", "o_orderkey"), root)
    s.publish_generation(t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), root)
    return s.read_generation(t.spark, root)


@query("SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS year FROM orders")
def a1_a5_yearly_csv(t: Tables) -> DataFrame:
    """Exported as one CSV folder for each year that there is, and read back by year."""
    root = f"{s.shared_folder(t.spark)}/yearly-{__import__('uuid').uuid4().hex}"
    years = [x["y"] for x in t.orders.select(F.year("o_orderdate").alias("y")).distinct().orderBy("y").collect()]
    for y in years:
        s.export(t.orders.where(F.year("o_orderdate") == y).select("o_orderkey", "o_custkey"), f"{root}/{y}.csv", "csv")
    return s.read_yearly_csv(t.spark, root, "o_orderkey long, o_custkey long", years)


@query("SELECT o_orderkey, o_custkey, o_orderpriority, 'json' AS form FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, 'parquet' FROM orders")
def a5_exports(t: Tables) -> DataFrame:
    """As JSON lines and as Parquet compressed by gzip, each read back."""
    root, rows = f"{s.shared_folder(t.spark)}/exports-{__import__('uuid').uuid4().hex}", t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    for form in ("json", "parquet"):
        s.export(rows, f"{root}/{form}", form)
    back = t.spark.read.schema(rows.schema).json(f"{root}/json").withColumn("form", F.lit("json"))
    return back.unionByName(t.spark.read.parquet(f"{root}/parquet").withColumn("form", F.lit("parquet")))
