"""Cleaning, contract and quality-gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede import keys
from antecede.functions import columns as c
from antecede.operators import quality as q
from antecede.operators.names import rewritten
from antecede.plans.duels import DUELS, duels
from antecede.plans.registry import Tables, query, r

DIRTY = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || p_brand || ' ' WHEN 1 THEN 'nan' WHEN 2 THEN 'N/A' WHEN 3 THEN 'Unknown' WHEN 4 THEN '' ELSE p_brand END AS id,
    CASE p_partkey % 5 WHEN 0 THEN 'unknown team' WHEN 1 THEN NULL WHEN 2 THEN '  TBD ' WHEN 3 THEN p_name || '   x' ELSE p_name END AS name,
    CASE p_partkey % 4 WHEN 0 THEN '1800' WHEN 1 THEN 'x' WHEN 2 THEN '90.5' END AS seconds, CASE p_partkey % 3 WHEN 0 THEN '2024-01-05 10:00:00' WHEN 1 THEN 'soon' END AS began FROM part"""


def dirty(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    id_ = F.when(k % 6 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(k % 6 == 1, "nan").when(k % 6 == 2, "N/A").when(k % 6 == 3, "Unknown").when(k % 6 == 4, "").otherwise(F.col("p_brand"))
    name = F.when(k % 5 == 0, "unknown team").when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, "  TBD ").when(k % 5 == 3, F.concat("p_name", F.lit("   x"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", id_.alias("id"), name.alias("name"), F.when(k % 4 == 0, "1800").when(k % 4 == 1, "x").when(k % 4 == 2, "90.5").alias("seconds"), F.when(k % 3 == 0, "2024-01-05 10:00:00").when(k % 3 == 1, "soon").alias("began"))


@query(f"WITH d AS ({DIRTY}) SELECT p_partkey, CASE WHEN trim(id) NOT IN ('nan', 'null', 'unknown', 'Unknown', 'N/A') THEN trim(id) END AS id, round(try_cast(seconds AS DOUBLE) / 60, 6) AS minutes, try_cast(began AS TIMESTAMP) AS began FROM d")
def b1_format(t: Tables) -> DataFrame:
    return dirty(t).select("p_partkey", c.clean_id("id").alias("id"), r(c.minutes("seconds"), name="minutes"), F.try_to_timestamp("began").alias("began"))


@query(f"WITH d AS ({DIRTY}) SELECT p_partkey, name FROM d WHERE id <> '' AND lower(coalesce(name, '')) <> 'unknown team'")
def b2_drop_unknown(t: Tables) -> DataFrame:
    return dirty(t).where((F.col("id") != "") & ~c.is_unknown("name", "team")).select("p_partkey", "name")


@query("""WITH a AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1998-01-01' THEN '2-HIGH' ELSE o_orderpriority END AS p FROM orders)
    SELECT o_orderkey, CASE WHEN p = '2-HIGH' AND o_orderdate < TIMESTAMP '1997-01-01' THEN '3-MEDIUM' ELSE p END AS priority FROM a""")
def b3_aliases(t: Tables) -> DataFrame:
    """Each alias holds until its date; a later one sees what an earlier one made."""
    df = t.orders.withColumn("priority", F.col("o_orderpriority"))
    for old, new, until in (("1-URGENT", "2-HIGH", "1998-01-01"), ("2-HIGH", "3-MEDIUM", "1997-01-01")):
        df = df.withColumn("priority", F.when((F.col("priority") == old) & (F.col("o_orderdate") < F.lit(until).cast("timestamp")), new).otherwise(F.col("priority")))
    return df.select("o_orderkey", "priority")


_five = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH RECURSIVE rules AS (SELECT n_nationkey AS nth, {_five}[n_nationkey % 5 + 1] AS old_name, (n_nationkey % 7)::VARCHAR AS old_id, {_five}[(n_nationkey * 3 + 1) % 5 + 1] AS new_name, ((n_nationkey * 5 + 2) % 7)::VARCHAR AS new_id,
        CASE WHEN n_nationkey % 6 <> 0 THEN TIMESTAMP '1994-06-01' + to_days((n_nationkey * 97 % 2500)::INT) END AS until FROM nation),
    w AS (SELECT 0 AS k, o_orderkey, o_orderdate, o_orderpriority AS name, (o_custkey % 7)::VARCHAR AS id FROM orders
        UNION ALL SELECT k + 1, o_orderkey, o_orderdate, coalesce(r.new_name, name), coalesce(r.new_id, id) FROM w LEFT JOIN rules r ON r.nth = w.k AND r.old_name = name AND r.old_id = id AND (until IS NULL OR o_orderdate < until) WHERE k < (SELECT max(nth) + 1 FROM rules))
    SELECT o_orderkey, name, id FROM w WHERE k = (SELECT max(nth) + 1 FROM rules)""")
def b3_dated_rewrites(t: Tables) -> DataFrame:
    """Names with ids, rewritten by rules in order, each until its date: composed once, looked up once."""
    n, name = F.col("n_nationkey"), F.array(*map(F.lit, _five))
    until = F.when(n % 6 != 0, F.lit("1994-06-01").cast("timestamp") + F.make_dt_interval((n * 97 % 2500).cast("int")))
    rules = t.nation.select(
        n.alias("nth"), F.element_at(name, (n % 5 + 1).cast("int")).alias("old_name"), (n % 7).cast("string").alias("old_id"),
        F.element_at(name, ((n * 3 + 1) % 5 + 1).cast("int")).alias("new_name"), ((n * 5 + 2) % 7).cast("string").alias("new_id"), until.alias("until"),
    )
    facts = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 7).cast("string").alias("id"))
    return rewritten(facts, "name", "id", "o_orderdate", rules).select("o_orderkey", "name", "id")


@query(f"WITH d AS ({DIRTY}) SELECT p_partkey, coalesce(id, name) AS identity FROM d WHERE lower(trim(coalesce(id, name))) NOT IN ('', 'nan', '<na>', 'none')")
def b4_identity(t: Tables) -> DataFrame:
    return dirty(t).select("p_partkey", c.identity("id", "name").alias("identity")).where("identity IS NOT NULL")


@query("SELECT l_orderkey AS game, l_quantity AS kills, l_tax AS share FROM lineitem WHERE lower(l_linestatus) = 'f'")
def b6_entity_split(t: Tables) -> DataFrame:
    return t.lineitem.where(F.lower("l_linestatus") == "f").select(F.col("l_orderkey").alias("game"), F.col("l_quantity").alias("kills"), F.col("l_tax").alias("share"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') OR c_mktsegment IN ('Furniture', 'HOUSEHOLD')")
def b7_allow_list(t: Tables) -> DataFrame:
    return t.customer.where(F.lower("c_mktsegment").isin("building", "machinery") | F.col("c_mktsegment").isin("Furniture", "HOUSEHOLD")).select("c_custkey")


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN 1.0 WHEN 5 THEN 0.5 END AS result FROM events""")
def b8_normal_result(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("W", "Win", "L", "False", "1", "0.5", "maybe"))), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", raw.alias("raw")).select("event_id", c.normal_result("raw").alias("result"))


_counts = " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS rows, count(*) - count({y}) AS nulls FROM o" for x, y in (("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "o_totalprice"), ("o_orderdate", "o_orderdate"), ("o_orderpriority", "o_orderpriority")))


@query(f"""WITH o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders), n AS ({_counts}),
    d(name, "use") AS (VALUES ('o_orderkey', 'required'), ('o_custkey', 'required'), ('o_clerk', 'required'), ('o_gone', 'feature'))
    SELECT coalesce(n.name, d.name) AS "column", CASE WHEN n.name IS NULL THEN 'missing' WHEN d.name IS NULL THEN 'new' ELSE 'present' END AS status, coalesce("use", 'candidate') AS "use", coalesce(rows, 0) AS rows, coalesce(nulls, 0) AS nulls,
        CASE WHEN "use" = 'required' AND n.name IS NULL THEN 'required column missing' WHEN "use" = 'required' AND nulls > 0 THEN 'required column has nulls' END AS violation FROM n FULL JOIN d ON n.name = d.name""")
def b9_b10_column_report(t: Tables) -> DataFrame:
    """The table's columns against a declared list, with their rows and nulls and what breaks the contract of required ones."""
    k = F.col("o_orderkey")
    some = t.orders.withColumns({"o_custkey": F.when(k % 9 != 0, F.col("o_custkey")), "o_orderpriority": F.when(k % 4 != 0, F.col("o_orderpriority"))})
    names = t.spark.createDataFrame([("o_orderkey", "required"), ("o_custkey", "required"), ("o_clerk", "required"), ("o_gone", "feature")], "column string, use string")
    return q.column_report(some, names)


@query("""WITH n(name) AS (SELECT DISTINCT lower(p_type) || CASE WHEN p_partkey % 3 = 0 THEN '_before' WHEN p_partkey % 3 = 1 THEN '_after' ELSE '' END FROM part),
    r(kind, pattern, role) AS (VALUES ('exact', 'small_after', 'target'), ('suffix', '_before', 'feature'), ('suffix', '_after', 'state'), ('suffix', 'e', 'odd'), ('suffix', 'small_before', 'twice'))
    SELECT name AS "column", coalesce(max(CASE WHEN kind = 'exact' AND name = pattern THEN role END), CASE WHEN count(*) FILTER (WHERE kind = 'suffix' AND ends_with(name, pattern)) = 1 THEN max(CASE WHEN kind = 'suffix' AND ends_with(name, pattern) THEN role END) END) AS role,
        CASE WHEN coalesce(max(CASE WHEN kind = 'exact' AND name = pattern THEN role END), CASE WHEN count(*) FILTER (WHERE kind = 'suffix' AND ends_with(name, pattern)) = 1 THEN 'x' END) IS NOT NULL THEN NULL
             WHEN count(*) FILTER (WHERE kind = 'suffix' AND ends_with(name, pattern)) > 1 THEN 'ambiguous' ELSE 'no rule' END AS problem FROM n CROSS JOIN r GROUP BY name""")
def b11_feature_contract(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    names = t.part.select(F.concat(F.lower("p_type"), F.when(k % 3 == 0, "_before").when(k % 3 == 1, "_after").otherwise("")).alias("column")).distinct()
    rules = t.spark.createDataFrame([("exact", "small_after", "target"), ("suffix", "_before", "feature"), ("suffix", "_after", "state"), ("suffix", "e", "odd"), ("suffix", "small_before", "twice")], "kind string, pattern string, role string")
    return q.feature_contract(names, rules)


@query("SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '\\N' ELSE o_orderpriority END)), 1, 16) AS row_id FROM orders")
def b12_row_ids(t: Tables) -> DataFrame:
    df = t.orders.withColumn("p", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return df.select("o_orderkey", keys.row_id("o_orderkey", "o_orderstatus", "p", length=16).alias("row_id"))


@query("""SELECT count(*) AS rows, sum(('0x' || substr(md5(concat_ws(chr(31), l_orderkey::VARCHAR, l_linenumber::VARCHAR, CASE WHEN l_orderkey % 7 = 0 THEN '\\N' ELSE l_returnflag END, epoch_us(l_shipdate)::VARCHAR)), 1, 15))::BIGINT)::VARCHAR AS content,
    sha256('[(0, ''l_orderkey'', ''bigint''), (1, ''l_linenumber'', ''int''), (2, ''flag'', ''string''), (3, ''shipped'', ''bigint'')]') AS schema FROM lineitem""")
def b12_table_fingerprint(t: Tables) -> DataFrame:
    """Of rows in any order, and of the schema; the tests shuffle and change rows."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("flag"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("shipped"))
    return keys.table_fingerprint(df).withColumn("schema", F.lit(keys.schema_fingerprint(df)))


@query("""WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || ('customer:' || c_custkey)::BLOB) AS h FROM customer)
    SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def b13_identity_uuid(t: Tables) -> DataFrame:
    """Version 5 UUIDs of customers; checked against Python's uuid in the tests too."""
    return t.customer.select("c_custkey", keys.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws(":", F.lit("customer"), F.col("c_custkey").cast("string"))).alias("uuid"))


@query(rf"WITH d AS ({DIRTY}) SELECT p_partkey, CASE WHEN lower(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'))) IN ('tba', 'tbd') THEN '' ELSE trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g')) END AS name FROM d")
def b15_clean_text(t: Tables) -> DataFrame:
    return dirty(t).select("p_partkey", c.clean_text("name").alias("name"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10 06:00:00' THEN 'started' WHEN ts >= TIMESTAMP '2024-01-12 06:00:00' THEN 'beyond horizon' END AS excluded FROM events")
def b16_horizon(t: Tables) -> DataFrame:
    return q.split_horizon(t.events, "ts", "2024-01-10 06:00:00", 48).select("event_id", "excluded")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_extendedprice / nullif(abs(l_discount), 0), 3) AS ratio, round(l_quantity / 32, 6) AS per_minute,
    round(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + l_tax ELSE (l_quantity + l_tax) / (l_linenumber % 3) END, 6) AS kda FROM lineitem""")
def b17_b18_ratios(t: Tables) -> DataFrame:
    df = t.lineitem
    deaths = F.col("l_linenumber") % 3
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r(c.safe_ratio(F.col("l_extendedprice"), F.col("l_discount")), 3, "ratio"), r(F.col("l_quantity") / 32, name="per_minute"), r(c.kda(F.col("l_quantity"), deaths, F.col("l_tax")), name="kda"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 10 THEN l_quantity END AS a, CASE WHEN l_tax > 0.02 THEN l_tax END AS b, CASE WHEN l_discount > 0.03 THEN l_discount END AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0), 6) AS epics, round(coalesce(a, 0) / nullif(abs(coalesce(a, 0) + coalesce(b, 0)), 0), 6) AS share, round(a * d, 6) AS first_to_win FROM x""")
def b19_control(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *(F.when(F.col(n) > k, F.col(n)).alias(a) for a, n, k in (("a", "l_quantity", 10), ("b", "l_tax", 0.02), ("d", "l_discount", 0.03))))
    share = c.safe_ratio(F.coalesce("a", F.lit(0.0)), c.row_sum(F.col("a"), F.col("b")))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", r(c.row_sum(F.col("a"), F.col("b"), F.col("d")), name="epics"), r(share, name="share"), r(F.col("a") * F.col("d"), name="first_to_win"))


@query("SELECT o_orderkey, round(m15 - m10, 4) AS growth_m10_m15, round(m20 - m15, 4) AS growth_m15_m20 FROM (SELECT o_orderkey, o_totalprice AS m10, o_totalprice * 1.5 AS m15, o_totalprice * 1.5 + o_custkey AS m20 FROM orders)")
def b20_growth(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    df = t.orders.select("o_orderkey", p.alias("m10"), (p * 1.5).alias("m15"), (p * 1.5 + F.col("o_custkey")).alias("m20"))
    return df.select("o_orderkey", *(r(x, 4, n) for n, x in c.growth([("m10", "m15"), ("m15", "m20")]).items()))


@query(f"""{DUELS}, x AS (SELECT game, side, CASE WHEN game % 5 <> 0 THEN kills - 600000 END AS lead, CASE WHEN game % 7 <> 0 THEN result END AS won FROM duels)
    SELECT game, side, coalesce(lead > 0 AND won = 1, FALSE)::INT AS ahead_won, coalesce(lead > 0 AND won = 0, FALSE)::INT AS ahead_lost, coalesce(lead < 0 AND won = 1, FALSE)::INT AS behind_won, coalesce(lead < 0 AND won = 0, FALSE)::INT AS behind_lost FROM x""")
def b21_lead_flags(t: Tables) -> DataFrame:
    x = duels(t).select("game", "side", F.when(F.col("game") % 5 != 0, F.col("kills") - 600000).alias("lead"), F.when(F.col("game") % 7 != 0, F.col("result")).alias("won"))
    return x.select("game", "side", *(f.alias(n) for n, f in c.lead_flags(F.col("lead"), F.col("won")).items()))


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS best_of, (o_orderkey % 5 + 1 = substr(o_orderpriority, 1, 1)::INT)::INT AS deciding FROM orders")
def b22_series_context(t: Tables) -> DataFrame:
    b = c.best_of(t.orders, ["series", "o_orderpriority", "o_orderstatus"])
    return t.orders.select("o_orderkey", b.alias("best_of"), (F.col("o_orderkey") % 5 + 1 == b).cast("int").alias("deciding"))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING, (c_mktsegment = 'MACHINERY')::INT AS c_mktsegment_MACHINERY FROM customer")
def b23_one_hot(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", *(x.alias(n) for n, x in c.one_hot("c_mktsegment", ["BUILDING", "MACHINERY"]).items()))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, unnest([CASE WHEN l_quantity > 10 THEN l_quantity / 50 END, CASE WHEN l_tax > 0.02 THEN l_tax / 0.08 END, CASE WHEN l_discount > 0.03 THEN l_discount / 0.1 END]) AS v, row_number() OVER () AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(avg(v), 6) AS uncertainty, round(coalesce(stddev_samp(v), 0), 6) AS disagreement FROM x GROUP BY i, l_orderkey, l_linenumber, l_partkey, l_quantity""")
def b24_b25_consensus(t: Tables) -> DataFrame:
    parts = [F.when(F.col(n) > k, F.col(n) / m) for n, k, m in (("l_quantity", 10, 50), ("l_tax", 0.02, 0.08), ("l_discount", 0.03, 0.1))]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r(c.row_mean(*parts), name="uncertainty"), r(c.row_std(*parts), name="disagreement"))


def _checks() -> dict:
    return {
        "row count": F.count("*") < 3, "line set": ~F.array_contains(F.collect_set("l_linenumber"), 1), "suppliers": F.count_distinct("l_suppkey") != F.count("*"), "quantity": F.sum("l_quantity") > 150, "returned": F.bool_or(F.col("l_returnflag") == "R")
    }


_issues = """list_filter([CASE WHEN count(*) < 3 THEN 'row count' END, CASE WHEN NOT bool_or(l_linenumber = 1) THEN 'line set' END, CASE WHEN count(DISTINCT l_suppkey) <> count(*) THEN 'suppliers' END, CASE WHEN sum(l_quantity) > 150 THEN 'quantity' END, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT l_orderkey, array_to_string({_issues}, ',') AS issues FROM lineitem GROUP BY l_orderkey")
def d4_group_issues(t: Tables) -> DataFrame:
    return q.group_issues(t.lineitem, "l_orderkey", _checks()).select("l_orderkey", F.array_join("issues", ",").alias("issues"))


@query(f"WITH g AS (SELECT l_orderkey, len({_issues}) AS n FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN n = 0 THEN 'accepted' ELSE 'quarantined' END AS part, count(*) AS rows, count(DISTINCT l.l_orderkey) AS groups, round(sum(l_extendedprice), 2) AS price FROM lineitem l JOIN g USING (l_orderkey) GROUP BY 1")
def d5_quarantine(t: Tables) -> DataFrame:
    marked = q.marked_rows(t.lineitem, "l_orderkey", _checks())
    part = F.when(F.size("issues") == 0, "accepted").otherwise("quarantined")
    groups = marked.groupBy("l_orderkey", part.alias("part")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("p"))
    return groups.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), r(F.sum("p"), 2, "price"))


@query(f"WITH g AS (SELECT len({_issues}) AS n FROM lineitem GROUP BY l_orderkey), d AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem) SELECT (SELECT count(*) FROM d) AS input_rows, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates, (SELECT count(*) FROM g WHERE n = 0) AS accepted, (SELECT count(*) FROM g WHERE n > 0) AS quarantined, 0::BIGINT AS null_l_quantity")
def d3_d5_quality_report(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return q.quality_report(df, "l_orderkey", _checks()).select("input_rows", "duplicates", "accepted", "quarantined", "null_l_quantity")


@query(f"SELECT l_orderkey, array_to_string({_issues}, ',') AS issues FROM lineitem GROUP BY l_orderkey HAVING len({_issues}) > 0 ORDER BY l_orderkey LIMIT 5")
def d6_f2_failing_groups(t: Tables) -> DataFrame:
    """A bounded sample of offenders, which is the feature."""
    return q.group_issues(t.lineitem, "l_orderkey", _checks()).where("size(issues) > 0").orderBy("l_orderkey").limit(5).select("l_orderkey", F.array_join("issues", ",").alias("issues"))


_broken = """x AS (SELECT game, side, entity, kills, CASE WHEN game % 50 = 0 THEN 1 ELSE result END AS result, CASE WHEN game % 35 = 0 AND side = 'Red' THEN price + 1 ELSE price END AS target, (game % 5 + CASE WHEN game % 45 = 0 AND side = 'Red' THEN 4 ELSE 5 END - game % 5)::INT AS roles FROM duels WHERE NOT (game % 40 = 0 AND side = 'Red'))"""


@query(f"""{DUELS}, {_broken}, g AS (SELECT game, concat_ws(',', CASE WHEN count(*) <> 2 OR count(DISTINCT side) <> 2 THEN 'two sides' END, CASE WHEN sum(result) <> 1 THEN 'one winner' END, CASE WHEN min(target) <> max(target) THEN 'targets agree' END, CASE WHEN bool_or(roles <> 5) THEN 'five roles' END) AS issues FROM x GROUP BY game)
    SELECT issues, count(*) AS games, min(game) AS first FROM g WHERE issues <> '' GROUP BY issues""")
def d6_training_assertions(t: Tables) -> DataFrame:
    """What a training table must hold: two sides, one winner, the same target on both, five roles a side."""
    g = F.col("game")
    x = duels(t).where(~((g % 40 == 0) & (F.col("side") == "Red"))).withColumns({"result": F.when(g % 50 == 0, 1).otherwise(F.col("result")), "target": F.when((g % 35 == 0) & (F.col("side") == "Red"), F.col("price") + 1).otherwise(F.col("price")), "roles": F.when((g % 45 == 0) & (F.col("side") == "Red"), 4).otherwise(5)})
    issues = q.training_issues(x, "game", "side", "result", ["target"], "roles")
    return issues.where("size(issues) > 0").groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("games"), F.min("game").alias("first"))


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT (l_returnflag, l_linestatus)) AS versions FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def d7_conflicts(t: Tables) -> DataFrame:
    return q.conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])
