"""Evaluation and split queries. Forecasts are bound to `labels` and `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.operators import evaluation as e, splits as s
from antecede.operators.resampling import group_quantiles
from antecede.plans.duels import DUELS, duels
from antecede.plans.registry import Tables, cdf_sql, query, r

#: y, p and cohorts of labels; y, p, week and residual of events.
LABELLED = "WITH f AS (SELECT doc_id, quality AS y, toxic, ((doc_id * 37) % 101 + 0.5) / 102 AS p, lang, source, length(text) AS n FROM labels JOIN documents USING (doc_id))"
EVENTS = "WITH f AS (SELECT event_id, user_id, ts, event_type, (event_type IN ('purchase', 'view'))::INT AS y, ((event_id * 37) % 101 + 0.5) / 102 AS p, value FROM events)"


def labelled(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", F.char_length("text").alias("n"))
    return t.labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", (((F.col("doc_id") * 37) % 101 + 0.5) / 102).alias("p"), "lang", "source", "n")


def forecasts(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", "event_type", F.col("event_type").isin("purchase", "view").cast("int").alias("y"), (((F.col("event_id") * 37) % 101 + 0.5) / 102).alias("p"), "value")


def _quality(by: str, bins: str, q: str, eps: str, source: str = "f") -> str:
    ll = f"-(y * ln(greatest(least({q}, 1 - {eps}), {eps})) + (1 - y) * ln(1 - greatest(least({q}, 1 - {eps}), {eps})))"
    b = f"{by}, " if by else ""
    return f"""SELECT {b}sum(n)::BIGINT AS n, round(sum(ll) / sum(n), 6) AS log_loss, round(sum(br) / sum(n), 6) AS brier, round(sum(abs(sy - sp)) / sum(n), 6) AS ece
    FROM (SELECT {b}{bins} AS bin, count(*) AS n, sum(y) AS sy, sum({q}) AS sp, sum({ll}) AS ll, sum(({q} - y) * ({q} - y)) AS br FROM {source} GROUP BY ALL) GROUP BY ALL"""


LOW = "least(floor(p * 10), 9)"


def scores(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "n", r("log_loss"), r("brier"), r("ece"))


@query(f"{EVENTS} {_quality('event_type', LOW, 'p', '1e-12')}")
def d12_prediction_quality(t: Tables) -> DataFrame:
    return scores(e.prediction_quality(forecasts(t), "y", "p", ["event_type"]), "event_type")


@query(f"{LABELLED} {_quality('', 'greatest(least(ceil(greatest(least(p, 1 - 1e-6), 1e-6) * 10) - 1, 9), 0)', 'greatest(least(p, 1 - 1e-6), 1e-6)', '1e-6')}")
def d13_upper_closed_ece(t: Tables) -> DataFrame:
    return scores(e.prediction_quality(labelled(t), "y", "p", closed="upper", eps=1e-6))


@query()
def d14_calibration_line(t: Tables) -> DataFrame:
    """Fitted by iteration; held against a closed case in the tests."""
    return e.calibration_line(forecasts(t), "y", "p")


@query(f"""{EVENTS}, q AS (SELECT list_distinct(quantile_cont(p, [{', '.join(f'{k}::DOUBLE / 15' for k in range(16))}])) AS edges FROM f) SELECT greatest(len(list_filter(edges, lambda x: x < p)), 1)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM f CROSS JOIN q GROUP BY 1""")
def d15_reliability(t: Tables) -> DataFrame:
    return e.reliability(forecasts(t), "y", "p").select("bin", "n", r("mean_p"), r("mean_y"))


_auc = "(SELECT sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0 FROM (SELECT y, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS rk FROM f)) / ((SELECT count(*) FROM f WHERE y = 1)::DOUBLE * (SELECT count(*) FROM f WHERE y = 0))"


@query(f"""{EVENTS}, k AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn,
    avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, avg((p - y) * (p - y)) AS br FROM f)
    SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(ll, 6) AS log_loss, round(br, 6) AS brier, round({_auc.format('p')}, 6) AS auc FROM k""")
def d16_classification(t: Tables) -> DataFrame:
    out = e.classification_metrics(forecasts(t), "y", "p")
    return out.select("tp", "fp", "tn", "fn", *(r(c) for c in ("accuracy", "precision", "recall", "f1", "log_loss", "brier", "auc")))


@query(f"""{DUELS}, f AS (SELECT game, CASE WHEN game % 23 = 0 THEN 1 WHEN game % 29 = 0 THEN 0 ELSE result END AS y, (entity % 89 + CASE WHEN side = 'Blue' THEN 0.5 ELSE 0.25 END) / 90 AS p FROM duels),
    g AS (SELECT game, sum(y) AS won, max_by(y, p) AS picked, sum(CASE WHEN y = 1 THEN p END) / sum(p) AS share FROM f GROUP BY game HAVING count(*) = 2)
    SELECT count(*) FILTER (WHERE won = 1) AS games, round(avg(CASE WHEN won = 1 THEN picked END), 6) AS accuracy, round(avg(CASE WHEN won = 1 THEN -ln(share) END), 6) AS log_loss, count(*) FILTER (WHERE won = 2) AS both_won, count(*) FILTER (WHERE won = 0) AS both_lost FROM g""")
def d17_pairwise(t: Tables) -> DataFrame:
    f = duels(t).select("game", F.when(F.col("game") % 23 == 0, 1).when(F.col("game") % 29 == 0, 0).otherwise(F.col("result")).alias("y"), ((F.col("entity") % 89 + F.when(F.col("side") == "Blue", 0.5).otherwise(0.25)) / 90).alias("p"))
    return e.pairwise_metrics(f, "game", "y", "p").select("games", r("accuracy"), r("log_loss"), "both_won", "both_lost")


_res = ", ".join(f"round(quantile_cont(d, {q}), 4) AS q{round(100 * q):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))


@query(f"SELECT n, round(mae, 4) AS mae, round(mse, 2) AS mse, round(sqrt(mse), 4) AS rmse, round(1 - mse / v, 6) AS r2, round(bias, 4) AS bias, round(sigma, 4) AS sigma, q01, q05, q25, q50, q75, q95, q99 FROM (SELECT count(*) AS n, avg(abs(d)) AS mae, avg(d * d) AS mse, var_pop(value) AS v, avg(d) AS bias, stddev_samp(d) AS sigma, {_res} FROM (SELECT value, value - (event_id % 60) AS d FROM events))")
def d18_regression(t: Tables) -> DataFrame:
    out = e.regression_metrics(t.events.withColumn("guess", F.col("event_id") % 60), "value", "guess")
    return out.select("n", r("mae", 4), r("mse", 2), r("rmse", 4), r("r2"), r("bias", 4), r("sigma", 4), *(r(f"q{k}", 4) for k in ("01", "05", "25", "50", "75", "95", "99")))


@query(f"{LABELLED}, c AS (SELECT f.*, unnest(['lang', 'source', 'toxic']) AS cohort, unnest([lang, source, toxic::VARCHAR]) AS level FROM f) {_quality('cohort, level', LOW, 'p', '1e-12', 'c')}")
def d19_cohorts(t: Tables) -> DataFrame:
    return scores(e.prediction_quality(e.by_cohort(labelled(t), ["lang", "source", "toxic"]), "y", "p", ["cohort", "level"]), "cohort", "level")


@query(f"{EVENTS}, c AS (SELECT f.*, unnest(list_filter(['all', CASE WHEN p BETWEEN 0.4 AND 0.6 THEN 'close' END, CASE WHEN event_type = 'view' THEN 'type:view' END, CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS cohort FROM f) {_quality('cohort', LOW, 'p', '1e-12', 'c')}")
def d20_named_cohorts(t: Tables) -> DataFrame:
    tests = {"all": F.lit(True), "close": F.col("p").between(0.4, 0.6), "type:view": F.col("event_type") == "view", "even": F.col("user_id") % 2 == 0}
    return scores(e.prediction_quality(e.named_cohorts(forecasts(t), tests), "y", "p", ["cohort"]), "cohort")


@query("""WITH o AS (SELECT event_id, unnest(range(4)) AS k, event_id % 4 AS actual FROM events), w AS (SELECT *, (1 + (event_id * (k + 1)) % 7) AS w FROM o), p AS (SELECT *, w / sum(w) OVER (PARTITION BY event_id) AS p FROM w)
    SELECT event_id, round(-ln(sum(CASE WHEN k = actual THEN p ELSE 0 END)), 6) AS log_loss, round(sum(pow(p - (k = actual)::INT, 2)), 6) AS brier, (arg_max(k, (p, -k)) = any_value(actual))::INT AS hit FROM p GROUP BY event_id""")
def d21_distribution_scores(t: Tables) -> DataFrame:
    o = t.events.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), (F.col("event_id") % 4).alias("actual")).withColumn("w", 1 + (F.col("event_id") * (F.col("k") + 1)) % 7)
    total = o.groupBy("event_id").agg(F.sum("w").alias("s"))
    p = o.join(total, "event_id").withColumn("p", F.col("w") / F.col("s"))
    return e.distribution_scores(p, "event_id", "k", "p", "actual").select("event_id", r("log_loss"), r("brier"), "hit")


@query(f"{EVENTS} SELECT date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS n, round(avg((p >= 0.5)::INT = y), 6) AS accuracy FROM f GROUP BY 1".replace("avg((p >= 0.5)::INT = y)", "avg(((p >= 0.5)::INT = y)::INT)"))
def d22_weekly(t: Tables) -> DataFrame:
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    return e.weekly(forecasts(t), "ts", hit, "accuracy").select("week", "n", r("accuracy"))


BOUNDS = EVENTS + """, b AS (SELECT unnest([-1, least(floor(p * 5), 4)::INT]) AS bin, isoyear(ts) || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS week, y - p AS d FROM f),
    w AS (SELECT bin, week, avg(d) AS m, count(*) AS n FROM b GROUP BY ALL), bounds AS (SELECT bin, sum(n)::BIGINT AS n_rows, count(*) AS n_weeks, least(quantile_cont(m, 0.1), 0) AS lower, greatest(quantile_cont(m, 0.9), 0) AS upper FROM w GROUP BY bin HAVING sum(n) >= 20 AND count(*) >= 3)"""


def bounds(t: Tables) -> DataFrame:
    return e.week_block_bounds(forecasts(t).withColumn("d", F.col("y") - F.col("p")), "ts", "d", "p")


@query(f"{BOUNDS} SELECT bin, n_rows, n_weeks, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds")
def d23_week_bounds(t: Tables) -> DataFrame:
    return bounds(t).select("bin", "n_rows", "n_weeks", r("lower"), r("upper"))


_applied = f"{BOUNDS}, x AS (SELECT f.*, coalesce(b.lower, a.lower) AS lo, coalesce(b.upper, a.upper) AS up FROM f LEFT JOIN bounds b ON b.bin = least(floor(p * 5), 4) LEFT JOIN bounds a ON a.bin = -1), y AS (SELECT *, greatest(least(p + lo, 1), 0) AS lower, greatest(least(p + up, 1), 0) AS upper FROM x)"


@query(f"{_applied} SELECT event_id, round(lower, 6) AS lower, round(upper, 6) AS upper FROM y")
def d24_apply_bounds(t: Tables) -> DataFrame:
    return e.apply_bounds(forecasts(t), "p", bounds(t)).select("event_id", r("lower"), r("upper"))


@query(f"""{_applied}, wk AS (SELECT event_type, isoyear(ts) || '-' || weekofyear(ts) AS week, count(*) AS n, avg(y) AS seen, avg(lower) AS bound FROM y GROUP BY ALL)
    SELECT event_type, sum(n)::BIGINT AS n_rows, count(*) AS n_weeks, round(avg((seen >= bound)::INT), 6) AS coverage, sum(n) >= 30 AND count(*) >= 4 AS eligible, sum(n) >= 30 AND count(*) >= 4 AND avg((seen >= bound)::INT) >= 0.8 AS passed FROM wk GROUP BY event_type""")
def d25_coverage(t: Tables) -> DataFrame:
    return e.conservative_coverage(e.apply_bounds(forecasts(t), "p", bounds(t)), "event_type", "ts", "y", "lower").withColumn("coverage", r("coverage"))


_F = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def d38_feature_report(t: Tables) -> DataFrame:
    """Correlations by pairs of column blocks; held against numpy in the tests."""
    df = t.lineitem.withColumn("twin", F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 2 + 1))
    return e.feature_report(df, [*_F, "twin"], {"l_quantity": 5.0, "l_tax": 1.0, "twin": 4.0, "l_discount": 2.0, "l_extendedprice": 3.0})


@query("""WITH i AS (SELECT p_type || p_brand AS feature, sum(p_retailprice) AS importance FROM part GROUP BY 1), x AS (SELECT *, coalesce(sum(importance) OVER (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(importance) OVER () AS run, row_number() OVER (ORDER BY importance DESC, feature) AS k FROM i)
    SELECT feature, round(importance, 3) AS importance, importance > 12000 AS over_threshold, run < 0.6 OR k <= 15 AS in_share FROM x""")
def d39_select_features(t: Tables) -> DataFrame:
    i = t.part.groupBy(F.concat("p_type", "p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return e.select_features(i, 12000, 0.6).withColumn("importance", r("importance", 3))


_dead = " UNION ALL ".join(f"SELECT '{x}' AS \"column\", CASE WHEN avg(({x} IS NULL)::INT) > 0.5 THEN 'missing' WHEN coalesce(min({x}) = max({x}), TRUE) THEN 'constant' END AS problem FROM d" for x in ("l_quantity", "l_tax", "gone", "same"))


@query(f"WITH d AS (SELECT l_quantity, l_tax, CASE WHEN l_linenumber > 5 THEN l_quantity END AS gone, CASE WHEN l_linenumber > 1 THEN 'x' END AS same FROM lineitem) SELECT * FROM ({_dead}) WHERE problem IS NOT NULL")
def d40_dead_columns(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_quantity", "l_tax", F.when(F.col("l_linenumber") > 5, F.col("l_quantity")).alias("gone"), F.when(F.col("l_linenumber") > 1, F.lit("x")).alias("same"))
    return e.dead_columns(df, 0.5)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round((SELECT sum(CASE WHEN y THEN rk END) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0 FROM (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk FROM lineitem)) / ((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')::DOUBLE * (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R')), 6) AS auc" for c in _F))
def d41_leak_probes(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return e.leak_probes(df, "y", _F).select("feature", r("auc"))


@query("SELECT l_orderkey, count(*) AS n, min((l_returnflag = 'R')::INT) AS only FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2 AND min((l_returnflag = 'R')::INT) = max((l_returnflag = 'R')::INT)")
def d41_pure_levels(t: Tables) -> DataFrame:
    return e.pure_levels(t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "y", "l_orderkey")


_drawn = " + ".join(f"(u >= {c}::DOUBLE)::INT" for c in e.POISSON)


@query(f"""WITH c AS (SELECT l_suppkey AS c, sum(l_extendedprice * l_discount) AS a, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1), d AS (SELECT *, (('0x' || substr(md5('7:' || sample || ':' || c), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u FROM c CROSS JOIN range(0, 200) s(sample)),
    r AS (SELECT sample, sum(a * ({_drawn})) / sum(b * ({_drawn})) AS ratio FROM d GROUP BY sample) SELECT round((SELECT sum(a) / sum(b) FROM c), 6) AS estimate, round(quantile_cont(ratio, 0.05), 6) AS lower, round(quantile_cont(ratio, 0.95), 6) AS upper FROM r""")
def d42_bootstrap_ratio(t: Tables) -> DataFrame:
    """Its interval is tested against its normal form too."""
    out = e.bootstrap_ratio(t.lineitem.withColumn("pnl", F.col("l_extendedprice") * F.col("l_discount")), "pnl", "l_extendedprice", "l_suppkey", 200)
    return out.select(r("estimate"), r("lower"), r("upper"))


@query(f"""{EVENTS}, x AS (SELECT event_type, user_id, -(y * ln(p) + (1 - y) * ln(1 - p)) AS a, -(y * ln(0.4::DOUBLE) + (1 - y) * ln(0.6::DOUBLE)) AS b FROM f), c AS (SELECT event_type, user_id, sum(a - b) AS d, count(*) AS n FROM x GROUP BY ALL),
    w AS (SELECT *, (('0x' || substr(md5('7:' || sample || ':' || user_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u FROM c CROSS JOIN range(0, 100) s(sample)), q AS (SELECT event_type, sample, sum(d * ({_drawn})) / sum(n * ({_drawn})) AS ratio FROM w GROUP BY ALL),
    m AS (SELECT event_type, avg(a - b) AS d, avg(b) AS base FROM x GROUP BY 1) SELECT event_type, round(d / base, 6) AS delta, round(up / base, 6) AS upper FROM m JOIN (SELECT event_type, quantile_cont(ratio, 0.99) AS up FROM q GROUP BY 1) USING (event_type)""")
def d43_paired_bootstrap(t: Tables) -> DataFrame:
    """By cohort, relative to a baseline's loss; five cohorts share the error."""
    f = forecasts(t).withColumns({"a": e.log_loss(F.col("y"), F.col("p")), "b": e.log_loss(F.col("y"), F.lit(0.4))})
    return e.paired_bootstrap(f, "event_type", "user_id", "a", "b", 100, 0.95).select("event_type", r("delta"), r("upper"))


@query(f"{EVENTS}, m AS ({_quality('event_type', LOW, 'p', '1e-12')}) SELECT event_type, concat_ws(',', CASE WHEN n < 2000 THEN 'rows' END, CASE WHEN brier > 0.333 THEN 'brier' END, CASE WHEN ece > 0.26 THEN 'ece' END) AS failed, CASE WHEN n >= 2000 AND NOT brier > 0.333 AND NOT ece > 0.26 THEN 'promote' ELSE 'hold' END AS decision FROM m")
def d44_gate(t: Tables) -> DataFrame:
    m = e.prediction_quality(forecasts(t), "y", "p", ["event_type"])
    return e.gate(m, {"rows": F.col("n") < 2000, "brier": F.round("brier", 6) > 0.333, "ece": F.round("ece", 6) > 0.26}).select("event_type", F.array_join("failed", ",").alias("failed"), "decision")


@query("SELECT user_id, count(*) AS n, round(avg(value - event_id % 60), 6) AS bias, round(var_samp(value - event_id % 60), 4) AS variance, round(quantile_cont(value - event_id % 60, 0.9), 6) AS q90 FROM events GROUP BY user_id HAVING count(*) >= 60")
def d45_residuals_by_cohort(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", (F.col("value") - F.col("event_id") % 60).alias("d"))
    facts = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("d").alias("bias"), F.var_samp("d").alias("variance")).where("n >= 60")
    return facts.join(group_quantiles(rows, ["user_id"], "d", [0.9]), "user_id").select("user_id", "n", r("bias"), r("variance", 4), r(F.col("q")[0], name="q90"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, [round(x + 1e-9, 4) FOR x IN quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])]::VARCHAR AS prices FROM lineitem GROUP BY ALL")
def d45_quantiles_by_group(t: Tables) -> DataFrame:
    """Few groups of very many rows: narrowed in rounds, a twentieth of the table at most put in order at once."""
    q = group_quantiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0], most=max(1, t.lineitem.count() // 20))
    made = F.transform("q", lambda x: F.round(x + 1e-9, 4).cast("string"))
    return q.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.concat(F.lit("["), F.array_join(made, ", "), F.lit("]")).alias("prices"))


@query()
def d42_exact_bootstrap(t: Tables) -> DataFrame:
    """Exactly as many orders as there are in each sample; held against a plain resampler in the tests."""
    rows = t.lineitem.withColumn("pnl", F.col("l_extendedprice") * F.col("l_discount"))
    return e.bootstrap_ratio(rows, "pnl", "l_extendedprice", "l_orderkey", 200, draws="exact")


@query()
def d43_exact_paired_bootstrap(t: Tables) -> DataFrame:
    f = forecasts(t).withColumns({"a": e.log_loss(F.col("y"), F.col("p")), "b": e.log_loss(F.col("y"), F.lit(0.4))})
    return e.paired_bootstrap(f, "event_type", "user_id", "a", "b", 100, 0.95, draws="exact")


@query("""WITH c AS (SELECT user_id AS cohort, min(ts) AS enrolled, date_trunc('week', min(ts)) AS week FROM events GROUP BY user_id), e AS (SELECT event_id, user_id AS cohort, event_id + (event_id % 50 = 0)::INT * 10000000 AS fixture, ts FROM events WHERE event_type = 'signup')
    SELECT e.event_id, concat_ws(',', CASE WHEN f.event_id IS NULL THEN 'no fixture' END, CASE WHEN date_trunc('week', e.ts) <> c.week THEN 'other week' END, CASE WHEN e.ts <= c.enrolled THEN 'before enrolment' END, CASE WHEN x.n > 0 THEN 'earlier evidence' END) AS problems
    FROM e JOIN c ON e.cohort = c.cohort LEFT JOIN events f ON f.event_id = e.fixture LEFT JOIN (SELECT a.event_id, count(*) AS n FROM e a JOIN events b ON a.cohort = b.user_id AND b.event_type = 'error' AND b.ts < a.ts GROUP BY a.event_id) x ON x.event_id = e.event_id""")
def d48_cohort_enrolment(t: Tables) -> DataFrame:
    from antecede.operators.joins import reasons

    ev = t.events
    cohorts = ev.groupBy(F.col("user_id").alias("cohort")).agg(F.min("ts").alias("enrolled"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("evidence"))
    enrolled = ev.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("cohort"), F.when(F.col("event_id") % 50 == 0, F.col("event_id") + 10_000_000).otherwise(F.col("event_id")).alias("fixture"), "ts")
    x = enrolled.join(cohorts, "cohort").join(ev.select(F.col("event_id").alias("fixture"), F.lit(True).alias("known")), "fixture", "left")
    why = reasons({"no fixture": F.col("known").isNull(), "other week": F.date_trunc("week", "ts") != F.date_trunc("week", "enrolled"), "before enrolment": F.col("ts") <= F.col("enrolled"), "earlier evidence": F.col("evidence") < F.col("ts")})
    return x.select(F.col("id").alias("event_id"), F.array_join(why, ",").alias("problems"))


PARTS = {"train": 0.7, "calibrate": 0.1, "select": 0.05, "test": 0.15}


@query("""WITH d AS (SELECT DISTINCT o_orderdate FROM orders), k AS (SELECT *, row_number() OVER (ORDER BY o_orderdate) - 1 AS k, count(*) OVER () AS n FROM d)
    SELECT o_orderkey, CASE WHEN k < floor(n * 0.7::DOUBLE + 1e-9) THEN 'train' WHEN k < floor(n * (0.7::DOUBLE + 0.1::DOUBLE) + 1e-9) THEN 'calibrate' WHEN k < floor(n * (0.7::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE) + 1e-9) THEN 'select' ELSE 'test' END AS split FROM orders JOIN k USING (o_orderdate)""")
def j1_temporal_split(t: Tables) -> DataFrame:
    return s.temporal_split(t.orders, "o_orderdate", PARTS).select("o_orderkey", "split")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) <= round(count(*) OVER (PARTITION BY c_mktsegment) * 0.2) THEN 'test' ELSE 'train' END AS split FROM customer")
def j2_stratified_split(t: Tables) -> DataFrame:
    return s.stratified_split(t.customer, "c_custkey", ["c_mktsegment"], 0.2).select("c_custkey", "c_mktsegment", "split")


@query("""WITH x AS (SELECT o_custkey AS g, o_orderdate AS at_, CASE WHEN year(o_orderdate) < 1998 THEN 'a' WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'c' END AS split FROM orders), n AS (SELECT split, min(at_) AS lo, max(at_) AS hi FROM x GROUP BY split), l AS (SELECT *, lag(hi) OVER (ORDER BY lo, split) AS prev FROM n)
    SELECT 'shared group' AS kind, g::VARCHAR AS what FROM x GROUP BY g HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'overlap', split FROM l WHERE prev >= lo""")
def j3_split_problems(t: Tables) -> DataFrame:
    x = t.orders.withColumn("split", F.when(F.year("o_orderdate") < 1998, "a").when(F.col("o_orderkey") % 2 == 0, "b").otherwise("c"))
    return s.split_problems(x, "split", "o_custkey", "o_orderdate")


_week = "isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0')"


@query(f"WITH w AS (SELECT w, ntile(4) OVER (ORDER BY w) AS block FROM (SELECT DISTINCT {_week} AS w FROM orders)) SELECT o_orderkey, block::INT AS block FROM orders JOIN w ON w = {_week}")
def j4_rolling_folds(t: Tables) -> DataFrame:
    return s.rolling_folds(t.orders, "o_orderdate", 4).select("o_orderkey", "block")


@query("WITH w AS (SELECT w, ntile(6) OVER (ORDER BY w) AS block FROM (SELECT DISTINCT ts AS w FROM events)) SELECT event_id, block::INT AS block FROM events JOIN w ON w = ts")
def j4_timestamp_folds(t: Tables) -> DataFrame:
    """Six blocks of unique times, numbered in two levels."""
    return s.rolling_folds(t.events, "ts", 6, by_week=False).select("event_id", "block")


@query()
def j5_oof_logistic(t: Tables) -> DataFrame:
    """Out-of-fold probabilities; the tests check that no fold sees its own time."""
    df = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", F.col("o_custkey").cast("double").alias("c"), (F.col("o_totalprice") > 200000).cast("double").alias("y"))
    return s.oof_logistic(df, "o_orderkey", "o_orderdate", ["o_totalprice", "c"], "y")


CLOSE = "SELECT event_id, ((event_id * 37) % 101 + 0.5) / 102 AS p, ts - INTERVAL 2 HOUR AS cutoff, ts - to_minutes((event_id % 200)::INT) AS made, ts - to_minutes((event_id % 3)::INT) AS starts FROM events"


@query(f"WITH c AS ({CLOSE}) SELECT event_id, CASE WHEN NOT (cutoff < made AND made <= starts) THEN 'violation' ELSE 'close' END AS kind FROM c WHERE NOT (cutoff < made AND made <= starts) OR greatest(p, 1 - p) <= 0.6")
def j6_close_series(t: Tables) -> DataFrame:
    m = lambda n: F.make_dt_interval(mins=(F.col("event_id") % n).cast("int"))
    df = t.events.select("event_id", (((F.col("event_id") * 37) % 101 + 0.5) / 102).alias("p"), (F.col("ts") - F.expr("INTERVAL 2 HOURS")).alias("cutoff"), (F.col("ts") - m(200)).alias("made"), (F.col("ts") - m(3)).alias("starts"))
    close, bad = s.close_series(df, "p", "cutoff", "made", "starts")
    return close.select("event_id", F.lit("close").alias("kind")).unionByName(bad.select("event_id", F.lit("violation").alias("kind")))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber <> 2 THEN l_tax END AS tax, l_returnflag AS flag, year(l_shipdate) AS y FROM lineitem), m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(tax, 0.5) AS x FROM x WHERE y < 1998 AND flag <> 'R')
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(coalesce(tax, m.x), 6) AS tax, CASE WHEN flag IN (SELECT DISTINCT flag FROM x WHERE y < 1998 AND flag <> 'R') THEN flag ELSE 'Unknown' END AS flag FROM x CROSS JOIN m""")
def j7_feature_pipeline(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("tax"), F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("y"))
    model = s.fit_features(x.where("y < 1998 AND flag <> 'R'"), ["l_quantity", "tax"], ["flag"])
    return s.apply_features(x, model, ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r("tax"), "flag")


@query()
def j8_ensemble(t: Tables) -> DataFrame:
    """Ten members on week-weighted samples, and their mean blended with a baseline fitted on the rating alone, on a grid of 21."""
    f = forecasts(t).withColumns({"x": F.col("p"), "v": F.col("value"), "y": (F.col("value") + 20 * F.col("p") > 40).cast("double")})
    train, test = f.where("ts < TIMESTAMP '2024-01-20'"), f.where("ts >= TIMESTAMP '2024-01-20'")
    models = s.bagged_trees(train, ["x", "v"], "y", F.date_trunc("week", "ts"), 10, trees=4)
    m = s.member_probabilities(s.with_baseline(train, test, ["x"], "y"), models, ["x", "v"])
    m = m.withColumn("mean", F.aggregate("members", F.lit(0.0), lambda a, x: a + x) / F.size("members"))
    return s.best_blend(m, "y", "mean", "baseline")


@query()
def j9_calibration(t: Tables) -> DataFrame:
    """Raw, sigmoid and isotonic, chosen on another split; the tests use a shifted forecast."""
    f = forecasts(t)
    return s.calibrate(f.where("event_id % 2 = 0"), f.where("event_id % 2 = 1"), "y", "p")


@query(f"""WITH l AS (SELECT event_id AS id, (event_id % 60)::DOUBLE + 0.5 - 30 AS d, user_id AS a, event_type AS b FROM events), q AS (SELECT value - 30 AS residual, user_id + 75 AS a, event_type AS b FROM events),
    c AS (SELECT a, d, count(*) FILTER (WHERE residual <= d)::DOUBLE AS u, count(*) AS n FROM (SELECT DISTINCT a, d FROM l) JOIN q USING (a) GROUP BY a, d), e AS (SELECT b, d, count(*) FILTER (WHERE residual <= d)::DOUBLE AS u, count(*) AS n FROM (SELECT DISTINCT b, d FROM l) JOIN q USING (b) GROUP BY b, d),
    z AS (SELECT d, count(*) FILTER (WHERE residual <= d) / count(*)::DOUBLE AS p FROM (SELECT DISTINCT d FROM l) CROSS JOIN q GROUP BY d), s AS (SELECT avg(residual) AS m, stddev_samp(residual) AS s FROM q)
    SELECT l.id, round(coalesce((c.u + z.p * 50) / (c.n + 50), (e.u + z.p * 50) / (e.n + 50), z.p), 6) AS p_under, round(z.p, 6) AS p_empirical, round({cdf_sql("(l.d - s.m) / s.s")}, 6) AS p_normal
    FROM l CROSS JOIN s JOIN z ON z.d = l.d LEFT JOIN c ON c.a = l.a AND c.d = l.d LEFT JOIN e ON e.b = l.b AND e.d = l.d""")
def j10_price_lines(t: Tables) -> DataFrame:
    """All three modes: drawn to segments, empirical, and normal."""
    lines = t.events.select(F.col("event_id").alias("id"), F.lit(30.0).alias("mean"), ((F.col("event_id") % 60).cast("double") + 0.5).alias("line"), F.col("user_id").alias("a"), F.col("event_type").alias("b"))
    residuals = t.events.select((F.col("value") - 30).alias("residual"), (F.col("user_id") + 75).alias("a"), F.col("event_type").alias("b"))
    drawn, whole = s.price_lines(lines, residuals, ["a", "b"]), s.price_lines(lines, residuals, []).withColumnRenamed("p_under", "p_empirical")
    return drawn.join(whole, "id").join(s.price_lines_normal(lines, residuals), "id").select("id", r("p_under"), r("p_empirical"), r("p_normal"))


@query(f"{EVENTS} SELECT event_id, CASE WHEN p < 0.4 OR p > 0.6 THEN 'clear' ELSE 'close' END || '|' || year(ts) || '.' || lpad(quarter(ts)::VARCHAR, 2, '0') || '|' || 'bo' || (event_id % 3 * 2 + 1) AS segment FROM f")
def j11_segments(t: Tables) -> DataFrame:
    f = forecasts(t)
    band = F.when((F.col("p") < 0.4) | (F.col("p") > 0.6), "clear").otherwise("close")
    return f.select("event_id", F.concat_ws("|", band, F.concat_ws(".", F.year("ts").cast("string"), F.lpad(F.quarter("ts").cast("string"), 2, "0")), F.concat(F.lit("bo"), (F.col("event_id") % 3 * 2 + 1).cast("string"))).alias("segment"))


@query(f"{EVENTS}, m AS (SELECT *, list_sort([p, p * 0.9, (p + 0.5) / 2, p * p, sqrt(p)]) AS s FROM f) SELECT event_id, round(s[1] + 0.4 * (s[2] - s[1]), 6) AS low, round(s[4] + 0.6 * (s[5] - s[4]), 6) AS high, round(least(p, s[1] + 0.4 * (s[2] - s[1]), 0.45), 6) AS combined FROM m")
def j12_member_bounds(t: Tables) -> DataFrame:
    p = F.col("p")
    df = forecasts(t).withColumn("members", F.array(p, p * 0.9, (p + 0.5) / 2, p * p, F.sqrt(p)))
    return s.member_bounds(df, "members", "p", F.lit(0.45)).select("event_id", r("low"), r("high"), r("combined"))
