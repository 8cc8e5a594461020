"""Scores of forecasts: by cohort, by week, by bin; bootstraps and gates.

`y` is 0 or 1 and `p` a probability unless a function says otherwise. Everything is an aggregate; what is
collected to the driver is at most a row of totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.columns import logit
from antecede.operators.joins import reasons
from antecede.operators.resampling import drawn_sums

#: Cells of a two-level ranking.
CELLS = 4096


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, linear between neighbours, of a whole column: its values are never put in order in one task.

    A sketch with a proven error (1 in 10,000 of the rows) gives a narrow band around each; rows below the bands are
    counted, and only the distinct values inside a band, dealt by it, are put in order. A few numbers come to the driver.
    """
    x = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = x.count()
    if not n:
        return [None] * len(shares)
    wide = 0.0005 + 2 / n  # so that a quantile's upper neighbour is in its band too
    edges = x.agg(F.percentile_approx("v", F.array(*(F.lit(min(1.0, max(0.0, s + d))) for s in shares for d in (-wide, wide))), 10_000)).first()[0]
    bands = list(zip(edges[::2], edges[1::2], strict=True))
    below = x.agg(*(F.count_if(F.col("v") < low).alias(f"b{k}") for k, (low, _) in enumerate(bands))).first()
    inside = F.filter(F.array(*(F.when(F.col("v").between(low, high), F.lit(k)) for k, (low, high) in enumerate(bands))), lambda k: k.isNotNull())
    held = x.select("v", F.explode(inside).alias("k")).groupBy("k", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    ranked = held.select("k", "v", (upto - F.col("n")).alias("first"), (upto - 1).alias("last"))
    at = [s * (n - 1) for s in shares]
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(int(p) + i - below[f"b{k}"]).alias("r")) for k, p in enumerate(at) for i in (0, 1)))
    hits = ranked.select("k", "v", F.explode(F.filter(wanted, lambda w: (w["k"] == F.col("k")) & w["r"].between(F.col("first"), F.col("last")))).alias("w"))
    found = {(h["k"], h["i"]): h["v"] for h in hits.select("k", "v", "w.i").collect()}
    low, high = ([found.get((k, i)) for k in range(len(shares))] for i in (0, 1))
    return [a if p == int(p) or b is None else a + (p - int(p)) * (b - a) for a, b, p in zip(low, high, at, strict=True)]


def log_loss(y: Column, p: Column, eps: float = 1e-12) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def bin_of(p: Column, bins: int, closed: str) -> Column:
    """lower: [a, b), with 1 in the last; upper: (a, b], with 0 in the first."""
    if closed == "lower":
        return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return F.greatest(F.least(F.ceil(p * bins) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")


def prediction_quality(df: DataFrame, y: str, p: str, by: list[str] | None = None, bins: int = 10, closed: str = "lower", eps: float = 1e-12) -> DataFrame:
    """n, log_loss, brier, ece for each group: bins are summed first, then put together."""
    by = by or []
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps)) if closed == "upper" else F.col(p)
    rows = df.select(*by, F.col(y).cast("double").alias("__y"), q.alias("__p"))
    cells = rows.groupBy(*by, bin_of(F.col("__p"), bins, closed).alias("__bin")).agg(
        F.count("*").alias("n"), F.sum("__y").alias("sy"), F.sum("__p").alias("sp"), F.sum(log_loss(F.col("__y"), F.col("__p"), eps)).alias("ll"), F.sum(F.pow(F.col("__p") - F.col("__y"), 2)).alias("br")
    )
    total = F.sum("n")
    return cells.groupBy(*by).agg(total.alias("n"), (F.sum("ll") / total).alias("log_loss"), (F.sum("br") / total).alias("brier"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / total).alias("ece"))


def calibration_line(df: DataFrame, y: str, p: str) -> DataFrame:
    """slope and intercept of y on logit(p), without a penalty."""
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.select(F.col(y).cast("double").alias("label"), logit(F.col(p)).alias("x")))
    fit = LogisticRegression(regParam=0.0, standardization=False).fit(rows)
    return df.sparkSession.createDataFrame([(float(fit.coefficients[0]), float(fit.intercept))], "slope double, intercept double")


def reliability(df: DataFrame, y: str, p: str, bins: int = 15) -> DataFrame:
    """bin, n, mean_p, mean_y over quantile bins, right-closed (the first holds its lower edge); equal edges are one."""
    edges = sorted({e for e in quantiles(df, p, [k / bins for k in range(bins + 1)]) if e is not None})
    k = F.greatest(sum((F.col(p) > e).cast("int") for e in edges) if edges else F.lit(0), F.lit(1))
    return df.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def auc(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """auc by average ranks, for each group; null if it has one class. Ranks are counted in cells, so no group is ordered in one task."""
    by = by or []
    values = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    spread = df.groupBy(*by).agg(F.min(p).alias("__lo"), F.max(p).alias("__hi"))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    placed = (values.alias("v").join(spread.alias("s"), same) if by else values.alias("v").crossJoin(F.broadcast(spread.alias("s")))).select("v.*", "__lo", "__hi")
    cell = F.coalesce(F.floor((F.col(p) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0)) * CELLS), F.lit(0)).cast("int")
    placed = placed.withColumn("__c", cell)
    inside = Window.partitionBy(*by, "__c").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    cells = ranked.groupBy(*by, "__c").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2)).alias("area"))
    before = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("area", F.col("area") + F.col("pos") * before)
    return cells.groupBy(*by).agg((F.sum("area") / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1 (0 where nothing is to divide by), log_loss, brier, auc."""
    yes, hit = F.col(p) >= threshold, F.col(y) == 1
    counts = df.agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(yes & ~hit).alias("fp"), F.count_if(~yes & ~hit).alias("tn"), F.count_if(~yes & hit).alias("fn"), F.avg(log_loss(F.col(y), F.col(p))).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")
    )
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"accuracy": over(tp + tn, tp + fp + tn + fn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)})
    return out.crossJoin(auc(df, y, p))


def pairwise_metrics(df: DataFrame, game: str, y: str, p: str) -> DataFrame:
    """games, accuracy, log_loss (of p over the pair's sum), both_won, both_lost; games without two rows and one winner count in the last two only."""
    pairs = df.groupBy(game).agg(F.count("*").alias("n"), F.sum(y).alias("won"), F.max_by(y, p).alias("picked"), (F.sum(F.when(F.col(y) == 1, F.col(p))) / F.nullif(F.sum(p), F.lit(0.0))).alias("share")).where("n = 2")
    good = F.col("won") == 1
    return pairs.agg(F.count_if(good).alias("games"), F.avg(F.when(good, F.col("picked").cast("double"))).alias("accuracy"), F.avg(F.when(good, log_loss(F.lit(1), F.col("share")))).alias("log_loss"), F.count_if(F.col("won") == 2).alias("both_won"), F.count_if(F.col("won") == 0).alias("both_lost"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """mae, mse, rmse, r2, bias, sigma (n - 1) and quantiles of the residual y - p, in one row."""
    e = F.col(y) - F.col(p)
    shares = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    out = df.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("__v"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("sigma"))
    found = quantiles(df.select(e.alias("e")), "e", list(shares))
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - F.col("mse") / F.nullif(F.col("__v"), F.lit(0.0))} | {f"q{round(100 * s):02d}": F.lit(q).cast("double") for s, q in zip(shares, found, strict=True)}).drop("__v")


def by_cohort(df: DataFrame, cohorts: list[str]) -> DataFrame:
    """Each row once for every cohort column that isn't null: cohort, level."""
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("cohort"), F.col(c).cast("string").alias("level")) for c in cohorts)), lambda x: x["level"].isNotNull())
    return df.withColumn("__c", F.explode(pairs)).select(*df.columns, "__c.cohort", "__c.level")


def named_cohorts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Each row once for every named cohort that it is in; a null name is none."""
    return df.withColumn("cohort", F.explode(F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())))


def distribution_scores(outcomes: DataFrame, id_: str, k: str, p: str, actual: str) -> DataFrame:
    """id, log_loss, brier, hit of a discrete distribution in rows (id, k, p) with its actual k."""
    is_k = (F.col(k) == F.col(actual)).cast("double")
    return outcomes.groupBy(id_).agg((-F.ln(F.greatest(F.sum(is_k * F.col(p)), F.lit(1e-12)))).alias("log_loss"), F.sum(F.pow(F.col(p) - is_k, 2)).alias("brier"), (F.max_by(k, F.struct(p, (-F.col(k)).alias("first"))) == F.first(actual)).cast("int").alias("hit"))


def weekly(df: DataFrame, time: str, measure: Column, out: str) -> DataFrame:
    return df.groupBy(F.date_trunc("week", time).alias("week")).agg(F.count("*").alias("n"), F.avg(measure).alias(out))


def iso_week(time: str) -> Column:
    return F.concat_ws("-W", F.extract(F.lit("YEAROFWEEK"), time).cast("string"), F.lpad(F.weekofyear(time).cast("string"), 2, "0"))


def week_block_bounds(df: DataFrame, time: str, residual: str, p: str, least_rows: int = 20, least_weeks: int = 3, bins: int = 5) -> DataFrame:
    """bin (-1: all), lower (q10, at most 0), upper (q90, at least 0) of weekly mean residuals, for bins with enough rows and weeks."""
    both = F.array(F.lit(-1), bin_of(F.col(p), bins, "lower"))
    weeks = df.select(iso_week(time).alias("week"), F.explode(both).alias("bin"), residual).groupBy("bin", "week").agg(F.avg(residual).alias("m"), F.count("*").alias("n"))
    out = weeks.groupBy("bin").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_weeks"), F.least(F.percentile("m", 0.1), F.lit(0.0)).alias("lower"), F.greatest(F.percentile("m", 0.9), F.lit(0.0)).alias("upper"))
    return out.where((F.col("n_rows") >= least_rows) & (F.col("n_weeks") >= least_weeks))


def apply_bounds(df: DataFrame, p: str, bounds: DataFrame, bins: int = 5) -> DataFrame:
    """lower and upper around p from its bin's bounds, or else those of all rows, kept in [0, 1]. bounds has at most bins + 1 rows."""
    table = bounds.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("lower", "upper")))).alias("__b"))
    mine = F.coalesce(F.try_element_at("__b", bin_of(F.col(p), bins, "lower")), F.try_element_at("__b", F.lit(-1)))
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return df.crossJoin(F.broadcast(table)).withColumns({"lower": clip(F.col(p) + F.coalesce(mine["lower"], F.lit(0.0))), "upper": clip(F.col(p) + F.coalesce(mine["upper"], F.lit(0.0)))}).drop("__b")


def conservative_coverage(df: DataFrame, cohort: str, time: str, y: str, lower: str, least_rows: int = 30, least_weeks: int = 4, wanted: float = 0.8) -> DataFrame:
    """cohort, n_rows, n_weeks, coverage (share of weeks whose mean outcome reaches the mean lower bound), eligible, passed."""
    weeks = df.groupBy(cohort, iso_week(time).alias("week")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("seen"), F.avg(lower).alias("bound"))
    out = weeks.groupBy(cohort).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_weeks"), F.avg((F.col("seen") >= F.col("bound")).cast("double")).alias("coverage"))
    out = out.withColumn("eligible", (F.col("n_rows") >= least_rows) & (F.col("n_weeks") >= least_weeks))
    return out.withColumn("passed", F.col("eligible") & (F.col("coverage") >= wanted))


#: Columns in a block of the matrix of products.
WIDTH = 64


def strong_pairs(df: DataFrame, features: list[str], least: float = 0.95) -> DataFrame:
    """a, b, r: pairs of features whose correlation is beyond `least`, over the rows that have them all.

    Columns are scaled first. A task adds up the products of its rows by pairs of column blocks; a pair of blocks is summed over the
    tasks where it meets, and leaves only its strong pairs. So no one, the driver neither, holds the whole matrix's sum.
    """
    full = df.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)))
    full = full.where(" AND ".join(f"x{k} IS NOT NULL AND NOT isnan(x{k})" for k in range(len(features))))
    facts = full.agg(F.count("*").alias("n"), *(f(f"x{k}").alias(f"{n}{k}") for k in range(len(features)) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n = facts["n"]
    mean, sd = (np.array([facts[f"{c}{k}"] or 0.0 for k in range(len(features))]) for c in "ms")
    scale = np.divide(1.0, sd, out=np.zeros(len(sd)), where=sd > 0)
    starts = list(range(0, len(features), WIDTH))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(i, j): 0.0 for i in starts for j in starts if i <= j}
        for batch in batches:
            z = (np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1) - mean) * scale
            for i, j in sums:
                sums[i, j] = sums[i, j] + z[:, i : i + WIDTH].T @ z[:, j : j + WIDTH]
        for (i, j), x in sums.items():
            if not np.isscalar(x):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([x.ravel().tolist()])], ["i", "j", "x"])

    def strong(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        r = sum(x.values.to_numpy() for x in table["x"]).reshape(-1, min(WIDTH, len(features) - j)) / n
        p, q = np.nonzero(np.abs(r) > least)
        p, q, r = (x[p + i < q + j] for x in (p, q, r[p, q]))
        return pa.table({"a": [features[k + i] for k in p], "b": [features[k + j] for k in q], "r": pa.array(r, pa.float64())}, pa.schema([("a", pa.string()), ("b", pa.string()), ("r", pa.float64())]))

    blocks = full.mapInArrow(products, "i long, j long, x array<double>")
    return blocks.groupBy("i", "j").applyInArrow(strong, "a string, b string, r double")


def feature_report(df: DataFrame, features: list[str], importance: dict[str, float]) -> DataFrame:
    """feature, missing, correlated (others with |r| > 0.95), importance (share of the largest), score, rank."""
    missing = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features)).first()
    pairs = strong_pairs(df, features)
    counts = pairs.select(F.explode(F.array("a", "b")).alias("feature")).groupBy("feature").agg(F.count("*").cast("int").alias("correlated"))
    top = max(importance.values()) or 1.0
    rows = [(c, float(missing[c]), importance.get(c, 0.0) / top) for c in features]
    out = df.sparkSession.createDataFrame(rows, "feature string, missing double, importance double").join(counts, "feature", "left").select("feature", "missing", F.coalesce("correlated", F.lit(0)).alias("correlated"), "importance")
    out = out.withColumn("score", F.col("importance") * (1 - F.col("missing")) / (1 + F.col("correlated")))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))


def select_features(importances: DataFrame, threshold: float = 0.0, share: float = 0.95, least: int = 15) -> DataFrame:
    """Of (feature, importance): those over the threshold, and those that make up `share` of the total, but `least` at least."""
    w = Window.orderBy(F.desc("importance"), "feature")
    run = F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("importance").over(Window.partitionBy())
    return importances.select("feature", "importance", (F.col("importance") > threshold).alias("over_threshold"), ((F.coalesce(run, F.lit(0.0)) < share) | (F.row_number().over(w) <= least)).alias("in_share"))


def dead_columns(df: DataFrame, most_missing: float) -> DataFrame:
    """column, problem: missing more often than that, or the same wherever it isn't; one pass over the table."""
    one = df.agg(*(x for c in df.columns for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}"), (F.min(c) == F.max(c)).alias(f"k_{c}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(f"m_{c}") > most_missing, "missing").when(F.coalesce(F.col(f"k_{c}"), F.lit(True)), "constant").alias("problem")) for c in df.columns))
    return one.select(F.explode(rows).alias("x")).select("x.*").where("problem IS NOT NULL")


def leak_probes(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """feature, auc of that feature alone."""
    tall = df.select(y, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features))).alias("x")).select(y, "x.*")
    return auc(tall, y, "v", ["feature"])


def pure_levels(df: DataFrame, y: str, category: str, least: int = 2) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"), F.min(y).alias("only"), F.max(y).alias("__top")).where((F.col("only") == F.col("__top")) & (F.col("n") >= least)).drop("__top")


# The distribution function of a Poisson count with mean 1, at 0 to 7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def drawn_times(seed: int, *names: Column) -> Column:
    """How often a bootstrap sample has something: a Poisson draw from a hash of the seed and names, so reruns and other engines agree."""
    text = F.concat_ws(":", F.lit(str(seed)), *(n.cast("string") for n in names))
    u = (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return sum((u >= c).cast("int") for c in POISSON)


def sampled_ratios(df: DataFrame, by: list[str], num: str, den: str, cluster: str, samples: int, seed: int, draws: str = "poisson") -> DataFrame:
    """by, sample, ratio: sums over clusters, each as often as it is drawn. No join: a cluster's draws are made where it is, and added up before any shuffle.

    draws: "exact" draws as many clusters as there are, with replacement; "poisson" gives each a count of its own, as other engines can.
    """
    if draws == "exact":
        drawn = drawn_sums(df, by, num, den, cluster, samples, seed)
        return drawn.select(*by, "sample", (F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"))
    sums = df.groupBy(*by, cluster).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    draws = sums.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("k", drawn_times(seed, F.col("sample"), F.col(cluster)))
    return draws.groupBy(*by, "sample").agg((F.sum(F.col("a") * F.col("k")) / F.nullif(F.sum(F.col("b") * F.col("k")), F.lit(0.0))).alias("ratio"))


def bootstrap_ratio(df: DataFrame, num: str, den: str, cluster: str, samples: int = 1000, confidence: float = 0.9, seed: int = 7, draws: str = "poisson") -> DataFrame:
    """estimate, lower, upper of sum(num) / sum(den) with clusters drawn anew, as `sampled_ratios` draws them."""
    tail = (1 - confidence) / 2
    ratios = sampled_ratios(df, [], num, den, cluster, samples, seed, draws)
    bounds = ratios.agg(F.percentile("ratio", tail).alias("lower"), F.percentile("ratio", 1 - tail).alias("upper"))
    return df.agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0.0))).alias("estimate")).crossJoin(bounds)


def paired_bootstrap(df: DataFrame, cohort: str, cluster: str, candidate: str, baseline: str, samples: int, confidence: float, seed: int = 7, draws: str = "poisson") -> DataFrame:
    """cohort, delta, upper: the relative loss over the baseline's mean, and its upper quantile at 1 - (1 - c) / k for k cohorts; all in one plan."""
    x = df.where(F.col(cohort).isNotNull()).select(cohort, cluster, (F.col(candidate) - F.col(baseline)).alias("d"), F.lit(1.0).alias("one"), F.col(baseline).alias("__base"))
    means = x.groupBy(cohort).agg(F.avg("__base").alias("base"), F.avg("d").alias("d"))
    level = 1 - (1 - confidence) / max(1, means.count())
    upper = sampled_ratios(x, [cohort], "d", "one", cluster, samples, seed, draws).groupBy(cohort).agg(F.percentile("ratio", level).alias("u"))
    return means.join(upper, cohort).select(cohort, (F.col("d") / F.col("base")).alias("delta"), (F.col("u") / F.col("base")).alias("upper"))


def gate(metrics: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """The rows with `failed`, the names of the tests that hold, and `decision`."""
    return metrics.withColumn("failed", reasons(tests)).withColumn("decision", F.when(F.size("failed") == 0, "promote").otherwise("hold"))
