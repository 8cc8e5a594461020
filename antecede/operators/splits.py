"""Splits and folds by time, fitted feature pipelines, calibration."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.columns import expit, logit, normal_cdf
from antecede.operators.evaluation import calibration_line, iso_week, log_loss, prediction_quality, quantiles


def numbered_times(df: DataFrame, time: str) -> DataFrame:
    """time, k (from 0), total: distinct times in order. Numbered inside months first, then over one row for each month."""
    times = df.select(time).distinct().withColumn("__m", F.date_trunc("month", time))
    months = times.groupBy("__m").agg(F.count("*").alias("n"))
    run = F.coalesce(F.sum("n").over(Window.orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = months.select("__m", run.alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return times.join(starts, "__m").select(time, (F.col("start") + F.row_number().over(Window.partitionBy("__m").orderBy(time)) - 1).alias("k"), "total")


def temporal_split(df: DataFrame, time: str, fractions: dict[str, float]) -> DataFrame:
    """split: unique times are cut by fractions in order, so all rows of one time stay together; the last takes the rest."""
    at, total, case = 0.0, F.col("total"), None
    names = list(fractions)
    for name in names[:-1]:
        at += fractions[name]
        test = F.col("k") < F.floor(total * at + 1e-9)
        case = F.when(test, name) if case is None else case.when(test, name)
    table = numbered_times(df, time).select(time, (case.otherwise(names[-1]) if case is not None else F.lit(names[-1])).alias("split"))
    return df.join(table, time)


def stratified_split(df: DataFrame, group: str, strata: list[str], share: float, seed: int = 7) -> DataFrame:
    """split train or test: whole groups, in each stratum the given share of them by hash order."""
    groups = df.select(group, *strata).distinct()
    w = Window.partitionBy(*strata)
    ranked = groups.withColumns({"__k": F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), group)), "__n": F.count("*").over(w)})
    return df.join(ranked.select(group, *strata, F.when(F.col("__k") <= F.round(F.col("__n") * share), "test").otherwise("train").alias("split")), [group, *strata])


def split_problems(df: DataFrame, split: str, group: str, time: str) -> DataFrame:
    """kind, what: groups in two splits, and splits whose time ranges overlap."""
    shared = df.groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1").select(F.lit("shared group").alias("kind"), F.col(group).cast("string").alias("what"))
    ranges = df.groupBy(split).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    bad = ranges.withColumn("before", F.lag("hi").over(Window.orderBy("lo", split))).where("before >= lo")
    return shared.unionByName(bad.select(F.lit("overlap").alias("kind"), F.col(split).alias("what")))


def rolling_folds(df: DataFrame, time: str, blocks: int, by_week: bool = True) -> DataFrame:
    """Rows with block (1 to `blocks`), by runs of weeks or of times; fold k validates on block k and trains strictly before it."""
    if by_week:
        keys = df.select(iso_week(time).alias("__w")).distinct()
        table = keys.select("__w", F.ntile(blocks).over(Window.orderBy("__w")).alias("block"))
        return df.withColumn("__w", iso_week(time)).join(table, "__w").drop("__w")
    # Blocks of ntile from numbered times: the first `more` have one more.
    size, more = F.floor(F.col("total") / blocks), F.col("total") % blocks
    block = F.when(F.col("k") < more * (size + 1), F.floor(F.col("k") / (size + 1))).otherwise(more + F.floor((F.col("k") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return df.join(numbered_times(df, time).select(time, (block + 1).cast("int").alias("block")), time)


def oof_logistic(df: DataFrame, id_: str, time: str, features: list[str], y: str, blocks: int = 4, c: float = 0.5) -> DataFrame:
    """id, probability, fold, cutoff, forecast_at: block k (from 2) is forecast by a model of all rows strictly before its first time."""
    folds = rolling_folds(df, time, blocks)
    starts = {r["block"]: r["start"] for r in folds.groupBy("block").agg(F.min(time).alias("start")).collect()}
    out = None
    for k in range(2, blocks + 1):
        train, test = folds.where(F.col(time) < F.lit(starts[k])), folds.where(F.col("block") == k)
        n, cutoff = train.agg(F.count("*"), F.max(time)).first()
        v = VectorAssembler(inputCols=features, outputCol="raw")
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v.transform(train))
        model = LogisticRegression(labelCol=y, regParam=1 / (c * max(1, n)), standardization=False).fit(scaler.transform(v.transform(train)))
        p = vector_to_array("probability")[1]
        one = model.transform(scaler.transform(v.transform(test))).select(id_, p.alias("probability"), F.lit(k).alias("fold"), F.lit(cutoff).alias("cutoff"), F.col(time).alias("forecast_at"))
        out = one if out is None else out.unionByName(one)
    return out


def close_series(df: DataFrame, p: str, cutoff: str, forecast: str, start: str, most: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """(close rows, violations): evidence must be cut off before it is made and made by the start; close if the favourite has `most` or less."""
    valid = F.coalesce((F.col(cutoff) < F.col(forecast)) & (F.col(forecast) <= F.col(start)) & F.col(p).between(0, 1), F.lit(False))
    return df.where(valid & (F.greatest(F.col(p), 1 - F.col(p)) <= most)), df.where(~valid)


def fit_features(df: DataFrame, numbers: list[str], categories: list[str], most_levels: int = 1000) -> dict:
    """Medians and frozen levels of a training table, for apply_features. Levels are few by contract: too many fail."""
    medians = {c: quantiles(df, c, [0.5])[0] for c in numbers}
    levels = {}
    for c in categories:
        found = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most_levels + 1).collect()]
        if len(found) > most_levels:
            raise ValueError(f"{c} has more than {most_levels} levels")
        levels[c] = found
    return {"medians": medians, "levels": levels}


def apply_features(df: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """`keep`, numbers with medians for nulls, categories with Unknown for what training didn't have; absent columns count as null."""
    have = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    numbers = [F.coalesce(have(c, "double"), F.lit(m)).alias(c) for c, m in model["medians"].items()]
    return df.select(*keep, *numbers, *(F.when(have(c, "string").isin(*v), have(c, "string")).otherwise("Unknown").alias(c) for c, v in model["levels"].items()))


def bagged_trees(df: DataFrame, features: list[str], y: str, cluster: Column, members: int = 3, seed: int = 7, trees: int = 10) -> list:
    """Boosted trees on cluster-weighted samples: a cluster's weight in a member is a Poisson(1) draw from its hash."""
    v = VectorAssembler(inputCols=features, outputCol="features")
    models = []
    for k in range(members):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), cluster), F.lit(1_000_000)) + 0.5) / 1_000_000
        weight = F.when(u < 0.36788, 0.0).when(u < 0.73576, 1.0).when(u < 0.91970, 2.0).when(u < 0.98101, 3.0).otherwise(4.0)
        models.append(GBTClassifier(labelCol=y, weightCol="w", maxIter=trees, maxDepth=3, seed=seed + k).fit(v.transform(df.withColumn("w", weight)).where("w > 0")))
    return models


def with_baseline(train: DataFrame, df: DataFrame, features: list[str], y: str) -> DataFrame:
    """`df` with `baseline`: the probability of a logistic regression on the ratings alone, fitted on `train`."""
    v = VectorAssembler(inputCols=features, outputCol="__b")
    model = LogisticRegression(featuresCol="__b", labelCol=y, regParam=0.0, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__k").fit(v.transform(train))
    return model.transform(v.transform(df)).withColumn("baseline", vector_to_array("__p")[1]).drop("__b", "__p", "__r", "__k")


def member_probabilities(df: DataFrame, models: list, features: list[str]) -> DataFrame:
    v = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    for k, m in enumerate(models):
        v = m.transform(v).withColumn(f"p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return v.withColumn("members", F.array(*(F.col(f"p{k}") for k in range(len(models))))).drop("features", *(f"p{k}" for k in range(len(models))))


def best_blend(df: DataFrame, y: str, a: str, b: str, steps: int = 21) -> DataFrame:
    """weight, log_loss for each of `steps` blends of two probabilities in logits, and whether it is the best (the smallest of ties)."""
    grid = df.select(y, a, b, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")).withColumn("weight", F.col("k") / (steps - 1))
    p = expit(F.col("weight") * logit(F.col(a)) + (1 - F.col("weight")) * logit(F.col(b)))
    losses = grid.groupBy("weight").agg(F.avg(log_loss(F.col(y), p)).alias("log_loss"))
    return losses.withColumn("best", F.row_number().over(Window.orderBy("log_loss", "weight")) == 1)


def calibrate(fit: DataFrame, select: DataFrame, y: str, p: str) -> DataFrame:
    """method (raw, sigmoid, isotonic), log_loss on `select`, slope, intercept, allowed (0.8 to 1.2, within 0.1), chosen."""
    x = VectorAssembler(inputCols=["x"], outputCol="features")
    made = lambda df: x.transform(df.withColumn("x", logit(F.col(p))))
    line = LogisticRegression(labelCol=y, regParam=0.0, standardization=False).fit(made(fit.withColumn(y, F.col(y).cast("double"))))
    steps = IsotonicRegression(labelCol=y, featuresCol=p).fit(fit.withColumn(y, F.col(y).cast("double")))
    tried = {"raw": select.select(y, p), "sigmoid": line.transform(made(select)).select(y, vector_to_array("probability")[1].alias(p)), "isotonic": steps.transform(select).select(y, F.greatest(F.least(F.col("prediction"), F.lit(1 - 1e-6)), F.lit(1e-6)).alias(p))}
    out = None
    for name, df in tried.items():
        one = prediction_quality(df, y, p).select(F.lit(name).alias("method"), "log_loss").crossJoin(calibration_line(df, y, p))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("allowed", F.col("slope").between(0.8, 1.2) & (F.abs("intercept") <= 0.1))
    return out.withColumn("chosen", F.col("allowed") & (F.row_number().over(Window.orderBy(F.desc("allowed"), "log_loss", "method")) == 1))


#: Cells of a two-level count.
CELLS = 4096


def counts_at_most(points: DataFrame, values: DataFrame, by: str) -> DataFrame:
    """id, u, n: of the values (by, v) of a point's group, how many are at most its x, and how many there are. points: id, by, x.

    Counted inside cells of the group's range first, then over its cells, so no group is put in order in one task. Points of groups without values are left out.
    """
    stats = values.groupBy(by).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.count("*").alias("__n"))
    cell = F.coalesce(F.floor((F.col("x") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * CELLS), F.lit(0.0))
    cell = F.when(F.col("x") < F.col("__lo"), -1).when(F.col("x") > F.col("__hi"), CELLS).otherwise(F.least(cell, F.lit(CELLS - 1))).cast("int")
    rows = values.select(by, F.col("v").alias("x"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(0).alias("__point")).unionByName(points.select(by, "x", "id", F.lit(1).alias("__point")))
    rows = rows.join(stats, by).withColumn("__c", cell)
    inside = Window.partitionBy(by, "__c").orderBy("x", "__point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__u", F.sum(1 - F.col("__point")).over(inside))
    cells = rows.groupBy(by, "__c").agg(F.sum(1 - F.col("__point")).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.where("__point = 1").join(cells.select(by, "__c", before.alias("__before")), [by, "__c"]).select("id", (F.col("__u") + F.col("__before")).alias("u"), F.col("__n").alias("n"))


def price_lines(lines: DataFrame, residuals: DataFrame, segments: list[str], pull: float = 50.0) -> DataFrame:
    """P(total under the line): the share of residuals at most line - mean, of the first segment kind that has any, drawn to the share of all by n / (n + pull).

    lines: id, mean, line and the segments; residuals: residual and the segments.
    """
    out = lines.select("id")
    for s in (*segments, "__all"):
        group = F.lit("all") if s == "__all" else F.col(s)
        points = lines.select("id", group.alias("g"), (F.col("line") - F.col("mean")).alias("x"))
        found = counts_at_most(points, residuals.select(group.alias("g"), F.col("residual").alias("v")), "g")
        out = out.join(found.withColumnsRenamed({"u": f"u_{s}", "n": f"n_{s}"}), "id", "left")
    base = F.col("u___all") / F.col("n___all")
    drawn = [F.when(F.col(f"n_{s}") > 0, (F.col(f"u_{s}") + base * pull) / (F.col(f"n_{s}") + pull)) for s in segments]
    return out.select("id", F.coalesce(*drawn, base).alias("p_under"))


def price_lines_normal(lines: DataFrame, residuals: DataFrame) -> DataFrame:
    """id, p_normal: P(total under the line) if residuals are normal with their mean and standard deviation."""
    moments = residuals.agg(F.avg("residual").alias("__m"), F.stddev_samp("residual").alias("__s"))
    x = lines.crossJoin(F.broadcast(moments))
    return x.select("id", normal_cdf((F.col("line") - F.col("mean") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).alias("p_normal"))


def member_bounds(df: DataFrame, members: str, p: str, bound: Column) -> DataFrame:
    """low and high (quantiles 0.1 and 0.9 of the members, linear between them) and combined: the least of p, low and a bound."""
    s = F.array_sort(members)
    n = F.size(members)

    def at(q: float) -> Column:
        x = (n - 1) * F.lit(q)
        k = F.floor(x).cast("int")
        return F.get(s, k) + (x - k) * (F.coalesce(F.get(s, k + 1), F.get(s, k)) - F.get(s, k))

    return df.withColumns({"low": at(0.1), "high": at(0.9)}).withColumn("combined", F.least(F.col(p), F.col("low"), bound))
