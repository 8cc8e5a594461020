"""Quality gates over groups, contracts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from antecede.operators.joins import reasons


def group_issues(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key and `issues`, in order: one aggregate expression, true if the group is bad, for each code."""
    names = list(checks)
    return df.groupBy(key).agg(*(checks[n].alias(f"__{k}") for k, n in enumerate(names))).select(key, reasons({n: F.col(f"__{k}") for k, n in enumerate(names)}).alias("issues"))


def training_issues(df: DataFrame, game: str, side: str, result: str, targets: list[str], roles: str, members: int = 5) -> DataFrame:
    """game and the assertions that it breaks: two sides, one winner, targets agree, as many roles as members."""
    differ = F.lit(False)
    for c in targets:
        differ = differ | (F.min(c) != F.max(c))
    return group_issues(df, game, {"two sides": (F.count("*") != 2) | (F.count_distinct(side) != 2), "one winner": F.sum(result) != 1, "targets agree": differ, "five roles": F.bool_or(F.col(roles) != members)})


def marked_rows(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """The distinct rows with their group's issues. Rows are dealt by the group once, and duplicates, issues and the way back all use that."""
    rows = df.repartition(key).dropDuplicates()
    return rows.join(group_issues(rows, key, checks), key)


def quarantine(df: DataFrame, key: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of good groups, and rows of bad ones with their issues, from one written table; exact duplicates go first."""
    from antecede.sources.tables import written

    marked = written(marked_rows(df, key, checks), "marked")
    return marked.where("size(issues) = 0").drop("issues"), marked.where("size(issues) > 0")


def quality_report(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row: rows, duplicates, accepted and quarantined groups, and nulls of each column."""
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in df.columns}
    first = df.agg(F.count("*").alias("input_rows"), *(c.alias(n) for n, c in nulls.items()))
    kept = df.dropDuplicates().agg(F.count("*").alias("distinct_rows"))
    groups = group_issues(df, key, checks).agg(F.count_if(F.size("issues") == 0).alias("accepted"), F.count_if(F.size("issues") > 0).alias("quarantined"))
    return first.crossJoin(kept).crossJoin(groups).withColumn("duplicates", F.col("input_rows") - F.col("distinct_rows")).drop("distinct_rows")


def conflicts(df: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """Keys whose facts disagree between their rows; null is a value."""
    return df.groupBy(*key).agg(F.count_distinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in facts))).alias("versions")).where("versions > 1")


def column_report(df: DataFrame, names: DataFrame) -> DataFrame:
    """column, status (present, missing, new), use, rows, nulls, violation: the table's columns, counted in one pass, against a declared list (column, use).

    A column whose use is `required` must be there and hold no null.
    """
    counted = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns))
    here = counted.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"null_{c}").alias("nulls")) for c in df.columns))).alias("x")).select("x.column", "rows", "x.nulls")
    out = here.join(names.withColumn("named", F.lit(True)), "column", "full")
    must = F.col("use") == "required"
    violation = F.when(must & F.col("rows").isNull(), "required column missing").when(must & (F.col("nulls") > 0), "required column has nulls")
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("named").isNull(), "new").otherwise("present")
    return out.select("column", status.alias("status"), F.coalesce("use", F.lit("candidate")).alias("use"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("nulls", F.lit(0)).alias("nulls"), violation.alias("violation"))


def feature_contract(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """column, role, problem: the exact rule, or else exactly one suffix rule. rules: (kind, pattern, role)."""
    exact = rules.where("kind = 'exact'").select(F.col("pattern").alias("column"), F.col("role").alias("exact_role"))
    suffix = columns.join(F.broadcast(rules.where("kind = 'suffix'")), F.expr("endswith(column, pattern)")).groupBy("column").agg(F.count("*").alias("n"), F.min("role").alias("suffix_role"))
    out = columns.join(exact, "column", "left").join(suffix, "column", "left")
    role = F.coalesce("exact_role", F.when(F.col("n") == 1, F.col("suffix_role")))
    return out.select("column", role.alias("role"), F.when(role.isNotNull(), F.lit(None).cast("string")).when(F.col("n") > 1, "ambiguous").otherwise("no rule").alias("problem"))


def split_horizon(df: DataFrame, time: str, now: str, hours: int) -> DataFrame:
    """Adds `excluded`: null inside [now, now + hours), else why not."""
    t, start = F.col(time).cast("timestamp"), F.lit(now).cast("timestamp")
    return df.withColumn("excluded", F.when(t.isNull(), "no time").when(t < start, "started").when(t >= start + F.make_interval(hours=F.lit(hours)), "beyond horizon"))
