"""Queries by name, each with its SQL if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name: `t.orders`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def r(c: str | Column, n: int = 6, name: str | None = None) -> Column:
    """Rounded for comparison. The nudge keeps exact ties from falling to the order in which a sum was made."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, n).alias(name or c)


def nudged(sql: str) -> str:
    """The same in SQL: round(x, n) becomes round((x) + 1e-9, n)."""
    out, at = "", 0
    while (k := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, k + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        if not comma:
            out, at = out + sql[at:end], end
            continue
        out += f"{sql[at:k]}round(({nudged(sql[k + 6 : comma])}) + 1e-9{sql[comma:end]}"
        at = end
    return out + sql[at:]


def cdf_sql(z: str) -> str:
    """The standard normal distribution in SQL: the positive series of its error function, in logarithms."""
    x = f"greatest(least(abs({z}), 7.5), 1e-300) / sqrt(2.0)"
    terms = f"list_sum(list_transform(range(0, 111), lambda n: exp(n * ln(4.0::DOUBLE) + (2 * n + 1) * ln({x}) + lgamma(n + 1) - lgamma(2 * n + 2))))"
    return f"0.5 * (1 + sign({z}) * 2 / sqrt(pi()) * exp(-pow({x}, 2)) * {terms})"


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the tables under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = nudged(sql)
        return f

    return add
