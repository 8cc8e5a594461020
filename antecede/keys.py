"""Entities, times and keys: what the other modules agree on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


class EntitySpec(NamedTuple):
    """Who a row is about, when, and what puts rows of one time in a total order."""

    id: tuple[str, ...]
    time: str
    order: tuple[str, ...] = ()

    def all_rows(self, *more: str) -> WindowSpec:
        """Rows of the entity in order."""
        return Window.partitionBy(*self.id, *more).orderBy(self.time, *self.order)

    def earlier_times(self, *more: str) -> WindowSpec:
        """Rows of the entity of strictly earlier times: rows of one time share what was known before it."""
        return Window.partitionBy(*self.id, *more).orderBy(micros(self.time)).rangeBetween(Window.unboundedPreceding, -1)

    def day(self) -> Column:
        return F.to_date(self.time)

    def whole_day(self) -> WindowSpec:
        return Window.partitionBy(*self.id, self.day()).orderBy(self.time, *self.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in every double and float column; Spark orders it as the largest value."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


#: A side of at most this many narrow rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000


def sized(df: DataFrame) -> DataFrame:
    """`df` (cheap to count) marked for broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", cardinality: str = "m:1", matched: bool = False) -> DataFrame:
    """A join that first proves its cardinality (one more pass over the keys) and, if asked, that no left row is alone."""
    for side, one, name in ((left, cardinality[0] == "1", "left"), (right, cardinality[-1] == "1", "right")):
        if one and (bad := repeated_keys(side, on).first()):
            raise ValueError(f"{cardinality} join: the {name} side repeats {bad.asDict()}")
    if matched and (bad := left.join(right, on, "left_anti").first()):
        raise ValueError(f"no match for {bad.asDict()}")
    return left.join(right, on, how)


def repeated_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("rows")).where("rows > 1")


def row_id(*columns: str, length: int = 64) -> Column:
    """A deterministic id of some columns; null differs from an empty string."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)), 256), 1, length)


def schema_fingerprint(df: DataFrame) -> str:
    """Of positions, names and types."""
    import hashlib

    return hashlib.sha256(repr([(k, c, t) for k, (c, t) in enumerate(df.dtypes)]).encode()).hexdigest()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, content): the content's sum of row hashes doesn't depend on order. Null counts as the text \\N."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("content"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name, as RFC 4122 has it: SHA-1, with the version and variant put in."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
