"""The incremental side: each operator on a stream gives what its batch form gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ValueState
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructField, StructType

from antecede.operators.merge import merge_history
from antecede.sources.tables import exists, names, remove, written


def read_files(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A file stream of a folder or glob of Parquet files, with the schema of those there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Everything there is, to a Parquet table (append), read back."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None]) -> None:
    q = stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class BucketedTable:
    """A Parquet table partitioned by a bucket of its key. A batch reads and overwrites the buckets that its keys fall in, and no others.

    What a batch makes of its buckets is written beside the table first, under the batch's id. A batch that is run again
    after a failure, at a restart of the driver too, takes that instead of buckets that may be half replaced. Only the last
    batch can be run again, so what earlier ones made is removed. Buckets should be so many that one fits a task.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        path = f"{self.root}/table"
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], f"{self.schema}, bucket int")

    def change(self, batch: DataFrame, batch_id: int, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """`make(rows, batch)` gives what the batch's buckets hold from now on, of the rows that they hold; a bucket that has rows keeps some."""
        made = f"{self.root}/made/{batch_id}"
        if not exists(self.spark, f"{made}/_SUCCESS"):
            batch = written(batch, "batch")
            # At most as many numbers as there are buckets; as constants, they prune the folders that are read.
            touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]
            rows = self.read().where(F.col("bucket").isin(touched)).drop("bucket")
            make(rows, batch).withColumn("bucket", self.bucket()).write.mode("overwrite").parquet(made)
        merged = self.spark.read.schema(f"{self.schema}, bucket int").parquet(made)
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/table")
        remove(self.spark, f"{self.root}/made/{batch_id - 1}")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Game-atomic: all old rows of a batch's keys go."""
        self.change(batch, batch_id, lambda rows, new: merge_history(rows.select(*new.columns), new, self.key))


def append_new(table: BucketedTable, bad: str, batch: DataFrame, batch_id: int, content: str) -> None:
    """Rows of unknown keys go to `table`, those of known ones with other content to `bad`, under the batch's id.

    Of a batch's own rows of a key the least by content, then by the other columns, is kept. Only the buckets of the
    batch's keys are read, not what came in all earlier batches.
    """
    key = table.key

    def make(known: DataFrame, rows: DataFrame) -> DataFrame:
        others = [c for c in known.columns if c not in (key, content)]
        unknown = rows.join(known.select(key), key, "left_anti")
        new = unknown.groupBy(key).agg(F.min(F.struct(content, *others)).alias("__r")).select(key, "__r.*")
        after = written(known.unionByName(new.select(*known.columns)), "known")
        # Before the buckets count as made: a batch that failed in between makes both again from the same table.
        conflicts(after, rows.dropDuplicates([key, content]), key, content).write.mode("overwrite").parquet(f"{bad}/{batch_id}")
        return after

    table.change(batch, batch_id, make)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State stores of the streams begun inside are RocksDB's, as arbitrary state needs; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept_state(spark: SparkSession, root: str, schema: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a small state after a batch, from the batch and the whole state after the one before it, each a table under its batch's id.

    A batch that is run again writes the same table anew, so a restart goes on from the last checkpoint; older states are
    removed. A state with a row for each of many keys belongs in a `BucketedTable`.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        before = f"{root}/{batch_id - 1}"
        state = spark.read.schema(schema).parquet(before) if exists(spark, f"{before}/_SUCCESS") else spark.createDataFrame([], schema)
        step(batch, state).write.mode("overwrite").parquet(f"{root}/{batch_id}")
        remove(spark, f"{root}/{batch_id - 2}")

    return run


def last_state(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The state after the last batch."""
    done = [k for k in sorted(map(int, names(spark, root)), reverse=True) if exists(spark, f"{root}/{k}/_SUCCESS")]
    return spark.read.schema(schema).parquet(f"{root}/{done[0]}") if done else spark.createDataFrame([], schema)


def idempotent(stream: DataFrame, key: str, content: str, time: str, wait: str) -> DataFrame:
    """The same key with the same content again is dropped, if it comes within the wait."""
    return stream.withColumn("__h", F.xxhash64(content)).withWatermark(time, wait).dropDuplicatesWithinWatermark([key, "__h"]).drop("__h")


def conflicts(stored: DataFrame, batch: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of a batch whose key is stored with other content."""
    return batch.join(stored.select(key, F.col(content).alias("__old")).distinct(), key).where(F.col("__old") != F.col(content)).drop("__old")


def fresh_quotes(stream: DataFrame, observed: str, received: str, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(fresh, late) by the time between observation and receipt; both can be written."""
    age = F.unix_micros(F.col(received).cast("timestamp")) - F.unix_micros(F.col(observed).cast("timestamp"))
    ok = F.coalesce(age <= seconds * 1_000_000, F.lit(False))
    return stream.where(ok), stream.where(~ok)


def quotes_before_start(bets: DataFrame, quotes: DataFrame, key: str, hours: int, wait: str) -> DataFrame:
    """Stream-stream interval join: quotes after a bet's entry and before its start, at most `hours` later. Columns entered, observed, starts."""
    b = bets.withWatermark("entered", wait)
    q = quotes.withColumnRenamed(key, "__k").withWatermark("observed", wait)
    return b.join(q, (F.col(key) == F.col("__k")) & (F.col("observed") > F.col("entered")) & (F.col("observed") < F.col("starts")) & (F.col("observed") <= F.col("entered") + F.make_interval(hours=F.lit(hours)))).drop("__k")


def quotes_or_none(bets: DataFrame, quotes: DataFrame, key: str, hours: int, wait: str) -> DataFrame:
    """As `quotes_before_start`, but a bet without a quote leaves too, once, with null quote columns: when the watermark says that none can come.

    The watermark is that of the slower stream, and rows with a null key don't move it.
    """
    b = bets.withWatermark("entered", wait)
    q = quotes.withColumnRenamed(key, "__k").withWatermark("observed", wait)
    near = (F.col(key) == F.col("__k")) & (F.col("observed") > F.col("entered")) & (F.col("observed") < F.col("starts")) & (F.col("observed") <= F.col("entered") + F.make_interval(hours=F.lit(hours)))
    return b.join(q, near, "leftOuter").drop("__k")


#: Groups that a stateful stream's keys are dealt into; as many for the life of a checkpoint.
GROUPS = 1024


def by_groups(stream: DataFrame, key: str) -> GroupedData:
    """The stream by groups of its keys, a null key for itself. A group's keys share one state, so that no key costs a call of its own."""
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS))).cast("int")
    return stream.withColumn("__group", group).groupBy("__group")


def columns_of(**kinds: DataType) -> StructType:
    """A group's state: as many arrays as a key has values, in the same order."""
    return StructType([StructField(n, ArrayType(k)) for n, k in kinds.items()])


def held_rows(state: ValueState) -> list[tuple]:
    return list(zip(*state.get(), strict=True)) if state.exists() else []


def hold_rows(state: ValueState, rows: list[tuple]) -> None:
    """Puts the rows of a group's state; none clear it."""
    state.update(tuple(map(list, zip(*rows, strict=True)))) if rows else state.clear()


def longs(values: pd.Series) -> list:
    """Python numbers; None where there are none, as in the group of a null key."""
    return [None if pd.isna(v) else int(v) for v in values] if values.isna().any() else values.tolist()


LATE_SCHEMA = "key long, id long, observed_us long, late boolean, behind_us long"


class LateRows(StatefulProcessor):
    """Keeps the mark of each key of a group, the latest observation so far less a wait; a row that is behind it is late, and says by how much.

    Nothing is dropped: the two kinds are one stream, so each row is judged once, against the state before it.
    """

    def __init__(self, wait_us: int):
        self.wait = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", columns_of(key=LongType(), at=LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, out = dict(held_rows(self.latest)), []
        pdf = pd.concat(list(rows)).sort_values(["received_us", "id"], kind="stable")
        for who, id_, at in zip(longs(pdf["key"]), pdf["id"].tolist(), pdf["observed_us"].tolist(), strict=True):
            behind = latest[who] - self.wait - at if who in latest else 0
            out.append((who, id_, at, behind > 0, max(0, behind)))
            latest[who] = max(at, latest.get(who, at))
        hold_rows(self.latest, list(latest.items()))
        yield pd.DataFrame(out, columns=["key", "id", "observed_us", "late", "behind_us"])

    def close(self) -> None:
        pass


def split_late(stream: DataFrame, wait_seconds: int) -> DataFrame:
    """key, id, observed_us, late, behind_us of a stream (key, id, observed_us, received_us), whose rows come in order of receipt."""
    return by_groups(stream, "key").transformWithStateInPandas(LateRows(wait_seconds * 1_000_000), LATE_SCHEMA, "Append", "None")


def two_tables(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows that are in time and rows that are late, each to its table, under the batch's id: a batch that is run again replaces its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # Written together first, so that both are of one reading of the state.
        made = written(batch, "judged")
        for name, test in (("fresh", "NOT late"), ("rejected", "late")):
            made.where(test).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    return run


def gap_sessions(df: DataFrame, by: str, time: str, gap: str, wait: str | None = None) -> DataFrame:
    """by, start, last, rows of sessions that end after a gap; on a stream with a watermark, once they can't grow."""
    df = df.withWatermark(time, wait) if wait else df
    out = df.groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count("*").alias("rows"), F.max(time).alias("last"))
    return out.select(by, F.col("s.start").alias("start"), "last", "rows")


def health_counts(df: DataFrame, by: str, time: str, width: str = "24 hours", step: str = "1 hour", wait: str | None = None) -> DataFrame:
    """by, start, rows of sliding windows."""
    df = df.withWatermark(time, wait) if wait else df
    return df.groupBy(F.window(time, width, step).alias("w"), by).agg(F.count("*").alias("rows")).select(by, F.col("w.start").alias("start"), "rows")


EWM_SCHEMA = "entity long, at timestamp, value double, ema_before double, ema_after double, days_since long"


class RunningEwm(StatefulProcessor):
    """The pair (sum, weight) of each entity of a group and its last time: an exponential mean is a fold of two numbers.

    Rows of one batch are folded in order of time; batches must not go back in time for an entity.
    """

    def __init__(self, halflife: float = 9.0):
        self.keep = 2.0 ** (-1.0 / halflife)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ewm", columns_of(entity=LongType(), x=DoubleType(), w=DoubleType(), last_us=LongType(), n=LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, out = {who: rest for who, *rest in held_rows(self.state)}, []
        pdf = pd.concat(list(rows)).sort_values(["at", "tie"], kind="stable")
        times = pdf["at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        for who, at, value in zip(longs(pdf["entity"]), times, pdf["value"].tolist(), strict=True):
            x, w, last, n = known.get(who, (0.0, 0.0, None, 0))
            before, days = x / w if w else None, None if last is None else (at - last) // 86_400_000_000
            if not pd.isna(value):
                x, w, n = x * self.keep + value, w * self.keep + 1.0, n + 1
            known[who] = (x, w, at, n)
            out.append((who, before, x / w if w else None, days))
        hold_rows(self.state, [(who, *rest) for who, rest in known.items()])
        made = pd.DataFrame(out, columns=["entity", "ema_before", "ema_after", "days_since"])
        made.insert(1, "at", pdf["at"].to_numpy())
        made.insert(2, "value", pdf["value"].to_numpy())
        yield made.astype({"entity": "Int64", "ema_before": "float64", "ema_after": "float64", "days_since": "Int64"})

    def close(self) -> None:
        pass


def running_ewm(stream: DataFrame, halflife: float = 9.0) -> DataFrame:
    """stream: entity, at, tie, value."""
    return by_groups(stream, "entity").transformWithStateInPandas(RunningEwm(halflife), EWM_SCHEMA, "Append", "None")


ORDERED_SCHEMA = "entity long, at_us long, tie long, ema_before double, ema_after double"


class OrderedEwm(StatefulProcessor):
    """As `RunningEwm`, for rows that come out of order: a group's rows wait until the watermark passes them, and are folded in order of time.

    A timer stands at the earliest waiting row. Where `forget_us` is given, an entity without rows for so long loses its state by a timer too.
    """

    def __init__(self, halflife: float = 9.0, forget_us: int | None = None):
        self.keep, self.forget = 2.0 ** (-1.0 / halflife), forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", columns_of(entity=LongType(), at=LongType(), tie=LongType(), value=DoubleType()))
        self.state = handle.getValueState("ewm", columns_of(entity=LongType(), x=DoubleType(), w=DoubleType(), last=LongType()))

    def timer(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        values = [None if pd.isna(v) else float(v) for v in pdf["value"].tolist()]
        new = zip(longs(pdf["entity"]), pdf["at_us"].tolist(), pdf["tie"].tolist(), values, strict=True)
        hold_rows(self.waiting, [*held_rows(self.waiting), *new])
        self.timer(int(pdf["at_us"].min()))
        yield pd.DataFrame({"entity": pd.Series(dtype="int64"), "at_us": pd.Series(dtype="int64"), "tie": pd.Series(dtype="int64"), "ema_before": pd.Series(dtype="float64"), "ema_after": pd.Series(dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(held_rows(self.waiting), key=lambda r: (r[1], r[2]))
        now, rest = [r for r in waiting if r[1] <= mark], [r for r in waiting if r[1] > mark]
        known, out = {who: kept for who, *kept in held_rows(self.state)}, []
        for who, at, tie, value in now:
            x, w, last = known.get(who, (0.0, 0.0, None))
            if self.forget is not None and last is not None and at - last > self.forget:
                x = w = 0.0
            before = x / w if w else None
            if value is not None:
                x, w = x * self.keep + value, w * self.keep + 1.0
            known[who] = (x, w, at)
            out.append((who, at, tie, before, x / w if w else None))
        if now:
            hold_rows(self.waiting, rest)
        if rest:
            self.timer(rest[0][1])
        if self.forget is not None:
            # Who has rows waiting is judged when they are folded.
            expected = {r[0] for r in rest}
            known = {who: kept for who, kept in known.items() if who in expected or mark - kept[2] <= self.forget}
            if idle := [kept[2] for who, kept in known.items() if who not in expected]:
                self.timer(min(idle) + self.forget + 1000)
        hold_rows(self.state, [(who, *kept) for who, kept in known.items()])
        yield pd.DataFrame(out, columns=["entity", "at_us", "tie", "ema_before", "ema_after"]).astype({"entity": "Int64", "at_us": "int64", "tie": "int64", "ema_before": "float64", "ema_after": "float64"})

    def close(self) -> None:
        pass


def ordered_ewm(stream: DataFrame, wait: str, halflife: float = 9.0, forget_us: int | None = None) -> DataFrame:
    """stream: entity, at (a timestamp), tie, value; rows later than the wait are dropped by the watermark."""
    rows = stream.withWatermark("at", wait).withColumn("at_us", F.unix_micros("at"))
    return by_groups(rows, "entity").transformWithStateInPandas(OrderedEwm(halflife, forget_us), ORDERED_SCHEMA, "Append", "EventTime")
