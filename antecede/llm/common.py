"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.sources.tables import fresh_path, settled, written  # noqa: F401

#: Rows of whole texts, and bytes, in one Arrow batch that a Python worker gets.
SLICE, SLICE_BYTES = 512, 8 << 20

#: A side of at most this many narrow rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000

#: Number of runs into which rows are dealt by a hash of their identifier before their key is
#: looked at, so that no key, however common, reaches one task whole.
RUNS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends its texts to Python in small batches; the session's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": SLICE, "spark.sql.execution.arrow.maxBytesPerBatch": SLICE_BYTES}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, label: str) -> DataFrame:
    """What an Arrow function makes of whole texts, written at once, so that it runs in small batches."""
    with small_batches(df.sparkSession):
        return written(df.mapInArrow(f, schema), label)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def sized_broadcast(df: DataFrame) -> DataFrame:
    """`df` (already written, so that counting is cheap) marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; the fast built-in serves texts that are plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def run_of(identifier: Column, runs: int = RUNS) -> Column:
    return F.pmod(F.xxhash64(identifier), F.lit(runs)).cast("int")


def looked_up(rows: DataFrame, verdicts: DataFrame, key: str, spread: Column) -> DataFrame:
    """`rows` joined with the one row that `verdicts` has for each `key`, which may be common to very many rows.

    Rows are dealt into runs by a hash of `spread`. A verdict goes to each run that has its key, once; so no task of the
    join with the rows gets a key's rows whole. `verdicts` may lack keys; the rows of those are left out.
    """
    dealt = rows.withColumn("__run", run_of(spread))
    by_run = dealt.select("__run", key).distinct().join(verdicts, key)
    return dealt.join(by_run, ["__run", key]).drop("__run")


#: Bits of a bucket of a bitmap, as bitmap_bit_position() counts them, and the most buckets: 2^28 bits, or 32 MB.
BUCKET_BITS, MOST_BUCKETS = 32_768, 8_192


def marked(rows: DataFrame, key: Column, chosen: DataFrame, chosen_key: Column) -> DataFrame:
    """`rows` with `__may`: whether `key` (a long) may be among `chosen_key` of the written `chosen`; never false for one that is.

    A bitmap of hashes, about 32 bits for each chosen row and 32 MB at most, is broadcast; so texts that aren't chosen take
    part in no shuffle, and the few that only seem to be are sorted out by the join that follows.
    """
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * BUCKET_BITS < 32 * chosen.count():
        buckets *= 2
    bit = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets * BUCKET_BITS))
    bucket, place = F.floor(F.col("__bit") / BUCKET_BITS).cast("int").alias("__bucket"), F.col("__bit") % BUCKET_BITS
    maps = written(chosen.select(bit(chosen_key).alias("__bit")).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias("__bits")), "bitmap")
    placed = rows.withColumn("__bit", bit(key)).withColumn("__bucket", bucket).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = placed.withColumn("__byte", byte).withColumn("__may", F.coalesce(F.expr("shiftright(__byte, cast(__bit % 8 AS int)) & 1 = 1"), F.lit(False)))
    return may.drop("__bucket", "__bit", "__bits", "__byte")


def drop_rows(docs: DataFrame, drop: DataFrame, repeats: DataFrame, key: str, made: Column) -> DataFrame:
    """`docs` without the rows whose (doc_id, `made`) is in `drop`, and with one row for each in `repeats`.

    drop, repeats: (doc_id, key), both already written. `repeats` names pairs that stay but occur in
    several equal rows.
    """
    inner = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", made.alias("__made"))
    same = lambda a: a["doc_id"].eqNullSafe(F.col("__id")) & (a["__made"] == F.col("__key"))
    named = lambda other: other.select(F.col("doc_id").alias("__id"), F.col(key).alias("__key"))
    both = written(named(drop).withColumn("__drop", F.lit(True)).unionByName(named(repeats).withColumn("__drop", F.lit(False))), "verdicts")
    keyed = marked(inner, F.xxhash64("doc_id", "__made"), both, F.xxhash64("__id", "__key"))
    asked = keyed.where("__may").drop("__may")
    out = keyed.where("NOT __may").drop("__may").unionByName(asked.join(both, same(asked), "left_anti"))
    if not repeats.isEmpty():
        out = out.unionByName(asked.join(both.where("NOT __drop"), same(asked), "left_semi").dropDuplicates(["doc_id", "__made"]))
    return out.select("__doc.*")
