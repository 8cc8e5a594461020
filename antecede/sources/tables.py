"""Tables in the shared folder: written steps, immutable generations, exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.keys import table_fingerprint


_made: dict[str, str] = {}
#: The folder of the innermost `settled` that this thread is in.
_inner: ContextVar[str | None] = ContextVar("inner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset and everything runs on this machine, as in tests, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, for intermediate tables; it is deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = f"{shared_folder(spark)}/antecede-{app}"
        fs, p = _file(spark, _made[app])
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return _made[app]


def forget(spark: SparkSession) -> None:
    """Deletes all intermediate tables so far; results that were not written elsewhere are lost with them."""
    fs, p = _file(spark, work_folder(spark))
    fs.delete(p, True)
    fs.mkdirs(p)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has yet, among the intermediate tables; inside `settled` it goes with that."""
    return f"{_inner.get() or work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written; the intermediate tables that were written on the way are deleted then.

    So a long session holds its results and not what led to them. Calls may be nested: the inner result goes with the
    outer one's tables. A frame that was made inside and isn't the result can't be read after. Other threads, those of
    streams too, write outside.
    """
    path, inner = fresh_path(spark, label), fresh_path(spark, "inner")
    token = _inner.set(inner)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _inner.reset(token)
        remove(spark, inner)
    return spark.read.schema(df.schema).parquet(path)


def read_yearly_csv(spark: SparkSession, folder: str, schema: str, years: list[int]) -> DataFrame:
    """One CSV for each year, with a `year` column; fails if a year is absent or empty."""
    paths = [f"{folder}/{y}.csv" for y in years]
    df = spark.read.schema(schema).option("header", True).csv(paths).withColumn("year", F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})\.csv(?:/[^/]*)?$", 1).cast("int"))
    found = {r["year"] for r in df.groupBy("year").count().collect()}
    if missing := sorted({*years} - found):
        raise ValueError(f"no rows for {missing}")
    return df


def inspect_sources(spark: SparkSession, path: str, time: str, stale_days: int, now: str) -> DataFrame:
    """file, bytes, modified, rows, latest and issues (no times, stale) of each Parquet file; its data is read once, for one column."""
    df = spark.read.parquet(path)
    per = df.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified")).agg(F.count("*").alias("rows"), F.max(F.col(time).cast("timestamp")).alias("latest"))
    old = F.date_diff(F.to_date(F.lit(now)), F.to_date("latest")) > stale_days
    return per.withColumn("issues", F.filter(F.array(F.when(F.col("latest").isNull(), "no times"), F.when(old, "stale")), lambda x: x.isNotNull()))


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    fs, p = _file(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    fs, p = _file(spark, path)
    fs.delete(p, True)


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    return spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(fs.open(p)).decode() if fs.getFileStatus(p).getLen() else ""


def _current(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """Number of the newest pointer and its generations, the latest first; 0 and none before the first."""
    numbers = [int(x[8:-5]) for x in names(spark, root) if x.startswith("CURRENT-") and x.endswith(".json")]
    return (n := max(numbers, default=0)), json.loads(_get(spark, _pointer(root, n)))["generations"] if n else []


def _pointer(root: str, n: int) -> str:
    return f"{root}/CURRENT-{n:012d}.json"


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file unless the target is there. HDFS does both in one step; where renaming isn't atomic, publish from one place at a time."""
    fs, p = _file(spark, source)
    q = _file(spark, target)[1]
    return not fs.exists(q) and fs.rename(p, q)


def publish_generation(df: DataFrame, root: str, manifest: dict | None = None, keep: int = 2) -> str:
    """Writes a new immutable folder, then a new pointer, and removes all but the last `keep` generations.

    Pointers are numbered and never changed: one is written beside and renamed to the next number, so a reader sees it whole or not at all.
    Of two publishers only one gets a number; the other reads what that one published and takes the next, so neither loses a generation.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}")
    done = table_fingerprint(spark.read.parquet(f"{root}/{name}")).first()
    mine = {"name": name, "rows": done["rows"], "content": done["content"], "manifest": manifest or {}}
    while True:
        n, before = _current(spark, root)
        kept, beside = [mine, *before], f"{root}/.pointer-{name}-{n}"
        _put(spark, beside, json.dumps({"generations": kept[:keep]}))
        if _moved(spark, beside, _pointer(root, n + 1)):
            break
        fs, p = _file(spark, beside)
        fs.delete(p, False)
    for old in [f"{root}/{x['name']}" for x in kept[keep:]] + [_pointer(root, n - keep)]:
        fs, p = _file(spark, old)
        fs.delete(p, True)
    return name


def read_generation(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The current generation (or one before it), whose content is checked against the pointer."""
    now = _current(spark, root)[1]
    if len(now) <= back:
        raise ValueError(f"{root} has no such generation")
    df = spark.read.parquet(f"{root}/{now[back]['name']}")
    found = table_fingerprint(df).first()
    if (found["rows"], found["content"]) != (now[back]["rows"], now[back]["content"]):
        raise ValueError(f"{root}/{now[back]['name']} isn't what was published")
    return df


def export(df: DataFrame, path: str, form: str) -> None:
    """`parquet` (gzip), `json` or `csv`."""
    writer = df.write.option("compression", "gzip") if form == "parquet" else df.write.option("header", True)
    writer.format(form).save(path)


def flatten_fixtures(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each fixture of a nested document; lineups sorted by player."""
    schema = "id string, begin_at string, number_of_games int, opponents array<struct<opponent:struct<id:string,name:string>>>, lineup array<struct<id:string,name:string,role:string>>"
    x = df.withColumn("f", F.from_json(payload, schema))
    name = lambda k: F.try_element_at(F.col("f.opponents"), F.lit(k)).getField("opponent").getField("name")
    return x.select(F.col("f.id").alias("fixture"), F.try_to_timestamp("f.begin_at").alias("begin_at"), F.col("f.number_of_games").alias("best_of"), name(1).alias("team_a"), name(2).alias("team_b"), F.to_json(F.array_sort(F.coalesce("f.lineup", F.array()))).alias("lineup"))


def flatten_markets(df: DataFrame, payload: str = "payload") -> DataFrame:
    """event, market, outcome, token: parallel arrays zipped; a market whose arrays differ in length, or a bad document, is a row with `failure`."""
    schema = "id string, markets array<struct<id:string,outcomes:array<string>,tokens:array<string>>>"
    x = df.withColumn("e", F.from_json(payload, schema)).withColumn("m", F.explode_outer("e.markets"))
    fail = F.when(F.col("e.id").isNull(), "unreadable").when(F.col("m").isNull(), "no markets").when(F.size("m.outcomes") != F.size("m.tokens"), "arrays differ")
    x = x.withColumn("failure", fail)
    pairs = F.when(F.col("failure").isNull(), F.arrays_zip(F.col("m.outcomes").alias("outcome"), F.col("m.tokens").alias("token")))
    return x.select(F.col("e.id").alias("event"), F.col("m.id").alias("market"), "failure", F.explode_outer(pairs).alias("p")).select("event", "market", "failure", F.col("p.outcome").alias("outcome"), F.col("p.token").alias("token"))


def flatten_books(df: DataFrame, payload: str = "payload") -> DataFrame:
    """token, side, price, size, issue: levels of order books; a crossed book marks all its levels."""
    level = "array<struct<price:string,size:string>>"
    x = df.withColumn("b", F.from_json(payload, f"asset_id string, bids {level}, asks {level}"))
    top = lambda c: F.array_max(F.transform(c, lambda l: l["price"].try_cast("double")))
    low = lambda c: F.array_min(F.transform(c, lambda l: l["price"].try_cast("double")))
    x = x.withColumn("crossed", F.coalesce(top(F.col("b.bids")) >= low(F.col("b.asks")), F.lit(False)))

    def levels(side: str):
        return F.transform(F.coalesce(f"b.{side}s", F.array()), lambda l: F.struct(F.lit(side).alias("side"), l["price"].try_cast("double").alias("price"), l["size"].try_cast("double").alias("size")))

    both = F.concat(levels("bid"), levels("ask"))
    y = x.select(F.col("b.asset_id").alias("token"), "crossed", F.explode(both).alias("l")).select("token", "crossed", "l.*")
    bad = F.when(F.col("crossed"), "crossed").when(~F.coalesce((F.col("price") > 0) & (F.col("price") < 1), F.lit(False)), "price").when(~F.coalesce(F.col("size") > 0, F.lit(False)), "size")
    return y.select("token", "side", "price", "size", bad.alias("issue"))
