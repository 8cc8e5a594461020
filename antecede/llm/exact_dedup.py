"""Operator 5: exact deduplication by a tree-merge of sorted digest runs, in built-in functions only.

Rows are dealt into 256 runs by a hash of their identifier, as they lie: no digest decides where. Within
a run equal digests become one entry with its best identifier and its size, and the run is written sorted
by (cut, digest), where a cut is a range of the digest's first 12 bits. Then come binomial rounds: in each,
FAN_IN partner runs are exchanged, cut by cut, to the task that merges them; there they are put in one
order and neighbours with equal keys become one entry, whose identifier is the best of both and whose size
is their sum. The merged run is written sorted again, so the next round exchanges what this one left, and
a lost executor costs a round at most. After the last round one run is left, in 4,096 cuts. A key holds the
SHA-256 digest with the text's length and an independent 64-bit hash, so every merge at every level verifies
more than the digest. What a round moves is one entry of some 60 bytes for each text and run that is left.

The verdict goes back down: from the last run to each first run's entry, and from there to the rows, so a
text with a third of all rows is spread over all runs in both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.llm.common import RUNS, ascii_lower, drop_rows, run_of, text_of, written

KEY = ["digest", "n_bytes", "witness"]
#: Runs that are merged into one, and by which a sorted run is in order inside its file.
FAN_IN, ORDER = 16, ["run", "cut", *KEY]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, tag, run and the key of each row, written once; `tag` tells equal rows apart."""
    text = ascii_lower(text_of())
    rows = docs.select("doc_id", text.alias("normal")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("tag"),
        run_of(F.col("doc_id")).alias("run"),
        F.unhex(F.sha2("normal", 256)).alias("digest"),
        F.octet_length("normal").alias("n_bytes"),
        F.xxhash64("normal").alias("witness"),
    )
    return written(rows.withColumn("run", F.when(F.col("doc_id").isNull(), F.pmod("tag", F.lit(RUNS))).otherwise(F.col("run")).cast("int")), "digests")


def sorted_runs(entries: DataFrame, label: str) -> DataFrame:
    """`entries` (run, cut, key, keep, size) exchanged by run and cut, merged with their equals, written in order."""
    met = entries.repartition("run", "cut").sortWithinPartitions(*ORDER)
    merged = met.groupBy(*ORDER).agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))
    return written(merged.sortWithinPartitions(*ORDER), label)


def levels(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> list[DataFrame]:
    """The sorted runs of each level: the first, that of the tasks' own entries, and one for each round, to a single run."""
    cut = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 4).alias("cut")
    entries = rows.groupBy("run", cut, *KEY).agg(F.max(F.struct("doc_id", "tag")).alias("keep"), F.count("*").alias("size"))
    out = [written(entries.sortWithinPartitions(*ORDER), "runs-0")]
    while runs > 1:
        runs = -(-runs // fan_in)
        partner = F.floor(F.col("run") / fan_in).cast("int")
        out.append(sorted_runs(out[-1].withColumn("run", partner), f"runs-{len(out)}"))
    return out


def groups(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, tag, digest, witness, keep_id, group_size, kept: one row for each row of `docs`."""
    rows = digests(docs)
    first, *_, last = levels(rows, RUNS, fan_in)
    verdicts = first.select("run", *KEY).join(last.select(*KEY, "keep", "size"), KEY)
    return rows.join(verdicts, ["run", *KEY]).select(
        "doc_id", "tag", "digest", "witness", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("tag") == F.col("keep.tag")).alias("kept")
    )


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    Texts are equal if they are after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id stays (null is the smallest; of rows equal in both, any one stays, and only one).
    Other columns are not read.
    """
    return groups(docs, fan_in).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay; of equal rows one. Nulls, ties and empty tables as above."""
    pairs = groups(docs, fan_in).groupBy("doc_id", "witness").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    pairs = written(pairs, "verdicts")
    return drop_rows(docs, pairs.where("NOT kept"), pairs.where("kept AND n > 1"), "witness", F.xxhash64(ascii_lower(text_of())))
