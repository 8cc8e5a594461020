"""Operator 2: best-fit packing by minimum bin slack.

Bins are filled one at a time: the longest piece left goes in, and subset-sum dynamic programming
over a bitset of reachable totals finds the fullest combination of the lengths left beside it. The
same combination is then repeated as often as the counts of its lengths allow, so the search runs
over the histogram of lengths, which has at most `capacity` rows however many documents there are.
Pieces are matched to places by their rank within their length; ranks come from counts of salted
groups, so a length that many pieces share is not ordered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from antecede.llm.common import mapped, run_of, slices, sized_broadcast, written
from antecede.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and `end_id`, cut into pieces of `capacity`; the last may be shorter."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in slices(batches):
            rows: list[tuple] = []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.batch(texts), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select("doc_id", "text"), cut, PIECES, "pieces")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths left (longest first), how many of each fill `room` best; longer ones are tried first.

    Bit t of the set is 1 if some choice has total t. Each step adds up to 2^k pieces of one length;
    the sets before each step are kept until the choice is read off backwards.
    """
    goal, reach, steps = 1 << room, 1, []
    mask = 2 * goal - 1
    for length in lengths[bisect.bisect_left(lengths, -room, key=lambda x: -x) :]:
        left = min(counts[length], room // length)
        part = 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach = (reach | reach << length * part) & mask
            left -= part
            part *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            chosen[length] = chosen.get(length, 0) + part
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, pieces of each length) until no piece is left; at least one length runs low with each."""
    counts, out = {x: n for x, n in counts.items() if n}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        bin_ = fullest(lengths, counts, capacity - longest)
        counts[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in bin_.items())
        for x, n in bin_.items():
            counts[x] -= n * times
            if not counts[x]:
                lengths.remove(x)
        out.append((times, bin_))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A null text counts as empty and gives one piece, the end id; a null doc_id stays null; repeated
    rows are packed each; no rows give no rows. Other columns are not read. Only the histogram of
    lengths, at most `capacity` rows, comes to the driver, and only the patterns found from it, which
    it bounds too, are broadcast.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer, capacity, end_id)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, first, taken = [], 0, dict.fromkeys(counts, 0)
    for times, bin_ in patterns(counts, capacity):
        offset = 0
        for length, n in sorted(bin_.items(), reverse=True):
            slots.append((length, taken[length], taken[length] + n * times, n, first, offset))
            taken[length] += n * times
            offset += n * length
        first += times
    places = sized_broadcast(written(spark.createDataFrame(slots, "length long, low long, high long, each long, first long, base long"), "places"))

    salted = pieces.withColumn("run", run_of(F.struct("doc_id", "piece", "ids_crc32")))
    sizes = salted.groupBy("length", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # A salted group spans few of its length's slots; only those meet its pieces.
    spans = starts.join(places, "length").where("low < from + n AND from < high")
    spans = spans.groupBy("length", "run").agg(F.first("from").alias("from"), F.sort_array(F.collect_list(F.struct("low", "each", "first", "base"))).alias("slots"))
    order = Window.partitionBy("length", "run").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(spans, ["length", "run"])
    at = ranked.withColumn("rank", F.col("rank") + F.col("from")).withColumn("slot", F.expr("element_at(filter(slots, s -> s.low <= rank), -1)"))
    inside = F.col("rank") - F.col("slot.low")
    return at.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first") + F.floor(inside / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.base") + inside % F.col("slot.each") * F.col("length")).cast("long").alias("offset"),
    )
