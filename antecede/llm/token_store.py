"""Operator 10: token-id files with Elias-Fano encoded document boundaries.

Documents are put in order of doc_id by a range shuffle, and each task writes its stretch as one
file: all ids one after the other as they come, and then where each document ends, and the doc_ids.
Neither ever falls, so both are kept as Elias-Fano: the low bits of each number packed, and the rest in
unary in a bit vector, with the place of every SAMPLE-th one. `fetch` asks for single documents: it
finds a doc_id among them and its bounds by select, which decodes the few numbers between two samples,
so there is never a table of all offsets, and reads those ids alone. `read_token_files` reads whole
files and decodes the numbers block by block. A task that is run again writes a file of another name;
the manifest names those that count.
"""

from __future__ import annotations

import array
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from itertools import chain, repeat
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from antecede.llm.common import fresh_path, mapped, slices, text_of
from antecede.llm.encoding import encoder

MAGIC = b"EFTOKENS"
#: Every so many set bits of the upper part, the place of one is kept.
SAMPLE = 256
#: Ids, and documents, after which a file is closed and the next one begun.
FILE_IDS, FILE_DOCS = 1 << 27, 1 << 20
#: Ids that are read at a time, unless one document has more.
STRETCH = 1 << 20


class EliasFano:
    """Rising signed 64-bit numbers, as distances from the first: n * (2 + log2(span / n)) bits and the samples."""

    def __init__(self, n: int, width: int, first: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.first, self.low, self.high, self.samples = n, width, first, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, first = len(values), int(values[0]) if len(values) else 0
        # Unsigned, since the span of signed numbers may need all 64 bits.
        far = values.astype(np.int64).view(np.uint64) - np.array([first], np.int64).view(np.uint64)
        width = max(0, (int(far[-1]) // n).bit_length() - 1) if n else 0
        bits = far[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (far >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        return cls(n, width, first, low, np.packbits(flags, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def between(self, block: int) -> np.ndarray:
        """The numbers SAMPLE * block and on, up to the next sample: the set bits from one to the other, and their low bits."""
        begin = block * SAMPLE
        n = min(SAMPLE, self.n - begin)
        at = int(self.samples[block])
        upto = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        flags = np.unpackbits(self.high[at >> 3 : (upto + 7) >> 3], bitorder="little")[at & 7 :]
        upper = (np.flatnonzero(flags)[:n] + (at - begin) - np.arange(n)).astype(np.uint64)
        bit = begin * self.width
        bits = np.unpackbits(self.low[bit >> 3 : (bit + n * self.width + 7) >> 3], bitorder="little")[bit & 7 :][: n * self.width]
        lower = (bits.reshape(n, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return ((upper << np.uint64(self.width) | lower) + np.array([self.first], np.int64).view(np.uint64)).view(np.int64)

    def select(self, k: int) -> int:
        """The k-th number."""
        return int(self.between(k // SAMPLE)[k % SAMPLE])

    def find(self, value: int, start: int = 0) -> int:
        """Place of the first number from the `start`-th on that isn't below `value`; n if all are."""
        low, high = start, self.n
        while high - low > SAMPLE:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.select(middle) < value else (low, middle)
        for block in range(low // SAMPLE, -(-high // SAMPLE)):
            k = block * SAMPLE + int(np.searchsorted(self.between(block), value))
            if k < (block + 1) * SAMPLE:
                return max(low, min(k, high))
        return high

    def numbers(self) -> Iterator[int]:
        """All of them, decoded a block at a time."""
        for block in range(len(self.samples)):
            yield from self.between(block).tolist()

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, self.first, len(self.low), len(self.high), len(self.samples)], "<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, first, a, b, c = (int(x) for x in np.frombuffer(data, "<i8", 6))
        return cls(n, width, first, np.frombuffer(data, np.uint8, a, 48), np.frombuffer(data, np.uint8, b, 48 + a), np.frombuffer(data, "<u4", c, 48 + a + b))


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a shared path is, for a task: a mounted folder, or a store that pyarrow reaches."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class Writer:
    """A file: ids, boundaries, doc_ids, and at the end MAGIC, width of an id, ids, bytes of the boundaries and of the doc_ids, documents without doc_id."""

    def __init__(self, path: str, width: int, most: int = FILE_IDS):
        store, name = place(path)
        self.out, self.path, self.width, self.most = store.open_output_stream(name), path, width, most
        self.sizes, self.docs, self.missing, self.n = array.array("q"), array.array("q"), 0, 0

    def add(self, doc: int | None, ids: bytes) -> None:
        """Documents without doc_id come first."""
        self.out.write(np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes())
        self.sizes.append(len(ids) // 4)
        self.docs.append(0 if doc is None else doc)
        self.missing += doc is None
        self.n += len(ids) // 4

    def full(self) -> bool:
        return self.n >= self.most or len(self.docs) >= FILE_DOCS

    def close(self) -> tuple[str, int, int, int | None, int | None]:
        """path, documents, ids, least and greatest doc_id."""
        docs = np.frombuffer(self.docs, np.int64)[self.missing :]
        ends, names = EliasFano.of(np.cumsum(np.frombuffer(self.sizes, np.int64))).to_bytes(), EliasFano.of(docs).to_bytes()
        for part in (ends, names, MAGIC, np.array([self.width, self.n, len(ends), len(names), self.missing], "<i8").tobytes()):
            self.out.write(part)
        self.out.close()
        bounds = (int(docs[0]), int(docs[-1])) if len(docs) else (None, None)
        return self.path, len(self.sizes), self.n, *bounds


class Reader:
    """An open file: its boundaries and its doc_ids, as they are stored; documents without doc_id come first."""

    def __init__(self, f: pa.NativeFile, path: str):
        f.seek(f.size() - 48)
        tail = f.read(48)
        if tail[:8] != MAGIC:
            raise ValueError(f"{path} holds no token ids")
        self.f = f
        self.width, self.n, ends, names, self.missing = (int(x) for x in np.frombuffer(tail, "<i8", 5, 8))
        f.seek(self.width * self.n)
        self.ends, self.names = EliasFano.from_bytes(f.read(ends)), EliasFano.from_bytes(f.read(names))

    def ids(self, start: int, end: int) -> np.ndarray:
        self.f.seek(self.width * start)
        return np.frombuffer(self.f.read(self.width * (end - start)), f"<u{self.width}")

    def documents(self, stretch: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, its first id's place in the file, and its ids, which are read a stretch at a time."""
        start, low, held = 0, 0, np.zeros(0, f"<u{self.width}")
        for doc, end in zip(chain(repeat(None, self.missing), self.names.numbers()), self.ends.numbers(), strict=True):
            if end > low + len(held):
                low, held = start, self.ids(start, max(end, min(start + stretch, self.n)))
            yield doc, start, held[start - low : end - low]
            start = end

    def named(self, doc: int) -> Iterator[tuple[int, np.ndarray]]:
        """First id's place and ids of each document of that doc_id: two selects, and only those ids are read."""
        k = self.names.find(doc)
        while k < self.names.n and self.names.select(k) == doc:
            at = k + self.missing
            start = self.ends.select(at - 1) if at else 0
            yield start, self.ids(start, self.ends.select(at))
            k += 1


@contextmanager
def opened(path: str) -> Iterator[Reader]:
    store, name = place(path)
    with store.open_input_file(name) as f:
        yield Reader(f, path)


MANIFEST = "part int, file int, path string, n_docs long, n_tokens long, first_doc long, last_doc long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """The manifest, as MANIFEST: files in the order of doc_id (null first; equal ones by a hash of their text), and the least and greatest doc_id of each."""
    spark = docs.sparkSession
    folder = path or fresh_path(spark, "token-files")
    store, name = place(folder)
    store.create_dir(name, recursive=True)
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k, file = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        width = 2 if coder.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

        def closed(file: Writer) -> pa.RecordBatch:
            at, *numbers = file.close()
            longs = {name: pa.array([x], pa.int64()) for name, x in zip(("n_docs", "n_tokens", "first_doc", "last_doc"), numbers, strict=True)}
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([k], pa.int32()), "path": [at], **longs})

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                file = file or Writer(f"{folder}/{part:06d}-{k:06d}-{uuid.uuid4().hex}.ids", width, file_ids)
                file.add(doc, coder.encode(text) + end)
                if file.full():
                    yield closed(file)
                    k, file = k + 1, None
        if file:
            yield closed(file)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hash of the text beside doc_id, as very many rows may have none.
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = texts.repartitionByRange(width, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return mapped(ordered, write, MANIFEST, "manifest")


def read_token_files(manifest: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files. Starts count on from file to file: one row each to sum."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "first")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows = []
                with opened(path) as reader:
                    for doc, start, ids in reader.documents(stretch):
                        rows.append((doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    spread = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Ids that one Arrow batch of fetched documents holds, unless one document has more.
BATCH_IDS = 1 << 20


def fetch(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids (with the end id) of the documents whose doc_id is in `wanted`; equal doc_ids all come, unknown and null ones not.

    The driver gets the bounds of the parts, one row for each task that wrote: a doc_id is sent to the parts that may have it,
    there meets their files' bounds, and a file's wanted doc_ids are looked up in it together. Nothing else of a file is read
    but its boundaries and doc_ids.
    """
    parts = manifest.groupBy("part").agg(F.min("first_doc").alias("low"), F.max("last_doc").alias("high")).where("low IS NOT NULL").orderBy("part").collect()
    lows, highs, numbers = (np.array([r[k] for r in parts], np.int64) for k in ("low", "high", "part"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            # Parts are in order and share no more than their bounds, so those that may have a doc_id are neighbours.
            first, past = np.searchsorted(highs, doc, "left"), np.searchsorted(lows, doc, "right")
            many = np.maximum(past - first, 0)
            at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, many), pa.int64()), pa.array(numbers[at], pa.int32())], ["doc_id", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            docs, ids = zip(*rows, strict=True)
            sizes = [len(x) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

        with ExitStack() as stack:
            path, reader, rows, held = None, None, [], 0
            for batch in batches:
                for doc, at in zip(batch.column("doc_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                    if at != path:
                        stack.close()
                        path, reader = at, stack.enter_context(opened(at))
                    for _, ids in reader.named(doc):
                        rows.append((doc, ids))
                        held += len(ids)
                        if held >= BATCH_IDS:
                            yield batch_of(rows)
                            rows, held = [], 0
            if rows:
                yield batch_of(rows)

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    sent = asked.mapInArrow(send, "doc_id long, part int")
    files = manifest.select("part", "path", "first_doc", "last_doc").where("first_doc IS NOT NULL")
    found = sent.join(files, "part").where("doc_id BETWEEN first_doc AND last_doc").select("path", "doc_id")
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(width, "path").sortWithinPartitions("path", "doc_id").mapInArrow(read, "doc_id long, n_tokens long, ids array<int>")


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: one row for each row of `docs`, as read back from its files.

    A null text counts as empty and holds the end id alone; a null doc_id stays null and comes
    first; repeated rows are stored each; no rows write no files. Other columns are not read.
    """
    return read_token_files(write_token_files(docs, tokenizer, end_id))
