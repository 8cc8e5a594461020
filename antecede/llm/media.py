"""Operator 9: media columns. Texts as sound: WAV by the wave module, and spectral-peak fingerprints.

A document's bytes become the samples of an 8-bit mono WAV file, which is a column of the table. A
file is read back by the wave module; a short-time Fourier transform gives its spectrogram; in each
band of each frame the strongest bin that stands out from its neighbours is a peak, and each peak is
paired with the next ones after it. A pair of two bins and the time between them is a code, kept with
its time as one long: time << 32 | code.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.llm.common import mapped, slices, text_of

UNIT = 192
RATE = 8000
WINDOW, HOP = 192, 96
#: Bands of bins, each with one peak a frame at most; 0 is the level.
BANDS = ((1, 12), (12, 36), (36, 97))
#: A peak is so many times its band's mean.
STANDS_OUT = 2.5
#: Peaks after one that it is paired with.
FAN = 2
#: Frames that are transformed at a time.
FRAMES = 8192


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each peak, in order."""
    shape = np.hanning(WINDOW).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    when, what = [], []
    for a in range(0, len(frames), FRAMES):
        power = np.abs(np.fft.rfft((frames[a : a + FRAMES].astype(np.float32) - 128) * shape, axis=1)).astype(np.float32)
        for low, high in BANDS:
            band = power[:, low:high]
            top = band.argmax(1)
            out = np.flatnonzero(band[np.arange(len(band)), top] > STANDS_OUT * band.mean(1) + 1e-3)
            when.append(out + a)
            what.append(top[out] + low)
    t, f = np.concatenate(when), np.concatenate(what)
    order = np.lexsort((f, t))
    return t[order], f[order]


def codes(samples: np.ndarray) -> np.ndarray:
    t, f = peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        if len(t) > k:
            gap = np.minimum(t[k:] - t[:-k], 0xFFFF)
            out.append(t[:-k].astype(np.int64) << 32 | f[:-k].astype(np.int64) << 24 | f[k:].astype(np.int64) << 16 | gap)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the WAV file that holds the text's bytes and blanks up to a positive multiple of UNIT.

    A null text counts as empty, so its payload is UNIT blanks; one row for each row of `docs`.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [x or b"" for x in batch.column("raw").to_pylist()]
            media = [to_wav(x + b" " * (-len(x) % UNIT if x else UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.encode(text_of(text), "UTF-8").alias("raw")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media sizes and digests, and `codes` as read back from the stored files."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "codes": pa.list_(pa.int64())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for stored in batch.column("media"):
                stored = stored.as_py()
                payload = from_wav(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), codes(np.frombuffer(payload, np.uint8))))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True))], ["doc_id", "n_bytes", *kinds])

    return mapped(media, read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codes array<long>", "features")


def media_report(docs: DataFrame) -> DataFrame:
    """The features, with the time-coded `codes` themselves and `feature`: how many, and the digest of their values in order.

    Equal texts give equal values; a null text counts as empty; no rows give no rows. Other columns are not read.
    """
    rows = media_features(to_media(docs))
    feature = F.concat_ws(":", F.size("codes").cast("string"), F.sha2(F.array_join(F.transform("codes", lambda x: x.cast("string")), ","), 256))
    return rows.withColumn("feature", feature)
