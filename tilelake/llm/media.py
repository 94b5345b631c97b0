"""Media columns: bytes stored as WAV, and spectral-peak pair fingerprints of the samples read back.

A payload becomes a mono WAV of unsigned 8-bit samples through the wave module. From the samples that wave reads back,
short-time Fourier transforms (Hann window, WINDOW samples, HOP apart) give a spectrogram; its local maxima in time and
frequency are peaks, and each peak is paired with the next FAN peaks within REACH frames. A pair's code holds both
frequencies and their distance in time; the fingerprint is the array of (time, code), in order of time.

A document is transformed in blocks of BLOCK_FRAMES frames, each with NEAR_FRAMES more to both sides, and only its peaks
are kept: some 7 bytes of memory for each byte of a long text, the stored bytes included. No row needs another, and the
scan needs no shuffle.

Defined results: a null text is stored like an empty one, as one run of padding; repeated rows and equal texts have equal
values; null ids pass through; a payload shorter than a window is padded with silence for the transform only; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.common import slices, table

RATE, UNIT, PAD = 8000, 192, b" "
WINDOW, HOP, BLOCK_FRAMES = 256, 128, 1024
#: Peaks: largest among so many frames and bins to each side; loudness in steps of log2; pairs.
NEAR_FRAMES, NEAR_BINS, LEVELS, FAN, REACH = 2, 6, 8, 3, 32
SILENCE = 128

_taper = np.hanning(WINDOW).astype(np.float64)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def frames(samples: np.ndarray) -> np.ndarray:
    """A view of all windows; less than one window is filled up with silence."""
    if len(samples) < WINDOW:
        samples = np.concatenate([samples, np.full(WINDOW - len(samples), SILENCE, samples.dtype)])
    return np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]


def loudness(block: np.ndarray) -> np.ndarray:
    """Loudness of each frame and frequency bin, in whole steps."""
    power = np.abs(np.fft.rfft((block.astype(np.float64) - SILENCE) * _taper, axis=1))
    return np.floor(LEVELS * np.log2(1 + power) + 1e-6).astype(np.int16)


def _largest_near(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Largest value within reach along an axis."""
    out = x.copy()
    for d in range(1, reach + 1):
        if axis:
            np.maximum(out[:, d:], x[:, :-d], out=out[:, d:])
            np.maximum(out[:, :-d], x[:, d:], out=out[:, :-d])
        else:
            np.maximum(out[d:], x[:-d], out=out[d:])
            np.maximum(out[:-d], x[d:], out=out[:-d])
    return out


def peaks(loud: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and bins of local maxima, in order of time; of equal neighbours the first in time, then frequency, is one."""
    x = loud[:, 1:].astype(np.int32)
    order = np.arange(x.size, 0, -1, dtype=np.int64).reshape(x.shape)
    ranked = x.astype(np.int64) * (x.size + 1) + order
    top = _largest_near(_largest_near(ranked, NEAR_FRAMES, 0), NEAR_BINS, 1)
    time, bin_ = np.nonzero((ranked == top) & (x > 0))
    return time, bin_ + 1


def pairs(time: np.ndarray, bin_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and code of each peak with the next FAN ones: 7 bits for each bin, 6 for their distance."""
    when, code = [], []
    for k in range(1, FAN + 1):
        gap = time[k:] - time[:-k]
        near = gap < REACH
        when.append(time[:-k][near])
        code.append((((bin_[:-k] - 1) << 13) | ((bin_[k:] - 1) << 6) | gap)[near])
    when, code = np.concatenate(when), np.concatenate(code)
    order = np.lexsort((code, when))
    return when[order].astype(np.int32), code[order].astype(np.int32)


def all_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of the whole spectrogram, of which only a block at a time exists."""
    every, found = frames(samples), []
    for lo in range(0, len(every), BLOCK_FRAMES):
        first = max(lo - NEAR_FRAMES, 0)
        time, bin_ = peaks(loudness(every[first : lo + BLOCK_FRAMES + NEAR_FRAMES]))
        time += first
        own = (time >= lo) & (time < lo + BLOCK_FRAMES)
        found.append((time[own].astype(np.int32), bin_[own].astype(np.int32)))
    return tuple(map(np.concatenate, zip(*found)))


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    return pairs(*all_peaks(np.frombuffer(samples, np.uint8)))


_COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_sha256 string, times array<int>, codes array<int>"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            out: dict[str, list] = {c.split()[0]: [] for c in _COLUMNS.split(", ")}
            for text in part.column("text").to_pylist():
                payload = (text or "").encode()
                n = len(payload)
                payload += PAD * (max(UNIT, -(-n // UNIT) * UNIT) - n)
                media = to_wav(payload)
                del payload
                payload = from_wav(media)
                times, codes = fingerprint(payload)
                row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media, hashlib.sha256(media).hexdigest(), times, codes)
                for c, v in zip(out.values(), row):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch({"doc_id": part.column("doc_id"), **{c: pa.array(v, t) for (c, v), t in zip(out.items(), types)}})


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, sizes and hashes, media (the WAV), times and codes."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}"
    return docs.select("doc_id", "text").mapInArrow(_store, schema)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(" ", F.zip_with("times", "codes", lambda t, c: F.concat(t.cast("string"), F.lit(":"), c.cast("string"))))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), "media_sha256", feature.alias("feature"))
