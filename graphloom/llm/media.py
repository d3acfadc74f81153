"""Media columns: texts stored as WAV, read back, and fingerprinted.

A text's UTF-8 bytes, padded with byte 255 to a positive multiple of FRAME,
are the samples of an 8-bit mono WAV written and read by the wave module.  A
short-time Fourier transform (Hann window of FRAME samples, half overlapping)
gives the strongest bin of each of four bands per frame; the two strongest
peaks of a frame are paired with the strongest of the next one.  A pair is kept
as its frame's number (time) and a code of both bins: time-coded arrays.

Frames of all texts of an Arrow batch are transformed together, FFT_BLOCK at a
time, so that memory doesn't grow with a text's length.

Defined results: a null text is empty, and an empty one is FRAME bytes of 255;
equal texts have equal values; a single frame has no pairs; repeated rows are
repeated; an empty table gives an empty result.
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

from graphloom.llm.store import table

FRAME = 576
HOP = FRAME // 2
RATE = 8000
#: Bins of the four bands; the first bin (the mean) is left out.
BANDS = ((1, 20), (20, 60), (60, 140), (140, FRAME // 2 + 1))
FFT_BLOCK = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME), len(raw)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def _peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest and second strongest band peak (bin) of every frame at HOP."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    first, second = np.empty(len(frames), np.int32), np.empty(len(frames), np.int32)
    for a in range(0, len(frames), FFT_BLOCK):
        block = (frames[a : a + FFT_BLOCK].astype(np.float32) - 128.0) * _WINDOW
        spectrum = np.fft.rfft(block, axis=1)
        power = np.rint(np.log2(spectrum.real**2 + spectrum.imag**2 + 1.0) * 8.0)
        bins = np.stack([power[:, lo:hi].argmax(1) + lo for lo, hi in BANDS], axis=1)
        height = np.take_along_axis(power, bins, axis=1)
        order = np.argsort(-height, axis=1, kind="stable")
        first[a : a + FFT_BLOCK] = np.take_along_axis(bins, order[:, :1], axis=1)[:, 0]
        second[a : a + FFT_BLOCK] = np.take_along_axis(bins, order[:, 1:2], axis=1)[:, 0]
    return first, second


def fingerprints(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(times, codes) of each payload."""
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    first, second = _peaks(samples)
    at, out = 0, []
    for p in payloads:
        n = len(p) // HOP - 1
        a, b = at // HOP, at // HOP + n
        later = first[a + 1 : b]
        codes = np.stack((first[a : b - 1] * 1024 + later, second[a : b - 1] * 1024 + later), axis=1).reshape(-1)
        out.append((np.repeat(np.arange(n - 1, dtype=np.int32), 2), codes.astype(np.int32)))
        at += len(p)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, at, size = [], 0, 0
        values = batch["text"].to_pylist()
        for i, text in enumerate(values):
            texts.append(text)
            size += len(text or "")
            if size > 1 << 22 or i + 1 == len(values):
                yield _rows(batch["doc_id"].slice(at, len(texts)), texts)
                at, texts, size = i + 1, [], 0


def _rows(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    made = [payload(t) for t in texts]
    stored = [to_wav(p) for p, _ in made]
    back = [from_wav(s) for s in stored]
    prints = fingerprints(back)
    columns = {
        "n_bytes": pa.array([n for _, n in made], pa.int64()),
        "payload_bytes": pa.array([len(b) for b in back], pa.int64()),
        "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
        "tail_crc32": pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
        "media_bytes": pa.array([len(s) for s in stored], pa.int64()),
        "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in stored]),
        "feature": pa.array([f"{len(t)}:{hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest()}" for t, c in prints]),
        "media": pa.array(stored, pa.binary()),
        "peak_times": pa.array([t for t, _ in prints], pa.list_(pa.int32())),
        "peak_codes": pa.array([c for _, c in prints], pa.list_(pa.int32())),
    }
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns.values()], ["doc_id", *columns])


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _without_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _features(batches):
        yield batch.select([c for c in batch.schema.names if c != "media"])


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Digests, fingerprints and, if asked for, the WAV bytes of each row of doc_id, text."""
    schema = SCHEMA + (", media binary" if with_media else "") + ", peak_times array<int>, peak_codes array<int>"
    return docs.select("doc_id", "text").mapInArrow(_features if with_media else _without_media, schema)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), with_media=False)
