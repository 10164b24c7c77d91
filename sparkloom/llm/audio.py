"""Media columns: payloads stored as 8-bit audio, and log-mel features with speech-like segments.

``encode_wav`` stores any bytes losslessly as unsigned 8-bit mono samples of a WAV file, with SQL functions alone.
``audio_features`` reads the stored bytes back, resamples them by a polyphase filter, takes overlapped log-mel
filterbanks and cuts the time axis by energy with hysteresis (a segment opens above one level and closes
below a lower one). Log-mels come as Arrow fixed-shape tensors of ``TENSOR_FRAMES`` frames by ``MELS`` bands in an Arrow
stream, each row with its time span; the last tensor of a clip is padded with the floor value.

Each clip is computed by itself, so equal texts give equal values whatever stands beside them.

Defined cases: null or empty text is one block of 64 zero bytes; a null doc_id is carried along; repeated rows
repeat; a long clip is one row, whose bytes are read whole but are resampled and transformed ``FRAMES_AT_ONCE`` frames at a
time, so a clip takes some ten times its bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, with_text

RATE = 16_000
UP, DOWN = 1, 2
TAPS = 12
FRAME, HOP, FFT = 200, 80, 256
MELS = 20
TENSOR_FRAMES = 32
#: Frames that are resampled and transformed at once.
FRAMES_AT_ONCE = 1024
FLOOR = 1e-6
#: Of the range between a clip's quietest and loudest frame: where a segment opens and closes.
OPEN_AT, CLOSE_AT = 0.6, 0.4
BLOCK = 64


def padded(text: Column) -> Column:
    """The UTF-8 bytes of a text with zero bytes up to a positive multiple of ``BLOCK``."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.greatest(F.lit(BLOCK), F.ceil(F.octet_length(raw) / BLOCK).cast("int") * BLOCK)
    return F.rpad(raw, size, F.lit(b"\0"))


def _little(n: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]))


def encode_wav(payload: Column, rate: int = RATE) -> Column:
    """A WAV file of 8-bit mono samples around a payload of even length."""
    size = F.octet_length(payload).cast("long")
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(F.lit(b"RIFF"), _little(size + 36), F.lit(b"WAVE" + form + b"data"), _little(size), payload)


def decode_wav(stored: bytes) -> tuple[np.ndarray, int]:
    """Samples as they were stored and the sampling rate."""
    with wave.open(io.BytesIO(stored)) as w:
        if (w.getsampwidth(), w.getnchannels()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return np.frombuffer(w.readframes(w.getnframes()), np.uint8), w.getframerate()


@lru_cache
def low_pass(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold; ``taps`` lobes on each side."""
    widest = max(up, down)
    t = np.arange(-taps * widest, taps * widest + 1) / widest
    h = np.sinc(t) * np.hamming(len(t))
    return h * (up / h.sum())


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, first: int = 0, last: int | None = None) -> np.ndarray:
    """Resample by up / down: each output takes the one phase of the filter that meets stored samples.

    Only the outputs from ``first`` to before ``last`` are computed, from the samples that they need; 8-bit samples are
    taken from -1 to 1.
    """
    h = low_pass(up, down)
    half, total = len(h) // 2, -(-len(x) * up // down)
    last = total if last is None else min(last, total)
    out = np.zeros(max(0, last - first))
    for phase in range(up):
        # outputs m whose place m * down is phase modulo up: one in up
        start = next((m for m in range(first, first + up) if (m * down) % up == phase), None)
        if start is None or start >= last:
            continue
        m = np.arange(start, last, up)
        lag = np.arange(-((half - phase) // up) if half >= phase else 0, (half + phase) // up + 1)
        taps = h[half + phase - lag * up] if len(lag) else np.zeros(0)
        centre = (m * down - phase) // up
        begin, end = int(centre[0] + lag[0]), int(centre[-1] + lag[-1]) + 1
        part = x[max(0, begin) : max(0, end)]
        part = (part.astype(np.float64) - 128) / 128 if part.dtype == np.uint8 else part
        part = np.concatenate([np.zeros(max(0, -begin)), part, np.zeros(max(0, end - max(len(x), begin, 0)))])
        step = down if len(centre) > 1 else 1
        out[m - first] = np.lib.stride_tricks.sliding_window_view(part, len(lag))[::step][: len(m)] @ taps
    return out


@lru_cache
def mel_bank(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, over the bins of a real transform."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    left, top, right = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.clip(np.minimum((bins - left) / (top - left), (right - bins) / (right - top)), 0, None)


@lru_cache
def _window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1]


def _mels(frames: np.ndarray, rate: int) -> np.ndarray:
    power = np.abs(np.fft.rfft(frames * _window(), FFT)) ** 2
    return np.log(power @ mel_bank(rate).T + FLOOR)


def log_mels(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames by bands; a clip shorter than a frame is padded to one."""
    x = np.pad(x, (0, max(0, FRAME - len(x))))
    return _mels(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], rate)


def clip_mels(samples: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
    """Log-mels of 8-bit samples after resampling, and the new rate; a run of frames at a time."""
    n, rate = -(-len(samples) * UP // DOWN), rate * UP // DOWN
    frames = max(1, (n - FRAME) // HOP + 1)
    parts = [log_mels(resample(samples, UP, DOWN, i * HOP, (min(i + FRAMES_AT_ONCE, frames) - 1) * HOP + FRAME), rate) for i in range(0, frames, FRAMES_AT_ONCE)]
    return np.concatenate(parts), rate


def segments(energy: np.ndarray, open_at: float = OPEN_AT, close_at: float = CLOSE_AT) -> list[tuple[int, int]]:
    """Frames [start, end) of segments: opened at the upper level, kept until the lower one."""
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1e-9:
        return []
    level = (energy - low) / (high - low)
    # the last frame that is above the upper or below the lower level decides
    state = np.where(level >= open_at, 1, np.where(level < close_at, -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate([[False], np.where(known >= 0, state[known] > 0, False), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(mels: np.ndarray, rate: int) -> bytes:
    """An Arrow stream of fixed-shape tensors with their time spans in milliseconds."""
    n = -(-len(mels) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), math.log(FLOOR), np.float32)
    full[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TENSOR_FRAMES * MELS)
    start = np.arange(n) * TENSOR_FRAMES * HOP * 1000 / rate
    end = (np.minimum((np.arange(n) + 1) * TENSOR_FRAMES, len(mels)) - 1) * HOP * 1000 / rate + FRAME * 1000 / rate
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, storage), pa.array(start), pa.array(end)], names=["log_mel", "start_ms", "end_ms"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long, tensor binary, spans array<struct<start_ms:double,end_ms:double>>"


def audio_features(media: DataFrame, with_tensors: bool = True) -> DataFrame:
    """Features of stored clips (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.split()[0]: [] for f in FEATURES.split(", ")}
            for doc, n_bytes, clip in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stored = clip.as_buffer()
                samples, rate = decode_wav(stored)
                payload = samples.tobytes()
                mels, out_rate = clip_mels(samples, rate)
                cuts = segments(mels.mean(1))
                mean, spread = mels.mean(0), mels.std(0)
                ms = 1000 * HOP / out_rate
                row = {
                    "doc_id": doc,
                    "n_bytes": n_bytes,
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-BLOCK:]),
                    "media_bytes": len(stored),
                    "media_sha256": hashlib.sha256(stored).hexdigest(),
                    "feature": f"frames={len(mels)};segments={len(cuts)};active={sum(b - a for a, b in cuts)};mean=" + ",".join(f"{v:.2f}" for v in mean) + ";std=" + ",".join(f"{v:.2f}" for v in spread),
                    "n_frames": len(mels),
                    "n_segments": len(cuts),
                    "tensor": tensors(mels, out_rate) if with_tensors else None,
                    "spans": [{"start_ms": a * ms, "end_ms": b * ms} for a, b in cuts],
                }
                for k, v in row.items():
                    rows[k].append(v)
            kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
            fields = [pa.field(n, kinds[t]) for n, t in (f.split() for f in FEATURES.split(", ")[:-1])] + [pa.field("spans", pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in fields], schema=pa.schema(fields))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(trimmed(run), FEATURES)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the WAV file of each text."""
    return with_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), encode_wav(padded(F.col("text"))).alias("media"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_segments", F.octet_length("tensor").cast("long").alias("tensor_bytes"))
