"""Audio features: polyphase resampling, overlapped log-mel frames and hysteresis energy segments.

Media are RIFF/WAVE with 8-bit unsigned samples. Features of one recording are a fixed-shape Arrow tensor array (one
tensor for each stretch of ``frames`` frames) with its time spans; memory is bounded by a block of frames.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import written


@dataclass(frozen=True)
class AudioSettings:
    """Rates in Hz, window and hop in samples of the target rate, levels in dB below full scale."""

    rate: int = 16000
    target_rate: int = 8000
    taps: int = 16
    window: int = 256
    hop: int = 128
    mels: int = 32
    frames: int = 32
    on_db: float = -14.0
    off_db: float = -20.0
    block: int = 2048


def encode_wav(samples: bytes, rate: int) -> bytes:
    """A mono 8-bit WAVE of these samples; lossless."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = fmt + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; ValueError for what isn't mono 8-bit PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE stream")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def resampler(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass, as [phase, tap]; each phase sums to 1."""
    size = up * taps * max(1, down // up)
    t = np.arange(size) - (size - 1) / 2
    edge = 1 / max(up, down)
    h = edge * np.sinc(t * edge) * np.hamming(size)
    phases = h.reshape(-1, up).T
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, first: int, last: int, up: int, down: int, taps: int) -> np.ndarray:
    """Outputs first to last of the recording at up/down of its rate; silence beyond its ends."""
    filters = resampler(up, down, taps)
    width = filters.shape[1]
    n = np.arange(first, last)
    at, phase = n * down // up, n * down % up
    low, high = int(at[0]) - width + 1, int(at[-1]) + 1
    block = np.zeros(high - low, dtype=np.float32)
    a, b = max(low, 0), min(high, len(samples))
    if a < b:
        block[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(block, width)
    out = np.empty(last - first, dtype=np.float32)
    for p in range(up):
        mine = np.flatnonzero(phase == p)
        if len(mine):
            rows = windows[int(at[mine[0]]) - low - width + 1 :: down][: len(mine)]
            out[mine] = rows @ filters[p][::-1]
    return out


@lru_cache(8)
def mel_filters(rate: int, window: int, mels: int) -> np.ndarray:
    """Triangles equally spaced in mel, as [bin, filter]."""
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(window // 2 + 1) * rate / window
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: np.ndarray, s: AudioSettings) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows [frame, mel] and each frame's energy in dB; a last part frame is filled with silence."""
    gcd = math.gcd(s.target_rate, s.rate)
    up, down = s.target_rate // gcd, s.rate // gcd
    total = max(1, -(-len(samples) * up // down))
    count = 1 + max(0, -(-(total - s.window) // s.hop))
    shape = np.hanning(s.window + 1)[:-1].astype(np.float32)
    mels, energy = np.empty((count, s.mels), dtype=np.float32), np.empty(count, dtype=np.float32)
    for f in range(0, count, s.block):
        g = min(count, f + s.block)
        y = resample(samples, f * s.hop, (g - 1) * s.hop + s.window, up, down, s.taps)
        frames = np.lib.stride_tricks.sliding_window_view(y, s.window)[:: s.hop]
        frames = frames - frames.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(frames * shape, axis=1)).astype(np.float32) ** 2
        mels[f:g] = np.log(power @ mel_filters(s.target_rate, s.window, s.mels) + np.float32(1e-6))
        energy[f:g] = 10 * np.log10((frames**2).mean(axis=1) + np.float32(1e-10))
    return mels, energy


def active_spans(energy: np.ndarray, on_db: float, off_db: float) -> list[tuple[int, int]]:
    """Frame spans that begin at a level of on_db or more and last until one under off_db."""
    mark = np.where(energy >= on_db, 1, np.where(energy < off_db, 0, -1))
    settled = np.where(mark >= 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(settled)
    on = np.concatenate([[0], np.where(last >= 0, mark[last], 0), [0]])
    edges = np.diff(on)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def tensors(mels: np.ndarray, s: AudioSettings) -> bytes:
    """An Arrow stream: fixed-shape tensors [frames, mels] (the last one zero-filled) with start_ms and end_ms."""
    count = -(-len(mels) // s.frames)
    filled = np.zeros((count * s.frames, s.mels), dtype=np.float32)
    filled[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), (s.frames, s.mels))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), s.frames * s.mels)
    starts = np.arange(count) * s.frames
    ms = 1000 * s.hop / s.target_rate
    ends = (np.minimum(starts + s.frames, len(mels)) - 1) * ms + 1000 * s.window / s.target_rate
    batch = pa.record_batch([pa.ExtensionArray.from_storage(kind, flat), pa.array(starts * ms), pa.array(ends)], names=["log_mel", "start_ms", "end_ms"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def record(media: bytes, s: AudioSettings) -> list:
    """What is stored of a recording: tensors, number of frames, mean level in dB, active spans in ms."""
    samples, _ = decode_wav(media)
    mels, energy = log_mel(np.frombuffer(samples, dtype=np.uint8), s)
    ms = 1000 * s.hop / s.target_rate
    spans = active_spans(energy, s.on_db, s.off_db)
    return [tensors(mels, s), len(mels), float(energy.mean()), [a * ms for a, _ in spans], [b * ms for _, b in spans]]


def frames_of(stream: bytes, count: int) -> np.ndarray:
    """The first ``count`` log-mel rows of a stream of tensors."""
    column = pa.ipc.open_stream(stream).read_all().column("log_mel").combine_chunks()
    return column.to_numpy_ndarray().reshape(-1, column.type.shape[1])[:count]


def feature_text(stream: bytes, count: int, level: float, starts: list[float], ends: list[float]) -> str:
    """A short text that stands for stored tensors and active spans."""
    mels, spans = frames_of(stream, count), list(zip(starts, ends, strict=True))
    rounded = np.round(mels.astype(np.float64).mean(axis=0), 2)
    digest = hashlib.sha256(np.round(mels, 2).tobytes() + repr(spans).encode()).hexdigest()[:32]
    return f"frames={count};active={len(spans)};level={level:.2f};mel={','.join(f'{v:.2f}' for v in rounded[:: max(1, mels.shape[1] // 8)])};sha={digest}"


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)
SPANS = [T.StructField("active_start_ms", T.ArrayType(T.DoubleType())), T.StructField("active_end_ms", T.ArrayType(T.DoubleType()))]
TENSORS = [T.StructField("tensors", T.BinaryType()), *SPANS, T.StructField("media", T.BinaryType())]
STORED = T.StructType([*FEATURES.fields[:2], T.StructField("media", T.BinaryType()), TENSORS[0], T.StructField("frames", T.LongType()), T.StructField("level", T.DoubleType()), *SPANS])
_SPANS = [pa.list_(pa.float64())] * 2


def text_audio_features(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: int = 576, settings: AudioSettings | None = None, keep_tensors: bool = True
) -> DataFrame:
    """Each text's UTF-8 bytes as a recording, and that recording's features, both stored and read back.

    The payload is the bytes, filled with 255 to a positive multiple of ``unit``. Null and empty texts are one unit of
    255. Equal texts give equal values, whatever stands beside them. Repeated rows and null ids pass through; other
    columns are not read; an empty table gives no rows. Waves, Arrow streams of tensors and active spans are written to
    the shared folder; sizes, digests and features come from there. ``keep_tensors`` adds what is stored. No shuffle.
    """
    s = settings or AudioSettings()
    schema = T.StructType(FEATURES.fields + (TENSORS if keep_tensors else []))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, len(ids), 500):
                rows = []
                for raw in batch.column(1).slice(at, 500).cast(pa.binary()).to_pylist():
                    raw = raw or b""
                    media = encode_wav(raw + b"\xff" * (-len(raw) % unit or (0 if raw else unit)), s.rate)
                    rows.append([len(raw), media, *record(media, s)])
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), *_SPANS]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 500), *columns], names=STORED.names)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for media, *kept in zip(*[c.to_pylist() for c in part.columns[2:]], strict=True):
                    payload, _ = decode_wav(media)
                    rows.append([len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(*kept)])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                more = [part.column(STORED.names.index(f.name)) for f in TENSORS] if keep_tensors else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, *more], names=schema.names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(store, STORED), "audio", "zstd").mapInArrow(load, schema)
