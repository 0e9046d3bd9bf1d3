"""Audio columns: lossless 8-bit wave storage, polyphase resampling, log-mel patches and energy segments.

Payload bytes are stored as the unsigned 8-bit samples of a mono wave file (RIFF header of 44 bytes, then one byte a
sample), written as a binary column and read back. From the stored bytes: samples are resampled by a polyphase
windowed-sinc filter, cut into overlapped frames, and turned into log-mel filterbank values, which are laid out as
fixed-shape tensors of ``PATCH`` frames by ``MELS`` bands with their time spans. Frame energies are segmented with
hysteresis: a segment begins above the upper threshold and lasts until the energy falls below the lower one.

Long recordings are handled in blocks of frames with fixed borders, so memory doesn't follow their length and equal
payloads give equal features. Defined results: null texts are empty; an empty text is 192 blanks; recordings shorter
than a frame are one frame, the last frame is padded with zeros; the last patch is padded with the lowest value; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, raw_bytes, slices, written

UNIT, FILL = 192, b" "
RATE, UP, DOWN, TAPS = 16000, 2, 3, 24
FRAME, HOP, MELS, PATCH = 256, 128, 24, 64
BLOCK_FRAMES = 64 * 64
FLOOR = -10.0
#: Log-mel values are kept in steps of so many to a decade, which is finer than 8-bit samples tell.
STEPS = 64
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of the unit."""
    return text + FILL * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def wave(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return _HEADER.pack(b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\x80" * (n % 2)


def samples_of(media: bytes) -> bytes:
    """The payload of a stored wave: its chunks are walked to the samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def filter_taps(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates: (phase, tap)."""
    n = taps * up
    t = (np.arange(n) - (n - 1) / 2) / up
    cut = min(1.0, up / down)
    h = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1]
    phases = h.reshape(taps, up).T
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


_TAPS = filter_taps()


def resample(samples: np.ndarray, start: int, n: int, up: int = UP, down: int = DOWN, taps: np.ndarray = _TAPS) -> np.ndarray:
    """Outputs ``start`` to ``start + n`` of the resampled signal; outside the recording the signal is zero. Each phase
    of the output is a sum of strided input slices, one for each tap."""
    out = np.zeros(n, np.float32)
    width = taps.shape[1]
    for first in range(min(up, n)):
        places = (start + first + up * np.arange(len(range(first, n, up)))) * down
        phase, base = int(places[0] % up), int(places[0] // up) - width // 2 + 1
        count = len(places)
        need = base + (count - 1) * down + width
        piece = np.zeros((count - 1) * down + width, np.float32)
        lo, hi = max(base, 0), min(need, len(samples))
        if hi > lo:
            piece[lo - base : hi - base] = (samples[lo:hi].astype(np.float32) - 128) / 128
        total = np.zeros(count, np.float32)
        for k in range(width):
            total += taps[phase, width - 1 - k] * piece[k : k + (count - 1) * down + 1 : down]
        out[first::up] = total
    return out


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a frame's spectrum: (bin, band)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


OUT_RATE = RATE * UP / DOWN
_BANK = mel_bank(OUT_RATE)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def n_frames(n_samples: int) -> int:
    return max(1, 1 + -(-(-(-n_samples * UP // DOWN) - FRAME) // HOP))


def log_mel_blocks(samples: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first frame, log-mel values, log energies) of fixed blocks of frames."""
    total = n_frames(len(samples))
    for first in range(0, total, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, total - first)
        x = resample(samples, first * HOP, (n - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _WINDOW
        spectrum = np.fft.rfft(frames, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        yield first, np.round(np.maximum(np.log10(power @ _BANK + 1e-10), FLOOR) * STEPS) / STEPS, np.log10(power.sum(axis=1) + 1e-10)


def hysteresis(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Segments (first and last-plus-one frame) that begin above ``high`` and last until below ``low``."""
    event = np.where(energy > high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.append(np.append(0, np.where(last >= 0, event[np.maximum(last, 0)] == 1, False)), 0).astype(np.int8)
    edge = np.flatnonzero(np.diff(on))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans in seconds; thresholds lie a tenth of the energy's deviation around its mean."""
    mean, spread = float(energy.mean()), float(energy.std())
    step = HOP / OUT_RATE
    return [(s * step, (e - 1) * step + FRAME / OUT_RATE) for s, e in hysteresis(energy, mean - 0.1 * spread, mean + 0.1 * spread)]


def store(documents: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes", keep: list[str] | None = None) -> DataFrame:
    """Write the documents' payloads as a wave column beside ``keep`` (or all columns) and return the table as read."""
    keep = [c for c in (documents.columns if keep is None else keep) if c not in (media, n_bytes)]
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            texts = [x or b"" for x in raw_bytes(batch.column(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(map(len, texts), pa.int64()), pa.array([wave(payload_of(x)) for x in texts], pa.binary())], names=schema.names)

    return written(documents.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), schema), "media")


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=("frame", "mel"))


def tensors(values: np.ndarray) -> pa.ExtensionArray:
    """Log-mel frames as fixed-shape Arrow tensors, the last one filled up."""
    n = -(-len(values) // PATCH)
    padded = np.full((n * PATCH, MELS), FLOOR, np.float32)
    padded[: len(values)] = values
    return pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, PATCH, MELS))


def patches(stored: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """A row for each tensor: ``keep``, ``patch`` (its number), ``t0`` and ``t1`` (seconds) and ``tensor`` (the storage of
    the fixed-shape Arrow tensor, ``PATCH`` by ``MELS`` values; :func:`as_tensors` gives the type back)."""
    extra = "patch int, t0 double, t1 double, tensor array<float>"
    schema = T.StructType([*(stored.schema[c] for c in keep), *T._parse_datatype_string(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = HOP / OUT_RATE
        for batch in slices(batches, media, 1 << 20):
            for row, data in enumerate(batch.column(media).to_pylist()):
                samples = np.frombuffer(samples_of(data), np.uint8)
                for first, values, _ in log_mel_blocks(samples):
                    array = tensors(values)
                    n = len(array)
                    number = first // PATCH + np.arange(n)
                    ends = np.minimum((number + 1) * PATCH, first + len(values))
                    at = pa.array(np.full(n, row))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(at) for c in keep), pa.array(number, pa.int32()), pa.array(number * PATCH * step), pa.array((ends - 1) * step + FRAME / OUT_RATE), array.storage.cast(pa.list_(pa.float32()))],
                        names=schema.names,
                    )

    return stored.select(*dict.fromkeys([*keep, media])).mapInArrow(lean(run), schema)


def as_tensors(column: pa.Array) -> pa.ExtensionArray:
    """A column of :func:`patches` as fixed-shape tensors again."""
    fixed = column.cast(pa.list_(pa.float32(), PATCH * MELS))
    return pa.ExtensionArray.from_storage(tensor_type(), fixed)


def summary(values: np.ndarray) -> str:
    """Frames, segments, active seconds, and the mean of every sixth of the bands of log-mel frames, as text."""
    energy = np.log10((10.0 ** values.astype(np.float64)).sum(axis=1))
    spans = segments(energy)
    means = values.mean(axis=0, dtype=np.float64).reshape(6, -1).mean(axis=1)
    return f"frames={len(values)};segments={len(spans)};active={sum(e - s for s, e in spans):.3f};mel=" + ",".join(f"{m:.2f}" for m in means)


def with_tensors(stored: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """``keep`` with sizes and digests of the stored media, and its tensors with their spans, written and read again: a row
    for each recording, with lists of ``t0``, ``t1`` and ``tensor`` (as in :func:`patches`)."""
    extra = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, t0 array<double>, t1 array<double>, tensor array<array<float>>"
    fields = T._parse_datatype_string(extra).fields
    schema = T.StructType([*(stored.schema[c] for c in keep), *fields])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = HOP / OUT_RATE
        for batch in slices(batches, media, 4 << 20):
            rows, parts, offsets = [], [], [0]
            for data in batch.column(media).to_pylist():
                payload = samples_of(data)
                total = 0
                for _, values, _ in log_mel_blocks(np.frombuffer(payload, np.uint8)):
                    parts.append(tensors(values).storage.cast(pa.list_(pa.float32())))
                    total += len(values)
                first = np.arange(0, total, PATCH)
                offsets.append(offsets[-1] + len(first))
                ends = (np.minimum(first + PATCH, total) - 1) * step + FRAME / OUT_RATE
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), first * step, ends))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), lists], names=schema.names)

    return written(stored.select(*dict.fromkeys([*keep, media])).mapInArrow(lean(run), schema), "tensors")


def described(stored: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """``keep`` with sizes, digests and the feature summary, which comes from the tensors and spans that are read back."""
    found = with_tensors(stored, keep, media)
    kept = [c for c in found.columns if c not in ("t0", "t1", "tensor")]
    schema = T.StructType([*(found.schema[c] for c in kept), T.StructField("feature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = []
            for i, ends in enumerate(batch.column("t1").to_pylist()):
                values = batch.column("tensor").slice(i, 1).flatten().flatten().to_numpy().reshape(-1, MELS)
                # The last span tells where the filling begins.
                features.append(summary(values[: round((ends[-1] * OUT_RATE - FRAME) / HOP) + 1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(features, pa.string())], names=schema.names)

    return found.mapInArrow(lean(run), schema)
