"""Audio features as media columns (operator 7).

A clip is a mono WAV file of 8-bit samples. Its features come in four steps: a polyphase filter resamples it, overlapped
frames go through a bank of mel filters on a log scale, frame energies make segments by hysteresis (a segment opens
above one level and lasts until the energy falls below a lower one), and the frames of the log-mel bank are cut into
tensors of one fixed shape, each with the time span that it covers. What is found is stored as Arrow streams, the tensors as
an array of Arrow's fixed-shape tensor type beside their spans, in binary columns, since Spark has no such type.

Every step works on blocks of bounded size that start at fixed places of the clip, so a clip's features depend on nothing but
its samples, and no clip, however long, is held as more than its samples and one block of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts

#: Samples a second of a clip, and of its features: resampled by UP / DOWN.
RATE, UP, DOWN = 16_000, 5, 8
#: Taps of the resampling filter on each side of its centre, at the raised rate.
REACH = 16
#: Samples of a frame, from one frame to the next, and of its transform, at the features' rate.
FRAME, HOP, FFT = 250, 100, 256
#: Mel filters, and frames in a tensor.
MELS, TENSOR = 20, 100
#: Energies, in bels over the clip's mean, at which a segment opens and closes, and frames that it lasts at least.
OPEN, CLOSE, LEAST = 0.02, -0.02, 3
#: Frames worked on at a time, and bytes of clips of which the features are stored together.
BLOCK, SLICE = 4096, 1 << 20
PAD, UNIT = 255, 576


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + b"\0" * (n % 2)


def samples_of(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAV file of 8-bit mono samples, and their rate; found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("a WAV file without samples")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text as UTF-8, padded to a positive multiple of UNIT bytes, and its length before."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


@cache
def _phases(up: int, down: int) -> np.ndarray:
    """The taps of a windowed-sinc low-pass, one row for each phase of the raised rate."""
    t = np.arange(-REACH * up, REACH * up + 1) / max(up, down)
    taps = np.sinc(t) * np.hanning(len(t) + 2)[1:-1]
    taps = np.concatenate([taps, np.zeros(-len(taps) % up)])
    taps = taps.reshape(-1, up).T
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, first: int, n: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """n samples from the first-th on of x at up / down of its rate; each output sample uses just its own phase's taps."""
    phases = _phases(up, down)
    width = phases.shape[1]
    at = (first + np.arange(n)) * down
    base, phase = at // up - REACH, at % up
    low = int(base[0]) if n else 0
    high = int(base[-1]) + width if n else 0
    part = np.zeros(high - low, np.float32)
    a, b = max(low, 0), min(high, len(x))
    if b > a:
        part[a - low : b - low] = x[a:b]
    view = np.lib.stride_tricks.sliding_window_view(part, width) if n else np.zeros((0, width), np.float32)
    out = np.empty(n, np.float32)
    for p in range(up):
        own = phase == p
        out[own] = view[base[own] - low] @ phases[p, ::-1]
    return out


@cache
def filterbank() -> np.ndarray:
    """Triangles that are even on the mel scale (bins x filters)."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1]))).astype(np.float32)


def frames_of(n_samples: int) -> int:
    """Frames of so many samples at the clip's rate: the last may reach over the end."""
    n = -(-n_samples * UP // DOWN)
    return max(1, 1 + -(-(n - FRAME) // HOP))


def log_mel(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the log-mel frames (frames x filters) and their log energies."""
    total, window = frames_of(len(x)), np.hanning(FRAME).astype(np.float32)
    for first in range(0, total, BLOCK):
        n = min(BLOCK, total - first)
        y = resample(x, first * HOP, (n - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window, FFT, axis=1)).astype(np.float32) ** 2
        yield np.log10(power @ filterbank() + 1e-6), np.log10((frames.astype(np.float64) ** 2).mean(1) + 1e-6)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each segment: opened above OPEN, closed below CLOSE, over the mean."""
    level = energy - energy.mean()
    # the state after each frame is that of the last frame that opened or closed
    event = np.where(level > OPEN, 1, np.where(level < CLOSE, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.concatenate([[False], (last >= 0) & (event[np.maximum(last, 0)] > 0), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= LEAST]


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (tensors x TENSOR x MELS, the last filled up with zeros), their time spans, and the segments' time spans, in seconds."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32)
    x -= 128
    x /= 128
    blocks, energies = zip(*log_mel(x))
    mel, energy = np.concatenate(blocks), np.concatenate(energies)
    tensors = np.zeros((-(-len(mel) // TENSOR), TENSOR, MELS), np.float16)  # to three digits: half the bytes
    tensors.reshape(-1, MELS)[: len(mel)] = mel
    step, end = HOP * DOWN / UP / RATE, len(x) / RATE
    spans = [(i * TENSOR * step, min(end, (i + 1) * TENSOR * step)) for i in range(len(tensors))]
    return tensors, spans, [(a * step, min(end, b * step)) for a, b in segments(energy)]


def fixed_shape(tensors: np.ndarray) -> pa.FixedShapeTensorArray:
    """Tensors as an Arrow array of one fixed shape."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a WAV file a text, written to the shared folder and read again."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = [payload_of(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([wav(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


_CLIPS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("frames", pa.int64()), ("tensors", pa.int64()), ("segments", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))),
    ]
)


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(stream: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(stream.as_buffer()).read_next_batch()


def analysed(media: DataFrame) -> DataFrame:
    """What features finds in stored clips, written to the shared folder and read again. Each row holds about SLICE bytes of clips.

    clips is an Arrow stream of a row a clip: its digests, frames, number of tensors, and segments; tensors is one of a row a tensor, in the
    order of the clips: tensor, of fixed shape (TENSOR, MELS), and the start and end of its span in seconds. Defined
    results: a null id stays one; a longer clip is a row alone; no clips make no rows; other columns aren't looked at.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2, SLICE):
            rows, values, spans = [], [], []
            for doc_id, n_bytes, clip in zip(*part.columns):
                raw = clip.as_py()
                payload, _ = samples_of(raw)
                made, times, found = features(payload)
                voiced = [{"start": a, "end": b} for a, b in found]
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), frames_of(len(payload)), len(made), voiced))
                values.append(made)
                spans += times
            clips = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CLIPS.types)], schema=_CLIPS)
            tensor = pa.RecordBatch.from_arrays([fixed_shape(np.concatenate(values)), *(pa.array(c, pa.float64()) for c in zip(*spans))], names=["tensor", "start", "end"])
            yield pa.RecordBatch.from_arrays([pa.array([_stream(x)], pa.binary()) for x in (clips, tensor)], names=["clips", "tensors"])

    return cut(media.select("doc_id", "n_bytes", "media").mapInArrow(apply, "clips binary, tensors binary"), "features", compression="uncompressed")


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, pa.RecordBatch]]:
    """Each clip's stored row, its tensors, and the rows that those are in."""
    for batch in batches:
        for clips, tensors in zip(*batch.columns):
            found, at = _read(tensors), 0
            values = found.column(0).to_numpy_ndarray()
            for row in _read(clips).to_pylist():
                to = at + row["tensors"]
                yield row, values[at:to], found.slice(at, to - at)
                at = to


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, tensor number, start and end in seconds, and the log-mel tensor as TENSOR * MELS floats, row by row, of each clip that analysed has stored.

    Defined results are those of analysed; each clip has one tensor at least, the last filled up with zeros.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, values, found in _clips(batches):
            n = len(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * TENSOR * MELS, pa.int32()), pa.array(values.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * n, pa.int64()), pa.array(range(n), pa.int32()), found.column(1), found.column(2), lists], names=["doc_id", "number", "start", "end", "tensor"])

    return stored.select("clips", "tensors").mapInArrow(apply, "doc_id long, number int, start double, end double, tensor array<float>")


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each clip that analysed has stored.

    feature is made of the stored tensors and spans: the numbers of frames, tensors and segments, the seconds that tensors span and
    those in segments, and the mean log-mel value of each filter to one decimal. Defined results: a null or empty text is one
    unit of padding; equal texts have equal values; repeated rows, ties and null ids are rows like others; an empty table gives an empty result.
    """
    types = [*_CLIPS.types[:7], pa.string()]
    names = [*_CLIPS.names[:7], "feature"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, values, found in _clips([batch]):
                n, voiced = row["frames"], row["segments"]
                mean = values.reshape(-1, MELS)[:n].sum(0, dtype=np.float64) / n
                spanned, heard = found.column(2)[-1].as_py() - found.column(1)[0].as_py(), sum(x["end"] - x["start"] for x in voiced)
                feature = f"frames={n};tensors={len(values)};seconds={spanned:.3f};segments={len(voiced)};voiced={heard:.3f};mel=" + ",".join(f"{v:.1f}" for v in mean)
                rows.append((*(row[x] for x in names[:7]), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("clips", "tensors").mapInArrow(apply, schema)
