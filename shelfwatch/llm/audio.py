"""Audio columns: WAV media, polyphase resampling, log-mel filterbanks and hysteresis energy segments.

Media are RIFF/WAVE files of unsigned 8-bit mono samples, a binary column; the samples are the payload, unchanged.
Clips of any rate are resampled to ``TARGET`` by a polyphase filter.  Features are computed clip by clip in blocks of a
fixed number of frames, so that equal payloads give equal features whatever batch they are in; a task holds one clip, its
log-mel frames and their tensors, which together are less than four times the clip.  A clip's log-mel frames are cut into
windows of ``WINDOW_FRAMES`` frames, stored as an Arrow IPC stream: a fixed-shape tensor column (WINDOW_FRAMES x MELS,
float16) with the time span of each window.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_columns_replaced

UNIT = 576  # payloads are padded to multiples of this
RATE = 12_000  # of the media that texts are stored as
TARGET = 8_000
FRAME, HOP, MELS, WINDOW_FRAMES = 256, 128, 32, 62
BLOCK_FRAMES = 4096
ON_DB, OFF_DB = 1.0, -0.5  # above the clip's median frame energy
OUT_BYTES = 8 << 20


def payload_of(raw: bytes) -> bytes:
    """raw with bytes 255 appended up to a positive multiple of UNIT."""
    return raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def wav_of(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono WAV file of the payload (a pad byte ends an odd one)."""
    pad = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def samples_of(media: bytes) -> tuple[memoryview, int]:
    """(samples, rate) of an 8-bit mono WAV file; its chunks may come in any number and order."""
    riff, _, kind = struct.unpack_from("<4sI4s", media)
    if riff != b"RIFF" or kind != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return memoryview(media)[at + 8: at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def _resampler(up: int, down: int, half: int = 8) -> np.ndarray:
    """Low-pass taps at the lower of both rates, a Hann-windowed sinc, of unit gain at each phase."""
    most = max(up, down)
    n = np.arange(-half * most, half * most + 1)
    taps = np.sinc(n / most) * np.hanning(len(n) + 2)[1:-1]
    return (taps / taps.sum() * up).astype(np.float32)


def ratio(rate: int) -> tuple[int, int]:
    """(up, down) of resampling a clip of this rate to TARGET."""
    if rate <= 0:
        raise ValueError("a clip without a rate")
    g = math.gcd(rate, TARGET)
    return TARGET // g, rate // g


def resampled(samples: np.ndarray, first: int, last: int, up: int, down: int) -> np.ndarray:
    """Outputs first..last-1 of polyphase resampling of unsigned 8-bit samples (zero beyond both ends)."""
    taps = _resampler(up, down)
    centre = len(taps) // 2
    out = np.zeros(last - first, np.float32)
    low = (first * down - centre) // up - 1
    high = (last * down + centre) // up + 2
    x = np.zeros(high - low, np.float32)
    a, b = max(low, 0), min(high, len(samples))
    if b > a:
        x[a - low: b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    for r in range(min(up, last - first)):  # outputs of one phase
        t = (first + r) * down + centre
        phase, base = t % up, t // up
        count = len(range(r, last - first, up))
        for k, tap in enumerate(taps[phase::up]):
            i = base - k - low
            if i < 0:
                break
            out[r::up] += tap * x[i: i + (count - 1) * down + 1: down]
    return out


@lru_cache(maxsize=2)
def _mel_bank(rate: int) -> np.ndarray:
    """Triangular filters, frequencies x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames x MELS, frame energies in dB). There is a frame for every sample: the last are padded."""
    up, down = ratio(rate)
    n = -(-len(samples) * up // down)
    frames = max(1, -(-(n - FRAME) // HOP) + 1)
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    bank = _mel_bank(TARGET)
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for f in range(0, frames, BLOCK_FRAMES):
        g = min(f + BLOCK_FRAMES, frames)
        y = resampled(samples, f * HOP, (g - 1) * HOP + FRAME, up, down)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        energy[f:g] = 10 * np.log10(np.einsum("ij,ij->i", cut, cut) / FRAME + 1e-9)
        spectrum = np.fft.rfft(cut * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[f:g] = np.log(power.astype(np.float32) @ bank + 1e-6)
    return mels, energy


def energy_segments(energy: np.ndarray) -> np.ndarray:
    """Frame ranges (first, last + 1) that begin above median + ON_DB and last until the energy is below median + OFF_DB."""
    middle = np.median(energy)
    state = np.where(energy > middle + ON_DB, 1, np.where(energy < middle + OFF_DB, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(at >= 0, state[np.maximum(at, 0)], 0)
    edges = np.diff(np.concatenate([[0], on, [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


TENSOR = pa.fixed_shape_tensor(pa.float16(), [WINDOW_FRAMES, MELS])
FRAME_MS = 1000 * HOP / TARGET


def tensor_stream(mels: np.ndarray) -> bytes:
    """Arrow IPC stream: start_ms, end_ms, log_mel (fixed-shape tensor; the last window is padded with the floor)."""
    k = -(-len(mels) // WINDOW_FRAMES)
    full = np.full((k * WINDOW_FRAMES, MELS), np.log(np.float32(1e-6)), np.float16)
    full[: len(mels)] = mels
    starts = np.arange(k) * WINDOW_FRAMES
    batch = pa.record_batch({
        "start_ms": pa.array(starts * FRAME_MS), "end_ms": pa.array(np.minimum(starts + WINDOW_FRAMES, len(mels)) * FRAME_MS),
        "log_mel": pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), WINDOW_FRAMES * MELS))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors_of(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(spans: windows x 2, in ms; log-mels: windows x WINDOW_FRAMES x MELS) of a stored stream."""
    with pa.ipc.open_stream(stream) as source:
        table = source.read_all().combine_chunks()
    spans = np.stack([table["start_ms"].to_numpy(), table["end_ms"].to_numpy()], axis=1)
    return spans, table["log_mel"].combine_chunks().to_numpy_ndarray()


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_bytes and media: the text's UTF-8 bytes, padded, as a WAV file. Null counts as empty."""
    docs = with_columns_replaced(docs, ["n_bytes", "media"])
    at = docs.columns.index(text)
    rest = [f for f in docs.schema if f.name != text]

    def run(batches):
        for batch in batches:
            column = batch.column(at).cast(pa.binary())
            others = [i for i in range(batch.num_columns) if i != at]
            a, held, n = 0, [], 0
            for i, raw in enumerate(column):
                raw = raw.as_py() or b""
                held.append((len(raw), wav_of(payload_of(raw))))
                n += len(raw)
                if i == batch.num_rows - 1 or n >= OUT_BYTES:
                    part = batch.slice(a, i + 1 - a)
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in others], pa.array([k for k, _ in held], pa.int64()), pa.array([m for _, m in held], pa.binary())],
                                                     names=[*[batch.schema.names[k] for k in others], "n_bytes", "media"])
                    a, held, n = i + 1, [], 0

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "n_bytes long", "media binary"])
    return docs.mapInArrow(run, schema)


def features(clips: DataFrame, media: str = "media") -> DataFrame:
    """clips without its media, with what its bytes hold.

    payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes), media_bytes, media_sha256, tensors (Arrow
    IPC, see above) and segments (start_ms, end_ms).  Null media have nulls.
    """
    added = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors", "segments"]
    clips = with_columns_replaced(clips, added)
    at = clips.columns.index(media)
    rest = [f for f in clips.schema if f.name != media]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))]

    def described(raw: bytes | None):
        if raw is None:
            return (None,) * len(added)
        view, rate = samples_of(raw)
        samples = np.frombuffer(view, np.uint8)
        mels, energy = log_mel(samples, rate)
        segments = [{"start_ms": float(a * FRAME_MS), "end_ms": float(b * FRAME_MS)} for a, b in energy_segments(energy)]
        return (len(view), hashlib.sha256(view).hexdigest(), zlib.crc32(view[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), tensor_stream(mels), segments)

    def run(batches):
        for batch in batches:
            others = [i for i in range(batch.num_columns) if i != at]
            a, held, n = 0, [], 0
            for i, raw in enumerate(batch.column(at)):
                raw = raw.as_py()
                held.append(described(raw))
                n += len(raw or b"")
                if i == batch.num_rows - 1 or n >= OUT_BYTES:
                    part = batch.slice(a, i + 1 - a)
                    columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in others], *columns], names=[*[batch.schema.names[k] for k in others], *added])
                    a, held, n = i + 1, [], 0

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, segments array<struct<start_ms:double,end_ms:double>>"])
    return clips.mapInArrow(run, schema)


def with_feature(described: DataFrame) -> DataFrame:
    """described, without its tensors, with feature: what the stored tensors hold (windows, shape, end of the last in ms, digest of spans and values) and the segments.

    Null tensors have a null feature. A column of described by this name is replaced.
    """
    described = with_columns_replaced(described, ["feature"])
    at, seg = described.columns.index("tensors"), described.columns.index("segments")
    rest = [f for f in described.schema if f.name != "tensors"]

    def told(stream: bytes | None, segments: list) -> str | None:
        if stream is None:
            return None
        spans, mels = tensors_of(stream)
        digest = hashlib.sha256(np.ascontiguousarray(spans, "<f8").tobytes())
        digest.update(np.ascontiguousarray(mels, "<f2").tobytes())
        digest.update(np.array([[s["start_ms"], s["end_ms"]] for s in segments], "<f8").tobytes())
        return f"logmel {'x'.join(map(str, mels.shape))}; {spans[-1, 1]:.0f} ms; segments {len(segments)}; {digest.hexdigest()[:32]}"

    def run(batches):
        for batch in batches:
            said = [told(t.as_py(), s.as_py()) for t, s in zip(batch.column(at), batch.column(seg), strict=True)]
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != at], pa.array(said, pa.string())], names=[*[n for k, n in enumerate(batch.schema.names) if k != at], "feature"])

    return described.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "feature string"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every text of ``documents`` as a stored WAV column, read back; its features, stored and read back, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = materialise(with_media(docs), "audio-media")
    described = materialise(features(stored), "audio-features")
    return with_feature(described).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
                                          F.size("segments").alias("n_segments"))
