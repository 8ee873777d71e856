"""Media columns: 8-bit audio stored losslessly, read back, and described by fixed-shape tensors.

A payload becomes a mono 8-bit WAV file. What is read back from those stored bytes is
resampled by a polyphase filter, cut into overlapped frames, turned into log-mel bands,
and segmented by energy with hysteresis. Bands are stored as tensors of one shape
(``TENSOR_FRAMES`` x ``MELS``, the last one zero-padded), each with its time span. Spark has no
tensor type, so a document's tensors are one Arrow stream in a binary column, whose ``bands``
are of Arrow's fixed-shape tensor type; ``read_tensors`` gives them back.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, map_slices, table

UNIT = 64
RATE = 8000
UP, DOWN = 3, 4
TAPS = 16
FRAME, HOP = 256, 128
MELS, TENSOR_FRAMES = 16, 32
RISE_DB, FALL_DB = 2.0, 0.5
HEADER = 44

SCHEMA = (
    "doc_id long, n_bytes long, media binary, spans array<struct<start_s:double,end_s:double>>, "
    "n_tensors int, tensors binary, band_means array<float>"
)


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return payload + bytes(-len(payload) % unit or (0 if payload else unit))


def wav_write(samples: bytes, rate: int = RATE) -> bytes:
    return (
        b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
        + b"data" + struct.pack("<I", len(samples)) + samples
    )


def wav_read(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono WAV file, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@functools.cache
def _phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low-pass filter, dealt to ``up`` phases of ``taps`` taps each."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h * up / h.sum()).reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by ``up / down``: each output takes the taps of its own phase only."""
    phases = _phases(up, down)
    taps = phases.shape[1]
    n = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(1, np.float32)]), taps)
    out = np.empty(n, np.float32)
    for r in range(min(up, n)):
        k = np.arange(r, n, up)
        start, phase = k[0] * down // up, k[0] * down % up
        out[r::up] = windows[start :: down][: len(k)] @ phases[phase]
    return out


@functools.cache
def _mel_bank(rate: float) -> tuple[np.ndarray, np.ndarray]:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (f[:, None] - hz[None, :-2]) / (hz[1:-1] - hz[:-2])
    fall = (hz[None, 2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> np.ndarray:
    """Log-mel bands of overlapped frames (frames x MELS); what is short of a frame is zero-padded."""
    window, bank = _mel_bank(rate)
    n = max(1, -(-max(len(y) - FRAME, 0) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
    return np.log10(power @ bank + 1e-6).astype(np.float32)


def active_spans(bands: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that begin where energy is RISE_DB over the median and last until it is under FALL_DB over it."""
    energy = 10 * bands.mean(axis=1)
    floor = float(np.median(energy))
    spans, begun = [], -1
    for i, e in enumerate(energy.tolist()):
        if begun < 0 and e >= floor + RISE_DB:
            begun = i
        elif begun >= 0 and e < floor + FALL_DB:
            spans.append((begun, i))
            begun = -1
    if begun >= 0:
        spans.append((begun, len(energy)))
    return spans


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
TENSOR_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("bands", TENSOR)])


def write_tensors(bands: np.ndarray, step: float) -> tuple[int, bytes]:
    """How many tensors the bands (frames x MELS) fill, and these as an Arrow stream; ``step``: seconds a frame."""
    n = -(-len(bands) // TENSOR_FRAMES)
    whole = np.zeros((n, TENSOR_FRAMES, MELS), np.float32)
    whole.reshape(-1, MELS)[: len(bands)] = bands
    starts = np.arange(n) * TENSOR_FRAMES
    ends = np.minimum(starts + TENSOR_FRAMES, len(bands))
    batch = pa.record_batch([pa.array(starts * step), pa.array(ends * step), pa.FixedShapeTensorArray.from_numpy_ndarray(whole)], schema=TENSOR_SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as out:
        out.write_batch(batch)
    return n, sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """(start_s, end_s, bands) of a stored stream; bands are of the fixed-shape tensor type."""
    return pa.ipc.open_stream(stored).read_all()


def describe(media: bytes) -> tuple[list[dict], tuple[int, bytes], np.ndarray]:
    rate, samples = wav_read(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    out_rate = rate * UP / DOWN
    bands = log_mel(resample(x), out_rate)
    step = HOP / out_rate
    return [{"start_s": a * step, "end_s": b * step} for a, b in active_spans(bands)], write_tensors(bands, step), np.round(bands.mean(axis=0), 3)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_bytes (of the payload), media (a WAV file), active spans, n_tensors, tensors with time spans (an Arrow stream), band means.

    Null text is an empty payload (one unit of zeros); null ids stay null; repeated rows each
    get their row with equal values; an empty table gives an empty result; other columns are
    ignored. Long payloads only take memory in proportion to their own length.
    """

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            media = [wav_write(padded(r)) for r in raw]
            found = [describe(m) for m in media]
            span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r) for r in raw], pa.int64()),
                    pa.array(media, pa.binary()),
                    pa.array([x[0] for x in found], pa.list_(span)),
                    pa.array([x[1][0] for x in found], pa.int32()),
                    pa.array([x[1][1] for x in found], pa.binary()),
                    pa.array([x[2] for x in found], pa.list_(pa.float32())),
                ],
                names=[id_col, "n_bytes", "media", "spans", "n_tensors", "tensors", "band_means"],
            )

        return step

    return map_slices(keyed_text(df, id_col, text_col), kernel, SCHEMA.replace("doc_id", id_col, 1))


def op8_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media_columns(table(spark, sf_dir, "documents"))
    payload = F.expr(f"substring(media, {HEADER + 1}, octet_length(media) - {HEADER})")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(F.round(s["start_s"], 3).cast("string"), F.lit("-"), F.round(s["end_s"], 3).cast("string"))), ",")
    return made.withColumn("payload", payload).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, octet_length(payload) - {UNIT - 1}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.col("n_tensors").cast("string"), F.array_join(F.transform("band_means", lambda x: F.round(x, 3).cast("string")), ","), F.sha1(spans)).alias("feature"),
    )


QUERIES = {"op8_media_audio": op8_media_audio}
ORACLE_SQL: dict[str, str] = {}
