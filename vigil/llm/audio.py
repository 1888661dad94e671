"""Media columns: texts kept as sound, and features of it.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, become the samples of
a mono 8-bit PCM WAV file. The samples are read back from that file; then a polyphase filter
brings 16 kHz to 12 kHz, overlapped frames give log-mel bands, and a threshold with hysteresis
on the frames' energy gives time spans of sound. Bands are stored as tiles of one fixed
shape (an Arrow fixed_shape_tensor column with start_s and end_s for each tile) in Arrow's
stream format; the last tile is filled up with the floor value.

Each document is worked on by itself and in steps of fixed size, so equal texts give equal
values wherever they are, and memory doesn't grow with the length beyond the text and its
features. Null is an empty text: 192 spaces. Repeated rows give repeated results, an empty
table an empty one; columns other than the two named are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks, map_batches

UNIT, RATE, UP, DOWN, TAPS = 192, 16000, 3, 4, 24
FRAME, HOP, BANDS, TILE = 256, 128, 32, 32
FLOOR = -8.0
#: Frames whose energy is above HIGH begin a span, below LOW end it (natural log, against the document's mean).
HIGH, LOW = 0.15, -0.15
#: Frames that are worked on at once.
STEP = 4096


def _filters() -> np.ndarray:
    """Windowed-sinc low-pass, laid out so that DOWN new samples give UP outputs by one product."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(UP, DOWN)
    h = np.sinc(cut * t) * cut * np.hamming(n) * UP
    width = TAPS + DOWN
    out = np.zeros((width, UP))
    for p in range(UP):
        shift, phase = divmod(p * DOWN, UP)
        for j in range(TAPS):
            out[shift + TAPS - 1 - j, p] = h[phase + j * UP]
    return out.astype(np.float32)


def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


FILTERS, MEL, WINDOW = _filters(), _mel(), np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a mono 8-bit PCM file, found through its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not mono 8-bit PCM")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands and log energy of each frame of 8-bit samples."""
    n_out = -(-len(samples) * UP // DOWN)
    frames = max(1, 1 + -(-max(0, n_out - FRAME) // HOP))
    mel, energy = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    per = STEP * HOP  # outputs in a step, a multiple of UP times something: padded below
    lead = TAPS // 2
    for f0 in range(0, frames, STEP):
        f1 = min(frames, f0 + STEP)
        o0 = f0 * HOP // UP * UP
        need = (f1 - 1) * HOP + FRAME - o0
        groups = -(-need // UP)
        i0 = o0 // UP * DOWN - lead
        span = groups * DOWN + TAPS + DOWN
        x = np.zeros(span, np.float32)
        a, b = max(0, i0), min(len(samples), i0 + span)
        if b > a:
            x[a - i0 : b - i0] = (samples[a:b].astype(np.float32) - 128) * np.float32(1 / 128)
        view = np.lib.stride_tricks.as_strided(x, (groups, TAPS + DOWN), (4 * DOWN, 4))
        y = (np.ascontiguousarray(view) @ FILTERS).reshape(-1)[f0 * HOP - o0 :]
        framed = np.lib.stride_tricks.as_strided(y, (f1 - f0, FRAME), (4 * HOP, 4)) * WINDOW
        spectrum = np.fft.rfft(framed, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel[f0:f1] = np.log10(power.astype(np.float32) @ MEL + np.float32(10**FLOOR))
        energy[f0:f1] = np.log(np.einsum("ij,ij->i", framed, framed) + np.float32(1e-8))
    return mel, energy


def active_spans(energy: np.ndarray) -> np.ndarray:
    """First and end frame of each span: it begins above HIGH and lasts until below LOW."""
    e = energy - energy.mean(dtype=np.float64)
    mark = np.where(e > HIGH, 1, np.where(e < LOW, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


SECOND = RATE * UP / DOWN
TENSOR = pa.fixed_shape_tensor(pa.float32(), [TILE, BANDS])
TILES = pa.schema([("tensor", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tiles(mel: np.ndarray) -> bytes:
    n = -(-len(mel) // TILE)
    full = np.full((n * TILE, BANDS), FLOOR, np.float32)
    full[: len(mel)] = mel
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TILE * BANDS)
    starts = np.arange(n) * (TILE * HOP)
    ends = (np.minimum(np.arange(1, n + 1) * TILE, len(mel)) - 1) * HOP + FRAME
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(starts / SECOND), pa.array(ends / SECOND)], schema=TILES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TILES) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tiles(raw: bytes) -> pa.Table:
    """tensor, start_s, end_s of a stored feature column's value."""
    return pa.ipc.open_stream(raw).read_all()


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV), payload (read back), features (Arrow stream of tiles), spans, summary."""
    kind = dict(df.dtypes)[id_col]
    span_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batch):
        for a, b, buf, offs in blocks(batch.column(1), 1 << 20):
            raw = buf.tobytes()
            cols = [[] for _ in range(6)]
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
                size = e - s
                media = to_wav(raw[s:e] + b" " * (-size % UNIT if size else UNIT))
                payload = from_wav(media)
                mel, energy = log_mel(np.frombuffer(payload, np.uint8))
                spans = active_spans(energy)
                seconds = [{"start_s": x * HOP / SECOND, "end_s": ((y - 1) * HOP + FRAME) / SECOND} for x, y in spans.tolist()]
                active = int((spans[:, 1] - spans[:, 0]).sum())
                means = ",".join(f"{v:.2f}" for v in mel.mean(0, dtype=np.float64))
                summary = f"frames={len(mel)};spans={len(spans)};active={active};mel={means}"
                for c, v in zip(cols, (size, media, payload, tiles(mel), seconds, summary)):
                    c.append(v)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), span_type, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, cols, types)], ["id", "n_bytes", "media", "payload", "features", "spans", "summary"])

    schema = f"id {kind}, n_bytes long, media binary, payload binary, features binary, spans array<struct<start_s: double, end_s: double>>, summary string"
    return map_batches(df, [id_col, text_col], run, schema).withColumnRenamed("id", id_col)


def digests(df: DataFrame) -> DataFrame:
    """Lengths and hashes of what audio_features() stores."""
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    return df.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat("summary", F.lit(";tiles="), F.substring(F.sha2("features", 256), 1, 16)).alias("feature"),
    )
