"""Audio features: 8-bit PCM WAV payloads, polyphase resampling, log-mel filterbanks and hysteresis segmentation.

`encode_wav` stores bytes losslessly as unsigned 8-bit mono samples. `decode_wav` reads them back. The features are
computed from the samples that were read: a polyphase FIR filter resamples by UP/DOWN, overlapped Hann frames go through
a mel filterbank into log energies, and two thresholds on the frame energy cut active spans. Spans carry times in
milliseconds; `store_features` holds the log-mel frames as Arrow fixed-shape tensors of CHUNK frames by MELS bands (int16,
1/256 of a natural logarithm), the last one padded with its valid number of frames beside it; `read_features` reads them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces

BLOCK = 576
RATE = 16_000
UP, DOWN = 2, 5
TAPS = 32
FRAME, HOP, MELS, CHUNK = 256, 128, 32, 64
#: Frames a step: bounds the memory that a long text takes.
STEP = 1024
#: Bytes of media that a task takes from a batch at once.
BATCH_BYTES = 4 << 20
HIGH, LOW = 0.35, -0.15


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def decode_wav(data: bytes) -> tuple[bytes, int]:
    """The sample bytes and the rate of an 8-bit mono PCM file; walks the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        if kind == b"data":
            return data[at + 8 : at + 8 + n], rate
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc filter for resampling by up/down, as up phases of taps coefficients."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n) * cut
    return (h * up / h.sum()).astype(np.float32).reshape(taps, up).T[:, ::-1].copy()


def resample(x: np.ndarray, first: int, count: int, up: int = UP, down: int = DOWN, phases: np.ndarray | None = None) -> np.ndarray:
    """Samples first .. first+count-1 of x resampled by up/down; x is zero outside its ends.

    Output k is at input time k*down/up; it is phase (k*down) % up of the filter over the taps inputs that end there.
    """
    phases = low_pass(up, down) if phases is None else phases
    taps = phases.shape[1]
    k = np.arange(first, first + count)
    ends = k * down // up + taps // 2
    begin = int(ends[0]) - taps + 1
    stop = int(ends[-1]) + 1
    part = np.zeros(stop - begin, np.float32)
    a, b = max(begin, 0), min(stop, len(x))
    if a < b:
        part[a - begin : b - begin] = x[a:b]
    windows = np.lib.stride_tricks.sliding_window_view(part, taps)
    out = np.empty(count, np.float32)
    for r in range(min(up, count)):
        # outputs first + r + up * j share a phase, and their windows lie `down` inputs apart
        at = int(ends[r]) - taps + 1 - begin
        mine = out[r::up]
        mine[:] = windows[at::down][: len(mine)] @ phases[(first + r) * down % up]
    return out


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, equally spaced in mel from 0 to rate/2; a (frame/2+1) x mels matrix."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1)[:, None] * rate / frame
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


class Extractor:
    """The features of one sample sequence; the filters are made once a task."""

    def __init__(self) -> None:
        self.phases = low_pass()
        self.rate = RATE * UP / DOWN
        self.bank = mel_bank(self.rate)
        self.window = np.hanning(FRAME + 1)[:-1].astype(np.float32)

    def logmel(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """int16 log-mel frames (n x MELS) and the log energy of each frame; at least one frame."""
        total = -(-len(samples) * UP // DOWN)
        n = max(1, 1 + -(-(total - FRAME) // HOP))
        mel, energy = np.empty((n, MELS), np.int16), np.empty(n, np.float32)
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            y = resample(samples, a * HOP, (b - a - 1) * HOP + FRAME, phases=self.phases)
            frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * self.window
            power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
            mel[a:b] = np.rint(np.log(power @ self.bank + 1e-6) * 256)
            energy[a:b] = np.log((frames**2).mean(1) + 1e-9)
        return mel, energy

    def spans(self, energy: np.ndarray) -> list[tuple[int, int]]:
        """Active spans in ms: opened when the energy is HIGH above its mean, closed when it falls below mean + LOW."""
        level = energy - energy.mean(dtype=np.float64)
        state = np.where(level >= HIGH, 1, np.where(level < LOW, 0, -1))
        known = np.where(state >= 0, np.arange(len(state)), -1)
        last = np.maximum.accumulate(known)
        on = np.where(last >= 0, state[np.maximum(last, 0)], 0)
        edge = np.diff(np.concatenate(([0], on, [0])))
        ms = 1000 * HOP / self.rate
        width = 1000 * FRAME / self.rate
        return [(round(a * ms), round((b - 1) * ms + width)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def tensors(mel: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Chunks of CHUNK x MELS, the last one zero-padded, and the valid frames of each."""
    n = -(-len(mel) // CHUNK)
    full = np.zeros((n * CHUNK, MELS), np.int16)
    full[: len(mel)] = mel
    return full.reshape(n, CHUNK, MELS), [min(CHUNK, len(mel) - i * CHUNK) for i in range(n)]


def tensor_array(chunks: np.ndarray) -> pa.Array:
    """The chunks as Arrow's fixed_shape_tensor extension array."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(chunks)


def pack_tensors(mel: np.ndarray) -> bytes:
    """The frames as an Arrow IPC stream: logmel (fixed_shape_tensor) and valid_frames, a row a chunk."""
    chunks, valid = tensors(mel)
    batch = pa.RecordBatch.from_arrays([tensor_array(chunks), pa.array(valid, pa.int32())], ["logmel", "valid_frames"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_tensors(data: bytes) -> np.ndarray:
    """The valid frames (n x MELS) of what pack_tensors made."""
    with pa.ipc.open_stream(data) as stream:
        found = stream.read_next_batch()
    chunks = found.column("logmel").to_numpy_ndarray()
    return chunks.reshape(-1, MELS)[: sum(found.column("valid_frames").to_pylist())]


def feature_text(mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    digest = hashlib.sha256(mel.tobytes() + repr(spans).encode()).hexdigest()
    return f"frames={len(mel)};mels={MELS};spans={len(spans)};active_ms={sum(b - a for a, b in spans)};sha256={digest}"


def _payload(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    n = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
    return data.ljust(n, b"\xff"), len(data)


STORE = "doc_id long, n_bytes long, media binary"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the WAV file of each text (null: empty), padded with 255 to a positive multiple of BLOCK."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_pieces(batches, 1, BATCH_BYTES):
            made = [_payload(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_wav(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STORE)


PLACED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
SPANS = "spans_ms array<struct<start:long,stop:long>>"


def store_features(media: DataFrame) -> DataFrame:
    """Reads each stored file back: its sizes and digests, its spans, and its log-mel tensors as pack_tensors makes them
    (to be written beside the media). A file that is not 8-bit mono PCM fails the job."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
    names = [c.split()[0] for c in PLACED.split(", ")] + ["spans_ms", "tensors"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        extract = Extractor()
        for batch in byte_pieces(batches, 2, BATCH_BYTES):
            size = 0
            out: list[tuple] = []
            for doc, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                payload, _ = decode_wav(data)
                mel, energy = extract.logmel((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
                spans = [{"start": a, "stop": b} for a, b in extract.spans(energy)]
                packed = pack_tensors(mel)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), spans, packed))
                size += len(packed) + 600
                if size > 16 << 20:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{PLACED}, {SPANS}, tensors binary")


def read_features(features: DataFrame) -> DataFrame:
    """The stored features with `feature` and n_frames from the stored tensors and spans; the tensors stay in their files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_pieces(batches, 8, BATCH_BYTES):
            texts, frames = [], []
            for spans, data in zip(batch.column(7).to_pylist(), batch.column(8), strict=True):
                mel = unpack_tensors(data.as_buffer())
                texts.append(feature_text(mel, [(x["start"], x["stop"]) for x in spans]))
                frames.append(len(mel))
            held = batch.columns
            yield pa.RecordBatch.from_arrays([*held[:7], pa.array(texts, pa.string()), pa.array(frames, pa.int64()), held[7]], [*batch.schema.names[:7], "feature", "n_frames", "spans_ms"])

    return features.mapInArrow(run, f"{PLACED}, feature string, n_frames long, {SPANS}")
