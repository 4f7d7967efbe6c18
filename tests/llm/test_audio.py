import cmath
import hashlib
import math
import zlib

import numpy as np

from reelmill.llm import audio as A
from tests.llm import edge


def test_wav_round_trip():
    for n in (0, 1, 576, 1001):
        payload = bytes(i * 7 % 256 for i in range(n))
        assert A.decode_wav(A.encode_wav(payload)) == (payload, A.RATE)


def features_of(docs):
    """{doc_id: feature row}, {doc_id: stored tensors}"""
    placed = A.store_features(A.store_media(docs)).persist()
    return A.read_features(placed).collect(), {r.doc_id: bytes(r.tensors) for r in placed.collect()}


def test_media_rows(spark):
    rows = edge.rows()
    got, tensors = features_of(edge.table(spark))
    assert len(got) == len(rows)
    texts = {d: t for d, t, *_ in rows}
    by_text = {}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        wav = A.encode_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert by_text.setdefault(data, r.feature) == r.feature
        assert A.unpack_tensors(tensors[r.doc_id]).shape == (r.n_frames, A.MELS)
        assert all(a.start < a.stop for a in r.spans_ms)
    assert features_of(edge.table(spark, [])) == ([], {})


def plain_features(payload):
    """Log-mel frames and spans straight from the definitions, one output, frame and band at a time."""
    x = [(b - 128) / 128 for b in payload]
    phases = A.low_pass()
    total = -(-len(x) * A.UP // A.DOWN)
    frames = max(1, 1 + -(-(total - A.FRAME) // A.HOP))
    y = []
    for k in range((frames - 1) * A.HOP + A.FRAME):
        end = k * A.DOWN // A.UP + A.TAPS // 2
        y.append(sum(float(phases[k * A.DOWN % A.UP][i]) * x[end - A.TAPS + 1 + i] for i in range(A.TAPS) if 0 <= end - A.TAPS + 1 + i < len(x)))
    rate = A.RATE * A.UP / A.DOWN
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (A.MELS + 1) / 2595) - 1) for i in range(A.MELS + 2)]
    rows, energy = [], []
    for n in range(frames):
        part = [y[n * A.HOP + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / A.FRAME)) for i in range(A.FRAME)]
        energy.append(math.log(sum(v * v for v in part) / A.FRAME + 1e-9))
        power = [abs(sum(v * cmath.exp(-2j * math.pi * f * i / A.FRAME) for i, v in enumerate(part))) ** 2 for f in range(A.FRAME // 2 + 1)]
        row = []
        for m in range(A.MELS):
            low, mid, high = edges[m : m + 3]
            row.append(math.log(sum(p * max(0.0, min((f * rate / A.FRAME - low) / (mid - low), (high - f * rate / A.FRAME) / (high - mid))) for f, p in enumerate(power)) + 1e-6) * 256)
        rows.append(row)
    mean, spans, begun = sum(energy) / frames, [], None
    for n, e in enumerate([*energy, -1e9]):
        if begun is None and e - mean >= A.HIGH and n < frames:
            begun = n
        elif begun is not None and e - mean < A.LOW:
            spans.append((round(begun * 1000 * A.HOP / rate), round((n - 1) * 1000 * A.HOP / rate + 1000 * A.FRAME / rate)))
            begun = None
    return rows, spans


def test_query_against_the_definitions(spark, tmp_path):
    from reelmill.llm.queries import op3_audio_features

    texts = ["", "some words, and others " * 40, "a" * 700 + "zq!" * 500 + " " * 700, None]
    edge.table(spark, [(i, t, *[None] * 9) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_audio_features(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        rows, spans = plain_features(A._payload(t)[0])
        mel, _ = A.Extractor().logmel((np.frombuffer(A._payload(t)[0], np.uint8).astype(np.float32) - 128) / 128)
        # rounded to 1/256; single precision may be one step off
        assert mel.shape == (len(rows), A.MELS) and np.abs(mel - np.array(rows)).max() <= 1.6
        assert [(s.start, s.stop) for s in got[i].spans_ms] == spans and got[i].feature == A.feature_text(mel, spans)


def test_tone_lies_in_its_band_and_spans_find_it():
    t = np.arange(A.RATE * 2) / A.RATE
    x = np.where((t > 0.5) & (t < 1.0), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32) * 0.8 + 0.001
    e = A.Extractor()
    mel, energy = e.logmel(x)
    loud = mel[int(0.75 * e.rate / A.HOP)]
    centre = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + e.rate / 2 / 700), A.MELS + 2) / 2595) - 1)[1:-1]
    assert abs(centre[loud.argmax()] - 1000) < 150
    (a, b), = e.spans(energy)
    assert abs(a - 500) < 50 and abs(b - 1000) < 50


def test_resampling_by_blocks_equals_direct_convolution():
    rng = np.random.default_rng(0)
    x = rng.normal(size=1000).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        phases = A.low_pass(up, down)
        h = np.zeros(phases.size)
        for p in range(up):
            h[p::up] = phases[p][::-1]
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        full = np.convolve(stuffed, h)
        n = len(x) * up // down
        at = np.arange(n) * down + (A.TAPS // 2) * up
        want = np.where(at < len(full), full[np.minimum(at, len(full) - 1)], 0)
        got = np.concatenate([A.resample(x, a, min(100, n - a), up, down) for a in range(0, n, 100)])
        assert np.abs(got - want).max() < 1e-4


def test_steps_do_not_change_features(monkeypatch):
    x = np.random.default_rng(1).normal(size=60_000).astype(np.float32) / 4
    whole = A.Extractor().logmel(x)
    monkeypatch.setattr(A, "STEP", 37)
    parts = A.Extractor().logmel(x)
    assert np.abs(whole[0].astype(int) - parts[0]).max() <= 1 and np.allclose(whole[1], parts[1], atol=1e-3)


def test_tensors_are_fixed_shape():
    chunks, valid = A.tensors(np.ones((A.CHUNK + 3, A.MELS), np.int16))
    assert valid == [A.CHUNK, 3] and A.tensor_array(chunks).type.shape == [A.CHUNK, A.MELS]


def test_query_stores_fixed_shape_tensors_and_reads_them(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from reelmill.llm import queries as Q

    edge.table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    monkeypatch.setattr(Q, "stored", lambda df, name, inner=Q.stored, **options: kept.setdefault(name, inner(df, name, **options)))
    got = Q.op3_audio_features(spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, features_of(edge.table(spark))[0]))
    texts = {d: t for d, t, *_ in edge.rows()}
    for r in kept["features"].collect():
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert table.schema.field("logmel").type == pa.fixed_shape_tensor(pa.int16(), [A.CHUNK, A.MELS])
        mel, energy = A.Extractor().logmel((np.frombuffer(A._payload(texts[r.doc_id])[0], np.uint8).astype(np.float32) - 128) / 128)
        assert np.array_equal(A.unpack_tensors(bytes(r.tensors)), mel)
        assert [(x.start, x.stop) for x in r.spans_ms] == A.Extractor().spans(energy)
