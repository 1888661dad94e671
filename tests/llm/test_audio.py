import hashlib
import zlib

import numpy as np

from vigil.llm import audio

TEXTS = [(1, "hello world"), (2, None), (3, ""), (4, "hello world"), (5, "wörd " * 300000), (6, "x" * 192)]


def test_round_trip_and_digests(spark):
    df = spark.createDataFrame([(*t, 1) for t in TEXTS], "doc_id long, text string, n_bytes int")
    full = audio.audio_features(df)
    got = {r.doc_id: r for r in audio.digests(full).collect()}
    kept = {r.doc_id: r for r in full.collect()}
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(bytes(kept[i].media)).hexdigest() and r.media_bytes == 44 + len(payload)
        t = audio.read_tiles(bytes(kept[i].features))
        assert t.schema.field("tensor").type.shape == [audio.TILE, audio.BANDS]
        assert t["start_s"][0].as_py() == 0
    assert got[1].feature == got[4].feature != got[3].feature and got[2].feature == got[3].feature
    assert audio.digests(audio.audio_features(df.limit(0))).count() == 0


def test_resampler_keeps_a_tone():
    t = np.arange(16000) / 16000
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8)
    mel, _ = audio.log_mel(tone)
    hz = np.argmax(audio.MEL.T @ (np.abs(np.fft.rfftfreq(audio.FRAME, 1 / 12000) - 1000) < 30))
    assert abs(int(mel[5:-5].mean(0).argmax()) - int(hz)) <= 1


def test_steps_agree(monkeypatch):
    x = np.random.default_rng(0).integers(0, 255, 300_000).astype(np.uint8)
    a, _ = audio.log_mel(x)
    monkeypatch.setattr(audio, "STEP", 100)
    b, _ = audio.log_mel(x)
    assert np.allclose(a, b, atol=1e-3)


def test_hysteresis():
    e = np.array([0, 1, 0.0, 0.05, -1, -0.3, 0.0, 0.3, 0.0, -0.05])
    assert audio.active_spans(e).tolist() == [[1, 4], [7, 10]]


def test_bands_equal_a_plain_computation():
    """Filter, frame and band sums written out sample by sample."""
    import math

    up, down, taps, frame, hop = audio.UP, audio.DOWN, audio.TAPS, audio.FRAME, audio.HOP
    samples = np.random.default_rng(4).integers(0, 256, 192 * 5).astype(np.uint8)
    x = [(int(v) - 128) / 128 for v in samples]
    size = up * taps
    low = [math.sin(math.pi * (k - (size - 1) / 2) / down) / (math.pi * (k - (size - 1) / 2)) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (size - 1))) * up for k in range(size)]
    n_out = -(-len(x) * up // down)
    frames = max(1, 1 + -(-max(0, n_out - frame) // hop))
    y = []
    for o in range((frames - 1) * hop + frame):
        shift, phase = divmod(o * down, up)
        near = [shift + taps - 1 - j - taps // 2 for j in range(taps)]
        y.append(sum(x[i] * low[phase + j * up] for j, i in enumerate(near) if 0 <= i < len(x)))
    rate = audio.RATE * up / down
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (audio.BANDS + 1) / 2595) - 1) for k in range(audio.BANDS + 2)]
    got, energy = audio.log_mel(samples)
    assert got.shape == (frames, audio.BANDS)
    for f in range(frames):
        part = [y[f * hop + k] * (0.5 - 0.5 * math.cos(2 * math.pi * k / (frame - 1))) for k in range(frame)]
        assert abs(energy[f] - math.log(sum(v * v for v in part) + 1e-8)) < 1e-3
        power = [abs(sum(v * complex(math.cos(2 * math.pi * b * k / frame), -math.sin(2 * math.pi * b * k / frame)) for k, v in enumerate(part))) ** 2 for b in range(frame // 2 + 1)]
        for m in range(audio.BANDS):
            lo, mid, hi = edges[m : m + 3]
            total = sum(p * max(0.0, min((b * rate / frame - lo) / (mid - lo), (hi - b * rate / frame) / (hi - mid))) for b, p in enumerate(power))
            assert abs(got[f, m] - math.log10(total + 10**audio.FLOOR)) < 2e-3
