import random
import zlib

import numpy as np

from vigil.llm import toxicity


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    part = ["th", "er", "ion", "an", "st", "ble", "ou", "ing", "re"]
    word = lambda: "".join(rng.choices(part, k=rng.randint(1, 4)))
    bad = ["idiot", "moron", "trash"]
    rows = []
    for i in range(n):
        t = [word() for _ in range(rng.randint(5, 300))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(len(t))] = rng.choice(bad) if rng.random() < 0.6 else "gruk" + word()
        rows.append((i, " ".join(t), toxic))
    return rows


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.zeros(toxicity.WORDS), np.zeros(4 * toxicity.CHARS))
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    ids = rng.integers(0, 50, (6, 3, 5))
    ids[:, :, 1:] %= toxicity.CHARS
    n = np.array([6, 4, 1])
    forward = lambda: net.forward(net.inputs(ids.reshape(-1, 5)).reshape(6, 3, -1), n, keep=True)
    coef = np.array([0.3, -0.7, 1.1])
    _, kept = forward()
    g = net.backward(coef, ids, kept)
    for k in net.NAMES:
        x = getattr(net, k)
        flat = np.flatnonzero(np.abs(g[k]).reshape(-1) > 0)[:3]
        for i in flat:
            at, e = np.unravel_index(i, x.shape), 1e-2
            x[at] += e
            up = forward()[0] @ coef
            x[at] -= 2 * e
            down = forward()[0] @ coef
            x[at] += e
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k


def test_windows_cover_all_words():
    first = np.array([0, 0, 1, 48, 97, 400])
    start, n, offs = toxicity.window_starts(first)
    for d in range(5):
        seen = set()
        for s, k in zip(start[offs[d] : offs[d + 1]], n[offs[d] : offs[d + 1]]):
            seen |= set(range(s, s + k))
        assert seen == set(range(first[d], first[d + 1]))


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(9000, None, None)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == 902 and all(0 <= s <= 1 for s in got.values())
    assert got[9000] == got[9001] < 0.5
    held = [(got[i] >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()] == [True]
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_forward_pass_and_gradients_equal_a_plain_network():
    """The two directions, the gates and the attention written out word by word; gradients by differences."""
    import math

    from vigil.llm import toxicity as T

    rng = np.random.default_rng(2)
    net = T.Network.fresh(np.zeros(T.WORDS, np.float32), np.zeros(4 * T.CHARS, np.float32), 3)
    for name in net.NAMES:
        setattr(net, name, rng.normal(0, 0.4, getattr(net, name).shape).astype(np.float32))
    steps, h = 6, T.HIDDEN
    ids = rng.integers(0, 4 * T.CHARS, (steps, 3, 5))
    ids[..., 0] %= T.WORDS
    n = np.array([6, 4, 1])
    x = net.inputs(ids.reshape(-1, 5)).reshape(steps, 3, 2 * T.DIM)
    sig = lambda v: 1 / (1 + math.exp(-v))

    def plain(m):
        states = [[0.0] * (2 * h) for _ in range(n[m])]
        for d, order in ((0, range(n[m])), (1, range(n[m] - 1, -1, -1))):
            state = [0.0] * h
            for t in order:
                gate = lambda g, k, s: sum(float(x[t, m, i]) * float(net.w[d][i, g * h + k]) for i in range(2 * T.DIM)) + float(net.b[d][g * h + k])  # noqa: E731,B023
                back = lambda g, k: sum(state[i] * float(net.u[d][i, g * h + k]) for i in range(h))  # noqa: E731,B023
                z = [sig(gate(0, k, 0) + back(0, k)) for k in range(h)]
                r = [sig(gate(1, k, 0) + back(1, k)) for k in range(h)]
                new = [math.tanh(gate(2, k, 0) + r[k] * back(2, k)) for k in range(h)]
                state = [new[k] + z[k] * (state[k] - new[k]) for k in range(h)]
                states[t][d * h : (d + 1) * h] = state
        look = [sum(a * float(b) for a, b in zip(s, net.look)) for s in states]
        e = [math.exp(v - max(look)) for v in look]
        pooled = [sum(w * s[k] for w, s in zip(e, states)) / sum(e) for k in range(2 * h)]
        return sum(a * float(b) for a, b in zip(pooled, net.out)) + float(net.bias[0])

    logit, kept = net.forward(x, n, keep=True)
    assert np.allclose(logit, [plain(m) for m in range(3)], atol=1e-4)
    grad = rng.normal(size=3).astype(np.float32)
    got = net.backward(grad, ids, kept)
    for name, at in (("w", (0, 1, 2)), ("u", (1, 0, 5)), ("b", (0, 3)), ("look", (4,)), ("out", (2,)), ("bias", (0,)), ("word", (int(ids[0, 0, 0]), 1))):
        value, step = getattr(net, name), 1e-2
        old, ends = float(value[at]), []
        for s in (step, -step):
            value[at] = old + s
            ends.append(float((net.forward(net.inputs(ids.reshape(-1, 5)).reshape(x.shape), n) * grad).sum()))
        value[at] = old
        assert abs((ends[0] - ends[1]) / (2 * step) - got[name][at]) < 5e-3, name


def test_repeated_rows_and_very_long_texts(spark):
    from pyspark.sql import functions as F

    rows = [(i, "bad rude awful " * 20 if i % 2 else "calm kind words here " * 20) for i in range(1, 60)] + [(500, "calm kind words here " * 60_000 + "bad rude awful " * 20)] * 2 + [(None, "bad rude awful " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(500, 1)] * 2, "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    long = [(r.score, r.n_windows) for r in got if r.doc_id == 500]
    assert len(long) == 2 and long[0] == long[1] and long[0][1] > 5000
    assert toxicity.without_toxic(docs, net).columns == docs.columns


def test_training_holds_no_arrays_over_all_words_at_once(monkeypatch):
    """The driver's memory follows the sample's features, not several arrays of as many long numbers."""
    import tracemalloc

    rng = np.random.default_rng(5)
    size = rng.integers(2500, 3500, 600)
    first = np.concatenate([[0], np.cumsum(size)])
    ids = np.concatenate([rng.integers(0, toxicity.WORDS, (first[-1], 1)), rng.integers(0, toxicity.CHARS, (first[-1], 4)) + np.arange(4) * toxicity.CHARS], 1).astype(np.uint16)
    y = np.arange(600) % 3 // 2
    made = []
    for docs in (16, 600):
        monkeypatch.setattr(toxicity, "DOCS", docs, raising=False)
        tracemalloc.start()
        made.append((toxicity.fit(ids, first, y, 0.1, epochs=1), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    (one, peak), (other, _) = made
    assert peak < 2.5 * ids.nbytes
    assert all(np.array_equal(getattr(one, k), getattr(other, k)) for k in one.NAMES)
