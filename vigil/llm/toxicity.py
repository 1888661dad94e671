"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a word embedding and the sum of character embeddings (hashed first three,
four and five bytes and last three), so that unseen words of a seen stem are known. Both sets
start from the words' log odds in the training sample. Windows of WIDTH words overlap by
WIDTH - STRIDE; each is read in both directions, pooled by attention, and scored; a document's
score is that of its highest window, brought to a probability by a logistic fit that also
corrects for the share of labels in the sample.

Training takes at most `positives` + `negatives` labelled rows, the first by a hash of doc_id,
among those whose crc32(doc_id) mod 5 is not 0; scoring takes every window of every whole text.
Null and empty texts have no words and score as low as the lowest training row. Repeated rows give
equal scores; repeated labels count as often as they come. With no usable labels of both kinds,
scores stay below 0.5. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, blocks, map_batches, mix, span_hashes, word_spans
from .text import packed as bytes_of

WIDTH, STRIDE, HIDDEN, DIM = 48, 32, 8, 4
WORDS, CHARS = 1 << 14, 1 << 13
#: Bytes between words: all ASCII but letters and digits.
APART = np.ones(256, bool)
APART[128:] = False
APART[[*range(48, 58), *range(97, 123)]] = False
POSITIVES, NEGATIVES = 1500, 4500
#: Training documents that are worked on at once: arrays as long as all their words would stay with the driver in pieces.
DOCS = 256


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word (word, three prefixes, suffix) and each document's first word."""
    low = LOWER[buf]
    s, e, first = word_spans(low, offs, APART)
    ids = np.empty((len(s), 5), np.int32)
    ids[:, 0] = span_hashes(low, s, e) % np.uint64(WORDS)
    pad = np.concatenate([np.zeros(3, np.uint8), low, np.zeros(8, np.uint8)])
    head = np.zeros(len(s), np.uint64)
    for k in range(5):
        head |= np.where(s + k < e, pad[s + 3 + k], 0).astype(np.uint64) << np.uint64(8 * k)
        if k >= 2:
            ids[:, k - 1] = mix(head + np.uint64(k << 56)) % np.uint64(CHARS) + np.uint64((k - 2) * CHARS)
    tail = np.zeros(len(s), np.uint64)
    for k in range(3):
        tail |= np.where(e - 1 - k >= s, pad[e + 2 - k], 0).astype(np.uint64) << np.uint64(8 * k)
    ids[:, 4] = mix(tail + np.uint64(9 << 56)) % np.uint64(CHARS) + np.uint64(3 * CHARS)
    return ids, first


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each window, and each document's first window (n + 1 values)."""
    n = np.diff(first)
    count = np.where(n > WIDTH, -(-(n - WIDTH) // STRIDE) + 1, np.minimum(n, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(offs[-1]) - offs[doc]
    start = np.minimum(k * STRIDE, np.maximum(n[doc] - WIDTH, 0))
    return first[doc] + start, np.minimum(n[doc], WIDTH), offs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    word: np.ndarray
    char: np.ndarray
    w: np.ndarray = field(default=None)  # direction, input, gates (update, reset, new)
    u: np.ndarray = field(default=None)
    b: np.ndarray = field(default=None)
    look: np.ndarray = field(default=None)
    out: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)
    slope: float = 1.0
    shift: float = -4.0
    floor: float = -8.0  # the logit of a document without words: the lowest in training

    NAMES = ("word", "char", "w", "u", "b", "look", "out", "bias")

    @classmethod
    def fresh(cls, word_odds: np.ndarray, char_odds: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        word, char = small(WORDS, DIM) * 0.1, small(4 * CHARS, DIM) * 0.1
        word[:, 0], char[:, 0] = word_odds, char_odds / 4
        return cls(word, char, small(2, 2 * DIM, 3 * HIDDEN), small(2, HIDDEN, 3 * HIDDEN), np.zeros((2, 3 * HIDDEN), np.float32), small(2 * HIDDEN), small(2 * HIDDEN), np.zeros(1, np.float32))

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        c = self.char
        return np.concatenate([self.word[ids[:, 0]], c[ids[:, 1]] + c[ids[:, 2]] + c[ids[:, 3]] + c[ids[:, 4]]], 1)

    def forward(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        """x: steps, windows, input -> logits; states too if they are kept for backward()."""
        steps, m = x.shape[:2]
        mask = (np.arange(steps)[:, None] < n).astype(np.float32)
        full = bool(mask.all())
        states, kept = np.empty((steps, m, 2 * HIDDEN), np.float32), []
        for d in range(2):
            pre = (x.reshape(-1, 2 * DIM) @ self.w[d] + self.b[d]).reshape(steps, m, 3 * HIDDEN)
            h = np.zeros((m, HIDDEN), np.float32)
            trail = [None] * steps
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                hu = h @ self.u[d]
                zr = _sigmoid(pre[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(pre[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                nxt = new + z * (h - new)
                if not full:
                    nxt *= mask[t][:, None]
                if keep:
                    trail[t] = (h, z, r, new, hu[:, 2 * HIDDEN :])
                h = nxt
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
            kept.append(trail)
        at = states @ self.look + (mask - 1) * np.float32(1e4)
        at = np.exp(at - at.max(0))
        at *= mask
        at /= np.maximum(at.sum(0), np.float32(1e-9))
        pooled = np.einsum("tm,tmh->mh", at, states)
        logit = pooled @ self.out + self.bias[0]
        return (logit, (x, mask, states, at, pooled, kept)) if keep else logit

    def backward(self, grad: np.ndarray, ids: np.ndarray, kept) -> dict[str, np.ndarray]:
        """Gradients for d loss / d logit; ids: steps, windows, 5."""
        x, mask, states, at, pooled, trails = kept
        steps, m = x.shape[:2]
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        g["out"], g["bias"][0] = pooled.T @ grad, grad.sum()
        d_pool = grad[:, None] * self.out
        d_at = np.einsum("mh,tmh->tm", d_pool, states)
        d_score = at * (d_at - (at * d_at).sum(0))
        g["look"] = np.einsum("tm,tmh->h", d_score, states)
        d_states = at[:, :, None] * d_pool + d_score[:, :, None] * self.look
        dx = np.zeros_like(x)
        for d in range(2):
            dh = np.zeros((m, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                h, z, r, new, hn = trails[d][t]
                dh = (dh + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]) * mask[t][:, None]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                pre = np.concatenate([d_z, d_r, d_new], 1)
                rec = np.concatenate([d_z, d_r, d_new * r], 1)
                g["w"][d] += x[t].T @ pre
                g["u"][d] += h.T @ rec
                g["b"][d] += pre.sum(0)
                dx[t] += pre @ self.w[d].T
                dh = dh * z + rec @ self.u[d].T
        flat, rows = dx.reshape(-1, 2 * DIM), ids.reshape(-1, 5)
        np.add.at(g["word"], rows[:, 0], flat[:, :DIM])
        for k in range(1, 5):
            np.add.at(g["char"], rows[:, k], flat[:, DIM:])
        return g

    def windows(self, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers of each window: steps, windows, 5."""
        at = np.minimum(start[None, :] + np.minimum(np.arange(WIDTH)[:, None], n - 1), max(len(ids) - 1, 0))
        return ids[at], n

    def logits(self, ids: np.ndarray, first: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit of each document, and its number of windows."""
        start, n, offs = window_starts(first)
        x, out = self.inputs(ids), np.empty(len(start), np.float32)
        steps = np.arange(WIDTH)[:, None]
        for a in range(0, len(start), step):
            s, k = start[a : a + step], n[a : a + step]
            out[a : a + step] = self.forward(x[s[None, :] + np.minimum(steps, k - 1)], k)
        best = np.full(len(offs) - 1, self.floor, np.float32)
        some = np.diff(offs) > 0
        if some.any():
            best[some] = np.maximum.reduceat(out, offs[:-1][some])
        return best, np.diff(offs)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logit.astype(np.float64) + self.shift)


def _odds(ids: np.ndarray, first: np.ndarray, y: np.ndarray, k: int, low: int, buckets: int, used: np.ndarray) -> np.ndarray:
    """Log odds of each bucket of column k, over the used documents that hold it."""
    pos, neg = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for a in range(0, len(y), DOCS):
        b = min(a + DOCS, len(y))
        doc = np.repeat(np.arange(a, b), np.diff(first[a : b + 1]))
        seen = np.unique((doc * np.int64(buckets) + ids[first[a] : first[b], k] - low)[used[doc]])
        d, f = seen // buckets, seen % buckets
        pos += np.bincount(f[y[d] == 1], minlength=buckets)
        neg += np.bincount(f[y[d] == 0], minlength=buckets)
    odds = np.log((pos + 0.3) / (y[used].sum() + 0.6)) - np.log((neg + 0.3) / ((1 - y[used]).sum() + 0.6))
    return np.where(pos + neg > 5, np.clip(odds, -3, 3), 0).astype(np.float32)


def fit(ids: np.ndarray, first: np.ndarray, y: np.ndarray, prior: float, epochs: int = 5, batch: int = 128, seed: int = 7) -> Network:
    """A network for texts of features ids and first with labels y; prior: the share of label 1 where it will be used."""
    y = np.asarray(y)
    if not len(ids) or y.min() == y.max():
        return Network.fresh(np.zeros(WORDS, np.float32), np.zeros(4 * CHARS, np.float32))
    # Every fourth row of a thousand or more is kept for the probabilities; the odds and the network don't see it.
    aside = np.arange(len(y)) % 4 == 3
    if len(y) < 1000 or len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    odds = lambda k, low, n: _odds(ids, first, y, k, low, n, ~aside)
    net = Network.fresh(odds(0, 0, WORDS), np.concatenate([odds(k, (k - 1) * CHARS, CHARS) for k in range(1, 5)]), seed)
    # Windows to learn from: by the words' odds, the highest of a document, for label 0 the highest two.
    start, n, w_offs = window_starts(first)
    total = np.zeros(len(ids) + 1)
    for d in range(0, len(y), DOCS):
        a, b = first[d], first[min(d + DOCS, len(y))]
        hint = np.maximum(net.word[:, 0], 0)[ids[a:b, 0]]
        for k in range(1, 5):
            hint += np.maximum(net.char[:, 0], 0)[ids[a:b, k]]
        total[a : b + 1] = np.cumsum(np.concatenate([total[a : a + 1], hint]))
    guess = total[start + n] - total[start]
    del total
    pick, label = [], []
    for d in range(len(y)):
        a, b = w_offs[d], w_offs[d + 1]
        if a < b and not aside[d]:
            top = a + np.argsort(-guess[a:b], kind="stable")[: 1 if y[d] else 2]
            pick += top.tolist()
            label += [y[d]] * len(top)
    pick, label = np.array(pick), np.array(label, np.float32)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    square = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    step = 0
    for _ in range(max(epochs, -(-60 * batch // len(pick)))):
        for rows in np.array_split(rng.permutation(len(pick)), max(1, len(pick) // batch)):
            w, k = net.windows(ids, start[pick[rows]], n[pick[rows]])
            x = net.inputs(w.reshape(-1, 5)).reshape(WIDTH, len(rows), 2 * DIM)
            logit, kept = net.forward(x, k, keep=True)
            g = net.backward((_sigmoid(logit) - label[rows]) / len(rows), w, kept)
            step += 1
            for name in net.NAMES:
                mean[name] += 0.1 * (g[name] - mean[name])
                square[name] += 0.01 * (g[name] ** 2 - square[name])
                rate = (0.002 if name in ("word", "char") else 0.01) / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
                setattr(net, name, (getattr(net, name) - rate * mean[name] / (np.sqrt(square[name]) + 1e-8)).astype(np.float32))
    # Probability from the highest window: a weighted logistic fit by Newton's steps, halved where they don't help.
    z = np.concatenate([net.logits(ids[first[d] : first[min(d + DOCS, len(y))]], first[d : d + DOCS + 1] - first[d])[0] for d in range(0, len(y), DOCS)]).astype(np.float64)
    net.floor = float(z.min())
    if aside.any():
        z, y = z[aside], y[aside]
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    mid, scale = z.mean(), z.std() + 1e-6
    design, weight = np.stack([(z - mid) / scale, np.ones_like(z)], 1), weight / weight.mean()
    loss = lambda b: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (design @ b))).sum() + 0.05 * (b @ b)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(design @ beta)
        grad = design.T @ (weight * (p - y)) + 0.1 * beta
        move = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), grad)
        while loss(beta - move) > loss(beta) and np.abs(move).max() > 1e-9:
            move = move / 2
        beta = beta - move
    beta = np.array([beta[0] / scale, beta[1] - beta[0] * mid / scale])
    net.slope, net.shift = float(beta[0]), float(beta[1])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Network:
    """Fits the network on a bounded sample of the labelled rows that aren't held out."""
    rows = labels.where(~held_out("doc_id") & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id", F.lit(11))
    part = [rows.where(F.col("y") == v).orderBy(place, "doc_id").limit(most) for v, most in ((1, positives), (0, negatives))]
    sample = part[0].union(part[1])
    got = packed(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).orderBy(place, "doc_id").select("y", "ids").toArrow()
    total = sum(counts.values())
    raw = [bytes_of(c) for c in got["ids"].chunks]
    ids = np.concatenate([np.zeros(0, np.uint16), *[x.view(np.uint16) for x, _ in raw]]).reshape(-1, 5)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[np.diff(offs) // 10 for _, offs in raw]]))]).astype(np.int64)
    y = got["y"].to_numpy().astype(np.int64)
    del got, raw
    pa.default_memory_pool().release_unused()
    return fit(ids, first, y, counts.get(1, 0) / total if total else 0.0)


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, y, ids of rows (doc_id, text, y): the features as 16-bit numbers, so the driver gathers no texts."""

    def run(batch):
        for a, b, buf, offs in blocks(batch.column(2), 1 << 20):
            ids, first = features(buf, offs)
            raw, cut = ids.astype(np.uint16).tobytes(), (first * 10).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([raw[s:e] for s, e in zip(cut, cut[1:])], pa.binary())], ["doc_id", "y", "ids"])

    return map_batches(rows, ["doc_id", "y", "text"], run, f"doc_id {dict(rows.dtypes)['doc_id']}, y int, ids binary")


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), n_windows."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batch):
        net = held.value
        for a, b, buf, offs in blocks(batch.column(1), 1 << 20):
            logit, n = net.logits(*features(buf, offs))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(net.probability(logit)), pa.array(n.astype(np.int32))], ["id", "score", "n_windows"])

    return map_batches(docs, [id_col, text_col], run, f"id {dict(docs.dtypes)[id_col]}, score double, n_windows int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = held.value
        for batch in batches:
            keep = [net.probability(net.logits(*features(buf, offs))[0]) < threshold for _, _, buf, offs in blocks(batch.column(batch.schema.get_field_index(text_col)), 1 << 20)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
