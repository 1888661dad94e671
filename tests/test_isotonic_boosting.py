"""Isotonic curves and boosted trees from tables, against plain fits of all rows."""

import random

import numpy as np
import pytest

from vigil.functions import boosting
from vigil.functions.isotonic import isotonic_blocks, isotonic_fit, isotonic_values


def plain_curve(rows):
    """max over starts up to x of min over ends from x of the mean between them."""
    xs = sorted({x for x, _ in rows})
    n = {x: sum(a == x for a, _ in rows) for x in xs}
    t = {x: sum(y for a, y in rows if a == x) for x in xs}
    mean = lambda i, j: sum(t[x] for x in xs[i : j + 1]) / sum(n[x] for x in xs[i : j + 1])
    return {x: max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k, x in enumerate(xs)}


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_the_curve_of_parts_is_that_of_all_rows(spark, parts):
    rng = random.Random(parts)
    rows = [(x, float(rng.random() < 0.2 + 0.4 * x)) for x in (round(rng.random(), 2) for _ in range(700))]
    df = spark.createDataFrame([*rows, (None, 1.0), (0.5, None), (float("nan"), 1.0)], "x double, y double").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.x: (r.n, r.value) for r in isotonic_values(df.where("x = x and not isnan(x)"), "x", "y").collect()}
        x, value = isotonic_fit(df, "x", "y")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = plain_curve(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][1] == pytest.approx(v, abs=1e-12) and np.interp(k, x, value) == pytest.approx(v, abs=1e-12)


def test_weights_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 0.01, 100_000), (2.0, 0.005, 1000), (3.0, 0.5, 0)], "x double, y double, w long")
    blocks = isotonic_blocks(df, "x", "y", "w").collect()
    assert [(b.lo, b.hi, b.n) for b in blocks] == [(1.0, 2.0, 101_000.0)] and blocks[0].total == pytest.approx(1005)
    assert isotonic_blocks(df.where("x < 0"), "x", "y").count() == 0


def plain_boosting(x, y, k, rounds, depth, rate, model):
    """Softmax trees over raw comparisons, one node and one feature at a time."""
    bins = model.binned(list(x.T))
    sizes = np.bincount(y, minlength=k)
    w = (len(y) / (k * sizes))[y]
    score = np.tile(model.start, (len(y), 1))
    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        for c in range(k):
            g, h = (p[:, c] - (y == c)) * w, p[:, c] * (1 - p[:, c]) * w
            nodes = [np.arange(len(y))]
            for _ in range(depth):
                nxt = []
                for rows in nodes:
                    best = (1e-9, None)
                    for f in range(x.shape[1]):
                        for cut in np.unique(bins[:, f]):
                            left = rows[bins[rows, f] <= cut]
                            right = rows[bins[rows, f] > cut]
                            if h[left].sum() < boosting.LEAST or h[right].sum() < boosting.LEAST:
                                continue
                            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)  # noqa: E731,B023
                            gain = worth(left) + worth(right) - worth(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, (left, right))
                    nxt += best[1] if best[1] else (rows, rows[:0])
                nodes = nxt
            for rows in nodes:
                score[rows, c] -= rate * g[rows].sum() / (h[rows].sum() + 1)
    return np.exp(score) / np.exp(score).sum(1, keepdims=True)


def table(spark, x, y):
    rows = [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(3)


def test_boosting_equals_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 3))
    x[::17, 1] = np.nan
    y = (np.nan_to_num(x[:, 0]) > 0.3).astype(int) + (np.nan_to_num(x[:, 1]) > 0.1)
    model = boosting.fit(table(spark, x, y), ["a", "b", "c"], "y", 3, rounds=3, depth=2, rate=0.3)
    got = {r.id: r.probability for r in model.predict(table(spark, x, y)).collect()}
    want = plain_boosting(x, y, 3, 3, 2, 0.3, model)
    assert np.allclose([got[i] for i in range(240)], want, atol=1e-6)


def test_boosting_learns_what_no_single_split_tells(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    model = boosting.fit(table(spark, x[:600], y[:600]), ["a", "b", "c"], "y", 2, rounds=8, depth=3, rate=0.4)
    out = model.predict(table(spark, x[600:], y[600:])).collect()
    assert np.mean([r.prediction == r.y for r in out]) > 0.9


def test_boosting_of_nothing_and_of_one_class(spark):
    x, y = np.zeros((4, 3)), np.ones(4, int)
    none = boosting.fit(table(spark, x, y).where("id < 0"), ["a", "b", "c"], "y", 2, rounds=2)
    assert [r.probability for r in none.predict(table(spark, x, y)).collect()] == [[0.5, 0.5]] * 4
    one = boosting.fit(table(spark, x, y), ["a", "b", "c"], "y", 2, rounds=2)
    assert {r.prediction for r in one.predict(table(spark, x, y)).collect()} == {1.0}
