"""Sums along ranges against windows: keys over many tasks, ties, small batches."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions.ranks import global_rank
from vigil.functions.scan import moving_average, scan, summed_ranges
from vigil.operators import fusion as U


@pytest.fixture
def small(spark):
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "37", "spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in was.items():
        spark.conf.set(n, v)


def rows_of(spark, seed, n, keys):
    rng = random.Random(seed)
    rows = [(i, rng.choice(keys), rng.randrange(n // 3), rng.choice("ab"), rng.choice([0, 1, 2, None])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k long, t long, u string, v int").repartition(5)


@pytest.mark.parametrize("keys", [[1], [1] * 60 + list(range(2, 30)), list(range(500))])
def test_scan_equals_windows(small, keys):
    rows = rows_of(small, 3, 2000, keys)
    got = {r.id: (r._before, r._own) for r in scan(rows, ["k"], ["t", "u"], "v").collect()}
    w = Window.partitionBy("k").orderBy("t", "u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.coalesce("v", F.lit(0))
    own = F.sum(v).over(Window.partitionBy("k", "t", "u"))
    want = {r.id: (r.b, r.o) for r in rows.select("id", (F.sum(v).over(w) - own).alias("b"), own.alias("o")).collect()}
    assert got == want


def test_a_key_of_everybody_is_dealt_over_all_tasks(small):
    rows = rows_of(small, 4, 6000, [7])
    parts = [r["count"] for r in summed_ranges(rows, ["k"], ["t", "id"], "v").where("_edge = 0").groupBy("_part").count().collect()]
    assert len(parts) == 9 and max(parts) < 2 * 6000 / 9


def test_scan_of_nothing(small):
    assert scan(rows_of(small, 1, 3, [1]).where("id < 0"), ["k"], ["t"], "v").count() == 0


def test_ranks_with_one_score_for_most_rows(small):
    rng = random.Random(5)
    rows = [(f"e{i:05d}", rng.choice(["a", "a", "a", None]), 0.0 if rng.random() < 0.9 else rng.choice([float("nan"), None, -1.5, 2.0, rng.random()])) for i in range(3000)]
    df = small.createDataFrame(rows, "event_id string, g string, score double").repartition(4)
    got = {r.event_id: r["rank"] for r in global_rank(df, "score", "event_id", by=("g",)).collect()}
    for g in ("a", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (float("inf") if r[2] is None or np.isnan(r[2]) else -r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_empirical_z_where_nearly_all_is_zero(small):
    rng = random.Random(6)
    rows = [(f"e{i:05d}", 0.0 if rng.random() < 0.95 else rng.random(), float(rng.randrange(3000)), None if i % 50 == 0 else 1.0) for i in range(2500)]
    df = small.createDataFrame(rows, "event_id string, x double, y double, w double").repartition(4)
    got = {r.event_id: r for r in U.empirical_z(df, ["x", "y", "w"]).collect()}
    assert len(got) == 2500
    from statistics import NormalDist

    for c, i in (("x", 1), ("y", 2)):
        values = np.array([r[i] for r in rows])
        for r in rows[:300]:
            p = (1 + (values >= r[i]).sum()) / 2501
            assert got[r[0]][f"z_{c}"] == pytest.approx(max(-4, min(6, -NormalDist().inv_cdf(min(p, 1 - 1e-12)))), abs=1e-6)


@pytest.mark.parametrize("rate", [0.02, 0.5, 0.9])
def test_moving_average_equals_the_fold(small, rate):
    rng = random.Random(7)
    rows = [(rng.choice("aab") if i % 9 else None, i, rng.choice([0.0, 1.0, rng.random() * 1000])) for i in range(4000)]
    df = small.createDataFrame(rows, "k string, t int, x double").repartition(4)
    got = {r.t: r.h for r in moving_average(df, ["k"], ["t"], "x", rate, "h").collect()}
    held = {}
    for k, t, x in rows:
        held[k] = (1 - rate) * held[k] + rate * x if k in held else x
        assert got[t] == pytest.approx(held[k], rel=1e-12, abs=1e-12)


def test_intervals_by_counts_agree_with_those_by_rows(spark):
    from vigil.functions import ranks

    rng = np.random.default_rng(8)
    score = np.round(rng.normal(size=1500), 1)
    y = rng.random(1500) < 1 / (1 + np.exp(-score))
    df = spark.createDataFrame([(float(s), bool(v)) for s, v in zip(score, y)], "score double, y boolean").repartition(4)
    got = ranks.bootstrap_auc(df, "score", F.col("y"), 200).first()

    def auc(w):
        order = np.argsort(score, kind="stable")
        s, p, n = score[order], (w * y)[order], (w * ~y)[order]
        below = {v: n[s < v].sum() + n[s == v].sum() / 2 for v in np.unique(s)}
        return sum(a * below[v] for a, v in zip(p, s)) / (p.sum() * n.sum())

    rows = [auc(rng.poisson(1, 1500)) for _ in range(200)]
    low, high = np.percentile(rows, [2.5, 97.5])
    assert abs(got.low - low) < 0.012 and abs(got.high - high) < 0.012
    mean = ranks.bootstrap_mean(df, "score", 400).first()
    rows = [np.average(score, weights=rng.poisson(1, 1500)) for _ in range(400)]
    assert abs(mean.low - np.percentile(rows, 2.5)) < 0.02 and abs(mean.high - np.percentile(rows, 97.5)) < 0.02


def test_draws_follow_the_weights(spark):
    from vigil.functions.draws import draw_by_weight, draw_from
    from vigil.sources.generate import u

    weights = {f"i{k:02d}": float(1 + (k * k) % 17) * (50 if k == 3 else 1) for k in range(40)}
    table = spark.createDataFrame([(k, w, "ab"[int(k[1:]) % 2]) for k, w in weights.items()] + [("none", 0.0, "a")], "item string, w double, g string")
    draws = spark.range(40_000).select("id", F.when(F.col("id") % 4 > 0, "a").otherwise("b").alias("g"))

    def chi(counts, share, n):
        return sum((counts.get(k, 0) - n * p) ** 2 / (n * p) for k, p in share.items())

    out = draw_by_weight(draws, u(1, "d", F.col("id")), table, "item", "w", "drawn")
    assert out.count() == 40_000
    counts = {r.drawn: r["count"] for r in out.groupBy("drawn").count().collect()}
    total = sum(weights.values())
    assert "none" not in counts and chi(counts, {k: w / total for k, w in weights.items()}, 40_000) < 73  # 39 degrees of freedom, p = 0.001
    by = draw_by_weight(draws, u(2, "d", F.col("id")), table, "item", "w", "drawn", ("g",))
    own = {k: w for k, w in weights.items() if int(k[1:]) % 2 == 0}
    counts = {r.drawn: r["count"] for r in by.where("g = 'a'").groupBy("drawn").count().collect()}
    assert set(counts) <= set(own) and chi(counts, {k: w / sum(own.values()) for k, w in own.items()}, 30_000) < 44
    p = np.array([0.5, 0.02, 0.3, 0.1, 0.08])
    counts = {r.k: r["count"] for r in spark.range(30_000).select(draw_from(p, u(3, "a", F.col("id")), u(3, "b", F.col("id"))).alias("k")).groupBy("k").count().collect()}
    assert chi(counts, dict(enumerate(p)), 30_000) < 18.5
