"""Hand-computed cases of alerts and metrics, on literal rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from vigil.functions.columns import norm_ppf_sql, norm_sf_sql, top2mean
from vigil.functions.ranks import average_precision, roc_auc
from vigil.operators import alerts as A
from vigil.operators import metrics as M

T0 = dt.datetime(2026, 1, 1)


def events(spark, rows):
    """rows: id, entity, minutes, score[, ip]"""
    return spark.createDataFrame([(r[0], r[1], T0 + dt.timedelta(minutes=r[2]), float(r[3]), r[4] if len(r) > 4 else "1.1.1.1") for r in rows], "event_id string, entity_id string, timestamp timestamp, score double, source_ip string")


def labels(spark, rows):
    """rows: id, label, campaign, confounder"""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], "event_id string, label string, campaign_id string, confounder string")


@pytest.mark.parametrize("values, want", [([5.0], 5), ([1.0, 2.0, 3.0], 2.5), ([0.1, 0.9], 0.5), ([4.0, 4.0, 0.0], 4), ([], math.nan), ([math.nan, 2.0, 6.0], 4)])
def test_top2mean(spark, values, want):
    got = spark.createDataFrame([(values,)], "v array<double>").select(top2mean(F.col("v"))).first()[0]
    assert got == want or (math.isnan(got) and math.isnan(want))


def test_merge_window(spark):
    a, m = A.group_alerts(events(spark, [("e1", "A", 0, 0.1), ("e2", "A", 30, 0.9), ("e3", "A", 120, 0.5), ("e4", "B", 0, 0.3)]), "entity")
    assert sorted((r.alert_score, r.n_events) for r in a.collect()) == [(0.3, 1), (0.5, 1), (0.5, 2)]
    assert m.count() == 4 and A.group_alerts(events(spark, []), "entity")[0].count() == 0


def test_gap_of_the_window_merges(spark):
    assert A.group_alerts(events(spark, [("a", "A", 0, 1), ("b", "A", 60, 1)]), "entity")[0].count() == 1
    assert A.group_alerts(events(spark, [("a", "A", 0, 1), ("b", "A", 61, 1)]), "entity")[0].count() == 2


def test_event_metrics(spark):
    ev = events(spark, [(f"e{i:03d}", "A", 0, 1 - i / 100) for i in range(100)])
    m = M.event_metrics(ev, labels(spark, [(f"e{i:03d}", "brute_force", "C") for i in (1, 5, 50)]), 0.10).first()
    assert (m.k, m.precision_at_k, m.prevalence) == (10, 0.2, 0.03)
    assert m.recall_at_k == pytest.approx(2 / 3) and m.r_precision == pytest.approx(1 / 3)


def test_recall_ceiling(spark):
    ev = events(spark, [(f"e{i:04d}", "A", 0, 1.0 if i < 30 else 0.0) for i in range(1000)])
    m = M.event_metrics(ev, labels(spark, [(f"e{i:04d}", "brute_force", "C") for i in range(30)]), 0.01).first()
    assert m.recall_at_k == m.recall_ceiling == pytest.approx(1 / 3) and m.r_precision == 1 and m.roc_auc == 1 and m.average_precision == 1


def test_insider_drift_is_no_positive(spark):
    ev = events(spark, [(f"e{i}", "A", 0, 1 - i / 10) for i in range(10)])
    m = M.event_metrics(ev, labels(spark, [("e0", "insider_drift", "D"), ("e1", "lateral_movement", "C")]), 0.2).first()
    assert (m.n_attack, m.precision_at_k, m.recall_at_k, m.insider_share) == (1, 0.5, 1.0, 0.5)


@pytest.mark.parametrize("rows, want", [("C1 C1 C2 -", ("C1", 2)), ("C2 C2 C1 -", ("C2", 2)), ("C2 C1 - -", ("C1", 1)), ("- - - -", None)])
def test_attribution(spark, rows, want):
    ids = ["a", "b", "c", "d"]
    assign = spark.createDataFrame([(i, "x", "entity") for i in ids], "event_id string, alert_id string, level string")
    lab = labels(spark, [(i, "normal" if c == "-" else "brute_force", None if c == "-" else c) for i, c in zip(ids, rows.split())])
    got = A.attribution(assign, lab).collect()
    assert [(r.campaign_id, r.n_campaign) for r in got] == ([want] if want else [])


def campaigns(spark, rows):
    return spark.createDataFrame([(c, k, T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b)) for c, k, a, b in rows], "campaign_id string, campaign_type string, start_ts timestamp, end_ts timestamp")


def incident(spark, rows, lab, camps, budget, days):
    ev = events(spark, rows)
    a, m = A.group_alerts(ev, "entity")
    q = M.reviewed(a, days, {"entity": budget})
    found = M.detections(q, m, labels(spark, lab), campaigns(spark, camps), ev)
    return M.incident_metrics(q, found, days).first(), {r.campaign_type: r for r in M.recall_by_type(found).collect()}


def test_campaigns_count_once_each(spark):
    rows = [(f"a{i}", "A", i % 30, 0.9) for i in range(50)] + [("b", "B", 0, 0.8)] + [(f"n{i}", f"N{i}", 0, 0.1) for i in range(60)]
    lab = [(f"a{i}", "brute_force", "C1") for i in range(50)] + [("b", "device_spoofing", "C2")]
    m, types = incident(spark, rows, lab, [("C1", "brute_force", 0, 30), ("C2", "device_spoofing", 0, 1)], 5, 1)
    assert m.recall == 1.0 and all(t.n_campaigns == 1 for t in types.values())


def test_redundant_alerts(spark):
    rows = [("a", "A", 0, 0.9), ("b", "A", 500, 0.9)] + [(f"n{i}", f"N{i}", 0, 0.1) for i in range(50)]
    m, _ = incident(spark, rows, [("a", "brute_force", "C1"), ("b", "brute_force", "C1")], [("C1", "brute_force", 0, 500)], 4, 1)
    assert (m.n_detected, m.redundant, m.n_reviewed, m.precision) == (1, 1, 4, 0.25)


def test_time_to_detect(spark):
    rows = [("a", "A", 0, 0.01), ("b", "A", 20 * 1440, 0.99)] + [(f"n{i}", f"N{i}", 0, 0.05) for i in range(50)]
    m, _ = incident(spark, rows, [("a", "low_and_slow", "C"), ("b", "low_and_slow", "C")], [("C", "low_and_slow", 0, 20 * 1440)], 1, 20)
    assert m.recall == 1 and m.median_ttd_hours == 480.0 and m.share_early == 0


def test_fp_breakdown(spark):
    ev = events(spark, [(f"e{i:02d}", "A", 0, 1 - i / 20) for i in range(20)])
    lab = labels(spark, [("e00", "normal", None, "business_travel"), ("e01", "normal", None, "business_travel"), ("e02", "normal", None, "os_patch"), ("e03", "brute_force", "C")])
    got = {r.kind: (r.n_fp, r.fp_share) for r in M.fp_breakdown(ev, lab, 0.25).collect()}
    assert got["business_travel"] == (2, 0.5)
    assert sum(n for n, _ in got.values()) == 4


def test_bands(spark):
    ev = events(spark, [(f"i{i}", "A", 0, 0.5) for i in range(10)] + [(f"l{i}", "A", 0, 0.9) for i in range(10)])
    lab = labels(spark, [(f"i{i}", "insider_drift") for i in range(10)] + [(f"l{i}", "low_and_slow") for i in range(10)])
    got = {r.label: r for r in M.band_report(ev, lab, 0.8).collect()}
    assert got["insider_drift"].medium == 1.0 and got["low_and_slow"].high == 1.0


def test_ip_level(spark):
    ev = events(spark, [(f"e{i}", f"E{i}", i, 0.5, "9.9.9.9") for i in range(10)])
    assert A.group_alerts(ev, "entity")[0].count() == 10
    (one,) = A.group_alerts(ev, "ip")[0].collect()
    assert one.n_events == 10


def test_pools():
    assert A.pooled_bins({0: 50, 1: 10, 2: 25, 3: 5}) == [[0], [1, 2, 3]]
    assert A.pooled_bins({0: 5, 1: 6}) == [[0, 1]] and A.pooled_bins({}) == []


def test_normal_functions(spark):
    from statistics import NormalDist

    n = NormalDist()
    ps = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.9, 0.999, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(F.expr(norm_ppf_sql("p"))).collect()]
    assert got == pytest.approx([n.inv_cdf(p) for p in ps], rel=1e-7, abs=1e-8)
    xs = [-5.0, -1.0, 0.0, 0.5, 3.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.expr(norm_sf_sql("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in xs], rel=1e-6)


def test_tied_scores(spark):
    rows = [(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 0), (0.5, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, y int")
    pos = F.col("y") == 1
    assert average_precision(df, "score", pos).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 5)
    wins = sum(1 if a > b else 0.5 if a == b else 0 for a, y in rows if y for b, z in rows if not z)
    assert roc_auc(df, "score", pos).first()[0] == pytest.approx(wins / 8)


def test_ranks_quantiles_and_intervals(spark):
    """Running sums, places and quantiles by buckets equal what one sorted list gives."""
    import random

    from vigil.functions import ranks

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([0.0, -0.0, 1.5, -2.25, rng.gauss(0, 1), rng.gauss(0, 1e6), rng.gauss(0, 1e-6)]), rng.random() < 0.3) for i in range(500)] + [(900, "a", float("nan"), False), (901, "b", None, True), (902, "a", float("inf"), True), (903, "a", float("-inf"), True)]
    df = spark.createDataFrame(rows, "event_id long, g string, score double, y boolean").repartition(5)
    finite = [r for r in rows if r[2] is not None and r[2] == r[2]]
    low = lambda v: float("-inf") if v is None or v != v else v
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-low(r[2]), r[0])), 1)}
    assert {r.event_id: r["rank"] for r in ranks.global_rank(df, "score", "event_id").collect()} == want
    per = {r.score: r for r in ranks.score_steps(df.where("score IS NOT NULL AND NOT isnan(score)"), "score", F.col("y")).collect()}
    for s, r in per.items():
        assert r.cum_n == sum(x[2] >= s for x in finite) and r.cum_pos == sum(x[2] >= s and x[3] for x in finite)
    plain = [r for r in finite if abs(r[2]) != float("inf")]
    got = {r.g: r for r in ranks.quantiles(df.where("abs(score) < 1e300"), "score", {"mid": 0.5, "low": 0.16}, ("g",)).collect()}
    for g in "ab":
        v = sorted(r[2] for r in plain if r[1] == g)
        for name, q in (("mid", 0.5), ("low", 0.16)):
            at = (len(v) - 1) * q
            k = int(at)
            assert abs(got[g][name] - (v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (at - k))) < 1e-9
    pos, neg = [r[2] for r in plain if r[3]], [r[2] for r in plain if not r[3]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    r = ranks.bootstrap_auc(df.where("abs(score) < 1e300"), "score", F.col("y"), 60).first()
    assert abs(r.roc_auc - auc) < 1e-9 and r.low < auc < r.high and r.high - r.low < 0.3


def test_verdicts_scale_and_burn_in(spark):
    from vigil.operators import alerts as A
    from vigil.operators import metrics as M

    v = spark.createDataFrame([("a", "true", 1), ("a", "false", 2), ("b", "true", 1)], "alert_id string, verdict string, at int")
    assert {r.verdict: r.n for r in M.verdict_counts(v).collect()} == {"true": 1, "false": 1}
    ev = spark.createDataFrame([(str(i),) for i in range(200)], "entity_id string")
    camps = lambda k: spark.createDataFrame([("brute_force",)] * k, "campaign_type string")
    assert M.scale_note(ev, camps(50)) is None and "illustration" in M.scale_note(ev, camps(3))
    days = spark.sql("SELECT explode(sequence(timestamp'2026-01-01', timestamp'2026-01-20', interval 1 day)) AS start_ts")
    assert A.burned_in(days).count() == 13


def test_leads(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t, 0.5), (2, t, 0.9), (3, t + dt.timedelta(1), 0.9), (4, t, None), (5, t, float("nan"))], "event_id long, timestamp timestamp, score double")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "event_id long, alert_id string")
    got = {r.alert_id: tuple(r)[1:] for r in A.leads(members, ev).collect()}
    assert got == {"a": (3, 1, 3, 2), "b": (2, 4, 5, None)}
    assert A.leads(members.limit(0), ev).count() == 0
