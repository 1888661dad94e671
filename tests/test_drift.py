import math

import pytest
from pyspark.sql import functions as F

from vigil.plans import drift
from vigil.schema import EVENT_SCHEMA


@pytest.fixture(scope="module")
def experiment(spark):
    events = drift.world(spark, (1, 2), 2)
    assert events.drop("seed").schema.names == EVENT_SCHEMA.names
    daily, pairs = drift.run_experiment(events)
    return events, daily, pairs


def test_world_is_matched(experiment):
    events, _, _ = experiment
    per = {r.kind: r.n for r in events.where(F.col("entity_id").rlike("^[AB]")).groupBy(F.substring("entity_id", 1, 1).alias("kind")).agg(F.count("*").alias("n")).collect()}
    assert per["A"] == per["B"] == 4 * (60 * 6 + 30 * 2)
    assert events.select("event_id").distinct().count() == events.count()


def test_policies_and_pairs(experiment):
    _, daily, pairs = experiment
    rows = pairs.collect()
    assert {(r.seed, r.pair, r.policy) for r in rows} == {(s, p, a) for s in (1, 2) for p in (0, 1) for a in drift.POLICIES}
    assert {r.scenario for r in daily.select("scenario").distinct().collect()} == {"legit_drift", "slow_attacker", "control"}
    # Before the change all policies learn alike.
    early = daily.where(F.col("day") < drift.DRIFT_DAY).groupBy("entity_id", "day").agg((F.max("score") - F.min("score")).alias("gap"))
    assert early.agg(F.max("gap")).first()[0] == pytest.approx(0, abs=1e-12)
    mean = lambda policy, c: sum(getattr(r, c) for r in rows if r.policy == policy) / 4
    # A frozen baseline costs more alerts on legitimate change, and learns no attack.
    assert mean("none", "fp_legit") >= mean("all", "fp_legit")
    assert mean("none", "ratio_b") >= mean("all", "ratio_b") - 1e-9
    for r in rows:
        assert r.absorbed == (r.ratio_b < 0.5)


def test_summary(experiment):
    _, _, pairs = experiment
    out = drift.summary(pairs, 200)
    for r in out["policies"].collect():
        assert r.n_pairs == 4 and r.low <= r.absorbed <= r.high
    assert out["ratios"].columns == ["_key", *drift.POLICIES] and out["ratios"].count() == 4
    assert out["signed_ranks"].first().n <= 4


def test_scores_equal_an_event_by_event_fold(spark, experiment):
    """The policy 'all' learns always: its score is what the causal signals say."""
    from vigil.operators import signals as S
    from vigil.operators.causal import prepare

    events, _, _ = experiment
    one = events.where("seed = 1")
    frame = drift.evidence(one)
    theta = one.select("seed").distinct().withColumn("theta", F.lit(math.inf))
    got = {r.event_id: r.score for r in drift.fold(frame, theta, ("all",)).where(F.col("entity_id").startswith("B")).collect()}
    ev = S.corroboration(S.long_window(S.hour_surprisal(S.resource_signals(S.history(prepare(one.drop("seed")))))))
    for r in ev.where(F.col("entity_id").startswith("B")).collect():
        want = r.resource_surprisal + 0.6 * r.new_resource_rate_7d + 0.9 * r.uncorroborated_new_edges_7d - 0.7 * r.corroboration_7d
        assert got[r.event_id] == pytest.approx(want, abs=1e-9)
