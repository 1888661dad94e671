"""Studies on a small generated log: learned kinds, their merging, layers, sweeps, the audit's table and the headline."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import fusion as U
from vigil.operators import metrics as M
from vigil.operators.signals import signal_frame
from vigil.plans import pipeline, studies
from vigil.schema import ATTACK_TYPES, INSIDER, SIGNALS
from vigil.sources.generate import generate
from vigil.sources.store import store


@pytest.fixture(scope="module")
def small(spark):
    out = []
    for seed in (1, 2):
        log = tuple(store(x) for x in generate(spark, seed, 16, 16, 0.2, 2))
        out.append((log, store(signal_frame(log[0], pipeline.KEEP))))
    return out


@pytest.fixture(scope="module")
def evidence(small):
    names = [s.name for s in SIGNALS]
    return [store(M.labelled(U.empirical_z(signals, names), log[1])) for log, signals in small]


def test_learned_types_name_the_kinds(evidence):
    out = studies.learned_types(*evidence, rounds=10)
    got = {(r.label, r.predicted): r.n for r in out.groupBy("label", "predicted").agg(F.count("*").alias("n")).collect()}
    kinds = {*ATTACK_TYPES, INSIDER}
    assert {k for pair in got for k in pair} <= kinds
    right = sum(n for (a, b), n in got.items() if a == b) / sum(got.values())
    assert right > 0.5 and out.count() == evidence[1].where(F.col("label").isin(*kinds)).count()


def test_merging_two_kinds_is_measured(evidence):
    r = studies.merge_gain(*evidence, rounds=4).first()
    assert r.gain == pytest.approx(r.f1_merged - r.f1_apart) and 0 < r.f1_apart <= 1 and 0 < r.f1_merged <= 1
    merged = studies.learned_types(*evidence, merge=True, rounds=2)
    assert {"low_and_slow", INSIDER} & {r.label for r in merged.select("label").distinct().collect()} == set()


def test_ablation_says_what_a_layer_is_worth(small):
    (fit_log, fit_signals), (log, signals) = small
    out = {r.without: r for r in studies.ablation(fit_signals, fit_log[1], signals, log[1]).collect()}
    assert set(out) == {"-", "L0", "L1", "L2", "L3"} and out["-"].change == 0
    for r in out.values():
        assert r.change == pytest.approx(r.precision_at_k - out["-"].precision_at_k)
    assert len({(r.precision_at_k, r.average_precision, r.roc_auc) for r in out.values()}) > 2  # layers count


def test_sweep_and_headline(small):
    (fit_log, _), (log, _) = small
    out = {r.log: r for r in studies.sweep(fit_log, {"own": fit_log, "other": log}).collect()}
    assert set(out) == {"own", "other"} and out["own"].n_events == fit_log[0].count()
    text = M.headline(out["other"]).splitlines()
    assert len(text) == 4 and text[0].startswith(f"events {log[0].count()}, attacks ") and f"average precision {out['other'].average_precision:.3f}" in text[3]


def test_grouped_split_keeps_groups_together(small):
    (log, _), _ = small
    df = M.labelled(studies.artefacts(log[0]), log[1])
    split = studies.grouped_split(df, 3)
    group = F.coalesce("campaign_id", "entity_id")
    assert split.groupBy(group).agg(F.countDistinct("test").alias("n")).where("n > 1").count() == 0
    assert 0 < split.where("test").count() < split.count()


def test_one_trait_alone(small):
    (log, _), _ = small
    traits = ["place", "id_length"]
    got = {r.trait: r for r in studies.trait_auc(log[0], log[1], traits, 3).collect()}
    df = M.labelled(studies.artefacts(log[0]), log[1]).withColumn("y", M.is_attack())
    for t in traits:
        aucs = []
        for s in range(3):
            rows = [(r[t], r.y) for r in studies.grouped_split(df, s).where("test").select(t, "y").collect()]
            up, down = [v for v, y in rows if y], [v for v, y in rows if not y]
            if up and down:
                aucs.append(sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down))
        assert got[t].n_splits == len(aucs) > 0 and got[t].mean_auc == pytest.approx(sum(aucs) / len(aucs), abs=1e-9)
    assert studies.trait_auc(log[0].limit(0), log[1], traits, 3).count() == 0
