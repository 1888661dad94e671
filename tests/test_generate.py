import datetime

import pytest
from pyspark.sql import functions as F

from vigil.functions.columns import bumped
from vigil.plans import pipeline, studies
from vigil.schema import ATTACK_TYPES, CAMPAIGN_SCHEMA, EVENT_SCHEMA, LABEL_SCHEMA, LabelLeakError, assert_feature_frame
from vigil.sources import tables
from vigil.sources.generate import generate


@pytest.fixture(scope="module")
def log(spark):
    return tuple(pipeline.store(x) for x in generate(spark, 1, 40, 30, 0.5, 3))


def test_contract_and_contents(spark, log):
    events, labels, campaigns = log
    assert [(f.name, f.dataType) for f in events.schema] == [(f.name, f.dataType) for f in EVENT_SCHEMA]
    assert labels.columns == LABEL_SCHEMA.names and campaigns.columns == CAMPAIGN_SCHEMA.names
    n = events.count()
    assert n == labels.count() == events.select("event_id").distinct().count() > 5000
    kinds = {r.label for r in labels.select("label").distinct().collect()}
    assert set(ATTACK_TYPES) | {"normal", "insider_drift"} == kinds
    assert_feature_frame(events)
    with pytest.raises(LabelLeakError):
        assert_feature_frame(events.withColumn("label", F.lit(1)))
    with pytest.raises(LabelLeakError):  # this process has the generator
        assert_feature_frame(events, alone=True)
    versions = spark.createDataFrame([("10.2.9",), ("os 11 23H2",), ("n/a",), (None,)], "v string")
    assert [r.b for r in versions.select(bumped(F.col("v")).alias("b")).collect()] == ["10.2.10", "os 11 23H3", "n/a", None]


def test_same_log_under_any_partitioning(spark):
    a, _, _ = generate(spark, 5, 10, 10)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b, _, _ = generate(spark, 5, 10, 10)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    digest = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    assert digest(a) == digest(b)


def test_round_trip_and_discovery(spark, log, tmp_path):
    tables.write_tag(str(tmp_path), "t1", *log)
    assert tables.tags(spark, str(tmp_path)) == ["t1"]
    e, labels, c = tables.read_tag(spark, str(tmp_path), "t1")
    assert e.count() == log[0].count() and c.count() == log[2].count()
    folder = f"{tmp_path}/seed3_delta05"
    tables.write_bundle(spark, folder, {"meta": {"a": float("nan"), "t": datetime.datetime(2026, 1, 1), "n": [1, 2]}}, {"volume": c.select("campaign_id"), "hist": e.select("event_id", "command_sequence").limit(5)})
    assert [(s, d) for s, d, _ in tables.bundles(spark, str(tmp_path))] == [(3, 0.5)]
    assert tables.load_bundle(spark, folder) is None
    back = tables.read_bundle(spark, folder)
    assert back["meta"] == {"a": None, "t": "2026-01-01T00:00:00", "n": [1, 2]}
    assert back["volume"].count() == c.count() and back["hist"].count() == 5
    full = f"{tmp_path}/full"
    figures = spark.createDataFrame([("seed101", 0.25, 3)], "log string, prevalence double, n int")
    tables.write_bundle(spark, full, {n: {} for n in tables.BUNDLE_REQUIRED} | {"latency": {"p50_ms": 1.5}}, {"entity_history": figures, "fp_breakdown": figures})
    tables.write_figures(f"{full}/figures", {"holdout": figures})
    whole = tables.load_bundle(spark, full)
    assert whole["latency"] == {"p50_ms": 1.5} and dict(whole["fp_breakdown"].dtypes) == {"log": "string", "prevalence": "double", "n": "int"}
    assert whole["entity_history"].first() == figures.first() and spark.read.csv(f"{full}/figures/holdout.csv", header=True).count() == 1


def test_pipeline_ranks_attacks_first(spark, log):
    out = pipeline.run(spark, log, log, 30, explain=5)
    m = out["event_metrics"].first()
    assert m.average_precision > 5 * m.prevalence and m.roc_auc > 0.7
    assert out["incident_metrics"].first().n_detected > 0
    why = out["explained"].collect()
    assert len(why) == 5 and all(r.summary and r.pred_type for r in why)
    assert {r.level for r in out["alerts"].select("level").distinct().collect()} == {"entity", "ip", "long"}


def test_audit_finds_a_leak(spark, log):
    events, labels, _ = log
    marked = events.join(labels.select("event_id", "label"), "event_id").withColumn("device_os", F.when(F.col("label").isin(*ATTACK_TYPES), "evil").otherwise(F.col("device_os"))).drop("label")
    bad = studies.audit(marked.select(*EVENT_SCHEMA.names), labels, splits=1)
    assert not bad["passed"] and ("device_os", "evil") in bad["exclusive"]


def test_frozen_config():
    c = studies.frozen_config()
    studies.verify_config(c)
    with pytest.raises(ValueError):
        studies.verify_config(c | {"hash": "0"})


def test_each_confounder_raises_its_signal(spark, log):
    from vigil.operators.signals import signal_frame
    from vigil.sources.generate import CONFOUNDERS

    events, labels, _ = log
    got = pipeline.store(signal_frame(events).join(labels.select("event_id", "label", "confounder"), "event_id").where("label = 'normal'"))
    kinds = {r.confounder for r in got.select("confounder").distinct().collect()}
    assert set(CONFOUNDERS) <= kinds
    raised = {
        "business_travel": "geo_velocity", "password_reset_storm": "fail_rate_entity", "cert_retry_loop": "fail_rate_entity", "os_patch": "fingerprint_mismatch", "device_refresh": "fingerprint_mismatch",
        "oncall_rotation": "hour_surprisal", "maintenance_window": "hour_surprisal", "project_onboarding": "new_resource_rate_7d", "ci_automation_burst": "ncmd_z", "shared_jump_host": "ip_entity_fanout", "office_nat": "ip_entity_fanout", "credential_rotation": "auth_method_novelty",
    }
    names = sorted(set(raised.values()))
    mean = {r.confounder: r for r in got.groupBy("confounder").agg(*[F.avg(n).alias(n) for n in names]).collect()}
    for kind, name in raised.items():
        assert mean[kind][name] > mean[None][name], (kind, name, mean[kind][name], mean[None][name])


def test_addresses_of_attacks_are_those_of_benign_traffic(log):
    events, labels, _ = log
    both = events.join(labels.select("event_id", "label"), "event_id")
    own = both.where("label = 'normal'").select("source_ip").distinct()
    campaigns = both.where(F.col("label").isin("brute_force", "credential_stuffing", "lateral_movement", "low_and_slow")).select("source_ip").distinct()
    assert campaigns.join(own, "source_ip", "left_semi").count() / campaigns.count() > 0.4


def test_meta_and_memoised_datasets(spark, log, tmp_path):
    from vigil.sources import generate as g

    m = g.meta(*log)
    assert m["n_events"] == log[0].count() and 0 < m["prevalence"] < 0.5 and m["campaigns"]["brute_force"] == 3
    a = g.ensure_dataset(spark, str(tmp_path), "s", seed=2, n_entities=5, days=10, per_kind=1)
    n = a[0].count()
    assert g.ensure_dataset(spark, str(tmp_path), "s", seed=99, n_entities=50)[0].count() == n
