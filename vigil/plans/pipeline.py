"""The batch plan: fit on one log, score another, form alerts, measure and explain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.operators import explain as X
from vigil.operators import fusion as U
from vigil.operators import metrics as M
from vigil.operators.signals import signal_frame
from vigil.schema import LEVELS, assert_feature_frame
from vigil.sources.store import store

KEEP = ("entity_id", "entity_type", "source_ip", "timestamp")


def score_log(events: DataFrame, fusions: dict[str, U.Fusion]) -> DataFrame:
    return store(U.score(signal_frame(assert_feature_frame(events), KEEP), fusions))


def level_frame(scored: DataFrame, level: str) -> DataFrame:
    """One level's scores with p ranked within the live cohort."""
    return U.rank_p(scored.select("event_id", *KEEP, F.col(f"raw_{level}").alias("score"), F.col(f"cal_{level}").alias("score_cal")), "score", "entity_type")


def with_z(scored: DataFrame, fusions: dict[str, U.Fusion]) -> DataFrame:
    """scored with z_<signal> of every level against the fitted references."""
    held = scored.sparkSession.sparkContext.broadcast(fusions)
    columns, names = scored.columns, [s.name for f in fusions.values() for s in [*f.signals, *f.mitigators]]

    def run(batches):
        for pdf in batches:
            pdf = pdf[columns]
            for f in held.value.values():
                both = [*f.signals, *f.mitigators]
                if both:
                    z = f.z(pdf, both)
                    for i, s in enumerate(both):
                        pdf[f"z_{s.name}"] = z[:, i]
            yield pdf

    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in scored.schema] + [f"z_{n} double" for n in names])
    return scored.mapInPandas(run, schema)


def run(spark: SparkSession, fit_log, eval_log, days: float, explain: int = 40) -> dict[str, DataFrame]:
    """fit_log, eval_log: (events, labels, campaigns). Gives scored events, alerts, their members and the reports."""
    fit_signals = store(signal_frame(assert_feature_frame(fit_log[0]), KEEP))
    fusions = U.fit(fit_signals, fit_log[1])
    events, labels, campaigns = eval_log
    scored = score_log(events, fusions)
    alerts, members = None, None
    for level in LEVELS:
        a, m = A.group_alerts(level_frame(scored, level), level)
        alerts, members = (a, m) if alerts is None else (alerts.unionByName(a), members.unionByName(m))
    alerts, members = store(alerts), store(members)
    budgets = A.estate_budgets(scored.select("entity_id").distinct().count())
    queue = M.reviewed(alerts, days, budgets)
    found = store(M.detections(queue, members, labels, campaigns, events))
    return {
        "scored": scored,
        "alerts": alerts,
        "members": members,
        "queue": queue,
        "event_metrics": M.event_metrics(scored, labels),
        "incident_metrics": M.incident_metrics(queue, found, days),
        "recall_by_type": M.recall_by_type(found),
        "fp_breakdown": M.fp_breakdown(scored, labels),
        "bands": M.labelled(scored, labels).groupBy("label").agg(*[F.avg((F.col("band") == b).cast("int")).alias(b.lower()) for b in ("HIGH", "MEDIUM", "LOW")]),
        "explained": X.explain_alerts(alerts, members, with_z(scored, fusions), explain),
        "weights": weights(spark, fusions),
    }


def weights(spark: SparkSession, fusions: dict[str, U.Fusion]) -> DataFrame:
    rows = [(lv, s.name, s.prior, float(w), f.scale, f.theta) for lv, f in fusions.items() for s, w in zip(f.signals, f.weights)]
    return spark.createDataFrame(rows, "level string, signal string, prior double, weight double, scale double, theta double")


