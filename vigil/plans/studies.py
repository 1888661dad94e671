"""Studies around the detector: leakage audit, ablation, learned types, drift policies, frozen configuration and sweeps."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil import schema
from vigil.functions import boosting
from vigil.functions.ranks import roc_auc, running
from vigil.operators import explain as X
from vigil.operators import fusion as U
from vigil.operators import metrics as M
from vigil.schema import ATTACK_TYPES, SIGNALS
from vigil.sources.store import store

AUDIT_GATE, SPLITS, TEST_SHARE = 0.60, 7, 0.35
ARTEFACTS = ["place", "decimals_lat", "decimals_lon", "decimals_duration", "id_length", "id_bucket", "entity_length", "first_octet", "n_commands", "has_commands", "microseconds"]


def artefacts(events: DataFrame) -> DataFrame:
    """event_id, entity_id and traits of how a row is written: none of them should tell an attack."""
    digits = lambda c: F.length(F.substring_index(F.col(c).cast("string"), ".", -1)).cast("double")
    t = F.col("timestamp").cast("timestamp")
    return events.select(
        "event_id",
        "entity_id",
        (F.row_number().over(Window.partitionBy("entity_id").orderBy("timestamp", "event_id")) / F.count("*").over(Window.partitionBy("entity_id"))).alias("place"),
        digits("geo_lat").alias("decimals_lat"),
        digits("geo_lon").alias("decimals_lon"),
        digits("session_duration").alias("decimals_duration"),
        F.length("event_id").cast("double").alias("id_length"),
        F.pmod(F.xxhash64("event_id"), F.lit(997)).cast("double").alias("id_bucket"),
        F.length("entity_id").cast("double").alias("entity_length"),
        F.coalesce(F.split("source_ip", r"\.")[0].cast("double"), F.lit(-1.0)).alias("first_octet"),
        F.coalesce(F.array_size("command_sequence"), F.lit(-1)).cast("double").alias("n_commands"),
        F.col("command_sequence").isNotNull().cast("double").alias("has_commands"),
        (F.unix_micros(t) % 1000000).cast("double").alias("microseconds"),
    )


def grouped_split(df: DataFrame, seed: int, share: float = TEST_SHARE) -> DataFrame:
    """Adds test: whole groups (a campaign, else an entity) go to one side, by a hash of the group and the seed."""
    group = F.coalesce("campaign_id", F.concat(F.lit("ent:"), F.coalesce(F.col("entity_id").cast("string"), F.lit(""))))
    place = F.conv(F.substring(F.md5(F.concat(group, F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("test", place % 1000 < int(1000 * share))


def trait_auc(events: DataFrame, labels: DataFrame, traits: list[str] = ARTEFACTS, splits: int = SPLITS) -> DataFrame:
    """trait, n_splits, mean_auc and sd_auc: how well each artefact alone tells attacks, over the test sides of the grouped splits.

    Splits without attacks or without other events on their test side don't count. Rows are counted by (trait, value) for all
    splits at once, so what is summed in order grows with the distinct values, not with rows times splits.
    """
    df = M.labelled(artefacts(events), labels)
    for s in range(splits):
        df = grouped_split(df, s).withColumnRenamed("test", f"_t{s}")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).cast("double").alias("value")) for t in traits])).alias("_x")
    attack = M.is_attack()
    rows = df.select(each, *[f for s in range(splits) for f in ((F.col(f"_t{s}") & attack).cast("long").alias(f"pos_{s}"), (F.col(f"_t{s}") & ~attack).cast("long").alias(f"neg_{s}"))])
    sides = [f"{side}_{s}" for s in range(splits) for side in ("pos", "neg")]
    per = store(rows.groupBy("_x.trait", "_x.value").agg(*[F.sum(c).alias(c) for c in sides]))
    steps = running(per, "value", {f"pos_{s}": f"upto_{s}" for s in range(splits)}, ("trait",))
    total = lambda c: F.sum(F.col(c).cast("double"))
    won = lambda s: F.sum(F.col(f"neg_{s}").cast("double") * (F.col(f"upto_{s}") - F.col(f"pos_{s}") / 2))
    aucs = steps.groupBy("trait").agg(F.array(*[won(s) / F.nullif(total(f"pos_{s}") * total(f"neg_{s}"), F.lit(0.0)) for s in range(splits)]).alias("aucs"))
    return aucs.select("trait", F.explode("aucs").alias("auc")).groupBy("trait").agg(F.count("auc").alias("n_splits"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("sd_auc"))


def audit(events: DataFrame, labels: DataFrame, splits: int = SPLITS, gate: float = AUDIT_GATE, rounds: int = 20) -> dict[str, object]:
    """Mean AUC of a classifier on artefacts over grouped splits, and values that only attacks have; passes below the gate without any."""
    df = store(M.labelled(artefacts(events), labels).withColumn("y", M.is_attack().cast("double")))
    aucs = []
    for s in range(splits):
        split = grouped_split(df, s)
        out = boosting.fit(split.where("not test"), ARTEFACTS, "y", 2, rounds).predict(split.where("test"))
        aucs.append(roc_auc(out.withColumn("s", F.round(F.col("probability")[1], 9)), "s", F.col("y") == 1).first()[0])
    known = [a for a in aucs if a is not None]
    mean = sum(known) / len(known) if known else float("nan")
    vocabulary = M.exclusive_values(M.labelled(events, labels), ["resource_type", "auth_method", "geo_country", "device_os"], M.is_attack()).collect()
    return {"auc": mean, "aucs": aucs, "exclusive": [(r["column"], r["value"]) for r in vocabulary], "passed": mean <= gate and not vocabulary}


def ablation(fit_signals: DataFrame, fit_labels: DataFrame, signals: DataFrame, labels: DataFrame) -> DataFrame:
    """Event metrics of the full model and without each layer, with the change in precision."""
    out = None
    layers = ("L0", "L1", "L2", "L3")
    for gone in (None, *layers):
        kept = tuple(x for x in layers if x != gone)
        scored = U.score(signals, U.fit(fit_signals, fit_labels, layers=kept))
        row = M.event_metrics(scored, labels).withColumn("without", F.lit(gone or "-"))
        out = row if out is None else out.unionByName(row)
    full = out.where("without = '-'").select("precision_at_k").scalar()
    return out.withColumn("change", F.col("precision_at_k") - full)


def learned_types(train: DataFrame, test: DataFrame, merge: bool = False, rounds: int = 40) -> DataFrame:
    """label and predicted type of attack events by boosted trees over z evidence; merge joins low_and_slow with insider_drift."""
    features = [f"z_{s.name}" for s in SIGNALS if f"z_{s.name}" in train.columns]
    kinds = [*ATTACK_TYPES, schema.INSIDER]
    name = F.when(F.col("label").isin("low_and_slow", schema.INSIDER), "slow").otherwise(F.col("label")) if merge else F.col("label")
    names = sorted({("slow" if merge and k in ("low_and_slow", schema.INSIDER) else k) for k in kinds})
    index = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(float(i)))])
    ready = lambda df: df.where(F.col("label").isin(*kinds)).withColumn("kind", name).withColumn("y", index[F.col("kind")])
    out = boosting.fit(ready(train), features, "y", len(names), rounds).predict(ready(test))
    return out.select("event_id", F.col("kind").alias("label"), F.element_at(F.array(*map(F.lit, names)), (F.col("prediction") + 1).cast("int")).alias("predicted"))


def merge_gain(train: DataFrame, test: DataFrame, rounds: int = 40) -> DataFrame:
    """Macro F1 of the learned types with all kinds and with low_and_slow and insider_drift joined, and their difference."""
    both = [M.macro_f1(learned_types(train, test, merge, rounds), "label", "predicted").select(F.col("macro_f1").alias(name)) for merge, name in ((False, "f1_apart"), (True, "f1_merged"))]
    return both[0].withColumn("f1_merged", both[1].scalar()).withColumn("gain", F.col("f1_merged") - F.col("f1_apart"))


def frozen_config() -> dict[str, object]:
    """Every constant that shapes a result, and a hash of them."""
    names = ("FAIL_WINDOW", "IP_WINDOW", "LONG_WINDOW", "COLD_N0", "COLD_MIN", "GEO_GATE_KM", "GEO_CAP_KMH", "BURST_MIN", "BURST_FLOOR", "OFFHOURS", "NGRAM", "MERGE_WINDOW", "DAILY_BUDGET", "Z_RANGE", "TARGET_FPR", "REFERENCE_ROWS", "MITIGATION")
    body = {n.lower(): getattr(schema, n) for n in names} | {"signals": [(s.name, s.level, s.layer, s.prior) for s in SIGNALS], "rules": X.TYPE_RULES}
    return body | {"hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]}


def verify_config(frozen: dict[str, object]) -> None:
    now = frozen_config()["hash"]
    if frozen.get("hash") != now:
        raise ValueError(f"the configuration has changed: {frozen.get('hash')} is now {now}")


def sweep(fit_log, logs: dict[str, tuple]) -> DataFrame:
    """Event metrics of one fitted model on several logs (levels of difficulty, held-out seeds)."""
    from vigil.operators.signals import signal_frame
    from vigil.plans.pipeline import KEEP

    fusions = U.fit(store(signal_frame(fit_log[0], KEEP)), fit_log[1])
    out = None
    for name, (events, labels, _) in logs.items():
        row = M.event_metrics(U.score(signal_frame(events, KEEP), fusions), labels).withColumn("log", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
