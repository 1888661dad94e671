"""Why an alert: its strongest signals as text, the likely kind of attack, and one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.schema import BY_NAME, SIGNALS

#: What each kind weighs of the positive evidence, in the order that breaks ties.
TYPE_RULES = {
    "impossible_travel": {"geo_velocity": 2.0, "country_novelty": 1.0},
    "brute_force": {"fail_rate_entity": 1.5, "burst_ratio": 1.5, "ip_entity_fanout": -1.0},
    "credential_stuffing": {"ip_entity_fanout": 2.5, "fail_rate_ip": 1.0, "ip_fail_ratio": 1.0},
    "device_spoofing": {"fingerprint_mismatch": 2.0},
    "lateral_movement": {"cmd_surprisal": 2.0, "burst_ratio": 1.5, "resource_surprisal": 0.6, "peer_incongruence": 0.6, "offhours_rate_7d": -0.8},
    "low_and_slow": {"offhours_rate_7d": 2.0, "new_resource_rate_7d": 2.0, "uncorroborated_new_edges_7d": 1.5, "breadth_ratio_7d": 1.0, "burst_ratio": -1.5, "cmd_surprisal": -0.8},
}


def type_scores(z: dict[str, Column]) -> dict[str, Column]:
    """Score of each kind: weighted z of its signals, where z is at least 1."""
    used = lambda n: F.when(z[n] >= 1, z[n]).otherwise(0.0) if n in z else F.lit(0.0)
    return {kind: sum((used(n) * w for n, w in rule.items()), F.lit(0.0)) for kind, rule in TYPE_RULES.items()}


def predict_type(df: DataFrame, z: dict[str, Column]) -> DataFrame:
    """Adds pred_type (unclassified if no kind scores above 0) and pred_confidence (its share of the positive scores)."""
    s = type_scores(z)
    order = list(TYPE_RULES)
    best = F.array_max(F.array(*[F.struct(s[k].alias("s"), F.lit(-i).alias("i")) for i, k in enumerate(order)]))
    df = df.withColumn("_best", best).withColumn("_all", sum((F.greatest(F.lit(0.0), c) for c in s.values()), F.lit(0.0)))
    name = F.element_at(F.array(*map(F.lit, order)), 1 - F.col("_best.i"))
    good = F.col("_best.s") > 0
    return df.withColumn("pred_type", F.when(good, name).otherwise("unclassified")).withColumn("pred_confidence", F.when(good, F.col("_best.s") / F.col("_all")).otherwise(0.0)).drop("_best", "_all")


def explanation(z: dict[str, Column], value: dict[str, Column], k: int = 3) -> Column:
    """The k strongest signals with z above 0.5, strongest first (ties: registry order), each with its text."""
    names = [s.name for s in SIGNALS if s.name in z]
    each = [F.struct((-z[n]).alias("order"), F.lit(i).alias("place"), F.lit(n).alias("signal"), z[n].alias("z"), value[n].alias("value"), F.format_string(BY_NAME[n].text, value[n]).alias("text")) for i, n in enumerate(names)]
    kept = F.slice(F.array_sort(F.filter(F.array(*each), lambda x: x["z"] > 0.5)), 1, k)
    return F.transform(kept, lambda x: F.struct(x["signal"].alias("signal"), x["z"].alias("z"), x["value"].alias("value"), x["text"].alias("text")))


def sentence(scope: Column, why: Column, when: Column) -> Column:
    """One sentence of an alert's first three reasons."""
    parts = F.transform(F.slice(why, 1, 3), lambda x: x["text"])
    n = F.size(parts)
    body = F.when(n == 1, parts[0]).when(n == 2, F.array_join(parts, " and ")).otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), ", "), F.lit(", and "), F.try_element_at(parts, F.lit(3))))
    at = F.date_format(when, "yyyy-MM-dd HH:mm")
    return F.when(n == 0, F.concat(scope, F.lit(" stands out without one dominant signal, at "), at)).otherwise(F.concat(scope, F.lit(": "), body, F.lit(", at "), at))


def explain_alerts(alerts: DataFrame, assignment: DataFrame, scored: DataFrame, n: int = 40, k: int = 5) -> DataFrame:
    """The n highest alerts with their reasons; scored has event_id, entity_id, entity_type, signals and z_<signal>.

    Only the members of these alerts are joined. Evidence is the highest z of each signal over all members; the
    values are those of the member with the highest z.
    """
    top = alerts.orderBy(F.desc("alert_score"), "alert_id").limit(n)
    names = [s.name for s in SIGNALS if f"z_{s.name}" in scored.columns]
    plain = [x for x in names if not BY_NAME[x].mitigating]
    member = assignment.join(F.broadcast(top.select("alert_id")), "alert_id", "left_semi").select("alert_id", "event_id").join(scored, "event_id")
    most = F.greatest(*[F.col(f"z_{x}") for x in plain])
    per = member.groupBy("alert_id").agg(
        *[F.max(f"z_{x}").alias(f"z_{x}") for x in names], *[F.max_by(F.col(x), F.struct(most, "event_id")).alias(x) for x in names], F.min("_cold_start").alias("_cold"), F.max("_n_history").alias("n_history")
    )
    df = top.join(per, "alert_id")
    why = explanation({x: F.col(f"z_{x}") for x in plain}, {x: F.col(x) for x in plain}, k)
    df = predict_type(df, {x: F.col(f"z_{x}") for x in plain}).withColumn("why", why)
    return df.withColumn("summary", sentence(F.col("scope_key"), F.col("why"), F.col("start_ts"))).withColumn("cold_start", F.col("_cold") == 1).drop("_cold", *[f"z_{x}" for x in names], *names)
