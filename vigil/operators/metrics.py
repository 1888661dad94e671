"""Metrics of a ranking against labels, and reports over scored events and alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.ranks import global_rank, rank_statistics, running
from vigil.operators.alerts import attribution
from vigil.schema import ATTACK_TYPES, DAILY_BUDGET, INSIDER
from vigil.sources.store import store


def is_attack() -> Column:
    return F.col("label").isin(*ATTACK_TYPES)


def labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """scored with its labels; events without one are normal."""
    keep = [c for c in ("label", "campaign_id", "confounder", "is_cold_start") if c in labels.columns]
    return scored.drop(*keep).join(labels.select("event_id", *keep), "event_id", "left").withColumn("label", F.coalesce("label", F.lit("normal")))


def event_metrics(scored: DataFrame, labels: DataFrame, fraction: float = 0.01) -> DataFrame:
    """One row: prevalence, precision and recall among the top k = ceil(fraction N), their ceilings, R-precision, average precision, ROC-AUC."""
    df = store(labelled(scored, labels).select("event_id", "score", is_attack().alias("y"), (F.col("label") == INSIDER).alias("drift")))
    n = df.agg(F.count("*").alias("n_events"), F.sum(F.col("y").cast("long")).alias("n_attack")).withColumn("k", F.ceil(F.round(F.col("n_events") * fraction, 9)))
    ranked = global_rank(df, "score", "event_id").withColumn("n", n.select(F.struct("n_events", "n_attack", "k")).scalar())
    top = ranked.agg(
        F.first("n.n_events").alias("n_events"),
        F.first("n.n_attack").alias("n_attack"),
        F.first("n.k").alias("k"),
        F.sum((F.col("y") & (F.col("rank") <= F.col("n.k"))).cast("long")).alias("hits"),
        F.sum((F.col("y") & (F.col("rank") <= F.col("n.n_attack"))).cast("long")).alias("r_hits"),
        F.sum((F.col("drift") & (F.col("rank") <= F.col("n.k"))).cast("long")).alias("drift_hits"),
    )
    pos, k = F.nullif(F.col("n_attack"), F.lit(0)), F.nullif(F.col("k"), F.lit(0))
    out = top.select(
        "n_events",
        "n_attack",
        "k",
        (F.col("n_attack") / F.nullif(F.col("n_events"), F.lit(0))).alias("prevalence"),
        (F.col("hits") / k).alias("precision_at_k"),
        F.least(F.lit(1.0), F.col("n_attack") / k).alias("precision_ceiling"),
        (F.col("hits") / pos).alias("recall_at_k"),
        F.least(F.lit(1.0), F.col("k") / pos).alias("recall_ceiling"),
        (F.col("r_hits") / pos).alias("r_precision"),
        (F.col("drift_hits") / k).alias("insider_share"),
    )
    both = rank_statistics(df, "score", F.col("y")).select(F.struct("average_precision", "roc_auc")).scalar()
    return out.withColumn("_both", both).select("*", "_both.average_precision", "_both.roc_auc").drop("_both")


def reviewed(alerts: DataFrame, days: float, budgets: dict[str, float] | None = None) -> DataFrame:
    """The top K of each level's queue; K = max(1, budget times days, rounded half to even)."""
    budgets = budgets or DAILY_BUDGET
    out = None
    for level, per_day in budgets.items():
        k = max(1, round(per_day * days))
        top = alerts.where(F.col("level") == level).orderBy(F.desc("alert_score"), "alert_id").limit(k).withColumn("queue_k", F.lit(k))
        out = top if out is None else out.unionByName(top)
    return out


def detections(queue: DataFrame, assignment: DataFrame, labels: DataFrame, campaigns: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per attack campaign: whether a reviewed alert is attributed to it, how many are, and how late.

    With events (event_id, timestamp), detection is at the campaign's first event inside any reviewed alert;
    else at the start of its earliest alert.
    """
    camps = campaigns.where(F.col("campaign_type").isin(*ATTACK_TYPES)).select("campaign_id", "campaign_type", F.col("start_ts").alias("camp_start"), F.col("end_ts").alias("camp_end"))
    mine = assignment.join(queue.select("alert_id").distinct(), "alert_id", "left_semi")
    hits = queue.join(attribution(mine, labels), "alert_id").groupBy("campaign_id").agg(F.count("*").alias("n_alerts"), F.min("start_ts").alias("alert_ts"))
    out = camps.join(hits, "campaign_id", "left")
    if events is not None:
        inside = mine.select("event_id").distinct().join(labels.where(is_attack() & F.col("campaign_id").isNotNull()).select("event_id", "campaign_id"), "event_id").join(events.select("event_id", "timestamp"), "event_id")
        out = out.join(inside.groupBy("campaign_id").agg(F.min("timestamp").alias("event_ts")), "campaign_id", "left").withColumn("alert_ts", F.when(F.col("alert_ts").isNotNull(), F.coalesce("event_ts", "alert_ts"))).drop("event_ts")
    late = F.unix_timestamp("alert_ts") - F.unix_timestamp("camp_start")
    span = F.unix_timestamp("camp_end") - F.unix_timestamp("camp_start")
    return out.withColumns({"detected": F.col("n_alerts").isNotNull(), "ttd_hours": F.greatest(late, F.lit(0)) / 3600, "early": late <= span / 2})


def incident_metrics(queue: DataFrame, found: DataFrame, days: float) -> DataFrame:
    """One row over the campaigns of detections()."""
    q = queue.agg(F.count("*").alias("n_reviewed"), F.collect_set(F.struct("level", "queue_k")).alias("ks")).select("n_reviewed", F.aggregate("ks", F.lit(0).cast("long"), lambda a, x: a + x["queue_k"]).alias("budget_k"))
    c = found.agg(
        F.count("*").alias("n_campaigns"),
        F.sum(F.col("detected").cast("long")).alias("n_detected"),
        F.coalesce(F.sum("n_alerts"), F.lit(0)).alias("n_hits"),
        F.median("ttd_hours").alias("median_ttd_hours"),
        F.avg(F.when(F.col("detected"), F.col("early").cast("int"))).alias("share_early"),
    )
    c = c.withColumn("_q", q.select(F.struct("n_reviewed", "budget_k")).scalar()).select("*", "_q.n_reviewed", "_q.budget_k")
    n, k = F.nullif(F.col("n_campaigns"), F.lit(0)), F.nullif(F.col("budget_k"), F.lit(0))
    return c.select(
        "n_campaigns",
        "n_detected",
        (F.col("n_detected") / n).alias("recall"),
        (F.col("n_detected") / k).alias("precision"),
        F.least(F.lit(1.0), F.col("n_campaigns") / k).alias("precision_ceiling"),
        "budget_k",
        "n_reviewed",
        (F.col("n_reviewed") / days).alias("alerts_per_day"),
        F.greatest(F.lit(0), F.col("n_hits") - F.col("n_detected")).alias("redundant"),
        "median_ttd_hours",
        "share_early",
    )


def recall_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("campaign_type").agg(F.count("*").alias("n_campaigns"), F.sum(F.col("detected").cast("long")).alias("n_detected"), F.avg(F.col("detected").cast("int")).alias("recall"), F.median("ttd_hours").alias("median_ttd_hours"), F.avg(F.when(F.col("detected"), F.col("early").cast("int"))).alias("share_early"))


def budget_curve(alerts, assignment, labels, campaigns, days: float, factors=(0.1, 0.25, 0.5, 1, 2, 4), budgets=None) -> DataFrame:
    """Incident metrics at multiples of the budget."""
    out = None
    for f in factors:
        q = reviewed(alerts, days, {k: v * f for k, v in (budgets or DAILY_BUDGET).items()})
        row = incident_metrics(q, detections(q, assignment, labels, campaigns), days).withColumn("factor", F.lit(float(f)))
        out = row if out is None else out.unionByName(row)
    return out


def fp_breakdown(scored: DataFrame, labels: DataFrame, fraction: float = 0.01) -> DataFrame:
    """False positives of the top k by confounder: their count, rate among that confounder's events, and share."""
    scored = store(labelled(scored, labels).select("event_id", "score", "label", "confounder"))
    df = global_rank(scored, "score", "event_id")
    kind = F.coalesce("confounder", F.lit("(none)"))
    df = df.withColumn("_n", scored.agg(F.count("*")).scalar()).withColumn("kind", kind).withColumn("fp", ((F.col("rank") <= F.ceil(F.round(F.col("_n") * fraction, 9))) & ~is_attack()).cast("long"))
    per = df.where(~is_attack()).groupBy("kind").agg(F.sum("fp").alias("n_fp"), F.count("*").alias("n_all"))
    total = F.sum("n_fp").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("fp_rate", F.col("n_fp") / F.col("n_all")).withColumn("fp_share", F.col("n_fp") / F.nullif(total, F.lit(0))).where("n_fp > 0")


def band_report(scored: DataFrame, labels: DataFrame, theta: float) -> DataFrame:
    """Share of each band among the events of each label."""
    df = labelled(scored, labels)
    high, medium = (F.col("score") >= theta), (F.col("score") >= theta / 2)
    share = lambda c: F.avg(c.cast("int"))
    return df.groupBy("label").agg(F.count("*").alias("n"), share(high).alias("high"), share(medium & ~high).alias("medium"), share(~medium).alias("low"))


def cold_start_report(scored: DataFrame, labels: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Cold and warm events: shares of traffic and of the top k = max(1, int(fraction N)), attack rate, precision in the top."""
    scored = store(labelled(scored, labels).select("event_id", "score", "label", "is_cold_start"))
    df = global_rank(scored, "score", "event_id")
    df = df.withColumn("_n", scored.agg(F.count("*")).scalar())
    k = F.greatest(F.lit(1), F.floor(F.round(F.col("_n") * fraction, 9)))
    top = F.col("rank") <= k
    per = df.groupBy(F.coalesce("is_cold_start", F.lit(False)).alias("cold")).agg(
        F.count("*").alias("n"), F.first("_n").alias("_n"), F.first(k).alias("_k"), F.sum(top.cast("long")).alias("n_top"), F.avg(is_attack().cast("int")).alias("attack_rate"), F.avg(F.when(top, is_attack().cast("int"))).alias("top_precision")
    )
    return per.select("cold", "n", (F.col("n") / F.col("_n")).alias("traffic_share"), "n_top", (F.col("n_top") / F.col("_k")).alias("budget_share"), "attack_rate", "top_precision")


def volume_report(alerts: DataFrame, per_day: int, theta: float) -> DataFrame:
    """Alerts a day under a rate budget and under a fixed threshold."""
    day = F.date_trunc("day", "start_ts").alias("day")
    rate = alerts.groupBy(day).agg(F.least(F.count("*"), F.lit(per_day)).alias("rate_based"))
    fixed = alerts.where(F.col("alert_score") >= theta).groupBy(day).agg(F.count("*").alias("fixed_threshold"))
    return rate.join(fixed, "day", "full").na.fill(0)


def confusion(df: DataFrame, actual: str, predicted: str, classes: list[str]) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual")).pivot(predicted, classes).count().na.fill(0)


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean F1 over the classes that occur as actual ones."""
    pair = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    a = pair.groupBy(F.col(actual).alias("c")).agg(F.sum("n").alias("a"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    p = pair.groupBy(F.col(predicted).alias("c")).agg(F.sum("n").alias("p"))
    return a.join(p, "c", "left").agg(F.avg(2 * F.col("tp") / (F.col("a") + F.coalesce("p", F.lit(0)))).alias("macro_f1"), F.count("*").alias("n_classes"))


def exclusive_values(df: DataFrame, columns: list[str], attack: Column, support: int = 5) -> DataFrame:
    """Column values with enough rows that occur in attacks only."""
    each = df.select(attack.cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return each.groupBy("x.column", "x.value").agg(F.count("*").alias("support"), F.avg("y").alias("attack_share")).where((F.col("support") >= support) & (F.col("attack_share") >= 1.0))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns; 1 on the diagonal, 0 where a column is constant."""
    pairs = [(a, b) for a in columns for b in columns]
    safe = lambda a, b: F.when(F.isnan(F.corr(a, b)), 0.0).otherwise(F.coalesce(F.corr(a, b), F.lit(0.0)))
    wide = df.agg(*[(F.lit(1.0) if a == b else safe(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return wide.select(rows.alias("x")).select("x.a", "x.b", "x.r")


def quiet_runs(daily: DataFrame, keys: list[str], value: str, theta: float, days: int = 7) -> DataFrame:
    """First day of the first run of `days` consecutive daily values below theta, per key."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(0, days - 1)
    calm = (F.min((F.col(value) < theta).cast("int")).over(w) == 1) & (F.count("*").over(w) == days)
    return daily.withColumn("_calm", calm).groupBy(*keys).agg(F.min(F.when(F.col("_calm"), F.col("day"))).alias("quiet_from"))


def score_by_size(alerts: DataFrame) -> DataFrame:
    """n_alerts and r, the correlation of alert_score with n_events."""
    return alerts.agg(F.count("*").alias("n_alerts"), F.corr("alert_score", "n_events").alias("r"))


def recent_events(events: DataFrame, last: int = 40) -> DataFrame:
    """The last events of each entity, latest first by place, with the number of resources and addresses it has used in all."""
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("timestamp"), F.desc("event_id")))
    used = events.groupBy("entity_id").agg(F.countDistinct("resource_accessed").alias("n_resources"), F.countDistinct("source_ip").alias("n_ips"))
    return events.withColumn("place", place).where(F.col("place") <= last).join(used, "entity_id")


def first_alerts(queue: DataFrame, assignment: DataFrame, labels: DataFrame) -> DataFrame:
    """campaign_id, alert_id, start_ts: the earliest reviewed alert of each campaign (ties: the smaller alert_id)."""
    mine = assignment.join(queue.select("alert_id").distinct(), "alert_id", "left_semi")
    hits = queue.join(attribution(mine, labels), "alert_id")
    least = hits.groupBy("campaign_id").agg(F.min(F.struct("start_ts", "alert_id")).alias("x"))
    return least.select("campaign_id", "x.alert_id", "x.start_ts")


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Mean of value by row, one column for each of columns."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def registry(events: DataFrame, key: str) -> DataFrame:
    """key, n, share and begin: each value's part of the unit interval by its rows, heaviest first (ties: the smaller value).

    A uniform number falls in the part of the value that it draws. Values are ranked in buckets, so a large registry is no one task's.
    """
    per = store(events.groupBy(key).agg(F.count("*").alias("n")))
    whole = per.agg(F.sum("n")).scalar()
    steps = running(per.groupBy("n").agg(F.sum("n").alias("_sum")), "n", {"_sum": "_upto"}).select(F.col("n").alias("_n"), (F.col("_upto") - F.col("_sum")).alias("_above"))
    within = global_rank(per, "n", key, "_place", ("n",))
    at = within.join(steps, within["n"] == steps["_n"]).withColumn("begin", (F.col("_above") + (F.col("_place") - 1) * F.col("n")) / whole)
    return at.select(key, "n", "begin", (F.col("n") / whole).alias("share"))


def ordered_distinct(df: DataFrame, key: str, value: str, order: list[str], most: int) -> DataFrame:
    """key, values (its first `most` distinct values, in the order of their first rows) and n_distinct."""
    first = df.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    placed = first.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("_at")))
    values = F.transform(F.sort_array(F.collect_list(F.when(F.col("_i") <= most, F.struct("_i", value)))), lambda x: x[value])
    return placed.groupBy(key).agg(values.alias("values"), F.count("*").alias("n_distinct"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many values of key both frames have, and only the first or the second."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    marked = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), key, "full")
    return marked.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("first_only"), F.count(F.when(F.col("_a").isNull(), 1)).alias("second_only"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """verdict, n: what reviewers said of alerts (alert_id, verdict, at), the last word on each alert counting."""
    last = verdicts.groupBy("alert_id").agg(F.max_by("verdict", F.struct("at", "verdict")).alias("verdict"))
    return last.groupBy("verdict").agg(F.count("*").alias("n"))


#: Fewer entities or attack campaigns than these make figures illustrations.
LEAST_ENTITIES, LEAST_CAMPAIGNS = 150, 40


def scale_note(events: DataFrame, campaigns: DataFrame) -> str | None:
    """A warning if a log is too small for its figures to stand for results."""
    n = events.select("entity_id").distinct().count()
    c = campaigns.where(F.col("campaign_type").isin(*ATTACK_TYPES)).count()
    return f"illustration only: {n} entities (of {LEAST_ENTITIES}) and {c} attack campaigns (of {LEAST_CAMPAIGNS})" if n < LEAST_ENTITIES or c < LEAST_CAMPAIGNS else None


def headline(row) -> str:
    """The main figures of event_metrics(), one a line."""
    f = lambda x: "-" if x is None or math.isnan(x) else f"{x:.3f}"
    return "\n".join(
        [
            f"events {row.n_events}, attacks {row.n_attack}, prevalence {f(row.prevalence)}",
            f"precision at {row.k}: {f(row.precision_at_k)} (at most {f(row.precision_ceiling)})",
            f"recall at {row.k}: {f(row.recall_at_k)} (at most {f(row.recall_ceiling)})",
            f"R-precision {f(row.r_precision)}, average precision {f(row.average_precision)}, ROC-AUC {f(row.roc_auc)}",
        ]
    )
