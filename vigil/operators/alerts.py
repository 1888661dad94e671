"""Alerts: sessions of scored events, their scores, queues and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import norm_ppf_sql, norm_sf_sql
from vigil.functions.ranks import quantiles
from vigil.schema import ATTACK_TYPES, MERGE_WINDOW
from vigil.sources.store import store


def scope(level: str) -> Column:
    """What an alert of a level is about: an entity, an address, or an entity's day."""
    if level == "ip":
        return F.col("source_ip").cast("string")
    entity = F.col("entity_id").cast("string")
    return F.concat_ws("|", entity, F.date_format("timestamp", "yyyy-MM-dd")) if level == "long" else entity


def assign(scored: DataFrame, level: str, window: int | None = None) -> DataFrame:
    """Adds scope_key, alert_id and level: a new alert begins after more than `window` whole seconds without an event."""
    window = MERGE_WINDOW[level] if window is None else window
    w = Window.partitionBy("scope_key").orderBy("timestamp", "event_id")
    sec = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    gap = sec - F.lag(sec).over(w)
    df = scored.withColumn("scope_key", scope(level)).withColumn("_start", F.when(F.coalesce(gap > window, F.lit(True)), F.col("event_id")))
    begun = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("alert_id", F.concat_ws(":", F.lit(level), "scope_key", begun.cast("string"))).withColumn("level", F.lit(level)).drop("_start")


def group_alerts(scored: DataFrame, level: str, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(alerts, assignment). Score: with a column p, Stouffer's sum calibrated by size; else the mean of the two highest scores."""
    member = assign(scored, level, window)
    top = Window.partitionBy("alert_id").orderBy(F.desc("_s"), "event_id")
    good = ~F.isnan(F.col("score")) & F.col("score").isNotNull()
    member = member.withColumn("_s", F.when(good, F.col("score"))).withColumn("_place", F.row_number().over(top))
    aggregates = [
        F.first("scope_key").alias("scope_key"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        F.count("*").alias("n_events"),
        F.max("_s").alias("max_score"),
        F.coalesce(F.avg(F.when(F.col("_place") <= 2, F.col("_s"))), F.lit(float("nan"))).alias("alert_score"),
    ]
    if "p" in scored.columns:
        member = member.withColumn("_q", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p"))))
        member = member.withColumn("_z", F.greatest(F.lit(-8.0), F.least(F.lit(8.0), -F.expr(norm_ppf_sql("_q")))))
        aggregates.append((F.sum("_z") / F.sqrt(F.count("*"))).alias("alert_stouffer"))
    alerts = member.groupBy("alert_id", "level").agg(*aggregates)
    if "p" in scored.columns:
        alerts = size_calibrated(alerts)
    return alerts, member.select("event_id", "alert_id", "level")


def pooled_bins(counts: dict[int, int], least: int = 30) -> list[list[int]]:
    """Neighbouring size bins joined until each pool has `least` alerts; a tail joins the last pool."""
    pools, open_ = [], []
    for b in sorted(counts):
        open_.append(b)
        if sum(counts[x] for x in open_) >= least:
            pools.append(open_)
            open_ = []
    if open_:
        if pools:
            pools[-1] += open_
        else:
            pools.append(open_)
    return pools


def size_calibrated(alerts: DataFrame, value: str = "alert_stouffer") -> DataFrame:
    """alert_score: distance of the value from the median of alerts of like size, in units of their lower spread; and alert_p."""
    alerts = store(alerts).withColumn("_bin", F.floor(F.log2(F.greatest(F.col("n_events"), F.lit(1)))).cast("int"))
    counts = {r[0]: r[1] for r in alerts.groupBy("_bin").count().collect()}  # a bin for each power of two
    pools = pooled_bins(counts) or [[0]]
    number = F.lit(0)
    for i, pool in enumerate(pools):
        number = F.when(F.col("_bin").isin(pool), i).otherwise(number)
    alerts = alerts.withColumn("_pool", number)
    spread = quantiles(alerts, value, {"_mid": 0.5, "_low": 0.16}, ("_pool",))
    x = alerts.join(F.broadcast(spread), "_pool").withColumn("alert_score", (F.col(value) - F.col("_mid")) / F.greatest(F.col("_mid") - F.col("_low"), F.lit(1e-6)))
    x = x.withColumn("_x", F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("alert_score"))))
    return x.withColumn("alert_p", F.expr(norm_sf_sql("_x"))).drop("_bin", "_pool", "_mid", "_low", "_x")


def attribution(assignment: DataFrame, labels: DataFrame) -> DataFrame:
    """alert_id, campaign_id, n_campaign: the attack campaign with most events in an alert (ties: the smaller id)."""
    hit = labels.where(F.col("label").isin(*ATTACK_TYPES) & F.col("campaign_id").isNotNull()).select("event_id", "campaign_id")
    per = assignment.join(hit, "event_id").groupBy("alert_id", "campaign_id").agg(F.count("*").alias("n_campaign"))
    best = Window.partitionBy("alert_id").orderBy(F.desc("n_campaign"), "campaign_id")
    return per.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def leads(assignment: DataFrame, scored: DataFrame) -> DataFrame:
    """Per alert: its members' number, first and last (by time) and the one with the highest score (ties: the smallest event_id; without any score: null).

    Each is a largest or smallest value, so members are never brought together.
    """
    member = assignment.select("alert_id", "event_id").join(scored.select("event_id", "timestamp", "score"), "event_id")
    at, known = F.struct("timestamp", "event_id"), F.col("score").isNotNull() & ~F.isnan("score")
    lowest = F.min(F.when(known, F.struct((-F.col("score")).alias("s"), "event_id")))
    return member.groupBy("alert_id").agg(F.count("*").alias("n_members"), F.min(at)["event_id"].alias("first_event"), F.max(at)["event_id"].alias("last_event"), lowest["event_id"].alias("top_event"))


def daily_queue(alerts: DataFrame, per_day: int) -> DataFrame:
    """The highest alerts of each day, with their place."""
    day = F.date_trunc("day", "start_ts")
    w = Window.partitionBy(day).orderBy(F.desc("alert_score"), "alert_id")
    return alerts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_day)


def estate_budgets(entities: int) -> dict[str, int]:
    """Alerts a day that an estate of this many entities can review, by level."""
    return {"entity": max(2, round(0.03 * entities)), "ip": max(1, round(0.01 * entities)), "long": max(1, round(0.01 * entities))}


def burned_in(df: DataFrame, time: str = "start_ts", days: int = 7) -> DataFrame:
    """Rows from `days` after the first on."""
    return df.where(F.col(time) >= df.agg(F.min(time)).scalar() + F.expr(f"INTERVAL {days} DAYS"))
