"""Queries of alerts, metrics and fusion over the driver's events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import band, norm_ppf_sql, norm_sf_sql, rounded, top2mean
from vigil.functions.ranks import average_precision, quantiles, roc_auc, wilcoxon
from vigil.operators import alerts as A
from vigil.operators import explain as X
from vigil.operators import fusion as U
from vigil.operators import metrics as M
from vigil.operators import signals as S
from vigil.operators.causal import prepare
from vigil.plans.signal_queries import FAIL, HIST, _burst, _trail
from vigil.schema import ATTACK_TYPES
from vigil.sources.store import store
from vigil.sources.tables import LABELS_SQL, LOG_SQL, driver_labels, driver_log

DAY = 86400
BASE = ["event_id", "entity_id", "entity_type", "source_ip", "timestamp"]


def signals(spark, sf):
    """A few signals over one day each, which SQL has too."""
    ev = S.history(prepare(driver_log(spark, sf)))
    ev = S.novelties(S.burst_ratio(S.fail_rates(ev, DAY), DAY))
    return ev.select(*BASE, "role", "resource_accessed", rounded("fail_rate_entity", 6).alias("fail_rate_entity"), rounded("burst_ratio", 6).alias("burst_ratio"), rounded("ip_novelty", 6).alias("ip_novelty"), "session_duration", "geo_country", "auth_method")


def scored(spark, sf):
    s = F.col("fail_rate_entity") + F.col("burst_ratio") / 10 + F.col("ip_novelty") + F.col("session_duration") / 997
    return signals(spark, sf).withColumn("score", rounded(s, 6))


SCORED = f"""WITH {LOG_SQL}, {LABELS_SQL}{HIST}, sig AS (SELECT *, round({_trail(FAIL, 'entity_id', DAY)}::DOUBLE, 6) AS fail_rate_entity,
  CASE WHEN row_number() OVER (PARTITION BY entity_id, source_ip ORDER BY timestamp, event_id) = 1 THEN round(lam, 6) ELSE 0 END AS ip_novelty, {_burst(DAY, '_x')} FROM hist),
scored AS (SELECT * EXCLUDE (burst_ratio_x), round(burst_ratio_x::DOUBLE, 6) AS burst_ratio,
  round(fail_rate_entity + round(burst_ratio_x::DOUBLE, 6) / 10 + ip_novelty + session_duration / 997, 6) AS score FROM sig)"""

ATTACKS = "(" + ", ".join(repr(a) for a in ATTACK_TYPES) + ")"


def _alerts_cte(level: str, window: int) -> str:
    key = {"entity": "entity_id::VARCHAR", "ip": "source_ip", "long": "entity_id::VARCHAR || '|' || strftime(timestamp, '%Y-%m-%d')"}[level]
    return f""", scp AS (SELECT *, {key} AS scope_key FROM scored),
gap AS (SELECT *, CASE WHEN coalesce(sec - lag(sec) OVER w > {window}, true) THEN event_id END AS begun FROM scp WINDOW w AS (PARTITION BY scope_key ORDER BY timestamp, event_id)),
mem AS (SELECT *, '{level}:' || scope_key || ':' || last_value(begun IGNORE NULLS) OVER (PARTITION BY scope_key ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alert_id FROM gap),
pl AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY score DESC, event_id) AS place FROM mem),
alerts AS (SELECT alert_id, '{level}' AS level, any_value(scope_key) AS scope_key, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_events, max(score) AS max_score,
  avg(score) FILTER (WHERE place <= 2) AS alert_score FROM pl GROUP BY alert_id)"""


def _alert_query(level, window):
    def run(spark, sf):
        a, _ = A.group_alerts(scored(spark, sf), level, window)
        return a.select("alert_id", "scope_key", F.unix_timestamp("start_ts").alias("start_s"), F.unix_timestamp("end_ts").alias("end_s"), "n_events", F.round("max_score", 8).alias("max_score"), F.round("alert_score", 8).alias("alert_score"))

    sql = SCORED + _alerts_cte(level, window) + "SELECT alert_id, scope_key, floor(epoch(start_ts))::BIGINT AS start_s, floor(epoch(end_ts))::BIGINT AS end_s, n_events, round(max_score, 8) AS max_score, round(alert_score, 8) AS alert_score FROM alerts"
    return run, sql


def ranked_p(spark, sf):
    return U.rank_p(scored(spark, sf), "score", "entity_type")


RANKED = SCORED + ", pp AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY score DESC, event_id)::DOUBLE / (1 + count(*) OVER (PARTITION BY entity_type)) AS p FROM scored)"


def cohort_rank_p(spark, sf):
    return ranked_p(spark, sf).select("event_id", F.round("p", 9).alias("p"))


def size_calibrated(spark, sf):
    a, _ = A.group_alerts(ranked_p(spark, sf), "entity", DAY)
    return a.select("alert_id", "n_events", *[F.round(c, 5).alias(c) for c in ("alert_stouffer", "alert_score", "alert_p")])


_CAL = (
    RANKED
    + _alerts_cte("entity", DAY).replace("FROM scored)", "FROM pp)").replace("alerts AS (SELECT", "st AS (SELECT").replace(
        "avg(score) FILTER (WHERE place <= 2) AS alert_score", f"sum(greatest(-8, least(8, -({norm_ppf_sql('greatest(1e-12, least(1 - 1e-12, p))')})))) / sqrt(count(*)) AS alert_stouffer"
    )
    + """, bn AS (SELECT *, floor(log2(n_events))::INT AS bin FROM st),
bc AS (SELECT bin, count(*) AS c, row_number() OVER (ORDER BY bin) AS i FROM bn GROUP BY bin),
walk AS (SELECT i, bin, c AS acc, 0 AS pool, c >= 30 AS shut FROM bc WHERE i = 1
  UNION ALL SELECT b.i, b.bin, CASE WHEN w.shut THEN b.c ELSE w.acc + b.c END, CASE WHEN w.shut THEN w.pool + 1 ELSE w.pool END,
    CASE WHEN w.shut THEN b.c ELSE w.acc + b.c END >= 30 FROM walk w JOIN bc b ON b.i = w.i + 1),
pools AS (SELECT bin, CASE WHEN pool > 0 AND NOT bool_or(shut) OVER (PARTITION BY pool) THEN pool - 1 ELSE pool END AS pool FROM walk),
sp AS (SELECT pool, quantile_cont(alert_stouffer, 0.5) AS mid, quantile_cont(alert_stouffer, 0.16) AS low FROM bn JOIN pools USING (bin) GROUP BY pool),
adj AS (SELECT alert_id, n_events, alert_stouffer, (alert_stouffer - mid) / greatest(mid - low, 1e-6) AS alert_score FROM bn JOIN pools USING (bin) JOIN sp USING (pool)),
cl AS (SELECT *, greatest(-40, least(40, alert_score)) AS x FROM adj)
SELECT alert_id, n_events, round(alert_stouffer, 5) AS alert_stouffer, round(alert_score, 5) AS alert_score, round("""
    + norm_sf_sql("x")
    + ", 5) AS alert_p FROM cl"
)
_CAL = _CAL.replace("WITH log AS", "WITH RECURSIVE log AS", 1)


def empirical_z(spark, sf):
    names = ["fail_rate_entity", "burst_ratio", "ip_novelty"]
    return U.empirical_z(signals(spark, sf), names).select("event_id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in names])


def _z_cte() -> str:
    out = SCORED
    for c in ("fail_rate_entity", "burst_ratio", "ip_novelty"):
        out += f""", v_{c} AS (SELECT v, greatest(-4, least(6, -({norm_ppf_sql('least(1 - 1e-12, greatest(1e-12, p))')}))) AS z_{c} FROM
  (SELECT {c} AS v, (1 + sum(count(*)) OVER (ORDER BY {c} DESC))::DOUBLE / (1 + sum(count(*)) OVER ()) AS p FROM scored GROUP BY {c}))"""
    return out + ", zs AS (SELECT s.*, " + ", ".join(f"z_{c}" for c in ("fail_rate_entity", "burst_ratio", "ip_novelty")) + " FROM scored s " + " ".join(f"JOIN v_{c} ON v_{c}.v = s.{c}" for c in ("fail_rate_entity", "burst_ratio", "ip_novelty")) + ")"


Z3 = ("fail_rate_entity", "burst_ratio", "ip_novelty")
WEIGHTS = {"fail_rate_entity": 0.9, "burst_ratio": 0.9, "ip_novelty": 0.5}


def zframe(spark, sf):
    return U.empirical_z(scored(spark, sf), list(Z3))


def fused_score(spark, sf):
    df = zframe(spark, sf)
    raw = U.raw_column({c: F.col(f"z_{c}") for c in Z3}, WEIGHTS, 1.5, [F.col("z_ip_novelty") / 2])
    df = df.withColumn("raw", raw)
    df = store(df.select("event_id", "raw"))
    theta = quantiles(df, "raw", {"theta": 0.99}).scalar()
    return df.select("event_id", F.round("raw", 5).alias("raw"), band(F.round("raw", 9), F.round(theta, 9)).alias("band"))


FUSED = _z_cte() + """, rw AS (SELECT event_id, greatest((0.9 * z_fail_rate_entity + 0.9 * z_burst_ratio + 0.5 * z_ip_novelty) / 1.5,
  (z_fail_rate_entity + z_burst_ratio + z_ip_novelty - least(z_fail_rate_entity, z_burst_ratio, z_ip_novelty)) / 2) - 0.75 * greatest(0, z_ip_novelty / 2) AS raw FROM zs),
th AS (SELECT quantile_cont(raw, 0.99) AS theta FROM rw)
SELECT event_id, round(raw, 5) AS raw, CASE WHEN round(raw, 9) >= round(theta, 9) THEN 'HIGH' WHEN round(raw, 9) >= round(theta, 9) / 2 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM rw, th"""


def type_rules(spark, sf):
    df = X.predict_type(zframe(spark, sf), {c: F.col(f"z_{c}") for c in Z3})
    return df.select("event_id", "pred_type", F.round("pred_confidence", 6).alias("pred_confidence"))


_T = _z_cte() + """, u AS (SELECT event_id, CASE WHEN z_fail_rate_entity >= 1 THEN z_fail_rate_entity ELSE 0 END AS f, CASE WHEN z_burst_ratio >= 1 THEN z_burst_ratio ELSE 0 END AS b FROM zs),
s AS (SELECT event_id, 1.5 * f + 1.5 * b AS bf, 1.5 * b AS lm FROM u)
SELECT event_id, CASE WHEN bf > 0 THEN 'brute_force' ELSE 'unclassified' END AS pred_type, round(CASE WHEN bf > 0 THEN bf / (bf + lm) ELSE 0 END::DOUBLE, 6) AS pred_confidence FROM s"""


def explain(spark, sf):
    df = zframe(spark, sf)
    why = X.explanation({c: F.col(f"z_{c}") for c in Z3}, {c: F.col(c) for c in Z3}, 2)
    df = df.withColumn("why", why)
    return df.where(F.size("why") > 0).select("event_id", F.size("why").cast("long").alias("n"), F.array_join(F.transform("why", lambda x: x["signal"]), ",").alias("signals"), F.round(F.col("why")[0]["z"], 6).alias("top_z"))


_EXPLAIN = _z_cte() + """, l AS (SELECT event_id, unnest([{'z': z_fail_rate_entity, 'i': 0, 's': 'fail_rate_entity'}, {'z': z_burst_ratio, 'i': 1, 's': 'burst_ratio'}, {'z': z_ip_novelty, 'i': 2, 's': 'ip_novelty'}]) AS x FROM zs),
k AS (SELECT event_id, x.z AS z, x.s AS s, row_number() OVER (PARTITION BY event_id ORDER BY x.z DESC, x.i) AS r FROM l WHERE x.z > 0.5)
SELECT event_id, count(*) AS n, string_agg(s, ',' ORDER BY r) AS signals, round(max(z), 6) AS top_z FROM k WHERE r <= 2 GROUP BY event_id"""


def daily_queue(spark, sf):
    a, _ = A.group_alerts(scored(spark, sf), "entity", DAY)
    return A.daily_queue(a, 5).select("alert_id", "place", F.round("alert_score", 8).alias("alert_score"))


def event_metrics(spark, sf):
    m = M.event_metrics(scored(spark, sf), driver_labels(spark, sf))
    return m.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in m.columns])


_RANK = SCORED + f""", rk AS (SELECT s.event_id, s.score, l.label, l.confounder, l.is_cold_start, l.label IN {ATTACKS} AS y, row_number() OVER (ORDER BY s.score DESC, s.event_id) AS r, count(*) OVER () AS n FROM scored s JOIN lab l USING (event_id)),
stp AS (SELECT score, count(*) AS c, sum(y::INT) AS pos, sum(count(*)) OVER (ORDER BY score DESC) AS cn, sum(sum(y::INT)) OVER (ORDER BY score DESC) AS cp, sum(count(*) - sum(y::INT)) OVER (ORDER BY score) - (count(*) - sum(y::INT)) AS below FROM rk GROUP BY score)"""
_METRICS = _RANK + """, t AS (SELECT any_value(n) AS n_events, sum(y::INT) AS n_attack, ceil(round(any_value(n) * 0.01, 9)) AS k FROM rk),
h AS (SELECT any_value(n_events) AS n_events, any_value(n_attack) AS n_attack, any_value(k) AS k, sum((y AND r <= k)::INT) AS hits, sum((y AND r <= n_attack)::INT) AS rh, sum((label = 'insider_drift' AND r <= k)::INT) AS dh FROM rk, t)
SELECT n_events::DOUBLE AS n_events, n_attack::DOUBLE AS n_attack, k::DOUBLE AS k, round(n_attack / n_events, 6) AS prevalence, round(hits / k, 6) AS precision_at_k, round(least(1, n_attack / k), 6) AS precision_ceiling,
  round(hits / n_attack, 6) AS recall_at_k, round(least(1, k / n_attack), 6) AS recall_ceiling, round(rh / n_attack, 6) AS r_precision, round(dh / k, 6) AS insider_share,
  (SELECT round(sum(pos * cp / cn) / sum(pos), 6) FROM stp) AS average_precision, (SELECT round(sum(pos * (below + (c - pos) / 2)) / (sum(pos) * sum(c - pos)), 6) FROM stp) AS roc_auc FROM h"""


def avg_precision(spark, sf):
    df = M.labelled(scored(spark, sf), driver_labels(spark, sf))
    return average_precision(df, "score", M.is_attack()).select(F.round("average_precision", 6).alias("average_precision"))


def auc(spark, sf):
    df = M.labelled(scored(spark, sf), driver_labels(spark, sf))
    return roc_auc(df, "score", M.is_attack()).select(F.round("roc_auc", 6).alias("roc_auc"))


def attribution(spark, sf):
    _, members = A.group_alerts(scored(spark, sf), "entity", DAY)
    return A.attribution(members, driver_labels(spark, sf))


_ATTR = _alerts_cte("entity", DAY) + f""", per AS (SELECT m.alert_id, l.campaign_id, count(*) AS n_campaign FROM mem m JOIN lab l USING (event_id) WHERE l.label IN {ATTACKS} AND l.campaign_id IS NOT NULL GROUP BY 1, 2),
attr AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY n_campaign DESC, campaign_id) = 1)"""


def _incident(spark, sf):
    ev, labels = scored(spark, sf), driver_labels(spark, sf)
    a, members = A.group_alerts(ev, "entity", DAY)
    camp = labels.where("campaign_id is not null").join(ev.select("event_id", "timestamp"), "event_id").groupBy("campaign_id").agg(F.min("label").alias("campaign_type"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))
    q = M.reviewed(a, 30, {"entity": 5})
    return q, M.detections(q, members, labels, camp, ev)


def incident_metrics(spark, sf):
    q, found = _incident(spark, sf)
    m = M.incident_metrics(q, found, 30)
    return m.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in m.columns])


def recall_by_type(spark, sf):
    m = M.recall_by_type(_incident(spark, sf)[1])
    return m.select("campaign_type", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in m.columns[1:]])


_INC = SCORED + _ATTR + f""", camp AS (SELECT l.campaign_id, min(l.label) AS campaign_type, min(s.sec) AS c0, max(s.sec) AS c1 FROM lab l JOIN scored s USING (event_id) WHERE l.campaign_id IS NOT NULL GROUP BY 1),
q AS (SELECT * FROM alerts ORDER BY alert_score DESC, alert_id LIMIT 150),
hit AS (SELECT campaign_id, count(*) AS n_alerts FROM q JOIN attr USING (alert_id) GROUP BY 1),
ats AS (SELECT l.campaign_id, min(m.sec) AS t FROM mem m JOIN lab l USING (event_id) WHERE m.alert_id IN (SELECT alert_id FROM q) AND l.label IN {ATTACKS} AND l.campaign_id IS NOT NULL GROUP BY 1),
found AS (SELECT c.*, n_alerts, n_alerts IS NOT NULL AS detected, CASE WHEN n_alerts IS NOT NULL THEN greatest(t - c0, 0) / 3600 END AS ttd, CASE WHEN n_alerts IS NOT NULL THEN t - c0 <= (c1 - c0) / 2 END AS early FROM camp c LEFT JOIN hit USING (campaign_id) LEFT JOIN ats USING (campaign_id))"""
_INC_ROW = _INC + """SELECT count(*)::DOUBLE AS n_campaigns, sum(detected::INT)::DOUBLE AS n_detected, round(sum(detected::INT) / count(*), 6) AS recall, round(sum(detected::INT) / 150, 6) AS precision, round(least(1, count(*) / 150), 6) AS precision_ceiling,
  150.0::DOUBLE AS budget_k, (SELECT count(*) FROM q)::DOUBLE AS n_reviewed, round((SELECT count(*) FROM q) / 30, 6) AS alerts_per_day, greatest(0, coalesce(sum(n_alerts), 0) - sum(detected::INT))::DOUBLE AS redundant,
  round(median(ttd), 6)::DOUBLE AS median_ttd_hours, round(avg(early::INT) FILTER (WHERE detected), 6) AS share_early FROM found"""
_INC_TYPE = _INC + "SELECT campaign_type, count(*)::DOUBLE AS n_campaigns, sum(detected::INT)::DOUBLE AS n_detected, round(avg(detected::INT), 6) AS recall, round(median(ttd), 6)::DOUBLE AS median_ttd_hours, round(avg(early::INT) FILTER (WHERE detected), 6) AS share_early FROM found GROUP BY 1"


def fp_breakdown(spark, sf):
    m = M.fp_breakdown(scored(spark, sf), driver_labels(spark, sf), 0.05)
    return m.select("kind", "n_fp", "n_all", F.round("fp_rate", 6).alias("fp_rate"), F.round("fp_share", 6).alias("fp_share"))


_FP = _RANK + """, f AS (SELECT coalesce(confounder, '(none)') AS kind, sum((r <= ceil(round(n * 0.05, 9)))::INT)::BIGINT AS n_fp, count(*) AS n_all FROM rk WHERE NOT y GROUP BY 1)
SELECT kind, n_fp, n_all, round(n_fp / n_all, 6) AS fp_rate, round(n_fp / sum(n_fp) OVER (), 6) AS fp_share FROM f QUALIFY n_fp > 0"""


def band_report(spark, sf):
    m = M.band_report(scored(spark, sf), driver_labels(spark, sf), 1.0)
    return m.select("label", "n", *[F.round(c, 6).alias(c) for c in ("high", "medium", "low")])


def cold_start(spark, sf):
    m = M.cold_start_report(scored(spark, sf), driver_labels(spark, sf), 0.05)
    return m.select("cold", "n", "n_top", *[F.round(c, 6).alias(c) for c in ("traffic_share", "budget_share", "attack_rate", "top_precision")])


_COLD = _RANK + """SELECT is_cold_start AS cold, count(*) AS n, sum((r <= floor(round(n * 0.05, 9)))::INT)::BIGINT AS n_top, round(count(*) / any_value(n), 6) AS traffic_share,
  round(sum((r <= floor(round(n * 0.05, 9)))::INT) / floor(round(any_value(n) * 0.05, 9)), 6) AS budget_share, round(avg(y::INT), 6) AS attack_rate, round(avg(y::INT) FILTER (WHERE r <= floor(round(n * 0.05, 9))), 6) AS top_precision FROM rk GROUP BY 1"""


def volume(spark, sf):
    a, _ = A.group_alerts(scored(spark, sf), "entity", DAY)
    return M.volume_report(a, 20, 1.5).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("rate_based").cast("long").alias("rate_based"), F.col("fixed_threshold").cast("long").alias("fixed_threshold"))


_VOL = SCORED + _alerts_cte("entity", DAY) + "SELECT strftime(start_ts, '%Y-%m-%d') AS day, least(count(*), 20)::BIGINT AS rate_based, count(*) FILTER (WHERE alert_score >= 1.5) AS fixed_threshold FROM alerts GROUP BY 1"


def exclusivity(spark, sf):
    df = M.labelled(driver_log(spark, sf).drop("session_duration"), driver_labels(spark, sf))
    return M.exclusive_values(df, ["source_ip", "resource_accessed", "auth_method", "role"], F.col("auth_result") == "failure", 5).unionByName(M.exclusive_values(df, ["auth_result", "geo_country"], F.col("auth_result") == "failure", 5))


_EXCL = f"WITH {LOG_SQL}, e AS (UNPIVOT (SELECT source_ip::VARCHAR AS source_ip, resource_accessed::VARCHAR AS resource_accessed, auth_method::VARCHAR AS auth_method, role::VARCHAR AS role, auth_result::VARCHAR AS auth_result, geo_country::VARCHAR AS geo_country, auth_result = 'failure' AS y FROM log) ON source_ip, resource_accessed, auth_method, role, auth_result, geo_country INTO NAME \"column\" VALUE \"value\") SELECT \"column\", \"value\", count(*) AS support, avg(y::INT) AS attack_share FROM e GROUP BY 1, 2 HAVING count(*) >= 5 AND avg(y::INT) >= 1"


def corr_matrix(spark, sf):
    return M.correlations(scored(spark, sf), [*Z3, "session_duration"]).withColumn("r", F.round("r", 6))


def _corr_sql() -> str:
    names = [*Z3, "session_duration"]
    return SCORED + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + ("max(1.0::DOUBLE)" if a == b else f"round(coalesce(corr({a}, {b}), 0), 6)") + " AS r FROM scored" for a in names for b in names)


def confusion(spark, sf):
    df = M.labelled(zframe(spark, sf), driver_labels(spark, sf))
    df = X.predict_type(df, {c: F.col(f"z_{c}") for c in Z3})
    return M.confusion(df, "label", "pred_type", ["brute_force", "unclassified"])


_CONF = _T.replace("SELECT event_id, CASE WHEN bf > 0", ", pt AS (SELECT event_id, CASE WHEN bf > 0").rsplit(" FROM s", 1)[0] + " FROM s) SELECT label AS actual, count(*) FILTER (WHERE pred_type = 'brute_force') AS brute_force, count(*) FILTER (WHERE pred_type = 'unclassified') AS unclassified FROM pt JOIN lab USING (event_id) GROUP BY 1"


def macro_f1(spark, sf):
    df = M.labelled(zframe(spark, sf), driver_labels(spark, sf))
    df = X.predict_type(df, {c: F.col(f"z_{c}") for c in Z3}).withColumn("label", F.when(M.is_attack(), F.col("label")).otherwise("unclassified"))
    return M.macro_f1(df, "label", "pred_type").select(F.round("macro_f1", 6).alias("macro_f1"), "n_classes")


_F1 = _CONF.split(" SELECT label AS actual")[0] + f""", ap AS (SELECT CASE WHEN label IN {ATTACKS} THEN label ELSE 'unclassified' END AS a, pred_type AS p FROM pt JOIN lab USING (event_id)),
cs AS (SELECT DISTINCT a AS c FROM ap) SELECT round(avg(2 * (SELECT count(*) FROM ap WHERE a = c AND p = c) / ((SELECT count(*) FROM ap WHERE a = c) + (SELECT count(*) FROM ap WHERE p = c))), 6) AS macro_f1, count(*) AS n_classes FROM cs"""


def entity_history(spark, sf):
    """Per entity: its last 40 events summed up, and what it has used in all."""
    from pyspark.sql import Window

    ev = prepare(driver_log(spark, sf))
    back = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("timestamp"), F.desc("event_id")))
    return ev.withColumn("_b", back).groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("resource_accessed").alias("n_resources"), F.countDistinct("source_ip").alias("n_ips"), F.sum(F.when((F.col("_b") <= 40) & (F.col("auth_result") == "failure"), 1).otherwise(0)).alias("recent_failures"))


_HISTORY = f"WITH {LOG_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp DESC, event_id DESC) AS b FROM log) SELECT entity_id, count(*) AS n, count(DISTINCT resource_accessed) AS n_resources, count(DISTINCT source_ip) AS n_ips, count(*) FILTER (WHERE b <= 40 AND auth_result = 'failure') AS recent_failures FROM b GROUP BY 1"


def coverage_union(spark, sf):
    """Events per level of the queues joined into one, and the alerts they form."""
    out = None
    for level in ("entity", "ip", "long"):
        _, m = A.group_alerts(scored(spark, sf), level)
        out = m if out is None else out.unionByName(m)
    return out.groupBy("level").agg(F.count("*").alias("n_events"), F.countDistinct("alert_id").alias("n_alerts"))


def _cover_sql() -> str:
    parts = []
    for level, window in (("entity", 3600), ("ip", 3600), ("long", 86400)):
        parts.append(f"(SELECT '{level}' AS level, count(*) AS n_events, count(DISTINCT alert_id) AS n_alerts FROM ({SCORED}{_alerts_cte(level, window)}SELECT alert_id FROM mem))")
    return "SELECT * FROM " + " UNION ALL SELECT * FROM ".join(parts)


def top2mean_groups(spark, sf):
    """The operator on arrays: the two highest orders of each customer."""
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return o.select("o_custkey", F.round(top2mean(F.col("v")), 4).alias("top2mean"))


def signed_rank(spark, sf):
    """Paired daily failures of even and odd hours."""
    ev = prepare(driver_log(spark, sf)).withColumn("day", F.date_trunc("day", "timestamp"))
    fail = (F.col("auth_result") == "failure").cast("int")
    d = ev.groupBy("day").agg(F.sum(F.when(F.col("hour") % 2 == 0, fail).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("hour") % 2 == 1, fail).otherwise(0)).cast("double").alias("b"))
    return wilcoxon(d, "a", "b").select("n", F.round("w", 6).alias("w"), F.round("z", 6).alias("z"))


_WILCOXON = f"""WITH {LOG_SQL}, d AS (SELECT date_trunc('day', timestamp) AS day, (sum({FAIL}) FILTER (WHERE hour % 2 = 0) - sum({FAIL}) FILTER (WHERE hour % 2 = 1))::DOUBLE AS d FROM log GROUP BY 1),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d WHERE d <> 0),
s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS up, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS down, sum(t * t - 1) AS ties FROM r)
SELECT n, round(least(up, down), 6)::DOUBLE AS w, round((least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6)::DOUBLE AS z FROM s"""


def quiet_runs(spark, sf):
    daily = scored(spark, sf).withColumn("day", F.date_trunc("day", "timestamp")).groupBy("entity_id", "day").agg(F.max("score").alias("score"))
    return M.quiet_runs(daily, ["entity_id"], "score", 3.0, 5).select("entity_id", F.date_format("quiet_from", "yyyy-MM-dd").alias("quiet_from"))


_QUIET = SCORED + """, dl AS (SELECT entity_id, date_trunc('day', timestamp) AS day, max(score) AS score FROM scored GROUP BY 1, 2),
q AS (SELECT entity_id, day, max(score) OVER w < 3.0 AND count(*) OVER w = 5 AS calm FROM dl WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT entity_id, strftime(min(day) FILTER (WHERE calm), '%Y-%m-%d') AS quiet_from FROM q GROUP BY 1"""


_entity, _ip, _long = _alert_query("entity", DAY), _alert_query("ip", 3600), _alert_query("long", DAY)
REGISTRY = {
    "alert_sessions": _entity,
    "alert_sessions_ip": _ip,
    "alert_sessions_long": _long,
    "cohort_rank_p": (cohort_rank_p, RANKED + "SELECT event_id, round(p, 9) AS p FROM pp"),
    "size_calibrated": (size_calibrated, _CAL),
    "empirical_z": (empirical_z, _z_cte() + "SELECT event_id, " + ", ".join(f"round(z_{c}, 6)::DOUBLE AS z_{c}" for c in Z3) + " FROM zs"),
    "fused_score": (fused_score, FUSED),
    "type_rules": (type_rules, _T),
    "explain": (explain, _EXPLAIN),
    "daily_queue": (daily_queue, SCORED + _alerts_cte("entity", DAY) + "SELECT alert_id, row_number() OVER (PARTITION BY date_trunc('day', start_ts) ORDER BY alert_score DESC, alert_id) AS place, round(alert_score, 8) AS alert_score FROM alerts QUALIFY place <= 5"),
    "event_metrics": (event_metrics, _METRICS),
    "avg_precision": (avg_precision, _RANK + "SELECT round(sum(pos * cp / cn) / sum(pos), 6) AS average_precision FROM stp"),
    "roc_auc": (auc, _RANK + "SELECT round(sum(pos * (below + (c - pos) / 2)) / (sum(pos) * sum(c - pos)), 6) AS roc_auc FROM stp"),
    "attribution": (attribution, SCORED + _ATTR + "SELECT alert_id, campaign_id, n_campaign FROM attr"),
    "incident_metrics": (incident_metrics, _INC_ROW),
    "recall_by_type": (recall_by_type, _INC_TYPE),
    "fp_breakdown": (fp_breakdown, _FP),
    "band_report": (band_report, SCORED + "SELECT label, count(*) AS n, round(avg((score >= 1)::INT), 6) AS high, round(avg((score >= 0.5 AND score < 1)::INT), 6) AS medium, round(avg((score < 0.5)::INT), 6) AS low FROM scored JOIN lab USING (event_id) GROUP BY 1"),
    "cold_start": (cold_start, _COLD),
    "volume": (volume, _VOL),
    "exclusivity": (exclusivity, _EXCL),
    "corr_matrix": (corr_matrix, _corr_sql()),
    "confusion": (confusion, _CONF),
    "macro_f1": (macro_f1, _F1),
    "entity_history": (entity_history, _HISTORY),
    "coverage_union": (coverage_union, _cover_sql()),
    "top2mean": (top2mean_groups, "SELECT o_custkey, round(avg(o_totalprice), 4) AS top2mean FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 2 GROUP BY 1"),
    "signed_rank": (signed_rank, _WILCOXON),
    "quiet_runs": (quiet_runs, _QUIET),
}


def queries():
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items()}
