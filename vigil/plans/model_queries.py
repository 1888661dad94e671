"""Queries of the whole signal table, of a fitted level and of reports on alerts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import band, norm_ppf_sql, rounded
from vigil.functions.isotonic import isotonic_values
from vigil.functions.scan import moving_average
from vigil.operators import alerts as A
from vigil.operators import explain as X
from vigil.operators import fusion as U
from vigil.operators import metrics as M
from vigil.operators import signals as S
from vigil.operators import whole as W
from vigil.operators.causal import prepare
from vigil.plans import report_queries as R
from vigil.plans import signal_queries as Q
from vigil.plans import studies as T
from vigil.schema import LEVELS, SIGNALS, signals_of
from vigil.sources.store import store
from vigil.sources.tables import LABELS_SQL, LOG_SQL, driver_labels, driver_log

DAY = 86400


def signal_table(spark, sf):
    """All 21 signals of each event, from one frame."""
    out = S.signal_frame(driver_log(spark, sf))
    return out.select("event_id", *[rounded(s.name, 6).alias(s.name) for s in SIGNALS], F.col("_n_history").alias("n_history"), F.col("_cold_start").alias("few_events"))


def _signal_table_sql() -> str:
    parts = ("geo_velocity", "failed_burst", "burst_ratio", "ip_signals", "fingerprint", "hour_surprisal", "novelty", "resource_surprisal", "deviations", "long_window", "corroboration", "cmd_surprisal", "history")
    source = {c: name for name in parts for c in Q.REGISTRY[name][1]}
    joined = " ".join(f"{'FROM' if i == 0 else 'JOIN'} ({Q.REGISTRY[p][2]}) {p}{'' if i == 0 else ' USING (event_id)'}" for i, p in enumerate(parts))
    columns = ", ".join(f"{source[s.name]}.{s.name}::DOUBLE AS {s.name}" for s in SIGNALS)
    return f"SELECT event_id, {columns}, history.n::DOUBLE AS n_history, (history.n < 25)::INT::DOUBLE AS few_events {joined}"


def _address_signals(spark, sf):
    ev = S.ip_signals(S.history(prepare(driver_log(spark, sf))), DAY // 4, DAY)
    return store(ev.select("event_id", "entity_id", "entity_type", *[rounded(s.name, 6).alias(s.name) for s in signals_of("ip")]))


def _all_signals(spark, sf, levels=LEVELS):
    out = S.signal_frame(driver_log(spark, sf), ("entity_id", "entity_type", "timestamp"), levels)
    return store(out.select("event_id", "entity_id", "entity_type", "timestamp", "_n_history", "_cold_start", *[rounded(s.name, 6).alias(s.name) for s in SIGNALS if s.level in levels]))


def _names(*levels):
    return [s.name for level in levels for s in [*signals_of(level), *signals_of(level, mitigating=True)]]


def _fitted(ev, level):
    """A level fitted on the log (two rounds, flagged events leave the reference) and its scores of the same log. Every event is in the reference."""
    table, n = W.places(ev, _names(level))
    f = W.fit(table, n, level)
    out = W.with_tail_p(store(W.with_raw(table, {level: f}).withColumnRenamed(f"raw_{level}", "raw")), f.cuts[-1])
    return out.select("event_id", rounded("raw", 4).alias("raw"), rounded("p", 6).alias("p"), band(rounded("raw", 7), F.lit(float(W.rounded(f.cuts[-1], 7)))).alias("band"))


def fitted_level(spark, sf):
    return _fitted(_address_signals(spark, sf), "ip")


def fitted_entity(spark, sf):
    return _fitted(_all_signals(spark, sf, ("entity",)), "entity")


def fitted_long(spark, sf):
    return _fitted(_all_signals(spark, sf, ("long",)), "long")


def _fitted_sql(level: str, body: str) -> str:
    """Every step of the fit in SQL. The library's table of quantiles comes from another routine than the formula here."""
    names, mitigating = [s.name for s in signals_of(level)], [s.name for s in signals_of(level, mitigating=True)]
    every = names + mitigating
    prior = {s.name: s.prior for s in signals_of(level)}
    out = f"WITH sg AS ({body}), ev AS (SELECT sg.*, log.entity_type FROM sg JOIN (WITH {LOG_SQL} SELECT event_id, entity_type FROM log) log USING (event_id)), k0 AS (SELECT *, true AS kept FROM ev)"
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for r in (0, 1):
        out += f", n{r} AS (SELECT count(*) FILTER (WHERE kept) AS n FROM k{r})"
        out += f", t{r} AS (SELECT *, " + ", ".join(f"(1 + sum(kept::INT) OVER (ORDER BY {c} DESC))::DOUBLE / (1 + (SELECT n FROM n{r})) AS p_{c}" for c in every) + f" FROM k{r})"
        out += f", z{r} AS (SELECT event_id, entity_type, kept, {', '.join(every)}, " + ", ".join(f"greatest(-4, least(6, -({norm_ppf_sql(f'greatest(1e-12, least(1 - 1e-12, p_{c}))')}))) AS z_{c}" for c in every) + f" FROM t{r})"
        out += f", w{r} AS (SELECT " + ", ".join(f"{prior[c]}::DOUBLE / (1 + avg((z_{c} > 2.33)::INT) FILTER (WHERE kept) / 0.01) AS w_{c}" for c in names)
        out += "".join(f", CASE WHEN stddev_pop(z_{a}) FILTER (WHERE kept) > 1e-12 AND stddev_pop(z_{b}) FILTER (WHERE kept) > 1e-12 THEN corr(z_{a}, z_{b}) FILTER (WHERE kept) ELSE 0 END AS c_{a}_{b}" for a, b in pairs) + f" FROM z{r})"
        spread = " + ".join([f"w_{c} * w_{c}" for c in names] + [f"2 * w_{a} * w_{b} * c_{a}_{b}" for a, b in pairs])
        top = f"list_sum(list_sort([{', '.join(f'z_{c}' for c in names)}], 'DESC')[1:2]) / 2"
        off = f" - 0.75 * greatest(0, {', '.join(f'z_{c}' for c in mitigating)})" if mitigating else ""
        out += f", r{r} AS (SELECT z{r}.*, greatest((" + " + ".join(f"z_{c} * w_{c}" for c in names) + f") / sqrt(greatest({spread}, 1e-12)), {top}){off} AS raw FROM z{r}, w{r})"
        out += f", q{r} AS (SELECT quantile_cont(raw, 0.99) AS cut FROM r{r})"
        out += f", k{r + 1} AS (SELECT event_id, entity_type, {', '.join(every)}, round(raw, 9) < round(cut, 9) AS kept, raw, cut FROM r{r}, q{r})"
    out += ", sizes AS (SELECT entity_type, count(*) FILTER (WHERE kept) AS m, sum(count(*) FILTER (WHERE kept)) OVER () AS every FROM k2 GROUP BY 1)"
    out += ", u AS (SELECT *, sum(kept::INT) OVER (PARTITION BY entity_type ORDER BY round(raw, 9) DESC) AS own, sum(kept::INT) OVER (ORDER BY round(raw, 9) DESC) AS whole FROM k2)"
    return out + " SELECT event_id, round(raw, 4) AS raw, round(CASE WHEN m >= 200 THEN (1 + own)::DOUBLE / (1 + m) ELSE (1 + whole)::DOUBLE / (1 + every) END, 6) AS p, CASE WHEN round(raw, 7) >= round(cut, 7) THEN 'HIGH' WHEN round(raw, 7) >= round(cut, 7) / 2 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM u JOIN sizes USING (entity_type)"


def scored_log(spark, sf):
    """The log scored by all three levels, fitted on it: the highest raw score and the highest band (2: HIGH)."""
    ev = _all_signals(spark, sf)
    table, n = W.places(ev, _names(*LEVELS))
    fits = {level: W.fit(table, n, level) for level in LEVELS}
    risk = lambda level, f: F.when((b := band(rounded(f"raw_{level}", 7), F.lit(float(W.rounded(f.cuts[-1], 7))))) == "HIGH", 2).when(b == "MEDIUM", 1).otherwise(0)
    out = W.with_raw(table, fits)
    return out.select("event_id", F.greatest(*[rounded(f"raw_{level}", 4) for level in fits]).alias("score"), F.greatest(*[risk(level, f) for level, f in fits.items()]).alias("risk"))


def _scored_sql() -> str:
    parts = ", ".join(f"l_{level} AS ({_fitted_sql(level, _signal_table_sql())})" for level in ("entity", "ip", "long"))
    risk = lambda level: f"CASE l_{level}.band WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
    return f"WITH {parts} SELECT event_id, greatest(l_entity.raw, l_ip.raw, l_long.raw) AS score, greatest({risk('entity')}, {risk('ip')}, {risk('long')})::INT AS risk FROM l_entity JOIN l_ip USING (event_id) JOIN l_long USING (event_id)"


PLAIN = [s.name for s in SIGNALS if not s.mitigating]


def explained_queue(spark, sf):
    """The 40 highest alerts of the log, with kind and reasons by all 21 signals."""
    ev = _all_signals(spark, sf)
    scored = U.empirical_z(ev, [s.name for s in SIGNALS])
    a, members = A.group_alerts(R.scored(spark, sf), "entity", DAY)
    out = X.explain_alerts(store(a), store(members), store(scored), 40)
    return out.select("alert_id", "pred_type", F.round("pred_confidence", 5).alias("pred_confidence"), F.array_join(F.transform("why", lambda x: x["signal"]), ",").alias("reasons"), F.round(F.get("why", F.lit(0))["z"], 5).alias("top_z"), F.col("n_history").cast("long").alias("n_history"), "cold_start")


def _explained_sql() -> str:
    names = [s.name for s in SIGNALS]
    kinds = list(X.TYPE_RULES)
    out = f"{R.SCORED}{R._alerts_cte('entity', DAY)}, top AS (SELECT * FROM alerts ORDER BY alert_score DESC, alert_id LIMIT 40), sg AS ({_signal_table_sql()})"
    out += ", " + ", ".join(f"v_{c} AS (SELECT {c} AS v, greatest(-4, least(6, -({norm_ppf_sql('least(1 - 1e-12, greatest(1e-12, p))')}))) AS z FROM (SELECT {c}, (1 + sum(count(*)) OVER (ORDER BY {c} DESC))::DOUBLE / (1 + sum(count(*)) OVER ()) AS p FROM sg GROUP BY {c}))" for c in names)
    most = ", ".join(f"max(v_{c}.z) AS z_{c}" for c in names)
    out += f", per AS (SELECT alert_id, {most}, min(n_history) AS hist_low, max(n_history) AS n_history, min(few_events) AS cold FROM mem JOIN top USING (alert_id) JOIN sg USING (event_id) " + " ".join(f"JOIN v_{c} ON v_{c}.v = sg.{c}" for c in names) + " GROUP BY alert_id)"
    used = lambda c: f"CASE WHEN z_{c} >= 1 THEN z_{c} ELSE 0 END"
    score = lambda kind: " + ".join(f"({w} * {used(c)})" for c, w in X.TYPE_RULES[kind].items())
    out += ", s AS (SELECT alert_id, [" + ", ".join(score(k) for k in kinds) + "]::DOUBLE[] AS s FROM per)"
    out += f", t AS (SELECT alert_id, list_max(s) AS best, {kinds}[list_position(s, list_max(s))] AS kind, list_sum(list_transform(s, lambda x: greatest(x, 0))) AS total FROM s)"
    out += ", l AS (SELECT alert_id, unnest([" + ", ".join(f"{{'z': z_{c}, 'i': {i}, 's': '{c}'}}" for i, c in enumerate(names) if c in PLAIN) + "]) AS x FROM per)"
    out += ", k AS (SELECT alert_id, x.z AS z, x.s AS s, row_number() OVER (PARTITION BY alert_id ORDER BY x.z DESC, x.i) AS r FROM l WHERE x.z > 0.5)"
    out += ", w AS (SELECT alert_id, string_agg(s, ',' ORDER BY r) AS reasons, max(z) AS top_z FROM k WHERE r <= 5 GROUP BY alert_id)"
    return out + " SELECT alert_id, CASE WHEN best > 0 THEN kind ELSE 'unclassified' END AS pred_type, round(CASE WHEN best > 0 THEN best / total ELSE 0 END, 5)::DOUBLE AS pred_confidence, coalesce(reasons, '') AS reasons, round(top_z, 5) AS top_z, n_history::BIGINT AS n_history, cold = 1 AS cold_start FROM t JOIN per USING (alert_id) LEFT JOIN w USING (alert_id)"


def isotonic_map(spark, sf):
    """The calibration curve of the score, to two decimals: at each value its rows, attacks and probability."""
    df = M.labelled(R.scored(spark, sf), driver_labels(spark, sf)).select(rounded("score", 2).alias("x"), M.is_attack().cast("double").alias("y"))
    return isotonic_values(store(df), "x", "y").select("x", "n", F.col("total").cast("long").alias("attacks"), rounded("value", 9).alias("value"))


_ISOTONIC = R.SCORED + f""", st AS (SELECT round(score, 2) AS x, count(*) AS n, sum((label IN {R.ATTACKS})::INT) AS t FROM scored JOIN lab USING (event_id) GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(t) OVER (ORDER BY x) AS ct FROM st),
m AS (SELECT a.i AS a, b.i AS b, (b.ct - a.ct + a.t)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON b.i >= a.i),
l AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m),
v AS (SELECT b AS i, max(low) AS value FROM l GROUP BY b)
SELECT x, n, t::BIGINT AS attacks, round(value, 9) AS value FROM c JOIN v USING (i)"""


def usual_rate(spark, sf):
    """The moving average of an entity's new resources in a week, as the drift policies follow it, at each event."""
    ev = S.long_window(S.hour_surprisal(S.history(prepare(driver_log(spark, sf)))))
    ev = store(ev.select("event_id", "entity_id", "timestamp", "new_resource_rate_7d"))
    return moving_average(ev, ["entity_id"], ["timestamp", "event_id"], "new_resource_rate_7d", 0.02, "usual").select("event_id", F.round("usual", 8).alias("usual"))


_USUAL = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, entity_id, new_resource_rate_7d AS x, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp, event_id) AS i FROM ({Q.REGISTRY['long_window'][2]}) JOIN (WITH {LOG_SQL} SELECT event_id, entity_id, timestamp FROM log) USING (event_id)),
walk AS (SELECT event_id, entity_id, i, x::DOUBLE AS usual FROM r WHERE i = 1 UNION ALL SELECT r.event_id, r.entity_id, r.i, 0.98::DOUBLE * usual + 0.02::DOUBLE * x FROM walk JOIN r ON r.entity_id = walk.entity_id AND r.i = walk.i + 1)
SELECT event_id, round(usual, 8) AS usual FROM walk"""


def written_traits(spark, sf):
    """How rows are written: what the leakage audit lets a classifier see, without the hash of the id."""
    t = T.artefacts(driver_log(spark, sf))
    return t.select("event_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in T.ARTEFACTS if c != "id_bucket"])


_TRAITS = f"""WITH {LOG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp, event_id)::DOUBLE / count(*) OVER (PARTITION BY entity_id) AS place FROM log)
SELECT event_id, round(place, 6) AS place, """ + ", ".join(f"length(string_split({c}::VARCHAR, '.')[-1])::DOUBLE AS {n}" for c, n in (("geo_lat", "decimals_lat"), ("geo_lon", "decimals_lon"))) + """,
  length(string_split(session_duration::VARCHAR, '.')[-1])::DOUBLE AS decimals_duration, length(event_id::VARCHAR)::DOUBLE AS id_length, length(entity_id::VARCHAR)::DOUBLE AS entity_length,
  string_split(source_ip, '.')[1]::DOUBLE AS first_octet, len(command_sequence)::DOUBLE AS n_commands, (command_sequence IS NOT NULL)::INT::DOUBLE AS has_commands, (microsecond(timestamp) % 1000000)::DOUBLE AS microseconds FROM n"""


_PLAIN_TRAITS = [c for c in T.ARTEFACTS if c != "id_bucket"]  # SQL has no such hash
_LABELLED_TRAITS = (
    _TRAITS.replace("WITH ", f"WITH {LABELS_SQL}, ", 1).replace(", n AS (", ", n AS MATERIALIZED (", 1).replace("\nSELECT event_id, round(place, 6) AS place", ", t AS (SELECT event_id, entity_id, place", 1)
    + f"), y AS (SELECT t.*, coalesce(label IN {R.ATTACKS}, false) AS y, coalesce(campaign_id, 'ent:' || entity_id) AS grp FROM t LEFT JOIN lab USING (event_id)),"
    + f" sp AS (SELECT y.*, s.seed, ('0x' || substr(md5(grp || '|' || s.seed), 1, 8))::BIGINT % 1000 < {int(1000 * T.TEST_SHARE)} AS test FROM y, range({T.SPLITS}) s(seed))"
)


def grouped_splits(spark, sf):
    """On which side of each grouped split an event is: campaigns and entities stay whole."""
    out = M.labelled(driver_log(spark, sf), driver_labels(spark, sf))
    for s in range(T.SPLITS):
        out = T.grouped_split(out, s).withColumn(f"test_{s}", F.col("test").cast("int"))
    return out.select("event_id", *[f"test_{s}" for s in range(T.SPLITS)])


_SPLITS = _LABELLED_TRAITS + " SELECT event_id, " + ", ".join(f"max(test::INT) FILTER (WHERE seed = {s}) AS test_{s}" for s in range(T.SPLITS)) + " FROM sp GROUP BY 1"


def trait_auc(spark, sf):
    """How well each way of writing a row tells attacks by itself, over the grouped splits of the audit."""
    out = T.trait_auc(driver_log(spark, sf), driver_labels(spark, sf), _PLAIN_TRAITS)
    return out.select("trait", "n_splits", F.round("mean_auc", 6).alias("mean_auc"), F.round("sd_auc", 6).alias("sd_auc"))


_TRAIT_AUC = (
    _LABELLED_TRAITS
    + ", long AS (UNPIVOT (SELECT seed, y, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in _PLAIN_TRAITS) + " FROM sp WHERE test) ON " + ", ".join(_PLAIN_TRAITS) + " INTO NAME trait VALUE v)"
    + ", rk AS (SELECT trait, seed, y, rank() OVER (PARTITION BY trait, seed ORDER BY v) + (count(*) OVER (PARTITION BY trait, seed, v) - 1) / 2.0::DOUBLE AS r FROM long)"
    + ", auc AS (SELECT trait, seed, (sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y), 0)::DOUBLE AS auc FROM rk GROUP BY 1, 2)"
    + " SELECT trait, count(auc) AS n_splits, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS sd_auc FROM auc GROUP BY 1"
)


def alert_leads(spark, sf):
    """Per alert of an entity, its number of members, the first, the last and the one with the highest score."""
    ev = store(R.scored(spark, sf))
    _, members = A.group_alerts(ev, "entity", DAY)
    return A.leads(members, ev)


_LEADS = R.SCORED + R._alerts_cte("entity", DAY) + """SELECT alert_id, count(*) AS n_members, arg_min(event_id, (timestamp, event_id)) AS first_event, arg_max(event_id, (timestamp, event_id)) AS last_event,
  max(event_id) FILTER (WHERE place = 1) AS top_event FROM pl GROUP BY 1"""


def burned_in_alerts(spark, sf):
    """Alerts from a week after the first one on, when histories mean something."""
    a, _ = A.group_alerts(R.scored(spark, sf), "entity", DAY)
    return A.burned_in(store(a)).select("alert_id", F.unix_timestamp("start_ts").alias("start_s"), "n_events")


_BURNED = R.SCORED + R._alerts_cte("entity", DAY) + "SELECT alert_id, floor(epoch(start_ts))::BIGINT AS start_s, n_events FROM alerts WHERE start_ts >= (SELECT min(start_ts) FROM alerts) + INTERVAL 7 DAYS"


def first_resources(spark, sf):
    """Each entity's first eight distinct resources, in the order of their first use."""
    out = M.ordered_distinct(driver_log(spark, sf), "entity_id", "resource_accessed", ["timestamp", "event_id"], 8)
    return out.select("entity_id", F.array_join("values", ",").alias("resources"), "n_distinct")


_FIRST_USED = f"""WITH {LOG_SQL}, f AS (SELECT entity_id, resource_accessed, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp, event_id) AS i FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity_id, resource_accessed ORDER BY timestamp, event_id) = 1))
SELECT entity_id, string_agg(resource_accessed, ',' ORDER BY i) FILTER (WHERE i <= 8) AS resources, count(*) AS n_distinct FROM f GROUP BY 1"""


def budget_curve(spark, sf):
    """Recall and precision of the entity queue at half, once and twice its budget."""
    ev, labels = R.scored(spark, sf), driver_labels(spark, sf)
    ev = store(ev.select("event_id", "entity_id", "timestamp", "score"))
    a, members = A.group_alerts(ev, "entity", DAY)
    camp = labels.where("campaign_id is not null").join(ev.select("event_id", "timestamp"), "event_id").groupBy("campaign_id").agg(F.min("label").alias("campaign_type"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))
    m = M.budget_curve(store(a), store(members), labels, store(camp), 30, (0.5, 1, 2), {"entity": 5})
    return m.select("factor", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("n_campaigns", "n_detected", "recall", "precision", "budget_k", "redundant", "median_ttd_hours")])


def _budget_sql() -> str:
    head, tail = R._INC.split("q AS (SELECT * FROM alerts", 1)
    rest = tail.split("hit AS", 1)[1]
    rest = ", hit AS" + rest.split("ats AS", 1)[0] + "ats AS (SELECT campaign_id, min(floor(epoch(start_ts))) AS t FROM q JOIN attr USING (alert_id) GROUP BY 1), found AS" + rest.split("found AS", 1)[1]
    parts = []
    for f in (0.5, 1.0, 2.0):
        k = round(150 * f)
        parts.append(
            f"SELECT * FROM ({head}q AS (SELECT * FROM alerts ORDER BY alert_score DESC, alert_id LIMIT {k}){rest} SELECT {f}::DOUBLE AS factor, count(*)::DOUBLE AS n_campaigns, sum(detected::INT)::DOUBLE AS n_detected, round(sum(detected::INT) / count(*), 6) AS recall, "
            f"round(sum(detected::INT) / {k}, 6) AS precision, {k}::DOUBLE AS budget_k, greatest(0, coalesce(sum(n_alerts), 0) - sum(detected::INT))::DOUBLE AS redundant, round(median(ttd), 6)::DOUBLE AS median_ttd_hours FROM found)"
        )
    return " UNION ALL ".join(parts)


def score_by_size(spark, sf):
    """How far the score of alerts follows their size."""
    a, _ = A.group_alerts(R.scored(spark, sf), "entity", DAY)
    return M.score_by_size(a).select("n_alerts", F.round("r", 6).alias("r"))


def recent_events(spark, sf):
    """The last 40 events of each entity, with what it has used in all."""
    return M.recent_events(driver_log(spark, sf), 40).select("entity_id", "event_id", "place", "n_resources", "n_ips")


_RECENT = f"""WITH {LOG_SQL}, r AS (SELECT entity_id, event_id, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp DESC, event_id DESC) AS place FROM log),
t AS (SELECT entity_id, count(DISTINCT resource_accessed) AS n_resources, count(DISTINCT source_ip) AS n_ips FROM log GROUP BY 1)
SELECT entity_id, event_id, place, n_resources, n_ips FROM r JOIN t USING (entity_id) WHERE place <= 40"""


def first_alerts(spark, sf):
    """Per campaign, the earliest reviewed alert that is attributed to it."""
    ev, labels = R.scored(spark, sf), driver_labels(spark, sf)
    a, members = A.group_alerts(ev, "entity", DAY)
    q = M.reviewed(a, 30, {"entity": 5})
    return M.first_alerts(q, members, labels).select("campaign_id", "alert_id", F.unix_timestamp("start_ts").alias("start_s"))


_FIRST = R._INC + "SELECT campaign_id, alert_id, floor(epoch(start_ts))::BIGINT AS start_s FROM q JOIN attr USING (alert_id) QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY start_ts, alert_id) = 1"


def weekday_pivot(spark, sf):
    """Mean score by entity type and day of the week, one column a day."""
    ev = R.scored(spark, sf).withColumn("day", F.weekday("timestamp"))
    out = M.pivot_mean(ev, "entity_type", "day", "score", list(range(7)))
    return out.select("entity_type", *[F.round(f"`{d}`", 6).alias(f"day_{d}") for d in range(7)])


_PIVOT = R.SCORED + "SELECT entity_type, " + ", ".join(f"round(avg(score) FILTER (WHERE isodow(timestamp) = {d + 1}), 6) AS day_{d}" for d in range(7)) + " FROM scored GROUP BY 1"


def address_registry(spark, sf):
    """Each address's share of the log and where its range of a uniform number begins, heaviest first."""
    return M.registry(driver_log(spark, sf), "source_ip").select("source_ip", "n", F.round("begin", 9).alias("begin"), F.round("share", 9).alias("share"))


_REGISTRY = f"""WITH {LOG_SQL}, c AS (SELECT source_ip, count(*) AS n FROM log GROUP BY 1)
SELECT source_ip, n, round(coalesce(sum(n) OVER (ORDER BY n DESC, source_ip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER ()::DOUBLE, 9) AS begin, round(n / sum(n) OVER ()::DOUBLE, 9) AS share FROM c"""


def queue_overlap(spark, sf):
    """Events that the queues of two levels share, and that only one of them has."""
    ev = R.scored(spark, sf)
    of = {}
    for level in ("entity", "ip"):
        a, m = A.group_alerts(ev, level, DAY if level == "entity" else 3600)
        of[level] = m.join(M.reviewed(a, 30, {level: 5}).select("alert_id"), "alert_id", "left_semi").select("event_id")
    return M.overlap(of["entity"], of["ip"], "event_id")


def _overlap_sql() -> str:
    part = lambda level, window: f"(SELECT DISTINCT event_id FROM ({R.SCORED}{R._alerts_cte(level, window)} SELECT event_id FROM mem WHERE alert_id IN (SELECT alert_id FROM alerts ORDER BY alert_score DESC, alert_id LIMIT 150)))"
    a, b = part("entity", DAY), part("ip", 3600)
    return f"SELECT count(a.event_id IS NOT NULL AND b.event_id IS NOT NULL OR NULL) AS both, count(b.event_id IS NULL OR NULL) AS first_only, count(a.event_id IS NULL OR NULL) AS second_only FROM {a} a FULL JOIN {b} b USING (event_id)"


REGISTRY = {
    "signal_table": (signal_table, _signal_table_sql()),
    "fitted_level": (fitted_level, _fitted_sql("ip", Q._ip_sql(DAY // 4, DAY))),
    "fitted_entity": (fitted_entity, _fitted_sql("entity", _signal_table_sql())),
    "fitted_long": (fitted_long, _fitted_sql("long", _signal_table_sql())),
    "scored_log": (scored_log, _scored_sql()),
    "explained_queue": (explained_queue, _explained_sql()),
    "isotonic_map": (isotonic_map, _ISOTONIC),
    "usual_rate": (usual_rate, _USUAL),
    "written_traits": (written_traits, _TRAITS),
    "grouped_splits": (grouped_splits, _SPLITS),
    "trait_auc": (trait_auc, _TRAIT_AUC),
    "alert_leads": (alert_leads, _LEADS),
    "burned_in_alerts": (burned_in_alerts, _BURNED),
    "first_resources": (first_resources, _FIRST_USED),
    "budget_curve": (budget_curve, _budget_sql()),
    "score_by_size": (score_by_size, R.SCORED + R._alerts_cte("entity", DAY) + "SELECT count(*) AS n_alerts, round(corr(alert_score, n_events), 6) AS r FROM alerts"),
    "recent_events": (recent_events, _RECENT),
    "first_alerts": (first_alerts, _FIRST),
    "weekday_pivot": (weekday_pivot, _PIVOT),
    "address_registry": (address_registry, _REGISTRY),
    "queue_overlap": (queue_overlap, _overlap_sql()),
}


def queries():
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items()}
