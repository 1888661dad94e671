"""Queries of the causal signals over the driver's events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import rounded
from vigil.operators import signals as S
from vigil.operators.causal import prepare
from vigil.sources.tables import LOG_SQL, driver_log

DAY = 86400


def _rounded(df, *columns):
    return df.select("event_id", *[rounded(c, 6).alias(c) for c in columns])


def _query(steps, *columns):
    def run(spark, sf_dir):
        ev = S.history(prepare(driver_log(spark, sf_dir)))
        for step in steps:
            ev = step(ev)
        return _rounded(ev, *columns)

    return run


def _sql(body: str, columns: str, ctes: str = "") -> str:
    names = [c.strip() for c in columns.split(",")]
    return f"WITH {LOG_SQL}{ctes} SELECT event_id, {', '.join(f'round(({n})::DOUBLE, 6) AS {n}' for n in names)} FROM ({body})"


N = "(row_number() OVER (PARTITION BY entity_id ORDER BY timestamp, event_id) - 1)"
LAM = f"({N} / ({N} + 50.0))"


def _trail(value: str, key: str, seconds: int) -> str:
    """Earlier events in reach; those of the same second that come later are taken off."""
    return (
        f"(sum({value}) OVER (PARTITION BY {key} ORDER BY sec RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"
        f" - sum({value}) OVER (PARTITION BY {key}, sec ORDER BY timestamp, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


FAIL = "(auth_result = 'failure')::INT"
HIST = f""", hist AS (SELECT *, {N} AS n, {LAM} AS lam FROM log)"""
HOURS = HIST + """, hours AS (SELECT *,
  count(*) OVER (PARTITION BY entity_type ORDER BY timestamp, event_id) - 1 AS tn,
  count(*) OVER (PARTITION BY entity_type, hour ORDER BY timestamp, event_id) - 1 AS th,
  count(*) OVER (PARTITION BY entity_id, hour ORDER BY timestamp, event_id) - 1 AS eh FROM hist),
phour AS (SELECT *, lam * CASE WHEN n > 0 THEN (eh + 0.5::DOUBLE) / (n + 12) ELSE 1.0::DOUBLE / 24 END
  + (1 - lam) * CASE WHEN tn > 0 THEN (th + 1.0::DOUBLE) / (tn + 24) ELSE 1.0::DOUBLE / 24 END AS p_hour FROM hours)"""

PRIOR_E = "OVER (PARTITION BY entity_id ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _z(x: str, floor: float) -> str:
    return f"CASE WHEN n >= 5 THEN abs({x} - avg({x}) {PRIOR_E}) / greatest(sqrt(greatest(coalesce(var_samp({x}) {PRIOR_E}, 0), 1e-6)), {floor}) ELSE 0 END"


def _ip_sql(fail: int, tries: int) -> str:
    return _sql(
        f"""SELECT event_id, coalesce(fails, 0) AS fail_rate_ip, coalesce(fan, 0) AS ip_entity_fanout, CASE WHEN tries >= 5 THEN fails::DOUBLE / tries ELSE 0 END AS ip_fail_ratio FROM (
  SELECT event_id, {_trail(FAIL, 'source_ip', fail)} AS fails, {_trail('1', 'source_ip', tries)} AS tries,
    (SELECT count(DISTINCT b.entity_id) FROM log b WHERE b.source_ip = a.source_ip AND b.sec >= a.sec - {tries}
      AND (b.timestamp, b.event_id) < (a.timestamp, a.event_id)) AS fan
  FROM log a)""",
        "fail_rate_ip, ip_entity_fanout, ip_fail_ratio",
    )


def _tokens_sql() -> str:
    prior = {"e_bi": "entity_id, prev, tok", "e_ctx": "entity_id, prev", "g_bi": "entity_type, prev, tok", "g_ctx": "entity_type, prev", "uni": "tok", "al": ""}
    parts, joins = [], []
    for k, keys in prior.items():
        names = [x.strip() for x in keys.split(",") if x.strip()]
        group = "".join(f"{x}, " for x in names)
        part = f"PARTITION BY {keys} " if keys else ""
        parts.append(f"c_{k} AS (SELECT {group}event_id, count(*) AS own, sum(count(*)) OVER ({part}ORDER BY any_value(timestamp), event_id) - count(*) AS before FROM tok GROUP BY {group}event_id)")
        joins.append(f"JOIN c_{k} {k} ON t.event_id = {k}.event_id" + "".join(f" AND t.{x} = {k}.{x}" for x in names))

    def p(add: str) -> str:
        c = {k: f"({k}.before{add.format(k)})" for k in prior}
        return f"-log2(greatest(0.4 * CASE WHEN {c['e_ctx']} > 0 THEN {c['e_bi']}::DOUBLE / {c['e_ctx']} ELSE 0 END + 0.3 * CASE WHEN {c['g_ctx']} > 0 THEN {c['g_bi']}::DOUBLE / {c['g_ctx']} ELSE 0 END + 0.25 * CASE WHEN {c['al']} > 0 THEN {c['uni']}::DOUBLE / {c['al']} ELSE 0 END + 0.05::DOUBLE / 4096, 1e-12))"

    return f"""WITH {LOG_SQL},
flat AS (SELECT event_id, entity_id, entity_type, timestamp, unnest(list_concat(['hr:' || lpad(hour::VARCHAR, 2, '0'), 'res:' || resource_accessed, 'auth:' || auth_method,
  CASE WHEN auth_result = 'success' THEN 'ok' ELSE 'fail' END], list_transform(command_sequence, lambda x: 'cmd:' || x))) AS tok, generate_subscripts(list_concat([1, 2, 3, 4], [5, 6]), 1) AS pos FROM log),
tok AS (SELECT *, coalesce(lag(tok) OVER (PARTITION BY event_id ORDER BY pos), '<BOS>') AS prev FROM flat),
{', '.join(parts)},
per AS (SELECT t.event_id, any_value(t.entity_id) AS entity_id, any_value(t.timestamp) AS timestamp, avg({p('')}) AS pre, avg({p(' + {0}.own')}) AS post FROM tok t {' '.join(joins)} GROUP BY t.event_id),
z AS (SELECT event_id, pre, avg(post) {PRIOR_E} AS m, var_samp(post) {PRIOR_E} AS v, count(post) {PRIOR_E} AS c FROM per)
SELECT event_id, round(CASE WHEN c >= 8 THEN (pre - m) / greatest(sqrt(greatest(v, 1e-6)), 0.5) ELSE 0 END::DOUBLE, 6) AS cmd_surprisal FROM z"""


SEEN = """, edge AS (SELECT *, row_number() OVER (PARTITION BY entity_id, resource_accessed ORDER BY timestamp, event_id) AS nth FROM log)"""


def _new_sql(seconds: int) -> str:
    """Edges in reach of each event, with when the resource was touched again."""
    return f""", new AS (SELECT f.entity_id, f.sec, f.timestamp, f.event_id, g.timestamp AS again_ts, g.event_id AS again_id FROM edge f LEFT JOIN edge g
    ON g.entity_id = f.entity_id AND g.resource_accessed = f.resource_accessed AND g.nth = 2 WHERE f.nth = 1),
  reach AS (SELECT a.event_id, count(b.event_id) AS total, count(b.event_id) FILTER (WHERE b.again_ts IS NULL OR (b.again_ts, b.again_id) >= (a.timestamp, a.event_id)) AS once
    FROM log a LEFT JOIN new b ON b.entity_id = a.entity_id AND b.sec >= a.sec - {seconds} AND (b.timestamp, b.event_id) < (a.timestamp, a.event_id) GROUP BY a.event_id)"""


CORROBORATION = f"""WITH {LOG_SQL}{SEEN}, new AS (SELECT * FROM edge WHERE nth = 1),
  peers AS (SELECT a.entity_id, a.sec, a.timestamp, a.event_id, b.timestamp AS peer_ts, b.event_id AS peer_id,
      row_number() OVER (PARTITION BY a.event_id ORDER BY b.timestamp, b.event_id) AS k
    FROM new a JOIN new b ON a.resource_accessed = b.resource_accessed AND a.role = b.role AND a.entity_id <> b.entity_id AND abs(a.sec - b.sec) <= 604800),
  known AS (SELECT n.entity_id, n.sec, n.timestamp, n.event_id, p.peer_ts, p.peer_id FROM new n LEFT JOIN peers p ON p.event_id = n.event_id AND p.k = 2)
SELECT a.event_id, count(b.event_id) FILTER (WHERE b.peer_ts IS NOT NULL AND (b.peer_ts, b.peer_id) < (a.timestamp, a.event_id))::DOUBLE AS corroboration_7d,
  (count(b.event_id) - count(b.event_id) FILTER (WHERE b.peer_ts IS NOT NULL AND (b.peer_ts, b.peer_id) < (a.timestamp, a.event_id)))::DOUBLE AS uncorroborated_new_edges_7d
FROM log a LEFT JOIN known b ON b.entity_id = a.entity_id AND b.sec >= a.sec - 604800 AND (b.timestamp, b.event_id) < (a.timestamp, a.event_id) GROUP BY a.event_id"""

ROLE_RES = HIST + """, seen AS (SELECT *, (row_number() OVER (PARTITION BY role, resource_accessed ORDER BY timestamp, event_id) = 1)::INT AS fresh FROM hist),
rr AS (SELECT *, count(*) OVER (PARTITION BY role ORDER BY timestamp, event_id) - 1 AS rn, sum(fresh) OVER (PARTITION BY role ORDER BY timestamp, event_id) - fresh AS rd,
  count(*) OVER (PARTITION BY role, resource_accessed ORDER BY timestamp, event_id) - 1 AS rres,
  count(*) OVER (PARTITION BY entity_id, resource_accessed ORDER BY timestamp, event_id) - 1 AS eres FROM seen),
pr AS (SELECT *, CASE WHEN rn > 0 THEN (rres + 0.5::DOUBLE) / (rn + 0.5::DOUBLE * (rd + 1)) ELSE 1e-3 END AS p_role,
  CASE WHEN n > 0 THEN (eres + 0.5::DOUBLE) / (n + 32) ELSE 1e-3 END AS p_own FROM rr)"""

FINGERPRINT = f"""WITH {LOG_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY entity_id, device_id ORDER BY timestamp, event_id) AS pos,
  row_number() OVER (PARTITION BY entity_id, device_id, device_os, device_mac, device_firmware, device_protocol ORDER BY timestamp, event_id) AS cnt FROM log),
b AS (SELECT *, min(pos) OVER (PARTITION BY entity_id, device_id, device_os, device_mac, device_firmware, device_protocol) AS since FROM a),
c AS (SELECT *, max({{'c': cnt, 's': -since, 'os': device_os, 'mac': device_mac, 'fw': device_firmware, 'pr': device_protocol}})
  OVER (PARTITION BY entity_id, device_id ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM b)
SELECT event_id, CASE WHEN usual IS NULL THEN 0.0::DOUBLE ELSE ((usual.os <> device_os)::INT + (usual.mac <> device_mac)::INT + (usual.fw <> device_firmware)::INT + (usual.pr <> device_protocol)::INT)::DOUBLE END AS fingerprint_mismatch FROM c"""

VELOCITY = f"""SELECT event_id, CASE WHEN km > 25 THEN least(km / greatest((sec - psec) / 3600.0::DOUBLE, 1.0::DOUBLE / 60), 20000) ELSE 0 END AS geo_velocity FROM (
  SELECT event_id, sec, psec, 2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin((radians(geo_lat) - radians(plat)) / 2), 2)
    + cos(radians(plat)) * cos(radians(geo_lat)) * pow(sin((radians(geo_lon) - radians(plon)) / 2), 2)))) AS km
  FROM (SELECT *, lag(geo_lat) OVER w AS plat, lag(geo_lon) OVER w AS plon, lag(sec) OVER w AS psec FROM log WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp, event_id)))"""


def _burst(seconds: int, suffix: str) -> str:
    return f"CASE WHEN n >= 20 THEN {_trail('1', 'entity_id', seconds)} / greatest(n * {seconds}::DOUBLE / greatest(sec - min(sec) {PRIOR_E}, 1), 0.5) ELSE 0 END AS burst_ratio{suffix}"


BITS = "-log2(greatest({}, 1e-9))"
REGISTRY = {
    "geo_velocity": ([S.geo_velocity], ["geo_velocity"], _sql(VELOCITY, "geo_velocity")),
    "failed_burst": ([S.fail_rates, lambda e: S.fail_rates(e, DAY, "_1d")], ["fail_rate_entity", "fail_rate_entity_1d"], _sql(f"SELECT event_id, {_trail(FAIL, 'entity_id', 900)} AS fail_rate_entity, {_trail(FAIL, 'entity_id', DAY)} AS fail_rate_entity_1d FROM log", "fail_rate_entity, fail_rate_entity_1d")),
    "burst_ratio": ([S.burst_ratio, lambda e: S.burst_ratio(e, DAY, "_1d")], ["burst_ratio", "burst_ratio_1d"], _sql(f"SELECT event_id, {_burst(900, '')}, {_burst(DAY, '_1d')} FROM hist", "burst_ratio, burst_ratio_1d", HIST)),
    "ip_signals": ([S.ip_signals], ["fail_rate_ip", "ip_entity_fanout", "ip_fail_ratio"], _ip_sql(900, 3600)),
    "ip_signals_1d": ([lambda e: S.ip_signals(e, DAY // 4, DAY)], ["fail_rate_ip", "ip_entity_fanout", "ip_fail_ratio"], _ip_sql(DAY // 4, DAY)),
    "fingerprint": ([S.fingerprint_mismatch], ["fingerprint_mismatch"], FINGERPRINT),
    "hour_surprisal": ([S.hour_surprisal], ["p_hour", "hour_surprisal"], _sql(f"SELECT event_id, p_hour, {BITS.format('p_hour')} AS hour_surprisal FROM phour", "p_hour, hour_surprisal", HOURS)),
    "novelty": (
        [S.novelties],
        ["ip_novelty", "country_novelty", "auth_method_novelty"],
        _sql(
            "SELECT event_id, " + ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY entity_id, {c} ORDER BY timestamp, event_id) = 1 THEN lam ELSE 0 END AS {n}" for n, c in (("ip_novelty", "source_ip"), ("country_novelty", "geo_country"), ("auth_method_novelty", "auth_method"))) + " FROM hist",
            "ip_novelty, country_novelty, auth_method_novelty",
            HIST,
        ),
    ),
    "resource_surprisal": (
        [S.resource_signals],
        ["peer_incongruence", "resource_surprisal"],
        _sql(f"SELECT event_id, {BITS.format('p_role')} AS peer_incongruence, greatest(0, {BITS.format('lam * p_own + (1 - lam) * p_role')} - ({BITS.format('p_role')})) AS resource_surprisal FROM pr", "peer_incongruence, resource_surprisal", ROLE_RES),
    ),
    "deviations": ([S.deviations], ["duration_z", "ncmd_z"], _sql(f"SELECT event_id, {_z('ln(1 + session_duration)', 0.15)} AS duration_z, {_z('ncmd::DOUBLE', 0.75)} AS ncmd_z FROM hist", "duration_z, ncmd_z", HIST)),
    "long_window": (
        [S.hour_surprisal, S.long_window],
        ["new_resource_rate_7d", "offhours_rate_7d", "breadth_ratio_7d"],
        _sql(
            f"SELECT p.event_id, total AS new_resource_rate_7d, off AS offhours_rate_7d, CASE WHEN total > 0 THEN once::DOUBLE / total ELSE 0 END AS breadth_ratio_7d FROM reach JOIN (SELECT event_id, {_trail('(p_hour < 0.012)::INT', 'entity_id', 604800)} AS off FROM phour) p USING (event_id)",
            "new_resource_rate_7d, offhours_rate_7d, breadth_ratio_7d",
            HOURS + SEEN + _new_sql(604800),
        ),
    ),
    "corroboration": ([S.corroboration], ["corroboration_7d", "uncorroborated_new_edges_7d"], CORROBORATION),
    "cmd_surprisal": ([S.cmd_surprisal], ["cmd_surprisal"], _tokens_sql()),
    "history": ([], ["n", "lam"], _sql("SELECT event_id, n, lam FROM hist", "n, lam", HIST)),
}


def queries():
    return {name: _query(steps, *columns) for name, (steps, columns, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, _, sql) in REGISTRY.items()}
