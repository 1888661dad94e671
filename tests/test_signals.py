"""The signals against a plain event-by-event model, on small logs with ties in time."""

import datetime as dt
import math
import random

import pytest

from vigil.operators.signals import signal_frame
from vigil.plans import report_queries, signal_queries
from vigil.schema import EVENT_SCHEMA

COLUMNS = EVENT_SCHEMA.names


def small_log(seed, n=160):
    rng = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t += rng.choice([0, 0, 1, 40, 600, 4000, 30000, 200000])
        e = rng.randrange(5)
        out.append(
            (f"{rng.getrandbits(48):012x}", f"e{e}", ["user", "device"][e % 2], ["r1", "r2"][e % 2], dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t + rng.choice([0, 0.25])), f"10.0.0.{rng.randrange(3)}",
             *rng.choice([(52.5, 13.4, "DE"), (48.9, 2.35, "FR"), (52.51, 13.41, "DE")]), f"res{rng.randrange(6)}", "file", rng.choice(["password", "token"]), rng.choice(["success", "failure"]), rng.uniform(1, 100),
             rng.choice([None, [], ["a"], ["a", "b", "a"]]), f"d{e}", rng.choice("ab"), "f", rng.choice("xy"), "p")
        )
    return out


def plain(rows):
    """A separate model: for each event, everything strictly before it is looked through again."""
    evs = [dict(zip(COLUMNS, r)) for r in sorted(rows, key=lambda r: (r[4], r[0]))]
    for e in evs:
        e["sec"] = int((e["timestamp"] - dt.datetime(1970, 1, 1)).total_seconds() // 1)
    out = {}
    for i, e in enumerate(evs):
        past, s = evs[:i], {}
        own = [p for p in past if p["entity_id"] == e["entity_id"]]
        ip = [p for p in past if p["source_ip"] == e["source_ip"]]
        n = len(own)
        lam, now = n / (n + 50), e["sec"]
        within = lambda xs, w: [p for p in xs if now - p["sec"] <= w]  # noqa: E731,B023
        failed = lambda xs: [p for p in xs if p["auth_result"] == "failure"]
        s["fail_rate_entity"] = len(failed(within(own, 900)))
        s["burst_ratio"] = len(within(own, 900)) / max(n * 900 / max(now - own[0]["sec"], 1), 0.5) if n >= 20 else 0
        s["fail_rate_ip"] = len(failed(within(ip, 900)))
        s["ip_entity_fanout"] = len({p["entity_id"] for p in within(ip, 3600)})
        tries = len(within(ip, 3600))
        s["ip_fail_ratio"] = s["fail_rate_ip"] / tries if tries >= 5 else 0
        for name, c in (("ip_novelty", "source_ip"), ("country_novelty", "geo_country"), ("auth_method_novelty", "auth_method")):
            s[name] = 0 if any(p[c] == e[c] for p in own) else lam
        kind = [p for p in past if p["entity_type"] == e["entity_type"]]
        hour = lambda p: p["timestamp"].hour
        p_e = (sum(hour(p) == hour(e) for p in own) + 0.5) / (n + 12) if n else 1 / 24
        p_t = (sum(hour(p) == hour(e) for p in kind) + 1) / (len(kind) + 24) if kind else 1 / 24
        e["p_hour"] = lam * p_e + (1 - lam) * p_t
        s["hour_surprisal"] = -math.log2(max(e["p_hour"], 1e-9))
        role = [p for p in past if p["role"] == e["role"]]
        res = e["resource_accessed"]
        same = lambda xs: sum(p["resource_accessed"] == res for p in xs)  # noqa: E731,B023
        p_role = (same(role) + 0.5) / (len(role) + 0.5 * (len({p["resource_accessed"] for p in role}) + 1)) if role else 1e-3
        s["peer_incongruence"] = -math.log2(max(p_role, 1e-9))
        p_own = (same(own) + 0.5) / (n + 32) if n else 1e-3
        s["resource_surprisal"] = max(0, -math.log2(lam * p_own + (1 - lam) * p_role) - s["peer_incongruence"])
        for name, f, floor in (("duration_z", lambda p: math.log1p(p["session_duration"]), 0.15), ("ncmd_z", lambda p: len(p["command_sequence"] or []), 0.75)):
            xs = [f(p) for p in own]
            mean = sum(xs) / n if n else 0
            s[name] = abs(f(e) - mean) / max(math.sqrt(max(sum((x - mean) ** 2 for x in xs) / (n - 1), 1e-6)), floor) if n >= 5 else 0
        first = {}
        for p in own:
            first.setdefault(p["resource_accessed"], p)
        edges = [(r, p) for r, p in first.items() if now - p["sec"] <= 604800]
        s["new_resource_rate_7d"] = len(edges)
        s["offhours_rate_7d"] = sum(p["p_hour"] < 0.012 for p in within(own, 604800))
        s["breadth_ratio_7d"] = sum(sum(q["resource_accessed"] == r for q in own) <= 1 for r, _ in edges) / len(edges) if edges else 0
        together = 0
        for r, p in edges:
            peers = {}
            for q in past:
                if q["resource_accessed"] == r and q["role"] == e["role"] and q["entity_id"] != e["entity_id"]:
                    peers.setdefault(q["entity_id"], q["sec"])
            together += sum(abs(t - p["sec"]) <= 604800 for t in peers.values()) >= 2
        s["corroboration_7d"], s["uncorroborated_new_edges_7d"] = together, len(edges) - together
        devices = {}
        for p in own:
            k = (p["device_os"], p["device_mac"], p["device_firmware"], p["device_protocol"])
            devices[k] = devices.get(k, 0) + 1
        usual = max(devices, key=devices.get) if devices else None
        s["fingerprint_mismatch"] = sum(a != b for a, b in zip(usual, (e["device_os"], e["device_mac"], e["device_firmware"], e["device_protocol"]))) if usual else 0
        s["_n_history"] = n
        out[e["event_id"]] = s
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_signals_equal_plain_model(spark, seed):
    rows = small_log(seed)
    df = spark.createDataFrame(rows, EVENT_SCHEMA).repartition(3)
    want = plain(rows)
    got = {r.event_id: r for r in signal_frame(df).collect()}
    assert set(got) == set(want)
    for i, s in want.items():
        for name, v in s.items():
            assert got[i][name] == pytest.approx(v, abs=1e-9), (name, i)


def test_every_query_has_sql():
    for m in (signal_queries, report_queries):
        assert set(m.queries()) == set(m.oracle_sql())
