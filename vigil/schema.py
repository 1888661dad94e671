"""The access log's contract: columns, labels, constants and the signal registry."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class LabelLeakError(ValueError):
    """A frame meant for detection holds columns it must not see."""


#: The columns a detector may see, in their order, with their types.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("event_id", T.StringType()),
            ("entity_id", T.StringType()),
            ("entity_type", T.StringType()),
            ("role", T.StringType()),
            ("timestamp", T.TimestampType()),
            ("source_ip", T.StringType()),
            ("geo_lat", T.DoubleType()),
            ("geo_lon", T.DoubleType()),
            ("geo_country", T.StringType()),
            ("resource_accessed", T.StringType()),
            ("resource_type", T.StringType()),
            ("auth_method", T.StringType()),
            ("auth_result", T.StringType()),
            ("session_duration", T.DoubleType()),
            ("command_sequence", T.ArrayType(T.StringType())),
            ("device_id", T.StringType()),
            ("device_os", T.StringType()),
            ("device_firmware", T.StringType()),
            ("device_mac", T.StringType()),
            ("device_protocol", T.StringType()),
        ]
    ]
)
LABEL_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "label", "campaign_id", "campaign_type", "confounder")] + [T.StructField("is_cold_start", T.BooleanType())])
CAMPAIGN_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("campaign_id", "campaign_type", "scope_level", "scope_key")] + [T.StructField("start_ts", T.TimestampType()), T.StructField("end_ts", T.TimestampType()), T.StructField("n_events", T.LongType())])

#: Attack labels (insider_drift is a label, but never a positive), and name parts that betray a label.
ATTACK_TYPES = ("brute_force", "credential_stuffing", "device_spoofing", "impossible_travel", "lateral_movement", "low_and_slow")
INSIDER = "insider_drift"
FORBIDDEN_PARTS = ("label", "attack", "campaign", "confounder", "cold_start", "malicious", "anomaly", "inject", "scenario", "delta", "truth")
LEVELS = ("entity", "ip", "long")

#: Seconds, gates and smoothing of the signals.
FAIL_WINDOW, IP_WINDOW, LONG_WINDOW = 900, 3600, 7 * 86400
COLD_N0, COLD_MIN = 50.0, 25
GEO_GATE_KM, GEO_CAP_KMH, EARTH_KM = 25.0, 20000.0, 6371.0
BURST_MIN, BURST_FLOOR = 20, 0.5
OFFHOURS = 0.012
NGRAM = {"entity": 0.40, "group": 0.30, "unigram": 0.25, "floor": 0.05 / 4096.0}
MERGE_WINDOW = {"entity": 3600, "ip": 3600, "long": 86400}
DAILY_BUDGET = {"entity": 30, "ip": 10, "long": 10}
Z_RANGE, TARGET_FPR, REFERENCE_ROWS, MITIGATION = (-4.0, 6.0), 0.01, 120_000, 0.75


@dataclass(frozen=True)
class Signal:
    """A signal: where it is fused, its layer and prior, and how it reads (a format_string over its value)."""

    name: str
    level: str
    layer: str
    prior: float
    text: str
    mitigating: bool = False


SIGNALS = (
    Signal("geo_velocity", "entity", "L0", 1.0, "moved at %,.0f km/h since the last access"),
    Signal("fail_rate_entity", "entity", "L0", 0.9, "%.0f sign-ins failed within 15 minutes"),
    Signal("fail_rate_ip", "ip", "L0", 0.9, "%.0f sign-ins from the address failed within 15 minutes"),
    Signal("fingerprint_mismatch", "entity", "L0", 0.9, "%.0f device properties differ from the usual ones"),
    Signal("burst_ratio", "entity", "L0", 0.9, "activity is %.0f times the usual rate"),
    Signal("hour_surprisal", "entity", "L1", 0.6, "uncommon hour (%.1f bits)"),
    Signal("ip_novelty", "entity", "L1", 0.5, "address is new for the entity (%.2f)"),
    Signal("country_novelty", "entity", "L1", 0.7, "country is new for the entity (%.2f)"),
    Signal("resource_surprisal", "entity", "L1", 0.8, "uncommon resource for the entity (%.1f bits)"),
    Signal("duration_z", "entity", "L1", 0.4, "session length is %.1f deviations off"),
    Signal("ncmd_z", "entity", "L1", 0.4, "number of commands is %.1f deviations off"),
    Signal("peer_incongruence", "entity", "L1", 0.8, "uncommon resource for the role (%.1f bits)"),
    Signal("auth_method_novelty", "entity", "L1", 0.5, "sign-in method is new for the entity (%.2f)"),
    Signal("ip_entity_fanout", "ip", "L3", 1.0, "%.0f entities used the address within an hour"),
    Signal("ip_fail_ratio", "ip", "L0", 0.9, "share of failed attempts from the address is %.2f"),
    Signal("cmd_surprisal", "entity", "L2", 0.7, "uncommon sequence of actions (%.1f deviations)"),
    Signal("new_resource_rate_7d", "long", "L3", 0.8, "%.0f resources were first used within 7 days"),
    Signal("offhours_rate_7d", "long", "L3", 0.6, "%.0f accesses at rare hours within 7 days"),
    Signal("breadth_ratio_7d", "long", "L3", 0.7, "share %.2f of the new resources was touched once"),
    Signal("uncorroborated_new_edges_7d", "long", "L3", 0.9, "%.0f new resources that no two peers took up too"),
    Signal("corroboration_7d", "long", "L3", 0.0, "%.0f new resources that peers took up too", True),
)
BY_NAME = {s.name: s for s in SIGNALS}


def signals_of(level: str, layers: tuple[str, ...] | None = None, mitigating: bool = False) -> list[Signal]:
    return [s for s in SIGNALS if s.level == level and s.mitigating == mitigating and (layers is None or s.layer in layers)]


GENERATOR = "vigil.sources.generate"


def assert_feature_frame(df: DataFrame, alone: bool = False) -> DataFrame:
    """df itself, if it holds only what a detector may see; costs no job. alone: the log generator must not even be loaded."""
    allowed = set(EVENT_SCHEMA.names)
    if extra := [c for c in df.columns if c not in allowed]:
        raise LabelLeakError(f"columns outside the contract: {extra}")
    if named := [c for c in df.columns if any(p in c.lower() for p in FORBIDDEN_PARTS)]:
        raise LabelLeakError(f"columns named after labels: {named}")
    if alone and GENERATOR in sys.modules:
        raise LabelLeakError("the generator and its parameters are loaded in this process")
    return df
