"""Sources and sinks: event logs, labels, campaigns, the adapter for the driver's events, and result bundles."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schema import CAMPAIGN_SCHEMA, EVENT_SCHEMA, LABEL_SCHEMA, assert_feature_frame

#: Places of the adapter (latitude, longitude, country).
CITIES = [(52.52, 13.4, "DE"), (48.86, 2.35, "FR"), (40.42, -3.7, "ES"), (51.51, -0.13, "GB"), (41.9, 12.5, "IT"), (59.33, 18.07, "SE"), (40.71, -74.01, "US"), (34.05, -118.24, "US"), (19.43, -99.13, "MX"), (-23.55, -46.63, "BR"), (35.68, 139.69, "JP"), (37.57, 126.98, "KR"), (28.61, 77.21, "IN"), (1.35, 103.82, "SG"), (-33.87, 151.21, "AU"), (30.04, 31.24, "EG"), (-1.29, 36.82, "KE"), (55.76, 37.62, "RU")]
TYPES = ("user", "service_account", "edge_device")
ROLES = ("analyst", "engineer", "finance", "support", "batch", "deploy", "sensor")


def read_tag(spark: SparkSession, folder: str, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events (guarded), labels and campaigns of one dataset."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}_{tag}.parquet")
    return assert_feature_frame(read("events", EVENT_SCHEMA)), read("labels", LABEL_SCHEMA), read("campaigns", CAMPAIGN_SCHEMA)


def write_tag(folder: str, tag: str, events: DataFrame, labels: DataFrame, campaigns: DataFrame) -> None:
    for name, df in (("events", events), ("labels", labels), ("campaigns", campaigns)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}_{tag}.parquet")


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whatever store the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath()) for s in (found or []))


def tags(spark: SparkSession, folder: str) -> list[str]:
    """Datasets below a folder."""
    return [m[1] for p in _listed(spark, f"{folder}/events_*.parquet") if (m := re.search(r"events_(.+)\.parquet$", p))]


def bundles(spark: SparkSession, folder: str) -> list[tuple[int, float, str]]:
    """(seed, delta, path) of result bundles named seed<N>_delta<NN>, by seed and delta."""
    return sorted((int(m[1]), int(m[2]) / 10 ** (len(m[2]) - 1), p) for p in _listed(spark, f"{folder}/*") if (m := re.search(r"seed(\d+)_delta(\d+)$", p)))


def driver_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table as an access log (the same arithmetic as LOG_SQL)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    u, i = F.col("user_id"), F.col("event_id")
    city = F.when(i % 97 == 0, k % 18).otherwise(u % 18)
    part = lambda n: F.when(i % n == 0, "b").otherwise("a")
    return e.select(
        "event_id",
        u.alias("entity_id"),
        pick(TYPES, u % 3).alias("entity_type"),
        pick(ROLES, u % 7).alias("role"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("10.0.0."), (k % 20).cast("string")).alias("source_ip"),
        pick([c[0] for c in CITIES], city).alias("geo_lat"),
        pick([c[1] for c in CITIES], city).alias("geo_lon"),
        pick([c[2] for c in CITIES], city).alias("geo_country"),
        F.concat(F.lit("res/"), (k % 40).cast("string")).alias("resource_accessed"),
        F.lit("endpoint").alias("resource_type"),
        F.when(i % 50 == 0, "token").otherwise("password").alias("auth_method"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("auth_result"),
        F.col("value").alias("session_duration"),
        F.array("event_type", F.concat(F.lit("c"), (k % 5).cast("string"))).alias("command_sequence"),
        u.alias("device_id"),
        part(60).alias("device_os"),
        part(80).alias("device_firmware"),
        part(70).alias("device_mac"),
        part(90).alias("device_protocol"),
    )


def driver_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the adapter's rule: some failures are attacks, of a campaign per entity and day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    attack = (F.col("event_type") == "error") & (k % 10 == 0)
    drift = (F.col("event_type") == "purchase") & (k % 25 == 0)
    kind = F.element_at(F.array(*map(F.lit, ("brute_force", "credential_stuffing", "low_and_slow"))), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        "event_id",
        F.when(attack, kind).when(drift, "insider_drift").otherwise("normal").alias("label"),
        F.when(attack, F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))).alias("campaign_id"),
        F.when(~attack & (k % 4 == 1), "travel").when(~attack & (k % 4 == 2), "patch").alias("confounder"),
        (F.col("event_id") % 30 == 0).alias("is_cold_start"),
    )


def _values(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


LOG_SQL = f"""log AS (
  SELECT event_id, user_id AS entity_id, {_values(TYPES)}[user_id % 3 + 1] AS entity_type, {_values(ROLES)}[user_id % 7 + 1] AS role,
    ts AS timestamp, '10.0.0.' || (k % 20) AS source_ip, {_values([c[0] for c in CITIES])}[city + 1]::DOUBLE AS geo_lat,
    {_values([c[1] for c in CITIES])}[city + 1]::DOUBLE AS geo_lon, {_values([c[2] for c in CITIES])}[city + 1] AS geo_country,
    'res/' || (k % 40) AS resource_accessed, 'endpoint' AS resource_type,
    CASE WHEN event_id % 50 = 0 THEN 'token' ELSE 'password' END AS auth_method,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS auth_result, value AS session_duration,
    [event_type, 'c' || (k % 5)] AS command_sequence, user_id AS device_id,
    CASE WHEN event_id % 60 = 0 THEN 'b' ELSE 'a' END AS device_os, CASE WHEN event_id % 80 = 0 THEN 'b' ELSE 'a' END AS device_firmware,
    CASE WHEN event_id % 70 = 0 THEN 'b' ELSE 'a' END AS device_mac, CASE WHEN event_id % 90 = 0 THEN 'b' ELSE 'a' END AS device_protocol,
    floor(epoch(ts))::BIGINT AS sec, hour(ts)::INT AS hour, 2 AS ncmd
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k,
    CASE WHEN event_id % 97 = 0 THEN json_extract_string(props, '$.k')::INT % 18 ELSE user_id % 18 END AS city FROM events))"""

LABELS_SQL = """lab AS (
  SELECT event_id, CASE WHEN attack THEN ['brute_force', 'credential_stuffing', 'low_and_slow'][user_id % 3 + 1]
      WHEN event_type = 'purchase' AND k % 25 = 0 THEN 'insider_drift' ELSE 'normal' END AS label,
    CASE WHEN attack THEN user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') END AS campaign_id,
    CASE WHEN NOT attack AND k % 4 = 1 THEN 'travel' WHEN NOT attack AND k % 4 = 2 THEN 'patch' END AS confounder,
    event_id % 30 = 0 AS is_cold_start
  FROM (SELECT *, event_type = 'error' AND json_extract_string(props, '$.k')::INT % 10 = 0 AS attack,
    json_extract_string(props, '$.k')::INT AS k FROM events))"""


def plain(value):
    """A value as JSON can hold it: no NaN or infinity, times as text, nested as it is."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value


#: Files that a bundle must have and may have, and the table that is always Parquet.
BUNDLE_REQUIRED, BUNDLE_OPTIONAL, BUNDLE_PARQUET = ("meta", "metrics", "alerts", "weights"), ("alerts_by_level",), ("entity_history",)


def write_bundle(spark: SparkSession, folder: str, small: dict[str, object], tables: dict[str, DataFrame]) -> None:
    """A result bundle: small values as one JSON line each, tables as CSV or, with nested columns or by name, Parquet."""
    for name, value in small.items():
        write_json(spark, f"{folder}/{name}.json", value)
    for name, df in tables.items():
        nested = any(k.startswith(("array", "map", "struct")) for _, k in df.dtypes)
        if nested or name in BUNDLE_PARQUET:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        else:
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One small value as a line of JSON, for instance the report of a stream's latency."""
    spark.createDataFrame([(json.dumps(plain(value)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_figures(folder: str, tables: dict[str, DataFrame]) -> None:
    """Tables of figures (a sweep, held-out seeds, an ablation) as one CSV each: a row for each log or layer, so one file is enough."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, object]:
    """All files of a bundle by name; columns of CSV files get the types that their values show."""
    out: dict[str, object] = {}
    for p in _listed(spark, f"{folder}/*"):
        name, _, kind = p.rsplit("/", 1)[-1].rpartition(".")
        if kind == "json":
            out[name] = json.loads(spark.read.text(p).first()[0])
        elif kind == "csv":
            out[name] = spark.read.option("header", True).option("inferSchema", True).csv(p)
        elif kind == "parquet":
            out[name] = spark.read.parquet(p)
    return out


def load_bundle(spark: SparkSession, folder: str) -> dict[str, object] | None:
    """A bundle with every required file, else None."""
    there = {p.rsplit("/", 1)[-1] for p in _listed(spark, f"{folder}/*.json")}
    return read_bundle(spark, folder) if all(f"{n}.json" in there for n in BUNDLE_REQUIRED) else None
