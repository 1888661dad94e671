"""A distributed generator of access logs with attacks, insider drift and confounders.

All randomness is a hash of (seed, keys), so a log is the same under any partitioning. Intents
(who, when, what, how) of all kinds are built as DataFrames and pass one emission step, so that attacks
cannot be told by how they were written. delta goes from 0 (blatant) to 1 (hard to tell).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.columns import bumped
from vigil.functions.draws import draw_by_weight, draw_from
from vigil.schema import ATTACK_TYPES, EVENT_SCHEMA, INSIDER
from vigil.sources.tables import CITIES, ROLES, read_tag, tags, write_tag

START = 1767225600  # 2026-01-01 00:00:00 UTC
RESOURCES = 150
KINDS = ("brute_force", "credential_stuffing", "impossible_travel", "lateral_movement", "device_spoofing", "low_and_slow", INSIDER)
#: Benign behaviour that looks wrong, by name.
CONFOUNDERS = ("business_travel", "password_reset_storm", "cert_retry_loop", "os_patch", "device_refresh", "oncall_rotation", "maintenance_window", "project_onboarding", "ci_automation_burst", "shared_jump_host", "office_nat", "credential_rotation")
#: Addresses of each pool of a city (cloud: of the world), and the share of attack traffic from addresses that benign traffic uses.
POOLS = {"office": 8, "consumer": 400, "vpn": 4, "cloud": 64}
REGISTRY_SHARE = 0.75
#: How much likelier a role's own and shared resources are than others', and how far single ones vary.
OWN, SHARED, OTHER, VARY = 6.0, 3.0, 0.02, (0.7, 1.3)
FAVOURITES, HABIT = 16, 0.97
#: Fixed value: the share of brute force that gets in at the end.
BREAKS_IN = 0.35


def u(seed: int, *keys) -> Column:
    """A uniform number of 0 to 1 for these keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.lit(k) if isinstance(k, str) else k for k in keys]), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(u(seed, "g1", *keys))) * F.cos(2 * F.pi() * u(seed, "g2", *keys))


def poisson(mean: Column, x: Column, most: int = 60) -> Column:
    """Inverse distribution function of a Poisson number at x, up to `most`."""
    step = lambda a, k: F.struct((a["p"] * mean / k).alias("p"), (a["c"] + a["p"] * mean / k).alias("c"), (a["n"] + (x > a["c"]).cast("int")).alias("n"))
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step)["n"]


def lerp(a: float, b: float, delta: float) -> float:
    return a + (b - a) * delta


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(at * len(values)) + 1).cast("int"))


def _kind_of(seed: int, i: Column) -> Column:
    return F.when(u(seed, "t", i) < 0.72, "user").when(u(seed, "t", i) < 0.88, "service_account").otherwise("edge_device")


def _rate_of(seed: int, i: Column) -> Column:
    """Events a day of an entity, a function of its number."""
    kind = _kind_of(seed, i)
    return F.when(kind == "user", 6.0).when(kind == "service_account", 20.0).otherwise(12.0) * F.exp(0.4 * normal(seed, "k", i))


def _city_of(seed: int, i: Column) -> Column:
    return F.floor(u(seed, "c", i) * len(CITIES)).cast("int")


def volumes(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """Entities by their rate, and by role: what victims, members of a team and addresses are drawn from."""
    return entities(spark, n, seed).select("id", "role", "rate")


def address(seed: int, i: Column, *keys) -> Column:
    """An address of an entity, as a number: of its office, its home, its city's gateways, or the cloud."""
    x, y = u(seed, "pool", *keys), u(seed, "slot", *keys)
    city = _city_of(seed, i)
    pool = lambda name, slot: F.xxhash64(F.lit(name), F.lit(-1) if name == "cloud" else city, (slot % POOLS[name]).cast("int"))
    spare = F.floor(y * 1000)
    return F.when(x < 0.55, pool("office", i)).when(x < 0.85, pool("consumer", i * 7)).when(x < 0.95, pool("vpn", spare)).otherwise(pool("cloud", spare))


def entities(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """The population: type, role, home, rate and hours of each entity."""
    i = F.col("id")
    kind = _kind_of(seed, i)
    role = F.when(kind == "user", _pick(ROLES[:4], u(seed, "r", i))).when(kind == "service_account", _pick(ROLES[4:6], u(seed, "r", i))).otherwise(ROLES[6])
    prefix = F.when(kind == "user", "usr").when(kind == "service_account", "svc").otherwise("dev")
    return spark.range(n).select(
        "id",
        kind.alias("entity_type"),
        role.alias("role"),
        F.format_string("%s-%05d", prefix, i).alias("entity_id"),
        _city_of(seed, i).alias("city"),
        _rate_of(seed, i).alias("rate"),
        (9 + 3 * normal(seed, "h", i)).alias("mid_hour"),
        F.when(u(seed, "new", i) < 0.06, F.floor(u(seed, "j", i) * 30)).otherwise(0).cast("int").alias("joins"),
    )


def catalogue(seed: int) -> np.ndarray:
    """P(resource given role): each resource is one role's own or shared by all, and any role may use any."""
    owner = np.arange(RESOURCES) % (len(ROLES) + 1)
    base = np.where(owner == len(ROLES), SHARED, OTHER) + np.zeros((len(ROLES), 1))
    base[owner[None, :] == np.arange(len(ROLES))[:, None]] = OWN
    w = base * np.random.Generator(np.random.Philox(key=seed)).uniform(*VARY, base.shape)
    return w / w.sum(1, keepdims=True)


def _resource(seed: int, role: Column, who: Column, *keys) -> Column:
    """A resource, drawn by the role's weights: mostly one of the entity's favourites, which are draws of its own, the first far more often."""
    favourite = F.xxhash64(F.lit("own"), who, F.floor(FAVOURITES * F.pow(u(seed, "fav", *keys), 2.5)).cast("int"))
    draw = F.when(u(seed, "habit", *keys) < HABIT, favourite).otherwise(F.xxhash64(F.lit("any"), *keys))
    number = F.lit(None).cast("int")
    for name, w in zip(ROLES, catalogue(seed)):
        number = F.when(role == name, draw_from(w, u(seed, "res", draw), u(seed, "stay", draw))).otherwise(number)
    return F.concat(F.lit("res/"), number.cast("string"))


INTENT = ["id", "entity_id", "entity_type", "role", "city", "sec", "resource", "failed", "ip", "spoof", "recon", "nonce", "label", "campaign_id", "confounder", "method", "commands", "stretch"]


def _usual() -> list[Column]:
    """What most intents leave to the emission step: sign-in method, number of commands, length."""
    return [F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("commands"), F.lit(1.0).alias("stretch")]


def benign(spark, n, days, seed) -> DataFrame:
    pop = entities(spark, n, seed)
    d = pop.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).where(F.col("day") >= F.col("joins"))
    weekend = F.when((F.pmod(F.col("day") + 3, F.lit(7)) >= 5) & (F.col("entity_type") == "user"), 0.25).otherwise(1.0)
    d = d.withColumn("n", poisson(F.least(F.col("rate") * weekend, F.lit(40.0)), u(seed, "n", F.col("id"), F.col("day"))))
    d = d.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = (F.col("id"), F.col("day"), F.col("k"))
    hour = F.when(F.col("entity_type") == "user", F.pmod(F.col("mid_hour") + 2.2 * normal(seed, "hr", *key), F.lit(24.0))).otherwise(24 * u(seed, "hr", *key))
    return d.select(
        "id", "entity_id", "entity_type", "role", "city",
        (START + F.col("day") * 86400 + hour * 3600).cast("long").alias("sec"),
        F.when(u(seed, "sso", *key) < 0.22, "res/sso").otherwise(_resource(seed, F.col("role"), F.col("id"), *key)).alias("resource"),
        (u(seed, "f", *key) < 0.03).alias("failed"), address(seed, F.col("id"), *key).alias("ip"), F.lit(0).alias("spoof"), F.lit(0.0).alias("recon"),
        F.xxhash64(F.lit("b"), *key).alias("nonce"), F.lit("normal").alias("label"), F.lit(None).cast("string").alias("campaign_id"), F.lit(None).cast("string").alias("confounder"), *_usual(),
    )


def confounded(spark, n, days, seed, per_kind: int) -> DataFrame:
    """Benign episodes that look like attacks: `per_kind` of each, spread over the days, of entities drawn by volume."""
    c, k, kind = F.col("c"), F.col("k"), F.col("confounder")
    plan = spark.range(len(CONFOUNDERS) * per_kind).select(F.col("id").alias("c"), F.element_at(F.array(*map(F.lit, CONFOUNDERS)), (F.col("id") % len(CONFOUNDERS) + 1).cast("int")).alias("confounder"))
    x = lambda name, *more: u(seed, "cf", name, c, *more)
    between = lambda lo, hi, at: lo + (hi - lo) * at
    start = START + ((3 + (days - 6) * (F.floor(c / len(CONFOUNDERS)) + x("s")) / per_kind) * 86400).cast("long")
    crowd = kind.isin("shared_jump_host", "office_nat", "project_onboarding")
    size = (
        F.when(kind == "business_travel", between(8, 24, x("z")))
        .when(kind == "password_reset_storm", between(6, 15, x("z")))
        .when(kind == "cert_retry_loop", between(20, 70, x("z")))
        .when(kind.isin("os_patch", "device_refresh"), between(8, 30, x("z")))
        .when(kind.isin("oncall_rotation", "maintenance_window"), between(12, 40, x("z")))
        .when(kind == "project_onboarding", between(60, 140, x("z")))
        .when(kind == "ci_automation_burst", between(60, 200, x("z")))
        .when(crowd, between(40, 120, x("z")))
        .otherwise(between(10, 40, x("z")))
    ).cast("int")
    every = volumes(spark, seed, n)
    plan = draw_by_weight(plan.withColumn("start", start), u(seed, "vol", "cf", c), every, "id", "rate", "victim")
    plan = plan.join(every.select(F.col("id").alias("victim"), "role"), "victim")
    # A project's first two thirds are the victim's own, the rest that of members of its team; a crowd is drawn from all.
    e = plan.withColumn("k", F.explode(F.sequence(F.lit(1), size))).withColumn("who", F.floor(k / 3))
    own = ~crowd | ((kind == "project_onboarding") & (k % 3 != 0))
    team = draw_by_weight(e.where((kind == "project_onboarding") & ~own), x("who", F.col("who")), every, "id", "rate", "id", ("role",))
    e = e.where((kind != "project_onboarding") | own).withColumn("id", F.when(own, F.col("victim")).otherwise(F.floor(x("who", F.col("who")) * n)).cast("long")).unionByName(team).drop("role", "who")
    night = F.col("start") - F.pmod(F.col("start"), F.lit(86400))
    sec = (
        F.when(kind == "business_travel", F.col("start") + 36000 + F.floor(x("d", k) * 4) * 86400 + x("t", k) * 43200)
        .when(kind == "password_reset_storm", F.col("start") + x("t", k) * 1500)
        .when(kind == "cert_retry_loop", F.col("start") + k * between(90, 240, x("p")))
        .when(kind.isin("os_patch", "device_refresh"), F.col("start") + F.floor(x("d", k) * 7) * 86400 + x("t", k) * 50400)
        .when(kind.isin("oncall_rotation", "maintenance_window"), night + F.floor(x("d", k) * 6) * 86400 + between(1800, 18000, x("t", k)))
        .when(kind == "project_onboarding", night + F.floor(between(-2, 12, x("d", k))) * 86400 + between(28800, 68400, x("t", k)))
        .when(kind == "ci_automation_burst", F.col("start") + k * between(12, 72, x("p")))
        .when(crowd, F.col("start") + x("t", k) * 36000)
        .otherwise(F.col("start") + x("t", k) * 4 * 86400)
    ).cast("long")
    e = e.withColumn("sec", sec).join(entities(spark, n, seed), "id")
    far = F.pmod(F.col("city") + 5 + F.floor(x("far") * 8), F.lit(len(CITIES))).cast("int")
    shared = F.when(kind == "shared_jump_host", F.xxhash64(F.lit("cloud"), F.lit(-1), F.floor(x("ip") * POOLS["cloud"]).cast("int"))).otherwise(F.xxhash64(F.lit("office"), F.floor(x("ip") * len(CITIES)).cast("int"), F.lit(0)))
    retry = kind.isin("password_reset_storm", "cert_retry_loop")
    new = F.concat(F.lit("res/"), F.pmod(F.xxhash64(F.lit("project"), c, F.floor(x("r", k) * 5).cast("int")), F.lit(RESOURCES)).cast("string"))
    return e.select(
        "id", "entity_id", "entity_type", "role", F.when(kind == "business_travel", far).otherwise(F.col("city")).alias("city"), "sec",
        F.when(kind == "password_reset_storm", "res/sso").when(kind == "project_onboarding", new).otherwise(_resource(seed, F.col("role"), F.col("id"), c, k)).alias("resource"),
        F.when(retry, True).when(crowd, False).otherwise(x("f", k) < 0.03).alias("failed"),
        F.when(kind.isin("shared_jump_host", "office_nat"), shared).otherwise(address(seed, F.col("id"), "cf", c, k)).alias("ip"),
        F.when(kind == "device_refresh", 4).otherwise(0).alias("spoof"), F.lit(0.0).alias("recon"),
        F.xxhash64(F.lit("c"), c, k).alias("nonce"), F.lit("normal").alias("label"), F.lit(None).cast("string").alias("campaign_id"), kind.alias("confounder"),
        F.when(kind == "cert_retry_loop", "certificate").when(kind == "credential_rotation", F.when(x("m") < 0.5, "certificate").otherwise("passkey")).alias("method"),
        F.when(retry, 1).when(kind == "ci_automation_burst", between(8, 20, x("nc", k)).cast("int")).alias("commands"),
        F.when(kind == "ci_automation_burst", between(2.0, 8.0, x("du", k))).otherwise(1.0).alias("stretch"),
    )


def campaigns_of(spark, n, days, seed, per_kind: int) -> DataFrame:
    """One row for each planned campaign: its kind, its victim (drawn by volume) and its start (one in each of per_kind equal parts of the time)."""
    c = spark.range(len(KINDS) * per_kind).select(F.col("id").alias("c"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % len(KINDS) + 1).cast("int")).alias("kind"))
    long = F.col("kind").isin("low_and_slow", INSIDER)
    share = (F.floor(F.col("c") / len(KINDS)) + u(seed, "s", F.col("c"))) / per_kind
    start = START + (F.when(long, 7 + (days - 7) * 0.4 * share).otherwise(7 + (days - 8) * share) * 86400).cast("long")
    drawn = draw_by_weight(c, u(seed, "vol", "v", F.col("c")), volumes(spark, seed, n), "id", "rate", "victim")
    return drawn.select("c", "kind", "victim", start.alias("start"), F.concat("kind", F.lit("-"), F.col("c").cast("string")).alias("campaign_id"))


def attacks(spark, n, days, seed, delta: float, per_kind: int) -> DataFrame:
    pop = entities(spark, n, seed)
    c, k = F.col("c"), F.col("k")
    plan = campaigns_of(spark, n, days, seed, per_kind)
    long_days = lerp(28, 14, delta)
    size = (
        F.when(F.col("kind") == "brute_force", 25 + 64 * u(seed, "z", c))
        .when(F.col("kind") == "credential_stuffing", 40 + 120 * u(seed, "z", c))
        .when(F.col("kind") == "impossible_travel", 2 + 4 * u(seed, "z", c))
        .when(F.col("kind") == "lateral_movement", lerp(22, 7, delta))
        .when(F.col("kind") == "device_spoofing", 6 + 18 * u(seed, "z", c))
        .when(F.col("kind") == "low_and_slow", long_days * lerp(4, 1.4, delta))
        .otherwise(long_days * 0.8)
    ).cast("int")
    e = plan.withColumn("k", F.explode(F.sequence(F.lit(1), size))).withColumn("x", u(seed, "x", c, F.col("k")))
    kind = F.col("kind")
    step = (
        F.when(kind == "brute_force", k * 60 / lerp(60, 3, delta))
        .when(kind == "credential_stuffing", F.col("x") * lerp(1.5, 9, delta) * 3600)
        .when(kind == "impossible_travel", F.col("x") * 5400)
        .when(kind == "low_and_slow", F.floor(F.col("x") * long_days) * 86400 + 1800 + u(seed, "y", c, k) * 18000 - F.pmod(F.col("start"), F.lit(86400)))
        .when(kind == INSIDER, F.floor(F.col("x") * long_days) * 86400 + 32400 + u(seed, "y", c, k) * 28800 - F.pmod(F.col("start"), F.lit(86400)))
        .otherwise(F.col("x") * 3 * 3600)
    )
    who = F.when(kind == "credential_stuffing", F.floor(u(seed, "w", c, F.floor(k / 3)) * n)).otherwise(F.col("victim"))
    e = e.withColumn("id", who.cast("long")).withColumn("sec", (F.col("start") + step).cast("long")).join(pop, "id")
    own = kind.isin("device_spoofing", INSIDER)
    ip = F.when(kind == "credential_stuffing", F.floor(u(seed, "ips", c, k) * lerp(1, 4, delta))).otherwise(F.lit(0))
    # Most attack traffic comes from addresses that benign traffic uses, as often as it uses them.
    e = draw_by_weight(e.withColumn("_ip", ip), u(seed, "vol", "reg", c, F.col("_ip")), volumes(spark, seed, n), "id", "rate", "_lender")
    ip = F.col("_ip")
    lent = address(seed, F.col("_lender"), "reg", c, ip)
    hostile = F.when(u(seed, "lent", c, ip) < REGISTRY_SHARE, lent).otherwise(F.xxhash64(F.lit("a"), c, ip))
    resource = (
        F.when(kind.isin("brute_force", "credential_stuffing"), "res/sso")
        .when(kind.isin("lateral_movement", "low_and_slow"), F.concat(F.lit("res/"), F.floor(u(seed, "lr", c, k) * RESOURCES).cast("string")))
        .when(kind == INSIDER, F.concat(F.lit("res/"), F.pmod(F.xxhash64("role", F.floor(u(seed, "ir", c, k) * 4).cast("int"), F.floor(c / 7)), F.lit(RESOURCES)).cast("string")))
        .otherwise(_resource(seed, F.col("role"), F.col("id"), c, k))
    )
    last = k == F.max(k).over(Window.partitionBy("c"))
    fail = F.when((kind == "brute_force") & last & (u(seed, "in", c) < BREAKS_IN), False).when(kind == "brute_force", u(seed, "ff", c, k) < 0.97).when(kind == "credential_stuffing", u(seed, "ff", c, k) > lerp(0.02, 0.18, delta)).otherwise(u(seed, "ff", c, k) < 0.03)
    far = F.pmod(F.col("city") + 5 + F.floor(u(seed, "far", c) * 8), F.lit(len(CITIES))).cast("int")
    return e.select(
        "id", "entity_id", "entity_type", "role", F.when(kind == "impossible_travel", far).otherwise(F.col("city")).alias("city"), "sec", resource.alias("resource"), fail.alias("failed"),
        F.when(own, address(seed, F.col("id"), "own", c, k)).otherwise(hostile).alias("ip"),
        F.when(kind == "device_spoofing", F.lit(max(1, round(lerp(4, 1, delta))))).otherwise(0).alias("spoof"), F.when(kind == "lateral_movement", lerp(0.55, 0.12, delta)).otherwise(0.0).alias("recon"),
        F.xxhash64(F.lit("a"), c, k).alias("nonce"), kind.alias("label"), "campaign_id", F.lit(None).cast("string").alias("confounder"), *_usual(),
    )


def emit(intents: DataFrame, seed: int) -> DataFrame:
    """The one step that turns intents of any kind into events; labels stay beside."""
    key = (F.col("nonce"),)
    # People have up to three devices and mostly use the first; each has its system, firmware, address and protocol.
    fleet = F.when(F.col("entity_type") == "user", 1 + F.floor(3 * u(seed, "fleet", F.col("id")))).otherwise(1)
    device = F.floor(fleet * F.pow(u(seed, "dev", *key), 2)).cast("int")
    part = lambda name, i: F.substring(F.sha2(F.concat_ws("|", F.lit(name), "id", device.cast("string"), F.when(F.col("spoof") > i, F.col("nonce") % 7).otherwise(0).cast("string")), 256), 1, 8)
    number = lambda name, i, most: F.pmod(F.xxhash64(part(name, i)), F.lit(most)).cast("string")
    version = lambda name, i: F.concat(F.lit(f"{name}-"), number(name, i, 5), F.lit(" "), number(name, i, 40), F.lit("."), number(name, i, 9))
    patched = lambda v: F.when(F.col("confounder") == "os_patch", bumped(v)).otherwise(v)
    at = lambda j: F.element_at(F.array(*[F.lit(c[j]) for c in CITIES]), F.col("city") + 1)
    n_cmd = F.coalesce("commands", F.when(F.col("failed"), 0).otherwise(poisson(F.lit(3.0), u(seed, "nc", *key), 12)))
    command = lambda i: F.when(u(seed, "rc", *key, i) < F.col("recon"), F.concat(F.lit("scan"), F.floor(6 * u(seed, "rk", *key, i)).cast("string"))).otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("role", F.floor(8 * F.pow(u(seed, "ck", *key, i), 2)).cast("int")), F.lit(40)).cast("string")))
    octets = F.concat_ws(".", *[(F.pmod(F.shiftright("ip", 8 * j), F.lit(223)) + 1).cast("int").cast("string") for j in range(4)])
    return intents.select(
        F.substring(F.sha2(F.concat_ws("|", "entity_id", F.col("sec").cast("string"), "resource", F.col("nonce").cast("string")), 256), 1, 20).alias("event_id"),
        "entity_id", "entity_type", "role", F.timestamp_micros(F.col("sec") * 1000000 + F.floor(u(seed, "us", *key) * 1000000)).alias("timestamp"), octets.alias("source_ip"),
        F.round(at(0) + 0.05 * normal(seed, "la", *key), 4).alias("geo_lat"), F.round(at(1) + 0.05 * normal(seed, "lo", *key), 4).alias("geo_lon"), at(2).alias("geo_country"),
        F.col("resource").alias("resource_accessed"), _pick(("file", "endpoint", "port", "device_function"), F.pmod(F.xxhash64("resource"), F.lit(4)) / 4).alias("resource_type"),
        F.when(F.col("method").isNotNull(), F.col("method")).when(u(seed, "am", *key) < 0.04, "certificate").when(F.col("entity_type") == "user", "password").otherwise("token").alias("auth_method"),
        F.when(F.col("failed"), "failure").otherwise("success").alias("auth_result"),
        F.round(F.greatest(F.lit(0.4), F.least(F.lit(86400.0), F.col("stretch") * F.exp(4 + normal(seed, "du", *key)))), 2).alias("session_duration"),
        F.transform(F.when(n_cmd > 0, F.sequence(F.lit(1), n_cmd)).otherwise(F.array().cast("array<int>")), command).alias("command_sequence"),
        F.concat(F.lit("d-"), F.col("id").cast("string"), F.lit("-"), device.cast("string")).alias("device_id"), patched(version("os", 0)).alias("device_os"), patched(version("fw", 2)).alias("device_firmware"), part("mac", 1).alias("device_mac"), part("pr", 3).alias("device_protocol"),
        "label", "campaign_id", "confounder",
    )


def generate(spark: SparkSession, seed: int = 1, n_entities: int = 200, days: int = 60, delta: float = 0.5, per_kind: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, labels, campaigns) under the contract's schemas."""
    intents = benign(spark, n_entities, days, seed).unionByName(attacks(spark, n_entities, days, seed, delta, per_kind)).unionByName(confounded(spark, n_entities, days, seed, per_kind))
    intents = intents.where((F.col("sec") >= START) & (F.col("sec") < START + days * 86400))
    full = emit(intents, seed).dropDuplicates(["event_id"])
    first = F.min("timestamp").over(Window.partitionBy("entity_id"))
    full = full.withColumn("is_cold_start", (F.unix_timestamp("timestamp") - F.unix_timestamp(first) < 3 * 86400) & (F.unix_timestamp(first) > START + 2 * 86400))
    kind = F.when(F.col("label") != "normal", F.col("label")).alias("campaign_type")
    labels = full.select("event_id", "label", "campaign_id", kind, "confounder", "is_cold_start")
    hit = full.where("campaign_id is not null").groupBy("campaign_id", F.col("label").alias("campaign_type")).agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("n_events"), F.min("entity_id").alias("e"), F.min("source_ip").alias("i"))
    level = F.when(F.col("campaign_type") == "credential_stuffing", "ip").when(F.col("campaign_type").isin("low_and_slow", INSIDER), "long").otherwise("entity")
    camps = hit.select("campaign_id", "campaign_type", level.alias("scope_level"), F.when(level == "ip", F.col("i")).otherwise(F.col("e")).alias("scope_key"), "start_ts", "end_ts", "n_events")
    return full.select(*EVENT_SCHEMA.names), labels, camps


def meta(events: DataFrame, labels: DataFrame, campaigns: DataFrame) -> dict[str, object]:
    """A log's size, span and shares."""
    e = events.agg(F.count("*").alias("n_events"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("source_ip").alias("n_addresses"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first().asDict()
    attack = F.col("label").isin(*ATTACK_TYPES)
    share = labels.agg(F.avg(attack.cast("int")).alias("prevalence"), F.sum((F.col("label") == INSIDER).cast("long")).alias("n_insider"), F.sum(F.col("confounder").isNotNull().cast("long")).alias("n_confounded"), F.avg(F.col("is_cold_start").cast("int")).alias("cold_share")).first().asDict()
    per = {r.campaign_type: r.n for r in campaigns.groupBy("campaign_type").agg(F.count("*").alias("n")).collect()}
    return {**e, **share, "campaigns": per}


def ensure_dataset(spark: SparkSession, folder: str, tag: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dataset of a tag, generated and written only if it isn't there."""
    if tag not in tags(spark, folder):
        write_tag(folder, tag, *generate(spark, **options))
    return read_tag(spark, folder, tag)
