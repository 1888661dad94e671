"""The 21 causal signals of an event: each reads only what happened strictly before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import bits, haversine_km
from vigil.operators.causal import first_seen, is_first, ordered, pairs_alive, prepare, prior, prior_totals, trailing_sum
from vigil.schema import BURST_FLOOR, BURST_MIN, COLD_MIN, COLD_N0, FAIL_WINDOW, GEO_CAP_KMH, GEO_GATE_KM, IP_WINDOW, LEVELS, LONG_WINDOW, NGRAM, OFFHOURS, SIGNALS
from vigil.sources.store import drop, store

E, IP = "entity_id", "source_ip"


def _zero(c):
    return F.coalesce(c, F.lit(0)).cast("double")


def history(ev: DataFrame) -> DataFrame:
    """Adds n (earlier events of the entity) and lam, the weight of its own history."""
    n = F.row_number().over(ordered(E)) - 1
    return ev.withColumn("n", n).withColumn("lam", F.col("n") / (F.col("n") + COLD_N0))


def geo_velocity(ev: DataFrame) -> DataFrame:
    w = ordered(E)
    lat, lon, sec = (F.lag(c).over(w) for c in ("geo_lat", "geo_lon", "sec"))
    km = haversine_km(lat, lon, F.col("geo_lat"), F.col("geo_lon"))
    hours = F.greatest((F.col("sec") - sec) / 3600, F.lit(1 / 60))
    return ev.withColumn("geo_velocity", _zero(F.when(km > GEO_GATE_KM, F.least(km / hours, F.lit(GEO_CAP_KMH)))))


def fail_rates(ev: DataFrame, seconds: int = FAIL_WINDOW, suffix: str = "") -> DataFrame:
    failed = (F.col("auth_result") == "failure").cast("int")
    return ev.withColumn("fail_rate_entity" + suffix, _zero(trailing_sum(failed, [E], seconds)))


def burst_ratio(ev: DataFrame, seconds: int = FAIL_WINDOW, suffix: str = "") -> DataFrame:
    """Needs n."""
    recent = trailing_sum(F.lit(1), [E], seconds)
    span = F.greatest(F.col("sec") - F.min("sec").over(prior(E)), F.lit(1))
    expected = F.greatest(F.col("n") * seconds / span, F.lit(BURST_FLOOR))
    return ev.withColumn("burst_ratio" + suffix, F.when(F.col("n") >= BURST_MIN, recent / expected).otherwise(0.0))


def ip_signals(ev: DataFrame, fail_seconds: int = FAIL_WINDOW, ip_seconds: int = IP_WINDOW, suffix: str = "") -> DataFrame:
    """fail_rate_ip, ip_entity_fanout and ip_fail_ratio.

    The entities on an address in the last while are its rows in reach, less those whose entity came
    again before now: two running sums, so no row holds a set.
    """
    failed = (F.col("auth_result") == "failure").cast("int")
    fails, tries = trailing_sum(failed, [IP], fail_seconds), trailing_sum(F.lit(1), [IP], ip_seconds)
    ev = ev.withColumns({"_last": F.lag("sec").over(ordered(IP, E)), "_next": F.lead("sec").over(ordered(IP, E))})
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("sec")) <= ip_seconds, F.lit(False))
    return ev.withColumns(
        {
            "fail_rate_ip" + suffix: _zero(fails),
            "ip_entity_fanout" + suffix: _zero(tries) - pairs_alive(near("_last"), near("_next"), [IP], ip_seconds),
            "ip_fail_ratio" + suffix: F.when(tries >= 5, fails / tries).otherwise(0.0),
        }
    ).drop("_last", "_next")


def fingerprint_mismatch(ev: DataFrame) -> DataFrame:
    """Device properties that differ from the entity's most frequent earlier set on that device (ties: the first seen)."""
    fields = ["device_os", "device_mac", "device_firmware", "device_protocol"]
    here = [E, "device_id"]
    ev = ev.withColumn("_at", F.row_number().over(ordered(*here)))
    ev = ev.withColumn("_count", F.row_number().over(ordered(*here, *fields))).withColumn("_first", F.min("_at").over(Window.partitionBy(*here, *fields)))
    usual = F.max(F.struct("_count", (-F.col("_first")).alias("_since"), *fields)).over(prior(*here))
    differs = sum((F.when(~usual[f].eqNullSafe(F.col(f)), 1).otherwise(0) for f in fields), F.lit(0))
    return ev.withColumn("fingerprint_mismatch", F.when(usual.isNull(), 0.0).otherwise(differs.cast("double"))).drop("_at", "_count", "_first")


HOUR_SETS = {"_type_n": ["entity_type"], "_type_hour": ["entity_type", "hour"]}
RESOURCE_SETS = {"_role_n": ["role"], "_role_d": ["role"], "_role_res": ["role", "resource_accessed"]}


def populations(ev: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds earlier counts of an event's type and role, by name. _role_d needs _new_role."""
    every = HOUR_SETS | RESOURCE_SETS
    sets = {n: (every[n], F.col("_new_role") if n == "_role_d" else F.lit(1)) for n in names}
    counts = prior_totals(ev, sets, ["event_id"]).select(F.col("event_id").alias("_id"), *names)
    return ev.join(counts, ev["event_id"] == counts["_id"]).drop("_id")


def with_new_role(ev: DataFrame) -> DataFrame:
    return is_first(ev, "_new_role", ["role", "resource_accessed"]).withColumn("_new_role", F.col("_new_role").cast("int"))


def hour_surprisal(ev: DataFrame) -> DataFrame:
    """Needs n and lam; adds p_hour too."""
    if "_type_n" not in ev.columns:
        ev = populations(ev, tuple(HOUR_SETS))
    own = F.row_number().over(ordered(E, "hour")) - 1
    p_e = F.when(F.col("n") > 0, (own + 0.5) / (F.col("n") + 12)).otherwise(1 / 24)
    p_t = F.when(F.col("_type_n") > 0, (F.col("_type_hour") + 1) / (F.col("_type_n") + 24)).otherwise(1 / 24)
    ev = ev.withColumn("p_hour", F.col("lam") * p_e + (1 - F.col("lam")) * p_t)
    return ev.withColumn("hour_surprisal", bits(F.col("p_hour"))).drop(*HOUR_SETS)


def novelties(ev: DataFrame) -> DataFrame:
    """Needs n and lam. Where an entity has no history, lam is 0 and nothing is new."""
    new = {"ip_novelty": "source_ip", "country_novelty": "geo_country", "auth_method_novelty": "auth_method"}
    return ev.withColumns({name: F.when(first_seen(E, c), F.col("lam")).otherwise(0.0) for name, c in new.items()})


def resource_signals(ev: DataFrame) -> DataFrame:
    """peer_incongruence and resource_surprisal. Needs n and lam."""
    res = "resource_accessed"
    if "_role_n" not in ev.columns:
        ev = populations(with_new_role(ev), tuple(RESOURCE_SETS))
    p_role = F.when(F.col("_role_n") > 0, (F.col("_role_res") + 0.5) / (F.col("_role_n") + 0.5 * (F.col("_role_d") + 1))).otherwise(1e-3)
    own = F.row_number().over(ordered(E, res)) - 1
    p_e = F.when(F.col("n") > 0, (own + 0.5) / (F.col("n") + 32)).otherwise(1e-3)
    ev = ev.withColumn("_p_role", p_role).withColumn("peer_incongruence", bits(F.col("_p_role")))
    p = F.col("lam") * p_e + (1 - F.col("lam")) * F.col("_p_role")
    return ev.withColumn("resource_surprisal", F.greatest(F.lit(0.0), bits(p) - F.col("peer_incongruence"))).drop("_new_role", "_p_role", *RESOURCE_SETS)


def deviations(ev: DataFrame) -> DataFrame:
    """duration_z and ncmd_z. Needs n."""

    def z(x, floor):
        mean, var = F.avg(x).over(prior(E)), F.var_samp(x).over(prior(E))
        sd = F.greatest(F.sqrt(F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(1e-6))), F.lit(floor))
        return F.when(F.col("n") >= 5, F.abs(x - mean) / sd).otherwise(0.0)

    return ev.withColumns({"duration_z": z(F.log1p("session_duration"), 0.15), "ncmd_z": z(F.col("ncmd").cast("double"), 0.75)})


def long_window(ev: DataFrame, seconds: int = LONG_WINDOW) -> DataFrame:
    """new_resource_rate_7d, offhours_rate_7d and breadth_ratio_7d. Needs p_hour.

    A resource is new from its first access on for `seconds`, and breadth until its second.
    """
    here = ordered(E, "resource_accessed")
    ev = ev.withColumns({"_nth": F.row_number().over(here), "_last": F.lag("sec").over(here), "_next": F.lead("sec").over(here)})
    second = (F.col("_nth") == 2) & (F.col("sec") - F.col("_last") <= seconds)
    first = (F.col("_nth") == 1) & F.coalesce(F.col("_next") - F.col("sec") <= seconds, F.lit(False))
    new = trailing_sum((F.col("_nth") == 1).cast("int"), [E], seconds)
    ev = ev.withColumns({"_new": _zero(new), "_twice": pairs_alive(second, first, [E], seconds), "_off": trailing_sum((F.col("p_hour") < OFFHOURS).cast("int"), [E], seconds)})
    return ev.withColumns(
        {
            "new_resource_rate_7d": F.col("_new"),
            "offhours_rate_7d": _zero(F.col("_off")),
            "breadth_ratio_7d": F.when(F.col("_new") > 0, (F.col("_new") - F.col("_twice")) / F.col("_new")).otherwise(0.0),
        }
    ).drop("_nth", "_last", "_next", "_new", "_twice", "_off")


def corroboration(ev: DataFrame, seconds: int = LONG_WINDOW, base: DataFrame | None = None) -> DataFrame:
    """uncorroborated_new_edges_7d and corroboration_7d.

    A new edge (first access of an entity to a resource) is corroborated once two peers of the role
    have had their own first access within `seconds` of it. In the order of a resource's first
    accesses by a role, the edges within reach begin at a place that a range frame counts, so
    the second peer is found by an equi-join on that place rather than by joining all pairs. The
    moment of corroboration is put among the entity's own events, so that counts are running sums.
    """
    res, at = "resource_accessed", ["timestamp", "event_id"]
    src = ev if base is None else base
    firsts = src.groupBy(E, res).agg(F.min(F.struct(*at, "role", "sec")).alias("_at"))
    edges = firsts.select(E, res, "_at.role", "_at.sec", "_at.timestamp", "_at.event_id")
    pool = ["role", res]
    far = Window.partitionBy(*pool).orderBy("sec").rangeBetween(Window.unboundedPreceding, -seconds - 1)
    edges = edges.withColumn("_place", F.row_number().over(ordered(*pool))).withColumn("_out", F.count("*").over(far))
    edges = edges.withColumn("_second", F.when(F.col("_place") <= F.col("_out") + 2, F.col("_out") + 3).otherwise(F.col("_out") + 2))
    edges = store(edges)
    peer = edges.select(*[F.col(c).alias(f"_p_{c}") for c in (*pool, "sec", *at)], F.col("_place").alias("_p_place"))
    on = [edges[c].eqNullSafe(peer[f"_p_{c}"]) for c in pool] + [edges["_second"] == peer["_p_place"]]
    now, then = F.struct(*at), F.struct(F.col("_p_timestamp").alias("timestamp"), F.col("_p_event_id").alias("event_id"))
    near = F.coalesce(F.col("_p_sec") <= F.col("sec") + seconds, F.lit(False))
    known = store(edges.join(peer, on, "left").select(E, "event_id", F.when(near, F.greatest(now, then)).alias("_met")))
    ev = ev.join(known.select(F.col("event_id").alias("_edge"), F.lit(True).alias("_new"), F.col("_met").isNotNull().alias("_known")), ev["event_id"] == F.col("_edge"), "left").drop("_edge")
    ev = ev.withColumns({"_new": _zero(trailing_sum(F.coalesce(F.col("_new"), F.lit(False)).cast("int"), [E], seconds)), "_mark": F.lit(0)})
    met = known.where("_met IS NOT NULL").select(E, "_met.timestamp", "_met.event_id", F.lit(1).alias("_mark"))
    both = ev.unionByName(met, allowMissingColumns=True)
    # Its own event comes before a mark of the same moment, so an edge counts from the next event on.
    begun = F.sum("_mark").over(Window.partitionBy(E).orderBy(*at, "_mark").rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_begun", F.coalesce(begun, F.lit(0))).where("_mark = 0")
    gone = F.sum(F.col("_known").cast("int")).over(Window.partitionBy(E).orderBy("sec").rangeBetween(Window.unboundedPreceding, -seconds - 1))
    both = both.withColumn("corroboration_7d", (F.col("_begun") - F.coalesce(gone, F.lit(0))).cast("double"))
    return both.withColumn("uncorroborated_new_edges_7d", F.col("_new") - F.col("corroboration_7d")).drop("_new", "_known", "_mark", "_begun")


def cmd_surprisal(ev: DataFrame) -> DataFrame:
    """How far an event's mean bits per token are from the entity's own history of them.

    Bigrams of the entity and of its type and single tokens are mixed. An event is scored before its own
    tokens count; the history holds the bits after they count. Tokens are summed by event and stored once
    with the entity's own counts; all populations are counted in one pass.
    """
    parts = [F.format_string("hr:%02d", F.col("hour")), F.concat(F.lit("res:"), "resource_accessed"), F.concat(F.lit("auth:"), "auth_method"), F.when(F.col("auth_result") == "success", "ok").otherwise("fail")]
    commands = F.transform(F.coalesce("command_sequence", F.array().cast("array<string>")), lambda c: F.concat(F.lit("cmd:"), c))
    every = F.concat(F.array(*parts), commands)
    before = F.transform(every, lambda t, i: F.struct(F.when(i > 0, F.get(every, i - 1)).otherwise("<BOS>").alias("prev"), t.alias("tok")))
    tokens = ev.select("event_id", E, "entity_type", "timestamp", "sec", F.posexplode(before).alias("pos", "t")).select("event_id", E, "entity_type", "timestamp", "sec", "pos", F.coalesce("t.prev", F.lit("<BOS>")).alias("prev"), "t.tok")
    event = ["event_id", E, "entity_type", "timestamp", "sec"]
    grams = tokens.repartition(E, "prev").groupBy(*event, "prev", "tok").agg(F.count("*").alias("own"), F.min("pos").alias("gram"))  # the windows below need no other move
    held = ["own"]
    for name, keys in (("e_bi", [E, "prev", "tok"]), ("e_ctx", [E, "prev"])):
        upto = F.sum("own").over(Window.partitionBy(*keys).orderBy("timestamp", "event_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        grams = grams.withColumn(name + "_own", F.sum("own").over(Window.partitionBy(*keys, "timestamp", "event_id"))).withColumn(name, upto - F.col(name + "_own"))
        held += [name, name + "_own"]
    own = F.col("own")
    sets = {"g_bi": (["entity_type", "prev", "tok"], own), "g_ctx": (["entity_type", "prev"], own), "uni": (["tok"], own), "all": ([], own)}
    grams = store(grams)
    joined = prior_totals(grams, sets, ["event_id", "gram"], tuple(held))
    drop(grams)  # the sums are stored with all that is carried

    def p(after: bool):
        c = {k: F.col(k) + F.col(k + "_own") if after else F.col(k) for k in (*sets, "e_bi", "e_ctx")}
        part = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)
        return bits(NGRAM["entity"] * part("e_bi", "e_ctx") + NGRAM["group"] * part("g_bi", "g_ctx") + NGRAM["unigram"] * part("uni", "all") + NGRAM["floor"], 1e-12)

    mean_of = lambda c: F.sum(c * F.col("own")) / F.sum("own")
    scored = joined.groupBy("event_id").agg(mean_of(p(False)).alias("_bits"), mean_of(p(True)).alias("_after"))
    ev = ev.join(scored, "event_id", "left")
    mean, var, seen = F.avg("_after").over(prior(E)), F.var_samp("_after").over(prior(E)), F.count("_after").over(prior(E))
    sd = F.greatest(F.sqrt(F.greatest(var, F.lit(1e-6))), F.lit(0.5))
    return ev.withColumn("cmd_surprisal", F.when(seen >= 8, (F.col("_bits") - mean) / sd).otherwise(0.0)).drop("_bits", "_after")


def signal_frame(log: DataFrame, keep: tuple[str, ...] = (), levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """event_id, the 21 signals, _n_history and _cold_start; keep: further columns of the log. levels: only their signals.

    The prepared events are stored once, and all that needs other events reads them from there, so the
    plan grows with the number of steps and no step repeats those before it.
    """
    entity, long = "entity" in levels, "long" in levels
    base = history(prepare(log))
    base = store(with_new_role(base) if entity else base)
    sets = (*(HOUR_SETS if entity or long else ()), *(RESOURCE_SETS if entity else ()))
    ev = populations(base, sets) if sets else base
    ev = ev.repartition(E)  # windows of the entity and of the entity and more need no other move
    for step in (geo_velocity, fail_rates, burst_ratio, fingerprint_mismatch, novelties, deviations) if entity else ():
        ev = step(ev)
    for step, wanted in ((hour_surprisal, bool(sets)), (long_window, long), (resource_signals, entity)):
        ev = step(ev) if wanted else ev
    ev = store(ip_signals(ev) if "ip" in levels else ev)
    ev = corroboration(ev, base=base) if long else ev
    drop(base)
    ev = cmd_surprisal(ev) if entity else ev
    n = F.col("n").cast("double")
    return ev.select("event_id", *keep, *[s.name for s in SIGNALS if s.level in levels], n.alias("_n_history"), (F.col("n") < COLD_MIN).cast("double").alias("_cold_start"))
