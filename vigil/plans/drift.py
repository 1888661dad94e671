"""Does a baseline that keeps learning get poisoned? Matched worlds, four ways to learn, and what each absorbs.

Each pair has an entity that changes its role (A: its team takes up the same resources) and an attacker that
spreads at the same pace (B: alone, over resources its role doesn't use), beside a control (C) and peers. What
an entity sees of others comes from counts over all events; its own baseline is folded over its events once
for each policy, so that only the decision to learn differs. A resource is new as long as the baseline has
not learned it, so a frozen baseline finds the same ones new again and again.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.columns import bits
from vigil.functions.ranks import bootstrap_mean, quantiles, wilcoxon
from vigil.operators import metrics as M
from vigil.operators import signals as S
from vigil.operators.causal import prepare
from vigil.schema import COLD_N0, EVENT_SCHEMA, LONG_WINDOW
from vigil.sources.generate import START, u
from vigil.sources.store import store

POLICIES = ("all", "unflagged", "quarantine", "none")
#: A jump is more than SPIKE times the usual rate of new resources, ALONE of which nobody else took up;
#: MEMORY is how fast the usual rate follows; the score's weights; the world's days and sizes.
SPIKE, ALONE, MEMORY = 2.5, 2.0, 0.02
WEIGHTS = {"resource_surprisal": 1.0, "new_resource_rate_7d": 0.6, "uncorroborated_new_edges_7d": 0.9, "corroboration_7d": -0.7}
DAYS, DRIFT_DAY, DRIFT_END, PER_DAY, PEERS = 60, 30, 44, 6, 4
TEAMS = ("engineering", "finance", "hr", "sales", "operations")


def world(spark: SparkSession, seeds: tuple[int, ...] = (1, 2, 3, 4, 5), pairs: int = 6) -> DataFrame:
    """Events of the matched pairs of each seed, in the log's schema, with seed. Entities are A, B, C or peer, seed and pair."""
    seed, p, d, k = F.col("seed"), F.col("pair"), F.col("day"), F.col("k")
    base = spark.range(len(seeds) * pairs).select(F.element_at(F.array(*map(F.lit, seeds)), (F.floor(F.col("id") / pairs) + 1).cast("int")).alias("seed"), (F.col("id") % pairs).cast("int").alias("pair"))
    base = base.withColumn("role", F.element_at(F.array(*map(F.lit, TEAMS)), (p % len(TEAMS) + 1).cast("int")))
    tag = F.concat(seed.cast("string"), F.format_string("-%03d", p))
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(i).alias("peer")) for n, i in [("A", 0), ("B", 0), ("C", 0), *[("peer", i) for i in range(PEERS)]]])
    who = base.withColumn("x", F.explode(kinds)).select("seed", "pair", "role", "x.kind", "x.peer", F.concat(F.col("x.kind"), tag, F.when(F.col("x.kind") == "peer", F.format_string("_%d", "x.peer")).otherwise("")).alias("entity_id"))
    days = who.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))))
    draw = lambda name, *more: u(0, name, seed, F.col("entity_id"), d, *more)
    numbered = lambda prefix, of, i: F.concat(of, F.lit(f"/{prefix}"), F.format_string("%02d", i.cast("int")))
    other = F.element_at(F.array(*map(F.lit, TEAMS)), (F.floor(draw("team", k) * len(TEAMS)) + 1).cast("int"))
    usual = numbered("res", F.col("role"), F.floor(draw("res", k) * 8))
    strange = F.when(draw("kind", k) < 0.5, numbered("res", other, F.floor(draw("odd", k) * 12))).otherwise(numbered("rare", other, F.floor(draw("odd", k) * 12)))
    churn = (draw("churn", k) < 0.06) & (F.col("kind") != "C")
    plain = days.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PER_DAY - 1)))).withColumn("resource", F.when(churn, strange).otherwise(usual))
    step = F.floor((d - DRIFT_DAY) / 2)
    new = lambda i: F.when(i < 4, numbered("res", F.col("role"), i + 8)).otherwise(numbered("proj", F.col("role"), i - 4))
    settled = F.floor(draw("back", k) * ((DRIFT_END - DRIFT_DAY) // 2))
    target = F.when(F.col("kind") == "A", new(F.when(d < DRIFT_END, step).otherwise(settled))).otherwise(numbered("rare", F.col("role"), F.least(step, F.lit(19)) % 12))
    moved = days.where(F.col("kind").isin("A", "B") & (d >= DRIFT_DAY)).withColumn("k", F.explode(F.array(F.lit(100), F.lit(101)))).withColumn("resource", target)
    team = who.where((F.col("kind") == "peer") & (F.col("peer") < 3)).withColumn("k", F.explode(F.sequence(F.lit(200), F.lit(219))))
    joined = team.withColumn("day", (DRIFT_DAY + 2 * (k - 200) + F.floor(u(0, "join", seed, F.col("entity_id"), k) * 9) - 4).cast("int")).where(F.col("day").between(0, DAYS - 1)).withColumn("resource", new(k - 200))
    every = plain.unionByName(moved).unionByName(joined)
    sec = START + d * 86400 + ((8 + 11 * draw("hour", k)) * 3600).cast("long")
    made = {
        "event_id": F.concat_ws("-", "entity_id", d.cast("string"), k.cast("string")),
        "entity_type": F.lit("user"),
        "timestamp": F.timestamp_seconds(sec),
        "source_ip": F.lit("10.0.0.1"),
        "geo_lat": F.lit(19.07),
        "geo_lon": F.lit(72.87),
        "geo_country": F.lit("IN"),
        "resource_accessed": F.col("resource"),
        "resource_type": F.lit("endpoint"),
        "auth_method": F.lit("password"),
        "auth_result": F.lit("success"),
        "session_duration": F.exp(5 + 0.5 * F.sqrt(-2 * F.log(draw("g1", k))) * F.cos(2 * F.pi() * draw("g2", k))),
        "command_sequence": F.array(F.lit("login"), F.lit("read")),
        "device_id": F.concat(F.lit("dev-"), "entity_id"),
        "device_os": F.lit("os 1"),
        "device_firmware": F.lit("n/a"),
        "device_mac": F.lit("aa:bb:cc:00:00:01"),
        "device_protocol": F.lit("https"),
    }
    return every.select("seed", *[(made[c] if c in made else F.col(c)).alias(c) for c in EVENT_SCHEMA.names])


def evidence(events: DataFrame) -> DataFrame:
    """seed, entity_id, event_id, timestamp, sec, day, resource, p_role, bits_role and met: when a second peer had taken up the resource, if within a week of the event.

    A seed is a world of its own: role and resource are named by it, so populations stay apart. A
    world's team is as large as its pairs make it, so the first accesses to a resource fit one row.
    """
    apart = lambda c: F.concat(F.col("seed").cast("string"), F.lit("|"), c).alias(c)
    ev = store(S.with_new_role(S.history(prepare(events.withColumns({"role": apart("role"), "resource_accessed": apart("resource_accessed")})))))
    firsts = ev.groupBy("role", "resource_accessed", "entity_id").agg(F.min("sec").alias("at"))
    firsts = firsts.groupBy("role", "resource_accessed").agg(F.sort_array(F.collect_list(F.struct("at", "entity_id"))).alias("firsts"))
    ev = S.populations(ev, tuple(S.RESOURCE_SETS)).join(firsts, ["role", "resource_accessed"])
    near = F.filter("firsts", lambda x: (x["entity_id"] != F.col("entity_id")) & (F.abs(x["at"] - F.col("sec")) <= LONG_WINDOW))
    p = F.when(F.col("_role_n") > 0, (F.col("_role_res") + 0.5) / (F.col("_role_n") + 0.5 * (F.col("_role_d") + 1))).otherwise(1e-3)
    ev = ev.withColumn("p_role", p).withColumn("met", F.get(near, F.lit(1))["at"])
    day = F.floor((F.col("sec") - START) / 86400).cast("int")
    return ev.select("seed", "entity_id", "event_id", "timestamp", "sec", day.alias("day"), F.col("resource_accessed").alias("resource"), "p_role", bits(F.col("p_role")).alias("bits_role"), "met")


def fold(frame: DataFrame, thetas: DataFrame, policies: tuple[str, ...] = POLICIES, active_from: int = DRIFT_DAY) -> DataFrame:
    """seed, entity_id, event_id, day, policy, score, n_new: an entity's events under each policy; thetas: seed, theta.

    What is observed always advances; the baseline takes in the events that the policy lets it learn from.
    """
    each = frame.join(F.broadcast(thetas), "seed").withColumn("policy", F.explode(F.array(*map(F.lit, policies))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "event_id"])
        policy, theta = pdf["policy"].iloc[0], pdf["theta"].iloc[0]
        n, known, usual, held, edges, out = 0, {}, None, False, deque(), []
        for e in pdf.itertuples(index=False):
            while edges and e.sec - edges[0][0] > LONG_WINDOW:
                edges.popleft()
            own = (known.get(e.resource, 0) + 0.5) / (n + 32) if n else 1e-3
            lam = n / (n + COLD_N0)
            surprisal = max(0.0, -math.log2(max(lam * own + (1 - lam) * e.p_role, 1e-9)) - e.bits_role)
            new, together = len(edges), sum(met < e.sec for _, _, met in edges)
            signals = {"resource_surprisal": surprisal, "new_resource_rate_7d": new, "uncorroborated_new_edges_7d": new - together, "corroboration_7d": together}
            score = sum(w * signals[k] for k, w in WEIGHTS.items())
            before, usual = usual, new if usual is None else (1 - MEMORY) * usual + MEMORY * new
            if e.day < active_from or policy == "all":
                learn = True
            elif policy == "none":
                learn = False
            elif policy == "unflagged":
                learn = score < theta
            else:
                jump = new > SPIKE * max(before or 0.0, 0.5)
                held = held or (jump and new - together >= ALONE)
                learn = not held and not jump and score < theta
            if e.resource not in known and (not edges or edges[-1][1] != e.resource):
                edges.append((e.sec, e.resource, math.inf if pd.isna(e.met) else e.met))
            if learn:
                n += 1
                known[e.resource] = known.get(e.resource, 0) + 1
            out.append((score, float(new)))
        return pdf[["seed", "entity_id", "event_id", "day", "policy"]].assign(score=[x[0] for x in out], n_new=[x[1] for x in out])

    kinds = dict(frame.dtypes)
    return each.groupBy("entity_id", "policy").applyInPandas(run, f"seed {kinds['seed']}, entity_id string, event_id string, day int, policy string, score double, n_new double")


def control(entity: Column) -> Column:
    return entity.startswith("C") | entity.startswith("peer")


def pair_of(entity: Column) -> Column:
    return F.regexp_extract(entity, r"(\d+)(?:_\d+)?$", 1).cast("int")


def pair_report(daily: DataFrame) -> DataFrame:
    """seed, pair, policy, theta, ratio_b, ratio_a, absorbed, fp_legit, t_adapt from daily highest scores (seed, entity_id, day, policy, score, theta).

    A ratio compares the last six days with the end of the ramp; below a half, the attacker was absorbed.
    t_adapt is the first day after the change from which A stays below theta for a week.
    """
    mean = lambda a, b: F.avg(F.when(F.col("day").between(a, b), F.col("score")))
    early, late = mean(DRIFT_END - 6, DRIFT_END), mean(DAYS - 6, DAYS)
    per = daily.where(F.col("entity_id").rlike("^[AB]")).groupBy("seed", "entity_id", "policy").agg((late / F.when(early > 1e-9, early)).alias("ratio"), F.sum(((F.col("day") >= DRIFT_DAY) & (F.col("score") >= F.col("theta"))).cast("long")).alias("n_over"), F.first("theta").alias("theta"))
    after = daily.where(F.col("entity_id").startswith("A") & (F.col("day") >= DRIFT_DAY)).withColumn("over", (F.col("score") >= F.col("theta")).cast("double"))
    quiet = M.quiet_runs(after, ["entity_id", "policy"], "over", 0.5, 7)
    a = per.where(F.col("entity_id").startswith("A")).join(quiet, ["entity_id", "policy"], "left")
    a = a.select("seed", pair_of(F.col("entity_id")).alias("pair"), "policy", "theta", F.col("ratio").alias("ratio_a"), F.col("n_over").alias("fp_legit"), (F.col("quiet_from") - DRIFT_DAY).alias("t_adapt"))
    b = per.where(F.col("entity_id").startswith("B")).select("seed", pair_of(F.col("entity_id")).alias("pair"), "policy", F.col("ratio").alias("ratio_b"), F.coalesce(F.col("ratio") < 0.5, F.lit(False)).alias("absorbed"))
    return a.join(b, ["seed", "pair", "policy"])


def summary(pairs: DataFrame, replicates: int = 2000) -> dict[str, DataFrame]:
    """Per policy the absorbed share with its interval, both ratios, false positives; ratios by policy; and the signed ranks of all against quarantine."""
    means = pairs.groupBy("policy").agg(F.avg(F.col("absorbed").cast("double")).alias("absorbed"), F.avg("ratio_b").alias("ratio_b"), F.avg("ratio_a").alias("ratio_a"), F.avg("fp_legit").alias("fp_legit"), F.count("*").alias("n_pairs"))
    keyed = pairs.withColumn("_key", F.concat_ws("|", "seed", "pair")).withColumn("_x", F.col("absorbed").cast("double"))
    ends = None
    for policy in POLICIES:
        row = bootstrap_mean(keyed.where(F.col("policy") == policy), "_x", replicates).select(F.lit(policy).alias("policy"), "low", "high")
        ends = row if ends is None else ends.unionByName(row)
    wide = M.pivot_mean(pairs.withColumn("_key", F.concat_ws("|", "seed", "pair")), "_key", "policy", "ratio_b", list(POLICIES))
    both = wide.where(F.col("all").isNotNull() & F.col("quarantine").isNotNull())
    return {"policies": means.join(ends, "policy"), "ratios": wide, "signed_ranks": wilcoxon(both, "all", "quarantine")}


def run_experiment(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(daily, pairs): the highest score of each day under each policy, and the report on pairs. theta is the 99th percentile of controls and peers before the change."""
    frame = store(evidence(events))
    seeds = frame.select("seed").distinct()
    probe = store(fold(frame, seeds.withColumn("theta", F.lit(float("inf"))), ("all",)))
    theta = quantiles(probe.where(control(F.col("entity_id")) & (F.col("day") < DRIFT_DAY)), "score", {"theta": 0.99}, ("seed",))
    theta = store(seeds.join(theta, "seed", "left").na.fill({"theta": 1.0}))
    scores = fold(frame, theta)
    daily = scores.groupBy("seed", "entity_id", "day", "policy").agg(F.max("score").alias("score")).join(F.broadcast(theta), "seed")
    kind = F.when(F.col("entity_id").startswith("A"), "legit_drift").when(F.col("entity_id").startswith("B"), "slow_attacker").when(F.col("entity_id").startswith("C"), "control")
    daily = store(daily.withColumn("scenario", kind).where("scenario IS NOT NULL"))
    return daily, pair_report(daily)
