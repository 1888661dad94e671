"""Fusion of signals into calibrated scores, per level.

Each signal becomes an empirical z-score against a reference of unflagged events. Stouffer's sum
(divided by what the signals' correlation makes its spread) and the mean of the two highest z compete;
mitigating evidence is taken off. The reference is a bounded sample (REFERENCE_ROWS events, the first
by a hash of their id), so its tables can be broadcast whatever the log's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.columns import norm_ppf_sql
from vigil.functions.isotonic import isotonic_fit, pooled
from vigil.functions.ranks import global_rank, quantiles, running
from vigil.schema import LEVELS, MITIGATION, REFERENCE_ROWS, TARGET_FPR, Z_RANGE, Signal, signals_of
from vigil.sources.store import store


#: A value that a thousandth of the rows have is looked up in a broadcast table, which so has at most HEAVY rows a column.
HEAVY = 1000


def empirical_z(df: DataFrame, columns: list[str], key: str = "event_id") -> DataFrame:
    """Adds z_<column>: the upper-tail rank among all rows of df as a normal quantile, within Z_RANGE. key tells rows apart.

    All columns are counted in one pass, by distinct value, so equal values share a z, and looked up in one join. Zeros and
    other values that very many rows have don't take part in it: they are few, so their z is broadcast.
    """
    df = store(df)
    value = lambda i, c: F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"))
    each = df.select(F.col(key).alias("_id"), F.explode(F.array(*[value(i, c) for i, c in enumerate(columns)])).alias("x")).select("_id", "x._c", "x._v")
    per = each.groupBy("_c", "_v").agg(F.count("*").alias("_n"))
    steps = running(per, "_v", {"_n": "_upto"}, ("_c",))
    rows = df.count()
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), (1 + F.col("_upto")) / F.lit(1 + rows)))
    steps = steps.withColumn("_p", p)
    z = F.greatest(F.lit(Z_RANGE[0]), F.least(F.lit(Z_RANGE[1]), -F.expr(norm_ppf_sql("_p"))))
    steps = store(steps.select(F.col("_c").alias("_of"), F.col("_v").alias("_at"), "_n", z.alias("_z")))
    on = (F.col("_c") == F.col("_of")) & F.col("_v").eqNullSafe(F.col("_at"))
    often = F.col("_n") * HEAVY >= rows
    met = each.join(F.broadcast(steps.where(often)), on, "left").select("_id", "_c", "_v", "_z")
    rest = met.where("_z IS NULL").drop("_z").join(steps.where(~often), on).select("_id", "_c", "_z")
    found = met.where("_z IS NOT NULL").select("_id", "_c", "_z").union(rest)
    wide = found.groupBy("_id").agg(*[F.max(F.when(F.col("_c") == i, F.col("_z"))).alias(f"z_{c}") for i, c in enumerate(columns)])
    return df.join(wide, df[key] == wide["_id"]).drop("_id")


def raw_column(z: dict[str, Column], weights: dict[str, float], scale: float, mitigators: list[Column] = ()) -> Column:
    """The fused score of z columns, as one expression."""
    names = list(weights)
    stouffer = sum((z[n] * w for n, w in weights.items()), F.lit(0.0)) / scale
    top = F.slice(F.sort_array(F.array(*[z[n] for n in names]), asc=False), 1, 2)
    pair = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    raw = F.greatest(stouffer, pair)
    return raw - MITIGATION * F.greatest(F.lit(0.0), *mitigators) if mitigators else raw


def rank_p(df: DataFrame, score: str, cohort: str, tie: str = "event_id") -> DataFrame:
    """Adds p = (1 + place from the top within the cohort, from 0) / (1 + n): uniform by construction.

    A cohort may hold most rows: its places are counted per bucket of the score.
    """
    sizes = df.groupBy(F.col(cohort).alias("_cohort")).agg(F.count("*").alias("_all"))
    ranked = global_rank(df, score, tie, "_place", (cohort,))
    joined = ranked.join(sizes, ranked[cohort].eqNullSafe(F.col("_cohort")))
    return joined.withColumn("p", F.col("_place") / (1 + F.col("_all"))).drop("_place", "_cohort", "_all")


#: Fixed value: what the order within a step of the isotonic map may add.
TIE = 1e-6


@dataclass
class Fusion:
    """A fitted level: references, weights, spread, threshold, calibration and cohort references."""

    level: str
    signals: list[Signal]
    mitigators: list[Signal]
    reference: dict[str, np.ndarray] = field(default_factory=dict)
    table: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)
    scale: float = 1.0
    theta: float = float("nan")
    cohorts: dict[str, np.ndarray] = field(default_factory=dict)
    raws: np.ndarray = field(default_factory=lambda: np.zeros(0))  # fused scores of the reference, in order
    steps: tuple[np.ndarray, np.ndarray] | None = None  # isotonic: raw, probability
    platt: tuple[float, float] | None = None

    def z(self, pdf: pd.DataFrame, signals: list[Signal]) -> np.ndarray:
        if not signals:
            return np.zeros((len(pdf), 1))
        return np.stack([self.table[len(r) - np.searchsorted(r, pdf[s.name].to_numpy(float), "left")] for s in signals for r in [self.reference[s.name]]], 1)

    def raw(self, pdf: pd.DataFrame) -> np.ndarray:
        z = self.z(pdf, self.signals)
        top = np.sort(z, 1)[:, -2:].mean(1)
        raw = np.maximum(z @ self.weights / self.scale, top)
        return raw - MITIGATION * np.maximum(self.z(pdf, self.mitigators), 0).max(1) if self.mitigators else raw

    def probability(self, raw: np.ndarray) -> np.ndarray:
        if self.steps is not None:
            # Plateaus are told apart by the score's place in the reference, so equal probabilities keep an order.
            place = np.interp(raw, self.raws, np.linspace(0, 1, len(self.raws))) if len(self.raws) else 0.0
            return np.interp(raw, *self.steps) + TIE * place
        if self.platt is not None:
            return 1 / (1 + np.exp(-(self.platt[0] * raw + self.platt[1])))
        return raw

    def tail_p(self, raw: np.ndarray, cohort: np.ndarray) -> np.ndarray:
        """Share of the cohort's unflagged reference at or above each score; small cohorts use all of it."""
        out = np.empty(len(raw))
        for c in pd.unique(cohort):
            r, rows = self.cohorts.get(c, self.cohorts["*"]), cohort == c
            out[rows] = (1 + len(r) - np.searchsorted(r, raw[rows], "left")) / (1 + len(r))
        return out


def _sample(df: DataFrame, columns: list[str], rows: int = REFERENCE_ROWS) -> pd.DataFrame:
    return df.orderBy(F.xxhash64("event_id"), "event_id").limit(rows).select(*columns).toPandas()


def _fit_reference(f: Fusion, ref: pd.DataFrame) -> None:
    n, normal = len(ref), NormalDist()
    tail = np.clip((1 + np.arange(n + 1)) / (1 + n), 1e-12, 1 - 1e-12)
    f.table = np.clip([-normal.inv_cdf(p) for p in tail], *Z_RANGE)
    f.reference = {s.name: np.sort(ref[s.name].to_numpy(float)) for s in [*f.signals, *f.mitigators]}
    z = f.z(ref, f.signals)
    prior = np.array([s.prior for s in f.signals]) if f.signals else np.ones(1)
    f.weights = prior / (1 + (z > 2.33).mean(0) / TARGET_FPR)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.atleast_2d(np.corrcoef(z, rowvar=False)))
    np.fill_diagonal(corr, 1.0)
    f.scale = float(np.sqrt(max(f.weights @ corr @ f.weights, 1e-12)))


def with_raw(df: DataFrame, f: Fusion, name: str = "raw") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(f)
    columns = df.columns

    def run(batches):
        for pdf in batches:
            pdf = pdf[columns]
            pdf[name] = held.value.raw(pdf)
            yield pdf

    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema] + [f"{name} double"])
    return df.mapInPandas(run, schema)


def with_tail_p(df: DataFrame, f: Fusion, name: str = "p") -> DataFrame:
    """Adds the share of the cohort's reference at or above each raw score; df has raw and entity_type."""
    held = df.sparkSession.sparkContext.broadcast(f)
    columns = df.columns

    def run(batches):
        for pdf in batches:
            pdf = pdf[columns]
            pdf[name] = held.value.tail_p(pdf["raw"].to_numpy(), pdf["entity_type"].to_numpy())
            yield pdf

    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema] + [f"{name} double"])
    return df.mapInPandas(run, schema)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The knots of the increasing step function nearest to y, each y counting n times (once by default)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = np.ones(len(x)) if n is None else np.asarray(n, float)
    ux, inverse = np.unique(x, return_inverse=True)
    lo, hi, w, total = pooled(ux, ux, np.bincount(inverse, n), np.bincount(inverse, y * n))
    return np.stack([lo, hi], 1).ravel(), np.repeat(total / w, 2)


def _calibrate(f: Fusion, raw: DataFrame, labels: DataFrame | None, attacks: tuple[str, ...]) -> None:
    """Labels enter here only: a monotone map of one variable. Fewer than 1000 positives: logistic; else isotonic over all rows."""
    if labels is None:
        return
    y = raw.join(labels.select("event_id", F.col("label").isin(*attacks).cast("double").alias("y")), "event_id", "left").select("event_id", "raw", F.coalesce("y", F.lit(0.0)).alias("label"))
    positives = y.agg(F.sum("label")).first()[0] or 0
    if positives < 1000:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        if positives == 0:
            return
        n = y.count()
        m = LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False).fit(VectorAssembler(inputCols=["raw"], outputCol="features").transform(y))
        f.platt = (float(m.coefficients[0]), float(m.intercept))
    else:
        f.steps = isotonic_fit(y, "raw", "label")


def fit(signals: DataFrame, labels: DataFrame | None = None, layers: tuple[str, ...] | None = None, without: tuple[str, ...] = (), rounds: int = 2, attacks: tuple[str, ...] | None = None, levels: tuple[str, ...] = LEVELS) -> dict[str, Fusion]:
    """Fits each of the levels that has signals on a signal frame with event_id and entity_type. Flagged (top 1 %) events leave the reference in each round."""
    from vigil.schema import ATTACK_TYPES

    out = {}
    for level in levels:
        take = lambda m: [s for s in signals_of(level, layers, m) if s.name not in without]  # noqa: E731,B023
        f = Fusion(level, take(False), take(True))
        if not f.signals:
            continue  # nothing is left of the level
        columns = [s.name for s in [*f.signals, *f.mitigators]]
        base = signals.select("event_id", "entity_type", *columns)
        kept = base
        for _ in range(rounds):
            _fit_reference(f, _sample(kept, columns))
            scored = store(with_raw(base, f))
            cut = quantiles(scored, "raw", {"cut": 1 - TARGET_FPR}).first()[0]
            below = scored.where(F.col("raw") < cut)
            kept = base if below.isEmpty() else below.select(*base.columns)  # one score for all flags nobody
        scored = store(with_raw(base, f))
        f.theta = float(quantiles(scored, "raw", {"cut": 1 - TARGET_FPR}).first()[0])
        ref = _sample(scored if below.isEmpty() else below, ["raw", "entity_type"])
        f.raws = np.sort(ref["raw"].to_numpy())
        f.cohorts = {"*": np.sort(ref["raw"].to_numpy())} | {c: np.sort(g["raw"].to_numpy()) for c, g in ref.groupby("entity_type") if len(g) >= 200}
        _calibrate(f, scored, labels, attacks or ATTACK_TYPES)
        out[level] = f
    return out


def score(signals: DataFrame, fusions: dict[str, Fusion]) -> DataFrame:
    """signals with, per level, raw_<level>, cal_<level>, p_train_<level>; and score (highest probability) and band (highest of the levels')."""
    held = signals.sparkSession.sparkContext.broadcast(fusions)
    columns = signals.columns
    levels = list(fusions)

    def run(batches):
        for pdf in batches:
            pdf = pdf[columns]
            rank = np.zeros(len(pdf), int)
            for lv in levels:
                f = held.value[lv]
                raw = f.raw(pdf)
                pdf[f"raw_{lv}"], pdf[f"cal_{lv}"] = raw, f.probability(raw)
                pdf[f"p_train_{lv}"] = f.tail_p(raw, pdf["entity_type"].to_numpy())
                rank = np.maximum(rank, np.where(raw >= f.theta, 2, np.where(raw >= 0.5 * f.theta, 1, 0)))
            pdf["score"] = pdf[[f"cal_{lv}" for lv in levels]].max(axis=1)
            pdf["band"] = np.array(["LOW", "MEDIUM", "HIGH"])[rank]
            yield pdf

    more = [f"{p}_{lv} double" for lv in levels for p in ("raw", "cal", "p_train")]
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in signals.schema] + more + ["score double", "band string"])
    return signals.mapInPandas(run, schema)
