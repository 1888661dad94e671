"""Global ranks and rank statistics without sorting a whole table in one task.

Rows are dealt by the leading bits of the score (sign, exponent and ten bits of the mantissa), which
needs no pass over the data and keeps the order. There are as many buckets as the number format has,
however many rows; their counts are summed in order, and only the distinct values of one bucket are sorted together. Places of
rows are counted along ranges of like size (scan).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scan import scan
from vigil.sources.store import store

#: Buckets of an octave, and what keeps bucket numbers positive for every exponent.
CELLS, OFFSET = 1024, 1100


def leading(x: Column) -> Column:
    """The bucket of a double, which grows with it. Null and NaN are below all numbers."""
    x = x.cast("double")
    size = F.abs(x)
    e = F.floor(F.log2(F.when(size > 0, size)))
    flat = (e + OFFSET) * CELLS + F.floor(size / F.pow(F.lit(2.0), e.cast("double")) * CELLS)
    most = F.lit(1 << 30)
    b = F.when(x.isNull() | F.isnan(x), -most).when(size == 0, 0).when(size == float("inf"), F.signum(x) * (most - 1)).otherwise(F.signum(x) * flat)
    return b.cast("int")


def running(per: DataFrame, value: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """per, with the sum of column c over the rows of `by` from the highest value down to each as name, for each c: name of sums.

    per has one row for each value (of by). With descending False sums go from the lowest value up.
    """
    way = F.desc if descending else F.asc
    per = per.withColumn("_cell", leading(F.col(value)))
    cells = per.groupBy(*by, "_cell").agg(*[F.sum(c).alias(c) for c in sums])
    own = Window.partitionBy(*by, "_cell").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, 0)
    placed = _placed(cells, list(sums), by, descending)
    joined = per.join(placed, _beside(per, placed, by))
    return joined.withColumns({name: F.col(f"_start_{c}") + F.sum(c).over(own) for c, name in sums.items()}).select(*per.columns, *sums.values()).drop("_cell")


def _placed(cells: DataFrame, sums: list[str], by: tuple[str, ...], descending: bool) -> DataFrame:
    """The buckets (by and _cell as _by0.. and _at) with the sums of those before them. The window is over buckets, whose number is bounded."""
    before = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("_cell") if descending else F.asc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], F.col("_cell").alias("_at"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_start_{c}") for c in sums])


def _beside(df: DataFrame, placed: DataFrame, by: tuple[str, ...]) -> list[Column]:
    return [*[df[k].eqNullSafe(placed[f"_by{i}"]) for i, k in enumerate(by)], df["_cell"] == placed["_at"]]


def global_rank(df: DataFrame, score: str, tie: str, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each row (of its group `by`) by (score descending, tie ascending), from 1. NaN scores come last, as null ones do.

    Rows are counted along ranges of (group, score, tie), so neither a large group nor a score that most rows have is one
    task. Rows that share score and tie share the place of the first.
    """
    names = df.columns
    low = F.when(F.col(score).isNull() | F.isnan(F.col(score)), F.lit(float("inf"))).otherwise(-F.col(score).cast("double"))
    group = F.xxhash64(F.concat_ws(",", *[F.col(k).isNull().cast("string") for k in by]), *by) if by else F.lit(0).cast("long")
    rows = df.withColumns({"_group": group, "_other": F.xxhash64(*by, F.lit(1)) if by else F.lit(0).cast("long"), "_low": low, "_one": F.lit(1)})
    return scan(rows, ["_group", "_other"], ["_low", tie], "_one").withColumn(name, F.col("_before") + 1).select(*names, name)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """by and, for each name: share, the exact quantile of value (linear between the two nearest), over values that are neither null nor NaN.

    Only the rows of the buckets that hold a wanted place are sorted.
    """
    df = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    per = df.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    steps = running(per, "_v", {"_n": "_upto"}, by, descending=False)
    if by:
        marks = {k: f"_t_{k}" for k in by}
        totals = per.groupBy(*by).agg(F.sum("_n").alias("_rows")).withColumnsRenamed(marks)
        joined = steps.join(totals, [steps[k].eqNullSafe(totals[m]) for k, m in marks.items()])
    else:
        joined = steps.withColumn("_rows", per.agg(F.sum("_n")).scalar())
    found = []
    for name, q in shares.items():
        at = (F.col("_rows") - 1) * F.lit(q)
        low, first = F.floor(at), F.col("_upto") - F.col("_n")  # the value holds places first .. upto - 1
        holds = lambda place, first=first: (first <= place) & (place < F.col("_upto"))
        found += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_lo_{name}"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias(f"_hi_{name}"), F.first(at - low).alias(f"_w_{name}")]
    out = joined.groupBy(*by).agg(*found)
    return out.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in shares])


def score_steps(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Per distinct score: rows and positives, and both summed from the highest score down to it."""
    per = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(positive.cast("long")).alias("pos"))
    return running(per, "score", {"n": "cum_n", "pos": "cum_pos"})


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the precision-recall steps; rows with one score share a threshold."""
    steps = score_steps(df, score, positive)
    return steps.agg((F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Probability that a positive scores above a negative, ties by half; null without both kinds."""
    steps = score_steps(df, score, positive)
    # Positives above a step and half of its own, for each of its negatives.
    neg = F.col("n") - F.col("pos")
    won = steps.withColumn("won", neg * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2))
    return won.agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum(neg), F.lit(0))).alias("roc_auc"))


def rank_statistics(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """average_precision and roc_auc from one pass over the steps."""
    steps = score_steps(df, score, positive)
    neg, pos = F.col("n") - F.col("pos"), F.col("pos")
    return steps.agg(
        (F.sum(pos * F.col("cum_pos") / F.col("cum_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"),
        (F.sum(neg * (F.col("cum_pos") - pos + pos / 2)) / F.nullif(F.sum("pos") * F.sum(neg), F.lit(0))).alias("roc_auc"),
    )


def resampled(value, n, replicates: int, seed: int, salt: int = 0) -> np.ndarray:
    """How often the n rows of a value count in each replicate, where each row counts Poisson(1) times: Poisson(n), drawn by the value alone."""
    key = [seed & (1 << 64) - 1, int(np.float64(value).view(np.uint64)) ^ salt << 1]
    return np.random.Generator(np.random.Philox(key=key)).poisson(n, replicates)


def _ends(per: DataFrame, column: str) -> Column:
    return per.agg(F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))).scalar()


def bootstrap_auc(df: DataFrame, score: str, positive: Column, replicates: int = 200, seed: int = 1) -> DataFrame:
    """roc_auc of all rows, and the 2.5 and 97.5 percentiles over resamples in which each row counts Poisson(1) times.

    The counts of a score's rows are drawn together, from how many they are, so resampling costs steps times replicates. Tasks
    sum along ranges of scores, for all replicates at once, and each gives three numbers a replicate.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))

    def run(batches):
        pos, neg, won, part = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates), TaskContext.get().partitionId()
        for batch in batches:
            for s, p, n in zip(*(c.to_pylist() for c in batch.columns)):
                p, n = resampled(s, p, replicates, seed), resampled(s, n, replicates, seed, 1)
                won += n * (pos + p / 2)
                pos += p
                neg += n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, part, np.int32)), pa.array(np.arange(replicates, dtype=np.int32)), pa.array(pos), pa.array(neg), pa.array(won)], ["part", "r", "pos", "neg", "won"])

    parts = store(per.repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score")).select("score", "pos", "neg").mapInArrow(run, "part int, r int, pos double, neg double, won double"))
    above = F.coalesce(F.sum("pos").over(Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = parts.withColumn("won", F.col("won") + F.col("neg") * above)
    aucs = placed.groupBy("r").agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    return roc_auc(df, score, positive).withColumn("_ends", _ends(aucs, "auc")).select("roc_auc", F.col("_ends")[0].alias("low"), F.col("_ends")[1].alias("high"))


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """Mean of value, and the 2.5 and 97.5 percentiles of its resampled means, by counts of each distinct value."""
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def run(batches):
        total, rows = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            for v, n in zip(*(c.to_pylist() for c in batch.columns)):
                c = resampled(v, n, replicates, seed)
                total += v * c
                rows += c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(total), pa.array(rows)], ["r", "total", "rows"])

    means = per.mapInArrow(run, "r int, total double, rows double").groupBy("r").agg((F.sum("total") / F.nullif(F.sum("rows"), F.lit(0.0))).alias("m"))
    return df.agg(F.avg(value).alias("mean")).withColumn("_ends", _ends(means, "m")).select("mean", F.col("_ends")[0].alias("low"), F.col("_ends")[1].alias("high"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of paired differences: n (without zeros), W (the smaller sum) and its normal approximation."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.round(F.abs("d"), 12))
    per = d.groupBy("m").agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    ranked = running(per, "m", {"n": "upto"}, descending=False).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("up"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("down"), F.sum(F.pow("n", 3) - F.col("n")).alias("ties"))
    n = F.col("n")
    w = F.least("up", "down")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return s.select("n", w.alias("w"), ((w - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))
