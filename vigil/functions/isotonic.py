"""Isotonic regression of a table: adjacent violators are pooled in each part, then the parts' blocks together.

Pooling may be done in any order, so blocks of parts can be pooled further without their rows. A curve over n yes-or-no
rows has on the order of n^(2/3) blocks at most; only these reach the last task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.sources.store import store

BLOCKS = "lo double, hi double, n double, total double"


def pooled(lo, hi, n, total) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in order, with neighbours joined until means (total / n) grow."""
    out: list[list[float]] = []
    for block in zip(*(np.asarray(x, float).tolist() for x in (lo, hi, n, total))):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, h, w, t = out.pop()
            last = out[-1]
            last[1], last[2], last[3] = h, last[2] + w, last[3] + t
    a = np.array(out, float).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def _pool(batches):
    held = [np.zeros(0)] * 4
    for batch in batches:
        held = pooled(*(np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)))
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["lo", "hi", "n", "total"])


def isotonic_blocks(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """lo, hi (the x it spans), n, total: the blocks of the increasing step function nearest to y; its value is total / n. Rows without x or y take no part."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(x).cast("double").alias("lo"), F.col(y).cast("double").alias("_y"), w.alias("_w")).where(F.col("lo").isNotNull() & ~F.isnan("lo") & F.col("_y").isNotNull())
    blocks = rows.groupBy("lo").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("total")).where("n > 0").select("lo", F.col("lo").alias("hi"), "n", "total")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        blocks = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(_pool, BLOCKS)
        if parts == 1:
            return blocks
        blocks, parts = store(blocks), int(parts**0.5)


def isotonic_fit(df: DataFrame, x: str, y: str, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The knots of the curve: both ends of each block, and its value twice."""
    b = isotonic_blocks(df, x, y, weight).orderBy("lo").toPandas()
    return b[["lo", "hi"]].to_numpy().ravel(), np.repeat((b["total"] / b["n"]).to_numpy(), 2)


def isotonic_values(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row for each x: x, n, total and value, the curve there."""
    steps = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("total"))
    blocks = store(isotonic_blocks(df, x, y)).select("lo", "hi", (F.col("total") / F.col("n")).alias("value"))
    return steps.join(blocks, (steps["x"] >= blocks["lo"]) & (steps["x"] <= blocks["hi"])).select("x", "n", "total", "value")
