"""Rounding to decimals as SQL on doubles does it."""

import math

from pyspark.sql import functions as F

from vigil.functions.columns import rounded
from vigil.plans import model_queries


def test_halves_in_text_that_are_no_halves(spark):
    values = [0.145, 0.565, 2.155, 0.125, -0.125, -0.145, 0.0, 1.005, 2.675, 560.21, float("nan"), float("inf"), None]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded("v", 2).alias("y")).orderBy("i").collect()]
    for v, y in zip(values, got):
        if v is None or not math.isfinite(v):
            assert y is v or str(y) == str(v)
        else:
            assert y == math.copysign(math.floor(abs(v) * 100 + 0.5) / 100, v)
    assert got[0] == 0.14  # 14.499999999999998 hundredths


def test_the_calibration_curve_puts_such_scores_below(spark, monkeypatch):
    frame = spark.createDataFrame([(1, 0.145), (2, 0.14), (3, 0.15)], "event_id long, score double")
    monkeypatch.setattr(model_queries.R, "scored", lambda *_: frame)
    monkeypatch.setattr(model_queries, "driver_labels", lambda *_: frame.select("event_id", F.lit("normal").alias("label"), F.lit(None).cast("string").alias("campaign_id"), F.lit(None).cast("string").alias("confounder"), F.lit(False).alias("is_cold_start")))
    assert {r.x: r.n for r in model_queries.isotonic_map(spark, "").collect()} == {0.14: 2, 0.15: 1}
