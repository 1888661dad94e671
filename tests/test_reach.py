"""Sums over what is in reach: against all pairs of rows, and without a frame that slides over many of them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vigil.operators.causal import trailing_sum
from vigil.plans import signal_queries


def test_sums_in_reach_equal_all_pairs_of_rows(spark):
    rng, start = random.Random(8), dt.datetime(2026, 1, 1)
    rows = [(i, rng.choice("ab"), None if i % 40 == 0 else start + dt.timedelta(seconds=rng.randrange(200), milliseconds=rng.choice([0, 500])), rng.choice([0, 1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, k string, timestamp timestamp, v int").withColumn("sec", F.unix_timestamp("timestamp"))
    got = {r.event_id: r.x for r in df.select("event_id", trailing_sum(F.col("v"), ["k"], 30).alias("x")).collect()}
    whole = lambda t: t and t.replace(microsecond=0)
    for i, k, t, _ in rows:
        near = [r for r in rows if r[1] == k and ((r[2] is None and t is None and r[0] < i) or (r[2] and t and (r[2], r[0]) < (t, i) and (whole(t) - whole(r[2])).total_seconds() <= 30))]
        assert got[i] == sum(r[3] or 0 for r in near)


def test_no_frame_slides(spark):
    """A frame with two moving ends is summed anew for each row: with 60 000 rows in reach of each, a table of 36 million never ends."""
    for name in ("ip_signals_1d", "failed_burst", "burst_ratio", "long_window"):
        plan = signal_queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan
