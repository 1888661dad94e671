"""Levels fitted on every row, against plain counts and the SQL, on logs that are larger than the reference of the stream's fit."""

import random

import duckdb
import numpy as np
import pytest

from vigil.operators import whole as W
from vigil.plans import model_queries
from vigil.schema import REFERENCE_ROWS


@pytest.mark.parametrize("few", [3, 40, 50_000])
def test_places_are_the_rows_at_or_above(spark, few):
    """With few values looked up, with columns along ranges, and with a value that most rows of such a column have."""
    rng = random.Random(few)
    values = {"a": lambda: rng.choice([0.0, -0.0, 1.5]), "b": lambda: rng.choice([0.0, rng.random(), -rng.random()]), "c": lambda: rng.choice([None, rng.randrange(60) / 8]), "d": lambda: 7.0}
    rows = [(i, rng.choice(["x", None]), *[f() for f in values.values()]) for i in range(3000)]
    table, n = W.places(spark.createDataFrame(rows, "event_id long, entity_type string, a double, b double, c double, d double").repartition(5), list(values), few)
    got = {r.event_id: r for r in table.collect()}
    assert n == len(rows) == len(got)
    for j, c in enumerate(values):
        x = np.array([-np.inf if r[2 + j] is None else r[2 + j] for r in rows])
        up = np.sort(x)
        for r, v in zip(rows, x):
            assert got[r[0]][c] == len(x) - np.searchsorted(up, v, "left") and got[r[0]].entity_type == r[1]


def test_quantile(spark):
    x = [random.Random(3).choice([0.0, -1.0, 2.5, i / 7]) for i in range(999)]
    df = spark.createDataFrame([(v,) for v in x], "v double").repartition(4)
    for q in (0.0, 0.37, 0.99, 1.0):
        assert W.quantile(df, "v", q) == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_a_small_cohort_is_ranked_among_all(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 20 else "small", rng.randrange(50) / 4) for i in range(2400)]
    got = {r.event_id: r.p for r in W.with_tail_p(spark.createDataFrame(rows, "event_id long, entity_type string, raw double").repartition(4), 12.0).collect()}
    kept = [r for r in rows if r[2] < 12]
    for i, kind, raw in rows:
        own = [r[2] for r in kept if kind == "small" or r[1] == "big"]
        assert got[i] == pytest.approx((1 + sum(x >= raw for x in own)) / (1 + len(own)))


def large_log(tmp_path, copies):
    """The events of sf0.1 and some of them again as other entities: more rows than the bounded reference."""
    (tmp_path / "log").mkdir()
    at = str(tmp_path / "log" / "events.parquet")
    duckdb.sql(f"COPY (SELECT event_id + 100000 * i AS event_id, ts, user_id + 1500 * i AS user_id, event_type, value, props FROM '/root/testdata/sf0.1/events.parquet', range(2) t(i) WHERE i = 0 OR event_id < {copies}) TO '{at}'")
    return str(tmp_path / "log")


def same_as_sql(spark, name, folder):
    frame = model_queries.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.sql(f"SELECT {', '.join(frame.columns)} FROM ({model_queries.oracle_sql()[name]}) ORDER BY event_id").fetchall()
    assert len(want) > REFERENCE_ROWS
    assert [tuple(r) for r in frame.orderBy("event_id").collect()] == want


def test_a_level_of_a_log_larger_than_the_reference(spark, tmp_path):
    same_as_sql(spark, "fitted_level", large_log(tmp_path, 25_000))
