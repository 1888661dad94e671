"""The long level of a log that is larger than the reference of the stream's fit."""

from vigil.operators.signals import signal_frame
from vigil.schema import SIGNALS
from vigil.sources.tables import driver_log

from tests.test_whole_fit import large_log, same_as_sql


def test_the_long_level_equals_its_sql(spark, tmp_path):
    same_as_sql(spark, "fitted_long", large_log(tmp_path, 25_000))


def test_a_frame_of_one_level_has_the_same_values(spark):
    log = driver_log(spark, "/root/testdata/sf0.001")
    every = {r.event_id: r for r in signal_frame(log).collect()}
    for level in ("entity", "ip", "long"):
        names = [s.name for s in SIGNALS if s.level == level]
        frame = signal_frame(log, levels=(level,))
        assert set(frame.columns) == {"event_id", "_n_history", "_cold_start", *names}
        rows = frame.collect()
        assert len(rows) == len(every) and all(r[n] == every[r.event_id][n] for r in rows for n in names)
