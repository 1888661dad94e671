"""The log scored by all levels, larger than the reference of the stream's fit."""

from tests.test_whole_fit import large_log, same_as_sql


def test_all_levels_equal_their_sql(spark, tmp_path):
    same_as_sql(spark, "scored_log", large_log(tmp_path, 25_000))
