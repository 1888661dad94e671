"""The entity level, whose columns have too many values to be looked up, of a log larger than the reference of the stream's fit."""

from tests.test_whole_fit import large_log, same_as_sql


def test_the_entity_level_equals_its_sql(spark, tmp_path):
    same_as_sql(spark, "fitted_entity", large_log(tmp_path, 25_000))
