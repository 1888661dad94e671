import numpy as np

from vigil.operators import fusion
from vigil.operators.fusion import Fusion


def test_steps_weigh_all_their_rows():
    x, p = fusion.isotonic([1.0, 2.0], [0.010, 0.005], [100_000, 1000])
    assert np.allclose(p, (100_000 * 0.010 + 1000 * 0.005) / 101_000)
    assert x.tolist() == [1.0, 2.0]


def test_calibration_uses_all_rows(spark):
    raw = spark.sql("select cast(id as string) event_id, if(id < 20000, 1.0D, 2.0D) raw from range(21000)")
    labels = spark.sql("select cast(id as string) event_id, if(id < 10000, 'bad', 'ok') label from range(21000)")
    f = Fusion("entity", [], [])
    fusion._calibrate(f, raw, labels, ("bad",))
    assert np.allclose(f.steps[1], 10000 / 21000)
