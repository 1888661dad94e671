import numpy as np

from vigil.llm import quality, toxicity


def tables(spark):
    docs = spark.sql("select id doc_id, concat('word ', id, ' .') text from range(9500)")
    labels = spark.sql("select id doc_id, cast(id < 2500 as int) toxic, cast(id < 4600 as int) quality from range(9500)")
    return docs, labels


def test_toxicity_learns_from_the_whole_sample(spark, monkeypatch):
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda *a: got.append(a))
    toxicity.train(*tables(spark))
    ids, first, y, _ = got[0]
    assert (int((y == 1).sum()), int((y == 0).sum())) == (1500, 4500)
    assert np.diff(first).tolist() == [2] * 6000 and ids.shape == (12000, 5)
    assert set(ids[::2, 0].tolist()) == set(toxicity.features(np.frombuffer(b"word", np.uint8), np.array([0, 4]))[0][:, 0].tolist())


def test_quality_learns_from_the_whole_sample(spark, monkeypatch):
    got = []
    monkeypatch.setattr(quality.Evidence, "fit", lambda *a: got.append(a))
    quality.train(*tables(spark))
    x, y, _ = got[0]
    assert (int((y == 1).sum()), int((y == 0).sum())) == (3000, 3000) and x.shape == (6000, quality.N_FEATURES)
