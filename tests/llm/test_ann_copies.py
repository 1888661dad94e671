import numpy as np

from vigil.llm import ann


def nearest(x, q, k=20):
    s = x @ x[q]
    return [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]


def test_recall_beside_a_third_of_copies(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(50, 64))
    x = centres[rng.integers(0, 50, 12000)] + rng.normal(size=(12000, 64))
    copies = rng.permutation(12000)[:4000]
    x[copies] = x[copies[0]]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = np.setdiff1d(np.arange(0, 12000, 100), copies).tolist()
    own = [int(copies[0]), int(copies.max())]
    got = {}
    for r in ann.search(df, df.where(df.vec_id.isin([*asked, *own]))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(got[q]) & set(nearest(x, q))) for q in asked)
    print("recall", hits / (20 * len(asked)))
    assert hits >= 0.9 * 20 * len(asked)
    low = np.sort(copies).tolist()
    assert all(got[q] == [i for i in low if i != q][:20] for q in own)


def test_pivots_are_distinct_directions(spark):
    x = np.concatenate([np.outer(np.arange(1, 101), [1.0, 2, 3]), np.eye(3), -np.eye(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")
    assert len(ann.directions(ann.distinct(df, 3), 128)) == 7
