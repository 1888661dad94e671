import numpy as np

from vigil.llm import ann


def frame(spark, x, extra=()):
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")


def exact(x, ids, k=20):
    out = {}
    for q in ids:
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        out[q] = [(int(i), float(s[i])) for i in order]
    return out


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] *= 1.5  # lengths differ: product, not angle
    df = frame(spark, x, [(5000, None, 0), (5020, [0.0] * 64, 0), (5040, [float("nan")] * 64, 0), (5060, [None] + [1.0] * 63, 0)])
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(x, range(0, 3000, 20))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_few_rows_and_copies(spark):
    x = np.tile([1.0, 2.0], (30, 1))
    got = [r.vec_id for r in ann.search(frame(spark, x), frame(spark, x).where("vec_id = 20")).orderBy("rank").collect()]
    assert got == [i for i in range(30) if i != 20][:20]
    one = frame(spark, x[:1])
    assert ann.search(one, one).count() == 0
    assert ann.search(one.limit(0), one.limit(0)).count() == 0


def test_hot_file_is_split(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile([3.0, 1, 0, 0], (300, 1)), rng.normal(size=(100, 4))])
    df = frame(spark, x)
    q = df.where("vec_id % 20 = 0")
    a = ann.search(df, q, block=32).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in a} == {(r.query_id, r.rank, r.vec_id) for r in ann.search(df, q).collect()}


def test_ragged_vectors_and_repeated_ids(spark):
    """Vectors of another length than most take no part; a repeated id counts once, by its smallest vector."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    extra = [(100, [1.0, 2.0], 0), (120, [1.0] * 7, 0), (140, [], 0), (20, [9.0] * 6, 0), (20, x[20].tolist(), 0)]
    df = frame(spark, x, extra)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    own = x.copy()
    own[20] = min([x[20].tolist(), [9.0] * 6])
    want = exact(own, (0, 20, 40))
    assert set(got) == {0, 20, 40}
    for q, rows in got.items():
        assert [v for _, v, _ in sorted(rows)] == [v for v, _ in want[q]]
    same = spark.createDataFrame([(i, [float(i + 1)] * (2 + i % 2), 0) for i in range(40)], "vec_id long, embedding array<double>, rank int")
    assert {len(v) for v in (r.embedding for r in same.join(ann.search(same, same.where("vec_id = 20")).select("vec_id"), "vec_id").collect())} == {2}
