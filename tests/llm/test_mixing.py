import collections

import duckdb

from vigil.llm import mixing

ROWS = [(1, "a b c", "s2"), (2, None, "s1"), (3, "x " * 400, "s1"), (3, "x " * 400, "s1"), (4, "y " * 50, None), (5, "", "s2"), (6, "q r s", "s3"), (7, "z " * 90, "s3")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")


def filled(sizes, weights, share=1.5, cap=2):
    """Brute force: hand the excess on by weight until no source is above its cap."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        hit = [i for i in open_ if left * weights[i] / w >= cap * sizes[i]]
        if not hit:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in hit:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in hit)
        open_ = [i for i in open_ if i not in hit]
    return out


def test_targets_and_taken(spark):
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(ROWS)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    by_id = {r[0]: r[2] for r in ROWS}
    for r in got:
        s = by_id[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    names = ["s1", "s2", "s3", None]
    want = filled([size[s] for s in names], [5, 2, 1, 5])
    for s, t in zip(names, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 1


def test_equals_sql(spark):
    import pandas as pd

    documents = pd.DataFrame(ROWS, columns=["doc_id", "text", "source"])  # noqa: F841
    want = sorted(map(tuple, duckdb.sql(mixing.SQL.replace("FROM documents", "FROM (SELECT doc_id, text, source FROM documents)")).fetchall()))
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(frame(spark)).collect())
    assert got == want


def test_empty_and_repeated(spark):
    assert mixing.mix(frame(spark).limit(0)).count() == 0
    docs = frame(spark, [(1, "a b c d", "s"), (2, "e f", "s"), (3, "g", None)])
    out = mixing.repeated(docs, mixing.mix(docs)).collect()
    words = collections.Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    assert mixing.repeated(docs, mixing.mix(docs)).columns == docs.columns


def test_rows_of_one_id_take_their_own_plans(spark):
    rows = [(1, "a b c", "s"), (1, "d e f g h", "s"), (1, "a b c", "s"), (None, "x y", "s"), (2, "q " * 30, "t"), (None, None, None)]
    docs = frame(spark, rows)
    plan = mixing.mix(docs)
    want = collections.Counter()
    for r in plan.collect():
        want[r.doc_id] += r.taken
    first, second = ([(r.doc_id, r.text) for r in mixing.repeated(docs, mixing.mix(docs)).collect()] for _ in range(2))
    assert sorted(first, key=repr) == sorted(second, key=repr)
    got = collections.Counter()
    for i, t in first:
        got[i] += len(t.split())
    assert got == {i: n for i, n in want.items() if n}
