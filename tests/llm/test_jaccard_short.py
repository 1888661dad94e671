import random

from vigil.llm import jaccard


def brute(rows, words, top):
    """component_id and n_links of each text, by comparing all pairs."""
    sets = {i: {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)} for i, t in rows for w in [t.split()]}
    up, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (find(i), links[i]) for i in sets}


def result(spark, rows, words, top):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_join(df, words, top).collect()}


def test_pair_that_shares_four(spark):
    assert result(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h i")], 5, 80) == {1: (1, 1), 2: (1, 1)}


def test_short_texts_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(90):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 20))]
        for _ in range(rng.randint(1, 4)):
            t = base[rng.choice([0, 0, 1]) : len(base) - rng.choice([0, 0, 1, 2])]
            if rng.random() < 0.3:
                t = [*t, f"w{rng.randrange(3000)}"]
            rows.append((len(rows), " ".join(t)))
    for words, top in ((5, 80), (3, 90), (2, 50)):
        want = brute(rows, words, top)
        assert sum(n for _, n in want.values()) > 50
        assert result(spark, rows, words, top) == want
