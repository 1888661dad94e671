import random

import numpy as np

from tests.llm.test_jaccard import corpus
from vigil.llm import odd_sketch


def brute(rows, top=85):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= top * len(sets[a] | sets[b]):
                up[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = low.get(find(k)) if sets[k] else i
        out.append((str(i), len(sets[k]), c, c is None or i == c))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in odd_sketch.near_duplicates(df).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(5, 30, 14)
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(odd_sketch, "BLOCK", 3)
    monkeypatch.setattr(odd_sketch, "_closest", lambda rows, *a: rows.select(rows.key.alias("a"), rows.key.alias("b")).limit(0))  # the last step does it all; bands cut into many blocks
    assert found(spark, rows) == brute(rows)


def test_chains_and_near_misses_in_one_band(spark):
    """Copies of one text, each a few words away: most pairs are just below the threshold, some link, and chains join them."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.choice([3, 4, 5, 6])):
            t[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(t)))
    assert found(spark, rows) == brute(rows)
    assert 2 < len({c for _, _, c, _ in brute(rows)}) < 120


def test_ids_texts_and_tables_of_all_kinds(spark):
    long = " ".join(f"w{k % 5000}" for k in range(150_000))
    words = [f"v{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(["other", *words[:-30]])
    rows = [(None, "x y z a"), (7, "x y z a"), (None, "lone words here"), (None, None), (4, ""), (5, " \n\t"), (8, long), (9, long + " end"), (10, "p q r"), (10, "p q r"), (3, a), (3, b), (6, a + " tail"), (2, b + " more"), (11, "One"), (12, "one")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for share, wide in ((0.95, 0.02), (0.85, 0.04), (0.7, 0.09)):
        n, got = 2000, []
        same = int(n * share)
        for _ in range(20):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            half = (n + same) // 2
            x, y = np.sort(both[:half]), np.sort(np.concatenate([both[:same], both[half:]]))
            s = odd_sketch.sketches(odd_sketch.minima(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])))
            differ = int(np.bitwise_count(s[0] ^ s[1]).sum())
            assert differ <= odd_sketch.threshold(0.85) or share < 0.85
            got.append(odd_sketch.similarity(differ))
        assert abs(np.mean(got) - share) < wide


def test_threshold_is_the_tail_of_the_walk():
    """Against drawn sketches: about a hundredth of pairs at the asked similarity lie above the bits of miss = 0.01."""
    rng = np.random.default_rng(4)
    most, above = odd_sketch.threshold(0.85, 0.01), 0
    for _ in range(4000):
        flips = 2 * rng.binomial(odd_sketch.PERMUTATIONS, 0.15)
        above += (np.bincount(rng.integers(0, odd_sketch.BITS, flips), minlength=odd_sketch.BITS) & 1).sum() > most
    assert above < 80
    assert odd_sketch.threshold(0.85) > most


def test_wanted_sets_are_made_and_chosen_in_one_step(spark):
    """Each step in Python is a worker more for each core, and its input a batch of whole sets."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, rows[3][1])], "doc_id long, text string")
    signed = odd_sketch.signatures(docs, 3)
    wanted = signed.where("doc_id % 7 = 3 AND key IS NOT NULL").select("key").distinct()
    sets = odd_sketch.full_sets(docs, wanted, 3)
    got = {bytes(r.key): len(set(r.tokens)) for r in sets.collect()}
    assert got == {bytes(r.key): r.n for r in signed.join(wanted, "key").select("key", "n").distinct().collect()} and got
    plan = odd_sketch.full_sets(docs, spark.createDataFrame([(b"x",)], "key binary"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
