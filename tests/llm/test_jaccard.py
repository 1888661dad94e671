import random
import re

from vigil.llm import jaccard


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def corpus(seed=5, bases=25, copies=14):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["É", "Ünder", "A"]
    passage = rng.choices(vocab, k=40)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "two words"), (6, "two  WORDS"), (7, "word " * 300), (8, "a\x00b c d")]
    for _ in range(bases):
        base = rng.choices(vocab, k=rng.choice([5, 30, 90, 200]))
        at = rng.randint(0, len(base))
        if rng.random() < 0.5:
            base[at:at] = passage
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.2:
                t = t[: int(len(t) * 0.93)]
            rows.append((len(rows), " ".join(t)))
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(df).collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_long_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 3)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    rows = corpus(9, 8, 20)
    assert result(spark, rows) == brute(rows)


def test_empty(spark):
    assert result(spark, []) == {}
    assert result(spark, [(1, None), (2, "")]) == {1: (0, 1, 0), 2: (0, 2, 0)}


def test_words_that_a_sum_over_places_would_confuse(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    got = result(spark, [(1, one), (2, one.translate({97: "b", 98: "a"})), (3, one)])
    assert got == {1: (1, 1, 1), 2: (1, 2, 0), 3: (1, 1, 1)}


def test_null_ids_repeats_and_long_texts(spark):
    long = " ".join(f"w{k % 5000}" for k in range(150_000))
    rows = [(None, "a b c d"), (7, "a b c d"), (None, "lone words here"), (8, long), (9, long + " end"), (10, "x y z"), (10, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(df).collect())
    assert got == [("10", 1, 10, 0), ("10", 1, 10, 0), ("7", 2, 7, 0), ("8", 5000, 8, 1), ("9", 5001, 8, 1), ("None", 1, None, 0), ("None", 2, 7, 0)]


def test_a_line_in_every_document_makes_no_pool(spark):
    """What all documents share stands last in their order, so no posting list holds them all."""
    rng = random.Random(3)
    line = " ".join(f"common{k}" for k in range(12))
    rows = [(i, " ".join(rng.choices([f"v{k}" for k in range(3000)], k=60)) + " " + line) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(20)]
    assert result(spark, rows) == brute(rows)
