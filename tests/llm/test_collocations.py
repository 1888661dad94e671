import random
import re
from collections import Counter

import numpy as np

from vigil.llm import collocations


def brute(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if any(len(v) > len(w) and m == lang and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (m, v), b in f.items() if b >= least):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def corpus(seed, texts=200):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["É", "ÜBER", "A", "a'b", " x", "日本"]
    fixed = ["new york city hall", "San Francisco", "the of", "a a a a a", "one two three"]
    rows = [(None, "en"), ("", None), (" \t.\n", "en"), ("lonely", "xx")]
    for _ in range(texts):
        parts = []
        for _ in range(rng.randint(1, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(vocab, k=rng.randint(1, 4))))
            parts.append(rng.choice([" ", " ", "\t", ". ", "\n", ",", "\x0b"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "de", None])))
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, w1 int, phrase string").repartition(3)
    return {tuple(r) for r in collocations.collocations(df, **more).collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows) == brute(rows) and len(brute(rows)) > 20


def test_without_ranks_and_with_small_tables(spark, monkeypatch):
    """Few ranks, small blocks that go out early and a crowded bitmap give the same."""
    rows = corpus(2) * 2
    monkeypatch.setattr(collocations, "RANKED", 4)
    monkeypatch.setattr(collocations, "TILE", 2)
    monkeypatch.setattr(collocations, "DENSE", 1)
    monkeypatch.setattr(collocations, "HELD", 10)
    monkeypatch.setattr("vigil.llm.bitmaps.BITS", 8)
    monkeypatch.setattr(collocations, "SLOTS", 4096)
    assert found(spark, rows, least=40, top=7) == brute(rows, 40, 7)


def test_two_words_with_one_hash_take_another_seed(spark, monkeypatch):
    real = collocations.span_hashes
    monkeypatch.setattr(collocations, "span_hashes", lambda b, s, e, seed=0: real(b, s, e, seed) if seed else real(b, s, e) & np.uint64(3))
    rows = corpus(3, 40)
    assert found(spark, rows, least=5) == brute(rows, 5)


def test_slots_leave_out_what_is_rare_only(spark, monkeypatch):
    rows = corpus(4, 120)
    for slots, least in ((1 << 14, 5), (1 << 16, 300)):
        monkeypatch.setattr(collocations, "SLOTS", slots)
        assert found(spark, rows * (60 if least > 255 else 1), least=least) == brute(rows * (60 if least > 255 else 1), least)


def test_empty_and_very_long(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None), ("", "en")]) == set()
    text = "x y " * 400_000
    assert found(spark, [(text, "en")]) == brute([(text, "en")])
