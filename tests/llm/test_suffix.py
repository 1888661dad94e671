import collections
import hashlib
import random

import numpy as np

from vigil.llm import suffix


def brute(rows, length):
    where = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        where.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if where[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_array():
    rng = random.Random(2)
    for trial in range(200):
        k = rng.choice([1, 2, 4, 200])
        pieces = [bytes(rng.randrange(k) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
        pieces += rng.choices(pieces, k=2) if rng.random() < 0.5 else []
        text = []
        for p in pieces:
            text += [x + 1 for x in p] + [0]
        text = np.array(text, np.uint16)
        ends = np.cumsum(text == 0)
        key = lambda s: [(int(c), int(ends[s + j]) if c == 0 else 0) for j, c in enumerate(text[s : s + 100])]  # noqa: E731,B023
        want = sorted(range(len(text)), key=key)
        assert suffix.suffix_array(text).tolist() == want, trial


def test_repeated_starts():
    rng = random.Random(4)
    for _ in range(200):
        pieces = list({bytes(rng.choices(b"ab", k=rng.randint(8, 40))) for _ in range(5)})
        count = collections.Counter(p[s : s + 8] for p in pieces for s in range(len(p) - 7))
        want = [[s for s in range(len(p) - 7) if count[p[s : s + 8]] > 1] for p in pieces]
        assert [x.tolist() for x in suffix.repeated_starts(pieces, 8)] == want


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 500), (5, "xy" * 200), (6, "same " * 30), (7, "same " * 30)]
    for i in range(8, 90):
        t = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passage)
            s = rng.randrange(len(p) // 2)
            t.insert(rng.randrange(3), p[s : s + rng.randint(30, len(p))])
        rows.append((i, " ".join(t)))
    return rows + [(100, rows[20][1]), (101, rows[20][1] + " and more"), (102, passage[0] * 2)]


def result(spark, rows, length, gram):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.removed(df, length, gram).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = corpus()
    assert result(spark, rows, 50, 8) == brute(rows, 50)


def test_hot_anchors_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 3000)
    monkeypatch.setattr(suffix, "STEP", 8)
    rows = corpus()
    for hot in (900, 200):
        monkeypatch.setattr(suffix, "HOT", hot)
        assert result(spark, rows, 50, 8) == brute(rows, 50)


def test_null_and_repeated_ids(spark):
    rows = corpus()
    rows += [(None, rows[30][1]), (None, rows[40][1] + " x"), (9, rows[50][1]), (9, rows[51][1][:200]), rows[60], rows[60], rows[60]]
    assert result(spark, rows, 50, 8) == brute(rows, 50)


def test_empty(spark):
    assert result(spark, [], 50, 8) == []
    assert result(spark, [(1, None), (1, None)], 50, 8) == brute([(1, None), (1, None)], 50)


def test_very_long_text_and_echoes(spark):
    rng = random.Random(1)
    some = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    text, passage, line = some(3_000_000), some(290), some(90)
    rows = [(1, text + text[1000:2000]), (2, "short"), (3, some(500) + passage + some(300)), (4, passage + some(200)), (5, some(700) + line), (6, line + some(900)), (7, some(2000)), (8, line * 2), (9, line * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_echoed) for r in suffix.removed(df, 400, 32, 128).collect()}
    assert got[1] == (2000, 2000) and got[2] == got[5] == got[6] == got[7] == (0, 0)
    assert got[3][0] == got[4][0] == 0 and 128 <= got[3][1] <= 290 and got[3][1] == got[4][1]
    assert got[8] == got[9] == (0, 180)


def test_only_what_may_repeat_is_sorted(spark):
    """Texts that share an anchor but no long string don't reach the suffix sorting."""
    rng = random.Random(3)
    some = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    line, passage = some(250), some(700)
    rows = [(i, some(500) + line + some(500)) for i in range(40)] + [(50, some(90) + passage + some(300)), (51, some(200) + passage + some(80))]
    anchored = collections.defaultdict(list)
    for _, t in rows:
        buf = np.frombuffer(t.encode(), np.uint8)
        offs, h = np.array([0, len(buf)]), suffix._gram_hashes(buf, 32)
        for _, q1, q2, _, key in zip(*suffix.anchors(offs, h, suffix._least(h, [369])[0], 400)):
            anchored[key & ~np.uint64(1)].append(t.encode()[q1 : q2 + 400])
    shared = {k: v for k, v in anchored.items() if len(v) > 1}
    pieces = [p for v in shared.values() for p in v]
    keys = np.array([k for k, v in shared.items() for _ in v], np.uint64).view(np.int64)
    lo, hi = suffix.shared_starts(pieces, keys, 400, 32, 32)
    left = [p[a : b + 400] for p, a, b in zip(pieces, lo, hi) if a <= b]
    assert len(pieces) > 40 and sum(map(len, left)) < sum(map(len, pieces)) / 5
    whole = [set(a + x) for a, x in zip(lo[lo <= hi], suffix.repeated_starts(left, 400))]
    every = [set(x) for x in suffix.repeated_starts(pieces, 400)]
    assert [x for x in whole if x] == [x for x in every if x] and any(every)
    assert result(spark, rows, 400, 32) == brute(rows, 400)
