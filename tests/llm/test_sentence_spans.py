import collections
import random
import re

from vigil.llm import sentence_spans
from vigil.llm.sentence_spans import MARKS


def split(t):
    return [m for m in re.findall(f"[^{MARKS}\n]*(?:[{MARKS}]+|\n|\\Z)", t) if m]


def brute(rows, run):
    """Every run of sentences, compared by its words; repeated rows in turn."""
    docs, seen = [], collections.defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        sent = split(t or "")
        words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in s)) for s in sent]
        at = [k for k, w in enumerate(words) if w]
        n = min(run, len(at))
        runs = [at[k : k + n] for k in range(len(at) - n + 1)] if len(at) > 1 else []
        docs.append((i, sent, words, runs))
        for r in runs:
            seen[tuple(tuple(words[k]) for k in range(r[0], r[-1] + 1) if words[k])].append((len(docs), r[0]))
    out = []
    for d, (i, sent, words, runs) in enumerate(docs, 1):
        gone = set()
        for r in runs:
            if min(seen[tuple(tuple(words[k]) for k in range(r[0], r[-1] + 1) if words[k])]) != (d, r[0]):
                gone |= set(range(r[0], r[-1] + 1))
        out.append((i, len(sent), len(gone), "".join(s for k, s in enumerate(sent) if k not in gone)))
    return sorted(out, key=repr)


def result(spark, rows, run=3):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int").repartition(3)
    return sorted(((r.doc_id, r.n_sentences, r.n_removed, r.kept) for r in sentence_spans.deduplicated(df, run).collect()), key=repr)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 3)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?", ".\n", "\n", "...", "。", "؟"])
    passages = [[sentence() for _ in range(6)] for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "one two."), (4, "One  TWO."), (5, "...\n\n!"), (103, "One. Two."), (104, "one.  TWO.")]
    for i in range(7, 80):
        t = [sentence() for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(passages)
        rows.append((i, " ".join(t)))
    return [*rows, (100, rows[30][1])]


def test_equals_brute_force(spark):
    rows = corpus()
    for run in (2, 3):
        assert result(spark, rows, run) == brute(rows, run)


def test_repeated_rows_and_null_ids(spark):
    rows = corpus()
    rows += [rows[20]] * 3 + [(None, rows[25][1]), (None, rows[25][1]), (200, None), (200, None), (201, "x. y. z."), (201, "u. v. w.")]
    assert result(spark, rows) == brute(rows, 3)


def test_a_passage_without_marks_is_found_inside_others(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = text(120)
    rows = [(1, f"{text(60)} {passage} {text(70)}"), (2, f"Short one. {text(3)} {passage}"), (3, text(300))]
    got = {r[0]: r[2] for r in result(spark, rows)}
    assert got[1] == 0 and got[3] == 0 and got[2] >= 3


def test_words_that_a_sum_over_places_would_confuse(spark):
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    one = " ".join("ab"[x] for x in thue) + ". c. d."
    two = " ".join("ba"[x] for x in thue) + ". c. d."
    assert [r[2] for r in result(spark, [(1, one), (2, two)])] == [0, 0]


def test_empty_and_long(spark):
    assert sentence_spans.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "word " * 400_000
    assert result(spark, [(1, long)])[0][2] == 0


def test_a_passage_of_one_or_two_long_sentences_is_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    text = lambda n, ends=".": " ".join(word() for _ in range(n)) + ends
    one, two, short = text(35), text(20) + " " + text(16), text(7) + " " + text(9)
    own = lambda: text(8) + " " + text(7)
    rows = [(k, f"{own()} {p} {own()}") for k, p in enumerate([one, one, two, two, short, short])] + [(6, one), (7, text(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_shared) for r in sentence_spans.deduplicated(df).collect()}
    assert got == {0: (0, 35), 1: (1, 35), 2: (0, 36), 3: (2, 36), 4: (0, 0), 5: (0, 0), 6: (1, 35), 7: (0, 0)}


def test_shared_words_of_repeated_rows_and_of_one_document_alone(spark):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) + ". "
    inner, long = text(15) + text(15) + text(15), text(40)
    rows = [(1, inner + text(5) + inner), (2, long), (2, long), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_removed, r.n_shared) for r in sentence_spans.deduplicated(df).collect()))
    assert got == [(0, 0, 40), (1, 3, 0), (2, 1, 40), (2, 1, 40)]
