import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
import public_tokenizers as P
import tiktoken
from vigil.llm import bpe, mixing, pii, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in cp.STAGES:
        out.append(docs)
        docs = cp.written(stage(spark, docs, SF), "test")
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxic_documents_go(spark, steps):
    net = toxicity.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(steps[0], net).collect()}
    assert set(rows(steps[1])) == {i for i, s in scores.items() if s < 0.5} and steps[1].columns == COLUMNS


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    sets = {}
    for i, r in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert set(after) == {i for i in ids if find(i) == i} and steps[2].columns == COLUMNS


def test_personal_data_is_replaced(steps):
    before, after = rows(steps[2]), rows(steps[3])
    assert set(before) == set(after) and steps[3].columns == COLUMNS
    made = pii.Surrogates(cp.SURROGATE_KEY)
    for i, r in before.items():
        want, last = [], 0
        for s, e, k in pii.find(r.text or ""):
            want += [r.text[last:s], made.replace(k, r.text[s:e])]
            last = e
        assert after[i].text == "".join(want) + r.text[last:]


def test_mix_takes_the_planned_words(steps):
    documents = steps[3].toPandas()  # noqa: F841
    want = {r[0]: r[4] for r in duckdb.sql(mixing.SQL).fetchall()}
    got = collections.Counter()
    for r in steps[4].collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in got.items() if n} and sorted(steps[4].columns) == sorted(COLUMNS)


def test_ids_equal_the_library(steps):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    digest = lambda r: (r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest())
    want = collections.Counter(digest(r) for r in steps[4].collect())
    assert want == collections.Counter((r.doc_id, r.ids_sha256) for r in steps[5].collect())


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"w{k % 3000}" for k in range(60_000))
    data = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "b", 1), (1, "other words that are not the same at all", "en", "a", 1), (None, "a text without any id in this place", "en", "a", 1), (None, "a text without any id in this place", "en", "a", 1), (7, None, None, None, None), (8, "", "en", "a", 0), (9, long, "en", "c", 1), (10, long + " end", "en", "c", 1)]
    docs = spark.createDataFrame([(*r, 5) for r in data], "doc_id long, text string, lang string, source string, n_chars long, size int").repartition(3)
    kept = cp.written(cp.drop_near_duplicates(spark, docs, SF), "test")
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "")[:12]) for r in kept.collect())
    assert got == sorted([("1", "one two thre"), ("1", "other words "), ("None", "a text witho"), ("7", ""), ("8", ""), ("9", "w0 w1 w2 w3 ")])
    mixed = cp.written(cp.mix_sources(spark, cp.replace_personal_data(spark, kept, SF), SF), "test")
    words = collections.Counter()
    for r in mixed.collect():
        if r.text:
            words[r.doc_id, r.text.split()[0]] += len(r.text.split())
    plan = collections.Counter()
    for r in mixing.mix(kept).collect():
        plan[r.doc_id] += r.taken
    assert {i: n for i, n in plan.items() if n} == {i: sum(n for (j, _), n in words.items() if j == i) for i in {j for j, _ in words}}
    assert cp.encode(spark, mixed, SF).count() == mixed.count()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = toxicity.without_toxic(docs, toxicity.train(docs, labels))
    for stage in (cp.drop_near_duplicates, cp.replace_personal_data, cp.mix_sources, cp.encode):
        docs = cp.written(stage(spark, docs, SF), "test")
    assert docs.count() == 0
