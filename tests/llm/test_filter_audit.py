import collections
import itertools
import random
import re

import pytest
from pyspark.sql import Row

from vigil.llm import filter_audit


def brute(rows, labels):
    """rows: (doc_id, text, source)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, text, _ in rows:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    failed = []
    for i, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = set()
        if len(w) < 200:
            bad.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            bad.add("C")
        if re.search("[#$%&*|]", text):
            bad.add("D")
        if i is not None and i > low[text]:
            bad.add("E")
        failed.append((source or "", bad, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [x for x in failed if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in own if f in x[1] and not x[1] & before]
                total[f] += len(here)
                out[part, order, step] = [sum(not x[1] & (before | {f}) for x in own), len(here), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
        for (p, order, step), got in out.items():
            if p == part:
                got.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def texts():
    plain = " ".join(f"word{k}" for k in range(250))
    return [plain, plain + " #", "same " * 300, "AB " + plain, "SHORT", "", None, " \n\t", "é" * 300, plain.upper(), "x " * 300_000]


def corpus():
    t = texts()
    rows = [(100 + 7 * k, t[k % len(t)], f"s{k % 3}" if k % 5 else None) for k in range(66)]
    rows += [(20, t[0], "s1"), (20, t[0], "s2"), (20, t[0], "s2"), (None, t[0], "s1"), (None, "only null", "s9"), (3, t[1], "late")]
    labels = [(100 + 7 * k, k % 2, int(k % 7 == 0)) for k in range(0, 66, 2)] + [(20, 1, 1), (20, 0, None), (3, None, 1), (None, 1, 1)]
    return rows, labels


def write(spark, rows, path, mode="overwrite"):
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, label string").coalesce(1).write.mode(mode).parquet(path)


def tabled(spark, labels):
    return spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, part string")


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_equals_brute_force_in_any_order_of_files(spark, folder):
    """Larger ids come first, so most files take back what earlier ones counted; the second run reads the new files only."""
    rows, labels = corpus()
    by_id = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k in range(0, len(by_id), 16):
        write(spark, by_id[k : k + 16], f"{folder}/docs", "append")
    half = len(by_id) // 16 // 2
    assert half
    got = {tuple(r) for r in filter_audit.audit(spark, f"{folder}/docs", tabled(spark, labels), f"{folder}/state").collect()}
    assert got == brute(rows, labels)
    more = [(1, texts()[0], "s0"), (2, texts()[0], "s5"), (1, texts()[2], None)]
    write(spark, more, f"{folder}/docs", "append")
    got = {tuple(r) for r in filter_audit.audit(spark, f"{folder}/docs", tabled(spark, labels), f"{folder}/state").collect()}
    assert got == brute(rows + more, labels)
    read = spark.read.schema(filter_audit.COUNTER).parquet(f"{folder}/state/changes")
    assert read.agg({"n": "sum"}).first()[0] == len(rows) + len(more)


def test_empty(spark, folder):
    write(spark, [], f"{folder}/docs")
    assert filter_audit.audit(spark, f"{folder}/docs", tabled(spark, [])).count() == 0


def test_tasks_combine_copies(spark, monkeypatch):
    """Whatever a task combines at once, the counters are the same."""
    rows, labels = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    labelled = filter_audit.judged(df).withColumnRenamed("mask", "code").select("doc_id", "part", "text_key", "code")
    for many in (3, 1000):
        monkeypatch.setattr(filter_audit, "COMBINED", many)
        got = labelled.mapInArrow(filter_audit._combine, "text_key binary, doc_id long, part string, code int, n long").collect()
        assert sum(r.n for r in got if r.doc_id is None) == len(rows)
    keyed = [r for r in got if bytes(r.text_key[:1]) == b"#"]
    assert len({bytes(r.text_key) for r in keyed}) == len({t or "" for _, t, _ in rows} - {"only null"})
    assert all((r.doc_id is None) == (bytes(r.text_key[:1]) == b"=") for r in got)


class Kept:
    """A list state that counts the requests to it."""

    def __init__(self):
        self.rows, self.requests = [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.requests += 1
        return iter(self.rows)

    def put(self, rows):
        self.requests, self.rows = self.requests + 1, list(rows)

    def appendList(self, rows):
        self.requests, self.rows = self.requests + 1, self.rows + list(rows)


def test_a_bucket_of_texts_takes_two_requests_a_batch():
    rng = random.Random(5)
    kept, bucket = Kept(), filter_audit.Retractions()
    bucket.init(kept)
    low, seen, got = {}, [], collections.Counter()
    for batch in range(6):
        came = [(b"#%d" % rng.randrange(50), rng.randrange(300) - 60 * batch, rng.choice("pq"), rng.choice([1, 34])) for _ in range(200)]
        seen += came
        rows = [Row(text_key=t, doc_id=d, part=p, code=c, n=1) for t, d, p, c in came]
        rows += [Row(text_key=b"=x", doc_id=None, part=p, code=c, n=1) for _, _, p, c in came]
        for r in bucket.handleInputRows((7,), iter(rows), None):
            got[r.part, r.code] += r.n
        for t, d, _, _ in came:
            low[t] = min(d, low.get(t, d))
        want = collections.Counter((p, c | 16 * (d > low[t])) for t, d, p, c in seen)
        assert {k: n for k, n in got.items() if n} == want
        assert kept.requests == 2 * (batch + 1)
        assert {(t, d) for t, d, *_ in kept.rows} >= set(low.items()) and len(kept.rows) <= 4 * len(low)


def test_buckets_stay_as_the_first_run_had_them(spark, folder):
    rows, labels = corpus()
    write(spark, [r for r in rows if (r[0] or 0) > 300], f"{folder}/docs", "append")
    filter_audit.audit(spark, f"{folder}/docs", tabled(spark, labels), f"{folder}/state").count()
    write(spark, [r for r in rows if (r[0] or 0) <= 300], f"{folder}/docs", "append")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = {tuple(r) for r in filter_audit.audit(spark, f"{folder}/docs", tabled(spark, labels), f"{folder}/state").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert got == brute(rows, labels)
