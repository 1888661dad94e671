import random
import zlib

from pyspark.sql import functions as F
from vigil.llm import quality


def corpus(n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(1, 9)))
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        t = [word() for _ in range(rng.randint(20, 120))]
        text = " ".join(t) + "." if good else rng.choice([" | ".join(t), "%%% ".join(t), "!! ".join(t).upper()])
        rows.append((i, text, f"h{i % 5}" if i % 7 else None, "en", int(good)))
    return rows


def test_held_out_and_sites(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r[:4], 0.5) for r in rows] + [(1000, None, "lone", None, 0.1)], "doc_id long, text string, source string, lang string, p_doc double")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.posterior(docs, quality.train(docs, labels), F.col("source"), F.col("lang")).collect()}
    assert len(got) == 401 and all(0 < r.score < 1 for r in got.values())
    held = [(got[r[0]].keep, r[4]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    # A site with one document stays between what it shows and what all show.
    mean = sum(r.p_doc for r in got.values()) / len(got)
    lone = got[1000]
    assert min(lone.p_doc, mean) - 1e-9 <= lone.p_host <= max(lone.p_doc, mean) + 1e-9


def test_shrinkage_equals_formula(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.posterior(docs, quality.train(docs, labels), F.col("source"), F.col("lang")).collect()}
    want = plain([(r[0], got[r[0]].p_doc, r[2], r[3]) for r in rows])
    for i, (h, p, s) in want.items():
        assert abs(got[i].p_host - h) < 1e-9 and abs(got[i].p_path - p) < 1e-9 and abs(got[i].score - s) < 1e-9


def test_sparse_hosts_stay_near_the_prior(spark):
    """Hosts of one page, and of two pages that differ as much within as between hosts, don't leave the share of all."""
    rows = corpus(400)
    docs = spark.createDataFrame([(r[0], r[1], f"h{r[0]}" if r[0] < 200 else f"h{r[0] % 100}") for r in rows], "doc_id long, text string, host string").withColumn("path", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    e = quality.train(docs, labels)
    for part in (docs.where("doc_id < 200"), docs.where("doc_id >= 200")):
        got = quality.posterior(part, e, F.col("host"), F.col("path")).collect()
        mean = sum(r.p_doc for r in got) / len(got)
        assert min(r.p_doc for r in got) < 0.1 and max(r.p_doc for r in got) > 0.9
        assert all(abs(r.p_host - mean) < 0.05 and abs(r.p_path - mean) < 0.05 for r in got)


def test_hosts_that_differ_leave_the_prior(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(r[0], r[1], "good" if r[4] else "bad", "p") for r in rows], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    got = quality.posterior(docs, quality.train(docs, labels), F.col("host"), F.col("path")).select("p_host", "doc_id").collect()
    good = {r[0]: r[4] for r in rows}
    assert all(r.p_host > 0.9 if good[r.doc_id] else r.p_host < 0.1 for r in got)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "h", "p"), (1, "a", "h", "p")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    e = quality.train(docs, none)
    assert [r.p_doc for r in quality.posterior(docs, e, F.col("source"), F.col("lang")).collect()] == [0.5, 0.5]
    assert quality.posterior(docs.limit(0), e, F.col("source"), F.col("lang")).count() == 0


def plain(rows):
    """p_host, p_path and score of (id, p_doc, host, path) rows, summed site by site."""
    import math

    logit = lambda p: math.log(p / (1 - p))
    strength = lambda m, v: max(1.0, min(10000.0, m * (1 - m) / max(v, 1e-9) - 1))
    hosts, paths = {}, {}
    for _, p, h, q in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    mean = sum(r[1] for r in rows) / len(rows)
    average = lambda v: sum(v) / len(v)

    def variance(groups):
        """Of true means, from (mean of the level above, its rows, rows of the group): what differs between groups beyond what their rows explain."""
        above = len({key for key, _, _, _ in groups})
        free, n = len(groups) - above, sum(len(v) for *_, v in groups)
        if free == 0 or n == len(groups):
            return 0.0
        spread = sum(len(v) * (average(v) - m) ** 2 for _, m, _, v in groups) / free
        chance = sum((x - average(v)) ** 2 for *_, v in groups for x in v) / (n - len(groups))
        return max(0.0, (spread - chance) / ((n - sum(len(v) ** 2 / size for _, _, size, v in groups)) / free))

    between = variance([(0, mean, len(rows), v) for v in hosts.values()])
    k = strength(mean, between)
    p_host = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    within = variance([(h, average(hosts[h]), len(hosts[h]), v) for (h, _), v in paths.items()])
    p_path = {}
    for (h, q), v in paths.items():
        k = strength(p_host[h], within)
        p_path[h, q] = (sum(v) + k * p_host[h]) / (len(v) + k)
    return {i: (p_host[h], p_path[h, q], 1 / (1 + math.exp(-(logit(p) + logit(p_path[h, q]) - logit(mean))))) for i, p, h, q in rows}


def test_hosts_and_paths_equal_plain_sums(spark):
    rows = corpus(150)
    urls = [f"https://{'www.' if i % 2 else ''}Site{i % 4}.example.org/{'news' if i % 3 else 'shop'}/{i}?x=1" if i % 11 else None for i in range(150)]
    docs = spark.createDataFrame([(r[0], r[1], u) for r, u in zip(rows, urls)], "doc_id long, text string, url string")
    host, path = quality.site(F.col("url"))
    docs = docs.withColumn("host", host).withColumn("path", path)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.posterior(docs, quality.train(docs, labels), F.col("host"), F.col("path")).collect()}
    sites = [(f"site{i % 4}.example.org", "news" if i % 3 else "shop") if i % 11 else (None, None) for i in range(150)]
    want = plain([(i, got[i].p_doc, *sites[i]) for i in range(150)])
    for i, (h, p, s) in want.items():
        assert abs(got[i].p_host - h) < 1e-9 and abs(got[i].p_path - p) < 1e-9 and abs(got[i].score - s) < 1e-9


def test_page_text_and_long_text(spark):
    html = "<html><head><style>p{a:b}</style></head><body><script>var t='</p>';</script><!-- no --><p>One &amp; <b>two</b></p><p>three &lt; four</p></body></html>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert [r.t for r in df.select(quality.page_text(F.col("html")).alias("t")).collect()] == ["One & two\nthree < four", None, ""]
    docs = spark.createDataFrame([(1, "word " * 300_000, "h", "p", "x"), (1, "word " * 300_000, "h", "p", "x")], "doc_id long, text string, host string, path string, p_path string")
    e = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.posterior(docs, e, F.col("host"), F.col("path")).count() == 2
