"""Quality by hierarchical empirical Bayes.

A logistic model of a document's own marks gives its evidence. Evidence is averaged by host and
by path of a host; each mean is shrunk toward the level above (path to host, host to all) by
a Beta prior whose strength is estimated from how much the means differ beyond what the spread within
them explains (analysis of variance, weighed by numbers of rows), so that a sparse site stays near the prior. Where every
site has one document, nothing tells sites from chance and all stay near the prior. A document's score adds to its own log odds what
its path's posterior says beyond the share of all.

Learning takes at most `most` labelled rows of each kind, the first by a hash of doc_id, where crc32(doc_id)
mod 5 is not 0; sites are summed over all documents. Null texts count as empty; null hosts and paths
are sites of their own. Repeated rows count as often as they come. Without labels of both kinds the
evidence is 0.5 throughout. An empty table gives an empty result; columns that aren't named are not read.

Pages have a host and a path in their address (site()); documents without one have their source as host
and their language as path, which are few and never sparse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blocks, map_batches, span_hashes, word_spans, written

MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*!|<>{}[]=~^_\\/@")] = True
N_FEATURES = 10


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares and lengths that tell prose from junk, one row for each text."""
    n_docs = len(offs) - 1
    n = np.diff(offs)
    size = np.maximum(n, 1).astype(np.float64)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs]) / size
    s, e, first = word_spans(buf, offs)
    words = np.maximum(np.diff(first), 1)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    per_word = lambda x: np.bincount(doc, weights=x, minlength=n_docs) / words
    h = span_hashes(buf, s, e)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    unique = np.bincount(doc[order], weights=fresh, minlength=n_docs) / words
    alone = (e - s == 1) & MARKS[buf[np.minimum(s, max(len(buf) - 1, 0))]] if len(s) else np.zeros(0, bool)
    odd_end = MARKS[buf[e - 1]] if len(e) else np.zeros(0, bool)
    return np.stack(
        [
            share(MARKS[buf]),
            share((buf >= 65) & (buf <= 90)),
            share((buf >= 48) & (buf <= 57)),
            share(buf == 10),
            share((buf == 46) | (buf == 44)),
            per_word((e - s).astype(float)) / 10,
            unique,
            per_word(alone.astype(float)),
            per_word(odd_end.astype(float)),
            np.log1p(np.diff(first)) / 5,
        ],
        1,
    )


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    loss = lambda b: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b))).sum() + ridge / 2 * b[:-1] @ b[:-1]
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ beta)))
        pull = np.append(beta[:-1], 0) * ridge
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([ridge] * (x.shape[1] - 1) + [1e-6]), x.T @ (weight * (p - y)) + pull)
        while loss(beta - move) > loss(beta) and np.abs(move).max() > 1e-9:
            move = move / 2
        beta = beta - move
    return beta


class Evidence:
    """The document's own classifier."""

    def __init__(self, mean=None, scale=None, beta=None):
        self.mean, self.scale, self.beta = mean, scale, beta

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, prior: float) -> Evidence:
        if len(y) == 0 or y.min() == y.max():
            return cls()
        mean, scale = x.mean(0), x.std(0) + 1e-6
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        return cls(mean, scale, _logistic((x - mean) / scale, y, weight))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.mean) / self.scale, -20, 20) @ self.beta[:-1] + self.beta[-1]
        return np.clip(1 / (1 + np.exp(-z)), 1e-4, 1 - 1e-4)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 3000) -> Evidence:
    rows = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id", F.lit(5))
    sample = rows.where("y = 1").orderBy(place, "doc_id").limit(most).union(rows.where("y = 0").orderBy(place, "doc_id").limit(most))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch):
        for a, b, buf, offs in blocks(batch.column(2), 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(features(buf, offs).tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # The driver gathers features, no texts.
    marked = map_batches(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "y", "text"], run, f"doc_id {kind}, y int, x array<double>")
    got = marked.orderBy(place, "doc_id").collect()
    return Evidence.fit(np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.y for r in got]), counts.get(1, 0) / max(1, sum(counts.values())))


def site(url: Column) -> tuple[Column, Column]:
    """Host (in small letters, without www. or m.) and the first part of the path of an address; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^(?:www|m)\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return F.when(host != "", host), F.when(path != "", path)


def page_text(html: Column) -> Column:
    """What a page says: scripts, styles, comments and tags go, line ends stay for blocks, and basic entities are read."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|nav|article|section|title|head)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def _strength(mean: Column, between: Column) -> Column:
    """Rows that the prior counts for: mean (1 - mean) / variance between groups - 1, kept in [1, 10000]."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.coalesce(mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(10000.0))))


def _between(groups: Column, above: Column, rows: Column, squares: Column, squares_above: Column, every: Column, sizes: Column) -> Column:
    """Variance of the groups' true means around those of the level above.

    groups, above: how many; rows: in all; squares: sum of n mean^2 of the groups, squares_above that of the level above; every: sum of squared
    rows; sizes: sum of n^2 / n of the level above.
    """
    more = F.nullif(groups - above, F.lit(0))
    chance = F.greatest(F.lit(0.0), every - squares) / F.nullif(rows - groups, F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.0), ((squares - squares_above) / more - chance) / F.nullif((rows - sizes) / more, F.lit(0.0))), F.lit(0.0))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posterior(docs: DataFrame, evidence: Evidence, host: Column, path: Column) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, score, keep (1 if score >= 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(evidence)

    def run(batch):
        for a, b, buf, offs in blocks(batch.column(1)):
            p = held.value(features(buf, offs))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in (0, 2, 3)], pa.array(p)], ["doc_id", "host", "path", "p_doc"])

    named = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("x"), host.cast("string")), F.lit("-")).alias("host"), F.coalesce(F.concat(F.lit("x"), path.cast("string")), F.lit("-")).alias("path"))
    rows = written(map_batches(named, ["doc_id", "text", "host", "path"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, host string, path string, p_doc double"), "evidence")
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("ss")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("ss").alias("host_ss"), F.count("*").alias("n_paths"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("in_paths"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    hosts = written(hosts, "hosts")
    total, n = F.sum("host_s"), F.sum("host_n")
    in_hosts, every = F.sum(F.col("host_s") * F.col("host_s") / F.col("host_n")), F.sum("host_ss")
    between = _between(F.count("*"), F.lit(1), n, in_hosts, total * total / n, every, F.sum(F.col("host_n") * F.col("host_n")) / n)
    within = _between(F.sum("n_paths"), F.count("*"), n, F.sum("in_paths"), in_hosts, every, F.sum(F.col("n2") / F.col("host_n")))
    whole = hosts.agg((total / n).alias("mean"), between.alias("between"), within.alias("within"))
    m = F.col("mean")
    k = _strength(m, F.col("between"))
    by_host = hosts.withColumn("_all", whole.select(F.struct("mean", "between", "within")).scalar()).select("host", "host_n", "host_s", "_all.*").withColumn("p_host", (F.col("host_s") + k * m) / (F.col("host_n") + k))
    k = _strength(F.col("p_host"), F.col("within"))
    sites = paths.join(by_host, "host").select("host", "path", "mean", "p_host", ((F.col("s") + k * F.col("p_host")) / (F.col("n") + k)).alias("p_path"))
    z = _logit(F.col("p_doc")) + _logit(F.col("p_path")) - _logit(F.col("mean"))
    return rows.join(sites, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-z))).select("doc_id", "p_doc", "p_host", "p_path", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
