"""Approximate nearest neighbours by a permutation index.

Each vector is represented by the order of its nearest pivots, and posted in the inverted
files of the first `posted` of them. A query probes the files of its own first `probed` pivots,
ranks what it finds there by footrule distance (sum of differences of the pivots' places), and
the nearest are ranked again by exact inner product. A pair that meets in several files is
taken in the one that is nearest to the query, so no pair is scored twice.

Pivots are compared by direction. For the largest inner product, the footrule distance f gives
an estimate 1 - f / E of the cosine (E: its mean over random orders), which the vector's length
multiplies; among vectors of one length this is the footrule order itself.

Files are dealt in blocks of about `block` rows, and the queries of a file in groups, so a
pivot that attracts a third of all rows is split. Pivots are `n_pivots` distinct directions chosen
by their hash: a bounded sample; the index covers every row.

Equal vectors are indexed as one, so copies take no share of the pivots, the posted files or the
exact ranking. Its ids come back after that: the k + 1 smallest of a vector suffice, as ties go
to the smaller id and at most one of them is the query's own.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most of the rest (of equally many: the shorter). Rows that
repeat a vec_id count once (the smallest vector by order is kept). Ties in score go to the
smaller vec_id; ties in footrule distance also. An empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import written

N_PIVOTS, POSTED, PROBED = 128, 12, 12
#: Of what a query finds in a file, this share is ranked by exact product, and no fewer than LEAST.
RERANKED, LEAST = 0.08, 200


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(~bad & F.exists(v, lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
    )


def distinct(rows: DataFrame, most: int) -> DataFrame:
    """vec_id, vec, ids: each distinct vector once, with its `most` smallest ids, the first of which is its vec_id."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "vec", "ids")


def directions(rows: DataFrame, n: int) -> np.ndarray:
    """n of the rows' distinct directions at most, as unit vectors: the first by a hash."""

    def ways_of(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy())
                x = x / np.abs(x).max(1)[:, None]
                x = np.round(x / np.sqrt((x**2).sum(1))[:, None], 9) + 0.0
                way = [int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in x]
                yield pd.DataFrame({"vec": pdf["vec"], "way": way})

    hashed = rows.select("vec").mapInPandas(ways_of, "vec array<double>, way long")
    ways = [r.way for r in hashed.select("way").distinct().orderBy("way").limit(n).collect()]
    found = hashed.where(F.col("way").isin(ways)).groupBy("way").agg(F.min("vec").alias("vec")).orderBy("way").collect() if ways else []
    x = np.array([r.vec for r in found], float)
    if len(x):
        x /= np.abs(x).max(1)[:, None]
        x /= np.sqrt((x**2).sum(1))[:, None]
    return x


def permutations(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pivots for each row (nearest first) and each pivot's place in it."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable").astype(np.int16)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int16), order.shape), 1)
    return order, place


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    n_pivots: int = N_PIVOTS,
    posted: int = POSTED,
    probed: int = PROBED,
    reranked: float = RERANKED,
    least: int = LEAST,
    block: int = 4096,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows other than itself."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(distinct(rows, k + 1), "vectors")
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.sum(F.size("ids")).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), "n").select("n").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.where(F.size("vec") == usual.n), asked.where(F.size("vec") == usual.n)
    pivots = directions(rows, n_pivots)
    p_n = len(pivots)
    posted, probed = min(posted, p_n), min(probed, p_n)
    held = spark.sparkContext.broadcast(pivots)

    def listing(n):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["vec"].to_numpy())
                    order, place = permutations(x, held.value)
                    data = [a.tobytes() + b.tobytes() for a, b in zip(x, place)]
                    yield pd.DataFrame({"vec_id": pdf["vec_id"], "ids": pdf["ids"], "data": pd.Series(data, dtype=object), "files": pd.Series([o.tolist() for o in order[:, :n]], dtype=object)})

        return run

    kind = "vec_id long, ids array<long>, data binary, files array<int>"
    posts = rows.mapInPandas(listing(posted), kind).select("vec_id", "ids", "data", F.explode("files").alias("file"))
    asks = asked.withColumn("ids", F.array("vec_id")).mapInPandas(listing(probed), kind).select("vec_id", "data", F.explode("files").alias("file"))
    # At most n_pivots counts each: how many blocks a file has.
    counts = {name: {r.file: r.n for r in df.groupBy("file").agg(F.count("*").alias("n")).collect()} for name, df in (("posts", posts), ("asks", asks))}
    parts = F.array(*[F.lit(-(-counts["posts"].get(f, 0) // block)) for f in range(p_n)])
    teams = F.array(*[F.lit(-(-counts["asks"].get(f, 0) // block)) for f in range(p_n)])
    n_parts, n_teams = F.get(parts, F.col("file")), F.get(teams, F.col("file"))
    dealt = posts.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")).where(n_teams > 0).withColumn("team", F.explode(F.sequence(F.lit(0), n_teams - 1)))
    asking = asks.withColumn("team", F.pmod(F.xxhash64("vec_id"), n_teams).cast("int")).where(n_parts > 0).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))

    def split(pdf, p_n):
        raw = np.frombuffer(b"".join(pdf["data"]), np.uint8).reshape(len(pdf), -1)
        cut = raw.shape[1] - 2 * p_n
        return raw[:, :cut].copy().view(np.float64), raw[:, cut:].copy().view(np.int16)

    def meet(key, have, want):
        out = {"query_id": [], "vec_ids": [], "scores": []}
        if len(have) and len(want):
            have = have.sort_values("vec_id")
            file, ids, all_ids = int(key[0]), have["vec_id"].to_numpy(), have["ids"].tolist()
            alone = np.array([len(a) == 1 for a in all_ids])
            x, place = split(have, p_n)
            long = np.sqrt((x * x).sum(1))
            usual = (p_n * p_n - 1) / 3 or 1.0
            narrow = place.T.astype(np.uint8).copy() if p_n <= 256 else place.T.copy()
            y, q_place = split(want, p_n)
            for qid, q, qp in zip(want["vec_id"].tolist(), y, q_place):
                order = np.argsort(qp)
                nearer = order[: int(qp[file])]
                own = ~(alone & (ids == qid))
                if len(nearer):
                    own &= narrow[nearer].min(0) >= posted
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                keep = max(least, int(np.ceil(reranked * len(ids))))
                if len(at) > keep:
                    far = -long[at] * (1 - np.abs(place[at] - qp).sum(1, dtype=np.int32) / usual)
                    edge = np.partition(far, keep - 1)[keep - 1]
                    sure = np.flatnonzero(far < edge)
                    at = at[np.concatenate([sure, np.flatnonzero(far == edge)[: keep - len(sure)]])]
                score = (x[at] * q).sum(1)
                if len(at) > k:  # each vector has an id other than the query's: the k highest and their ties suffice
                    high = score >= np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[high], score[high]
                named = np.concatenate([all_ids[i] for i in at])
                score = np.repeat(score, [len(all_ids[i]) for i in at])
                named, score = named[named != qid], score[named != qid]
                best = np.lexsort((named, -score))[:k]
                out["query_id"].append(qid)
                out["vec_ids"].append(named[best].tolist())
                out["scores"].append(score[best].tolist())
        return pd.DataFrame({"query_id": pd.Series(out["query_id"], dtype="int64"), **{c: pd.Series(out[c], dtype=object) for c in ("vec_ids", "scores")}})

    met = asking.groupBy("file", "part", "team").cogroup(dealt.groupBy("file", "part", "team")).applyInPandas(lambda key, want, have: meet(key, have, want), "query_id long, vec_ids array<long>, scores array<double>")
    flat = met.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("r")).select("query_id", F.col("r.vec_ids").alias("vec_id"), F.col("r.scores").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
