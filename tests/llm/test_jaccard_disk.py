"""What the join leaves on disk, and sets whose keys collide."""

import os

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import jaccard


def folders(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {n.rsplit("-", 5)[0] for n in os.listdir(root)} if os.path.isdir(root) else set(), root


def test_tables_between_the_steps_are_deleted(spark):
    _, root = folders(spark)
    was = set(os.listdir(root))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: (i + (F.col("id") / 3).cast("int") * 100).cast("string"))).alias("text"))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs).collect()}
    assert got == {i: i // 3 * 3 for i in range(60)}
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - was}
    assert not left & {"signatures", "posts", "posted", "long", "sets"}


def test_different_sets_with_one_key_get_others(spark, monkeypatch):
    real, asked = jaccard._keys, []
    colliding = lambda toks, at, seed: np.where(real(toks, at, seed) != 0, np.uint64(7), 0).astype(np.uint64) if seed == 0 else real(toks, at, seed)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (4, "i j k l m")], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(jaccard, "_keys", colliding)
    kept = jaccard._signatures
    monkeypatch.setattr(jaccard, "_signatures", lambda d, w, seed: asked.append(seed) or kept(d, w, seed))
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)} and asked == [0, 1]
