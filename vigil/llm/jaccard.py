"""Self-join of documents by Jaccard similarity of word shingles, with adaptive multi-match prefixes.

Copies come first: documents with equal shingle sets form a class, and its smallest doc_id
stands for it. Every set is put in one order: frequent shingles last and by their counts, else by
hash. Two sets
that link share at least L shingles within their first n - ceil(t n) + L, for any L; each
document's L is chosen by what the posting lists of its prefix would cost (longer lists: a
longer prefix, and as many more shared shingles asked of a pair before it is verified), and is
at most ceil(t n), what every link of a set of n shares at least.
A pair needs the smaller of its two L. Pairs are verified on keyed 64-bit shingle hashes, and sets
count as equal by 128 bits of a second, independent family.

Which shingles count as frequent may be any set without changing the result; it is summed
from what recurs within batches, and at most FREQUENT of them are broadcast. Posting lists that
stay longer than LONG (large groups of near copies) aren't expanded into pairs: their
documents are compared block by block, blocks being cut by set size, bytes and hash, as one matrix
product each; this compares every pair of such a group, so no link is lost.

Null and empty texts have no shingles: they link with nothing and are their own class. Fewer
words than a shingle make one shingle of all words. doc_id is taken to identify a text;
repeated rows give repeated, equal results. A row without doc_id has its n_shingles; it takes the
component of documents with the same set, links with nothing else, and else has no component. An
empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .text import LOWER, blocks, forget, map_batches, mix, span_hashes, word_spans, written

FREQUENT, LONG, BLOCK_ROWS, BLOCK_BYTES = 1 << 18, 256, 1024, 8 << 20
#: Sets that a task remembers, so as to send copies of them once.
REMEMBERED = 200_000
#: How often a shingle recurs in a batch to be counted, and in all to be put last.
RECURS, OFTEN = 4, 64
EXTRA = (1, 2, 4, 8)
#: What verifying one candidate costs, in posting rows.
VERIFY = 20


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, joined, and their n + 1 offsets. Each seed has hashes of its own."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offs)
    h = span_hashes(low, starts, ends, seed)
    sets, sizes, a = [], np.zeros(len(offs), np.int64), first.tolist()
    if len(h) >= words:
        rolled = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            rolled = mix(rolled + h[k : len(h) - words + 1 + k] + np.uint64(k + 1))
    for i in range(len(a) - 1):
        n = a[i + 1] - a[i]
        if n >= words:
            u = np.unique(rolled[a[i] : a[i + 1] - words + 1])
        elif n:
            x = np.full(1, 0x5151 + n, np.uint64)
            for k in range(a[i], a[i + 1]):
                x = mix(x * np.uint64(3) + h[k])
            u = x
        else:
            continue
        sets.append(u)
        sizes[i + 1] = len(u)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes)


def _keys(toks: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of each set: the sum of its mixed shingles; 0 for an empty set."""
    keys, full = np.zeros(len(at) - 1, np.uint64), np.diff(at) > 0
    if len(toks):
        keys[full] = np.add.reduceat(mix(toks + np.uint64(seed)), at[:-1][full])
    return keys


def _signatures(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, n, s1 (the key), s2 of each document; besides, rows without kind 0 hold recurring shingles (s1) and their count (n)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch):
        seen = []
        for a, b, buf, offs in blocks(batch.column(1)):
            toks, at = shingle_sets(buf, offs, words)
            other, o_at = shingle_sets(buf, offs, words, 1)
            n = np.diff(at)
            s1, s2 = _keys(toks, at, seed), _keys(other, o_at, 0)
            if len(toks):
                seen.append(toks)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(np.zeros(b - a, np.int32))], names)
        if seen:
            t, c = np.unique(np.concatenate(seen), return_counts=True)
            t, c = t[c >= RECURS], c[c >= RECURS]
            z = np.zeros(len(t), np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(t), batch.schema.field(0).type), pa.array(c.astype(np.int64)), pa.array(t.view(np.int64)), pa.array(z), pa.array(z.astype(np.int32) + 1)], names)

    names = ["doc_id", "n", "s1", "s2", "kind"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, n long, s1 long, s2 long, kind int")


def _kept_for(n, top: int, bottom: int):
    """Shingles in the plain prefix (L = 1) of a set of n: n - ceil(n top / bottom) + 1."""
    return n - (n * top + bottom - 1) // bottom + 1


def _prefixes(docs: DataFrame, frequent: np.ndarray, words: int, top: int, bottom: int, seed: int) -> DataFrame:
    """token, key, n, pos: the longest prefix that any L may ask for. A set goes by its key and comes once from a task that can remember it."""
    by_hash = np.argsort(frequent)  # frequent comes with the most frequent first
    held = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash))
    longest = EXTRA[-1]
    seen: set[bytes] = set()

    def run(batch):
        often, rank = held.value
        for a, b, buf, offs in blocks(batch.column(1)):
            toks, at = shingle_sets(buf, offs, words)
            if not len(toks):
                continue
            late = np.full(len(toks), -1)
            if len(often):
                i = np.minimum(np.searchsorted(often, toks), len(often) - 1)
                late = np.where(often[i] == toks, rank[i], -1)
            keys = _keys(toks, at, seed).view(np.int64)
            picked, rows, pos = [], [], []
            for d, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if e == s or (known := hashlib.blake2b(toks[s:e], digest_size=16).digest()) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(known)
                k = min(e - s, _kept_for(e - s, top, bottom) + longest - 1)
                u, f = toks[s:e], late[s:e]
                got = u[f < 0][:k]
                if len(got) < k:
                    last = f >= 0
                    got = np.concatenate([got, u[last][np.argsort(-f[last])][: k - len(got)]])
                picked.append(got)
                rows.append(np.full(k, d))
                pos.append(np.arange(k, dtype=np.int32))
            if not rows:
                continue
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64)), pa.array(keys[rows]), pa.array(np.diff(at)[rows].astype(np.int32)), pa.array(np.concatenate(pos))], ["token", "key", "n", "pos"])

    return map_batches(docs, ["doc_id", "text"], run, "token long, key long, n int, pos int")


def shingles(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, tokens: the packed set of each document, as sorted 64-bit hashes."""

    def run(batch):
        for a, b, buf, offs in blocks(batch.column(1)):
            toks, at = shingle_sets(buf, offs, words)
            raw, cut = toks.tobytes(), (at * 8).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([raw[s:e] for s, e in zip(cut, cut[1:])], pa.binary())], ["doc_id", "tokens"])

    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, top: int, bottom: int) -> DataFrame:
    """The pairs (a, b) that link. The set of b travels to a's group; a's comes once.

    Both joins sort and merge at every size, so that sets move once, for either side.
    """
    sides = pairs.hint("merge").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("theirs")), "b").select("a", "b", "theirs")
    own = sets.join(pairs.select(F.col("a").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("key"), F.col("tokens").alias("mine"))

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(right), bool)
        if len(left) and len(right):
            x = np.frombuffer(left["mine"].iloc[0], np.uint64)
            for i, raw in enumerate(right["theirs"]):
                y = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = int((x[at] == y).sum())
                keep[i] = same * bottom >= top * (len(x) + len(y) - same)
        return right.loc[keep, ["a", "b"]]

    kind = dict(pairs.dtypes)["a"]
    return own.groupBy("key").cogroup(sides.groupBy("a")).applyInPandas(check, f"a {kind}, b {kind}")


def _dense(rows: DataFrame, sets: DataFrame, sizes: DataFrame, top: int, bottom: int) -> DataFrame:
    """rows (doc_id, n, pool): every pair of a pool, compared in blocks.

    Gives doc_id, other (a spanning link of its block, or itself) and linked (members of the classes linked to it in that block).
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(bottom / top))).cast("int")
    rows = rows.withColumn("band", band)
    parts = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") * 8 / BLOCK_BYTES)
    counts = rows.groupBy("pool", "band").agg(F.ceil(parts).cast("int").alias("parts"))
    cut = rows.join(counts, ["pool", "band"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
    one = counts.select("pool", F.col("band").alias("x_band"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x_part"))
    two = one.select("pool", F.col("x_band").alias("y_band"), F.col("x_part").alias("y_part"))
    after = ((F.col("y_band") == F.col("x_band")) & (F.col("y_part") >= F.col("x_part"))) | (F.col("y_band") == F.col("x_band") + 1)
    meets = one.join(two, "pool").where(after).withColumn("meet", F.struct("x_band", "x_part", "y_band", "y_part"))
    left = meets.select("pool", F.col("x_band").alias("band"), F.col("x_part").alias("part"), "meet", F.lit(0).alias("side"))
    right = meets.where((F.col("x_band") != F.col("y_band")) | (F.col("x_part") != F.col("y_part"))).select("pool", F.col("y_band").alias("band"), F.col("y_part").alias("part"), "meet", F.lit(1).alias("side"))
    full = cut.join(sets, "doc_id").join(sizes, "doc_id")
    placed = full.join(left.union(right), ["pool", "band", "part"]).select("pool", "meet.*", "side", "doc_id", "size", "tokens")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "doc_id"])
        ids, side, weight = pdf["doc_id"].to_numpy(), pdf["side"].to_numpy(), pdf["size"].to_numpy()
        toks = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        n = np.array([len(t) for t in toks])
        vocab, inverse, df = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
        shared = np.cumsum(df > 1) - 1
        row, col = np.repeat(np.arange(len(toks)), n), inverse
        keep = df[col] > 1
        row, col = row[keep], shared[col[keep]]
        m = np.zeros((len(toks), len(toks)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for c in range(0, int((df > 1).sum()), 4096):
            s, e = np.searchsorted(col, [c, c + 4096])
            x = np.zeros((len(toks), 4096), np.float32)
            x[row[s:e], col[s:e] - c] = 1
            m += x @ x.T
        same = m.astype(np.int64)
        link = same * bottom >= top * (n[:, None] + n[None, :] - same)
        np.fill_diagonal(link, False)
        if tuple(pdf[["x_band", "x_part"]].iloc[0]) != tuple(pdf[["y_band", "y_part"]].iloc[0]):
            link &= side[:, None] != side[None, :]
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label, np.where(link, label[None, :], len(ids)).min(1, initial=len(ids)))
            low = low[low]
            if (low == label).all():
                break
            label = low
        return pd.DataFrame({"doc_id": ids, "other": ids[label], "linked": link @ weight})

    kind = dict(rows.dtypes)["doc_id"]
    return placed.groupBy("pool", "x_band", "x_part", "y_band", "y_part").applyInPandas(compare, f"doc_id {kind}, other {kind}, linked long")


def jaccard_join(docs: DataFrame, words: int = 3, top: int = 90, bottom: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set), n_links (linked documents)."""
    seed = 0
    while True:
        first = written(_signatures(docs, words, seed), "signatures")
        own = first.where("kind = 0").select("doc_id", "n", "s1", "s2")
        # Written, so that its join has an exchange of its own and Spark can split a large class.
        classes = own.where("n > 0").groupBy("s1").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("size"), F.count("*").alias("rows"), *[f(c).alias(f"{c}_{at}") for c in ("n", "s2") for at, f in (("low", F.min), ("high", F.max))])
        classes = written(classes.where("rows > 1"), "classes")
        if classes.where("n_low <> n_high OR s2_low <> s2_high").isEmpty():
            break
        forget(first, classes)
        seed += 1  # different sets had one key
    held = classes.select("s1", F.col("n_low").alias("n"), "rep", "size")
    members = written(
        own.join(held.hint("merge"), ["n", "s1"], "left").select("doc_id", "n", F.col("s1").alias("key"), F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("size", F.lit(1)).cast("long").alias("size")),
        "members",
    )
    often = first.where("kind = 1").groupBy(F.col("s1").alias("token")).agg(F.sum("n").alias("df")).where(F.col("df") >= OFTEN)
    frequent = often.orderBy(F.desc("df"), "token").limit(FREQUENT).select("token").toArrow()["token"].to_numpy().view(np.uint64)
    forget(first, classes)
    named = members.where("n > 0 AND doc_id = rep").select("key", "rep").distinct()

    # Postings move once: copies from several tasks meet at their shingle, where they are counted too.
    met = _prefixes(docs.where("doc_id IS NOT NULL"), frequent, words, top, bottom, seed).repartition("token").dropDuplicates(["token", "key"])
    posts = written(met.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1"), "posts")

    # L of each document, by the cost of its posting lists and of the candidates they leave.
    plain = F.expr(f"n - (n * {top} + {bottom - 1}) div {bottom} + 1")
    of_set = Window.partitionBy("key")
    cost = {f"c{x}": F.sum(F.when(F.col("pos") < plain + (x - 1), F.col("df") - 1).otherwise(0)).over(of_set) for x in EXTRA}
    least = F.expr(f"(n * {top} + {bottom - 1}) div {bottom}")
    price = [F.when(least >= x, F.col(f"c{x}") * (1 + VERIFY / x)).otherwise(float("inf")) for x in EXTRA]
    chosen = F.lit(EXTRA[-1])
    for x, p in list(zip(EXTRA, price))[::-1]:
        chosen = F.when(p <= F.least(*price), F.lit(x)).otherwise(chosen)
    asked = posts.repartition("key").withColumns(cost).withColumn("need", chosen)
    posted = written(asked.where(F.col("pos") < plain + F.col("need") - 1).select("token", "key", "n", "need", "df"), "posted")
    forget(posts)

    short = posted.where(F.col("df") <= LONG)
    long = written(posted.where(F.col("df") > LONG).select("token", "key", "n").join(named.hint("merge"), "key").select("token", F.col("rep").alias("doc_id"), "n"), "long")
    lists = long.groupBy("token").agg(F.min("doc_id").alias("b"))
    has_pools = not lists.isEmpty()
    if has_pools:
        stars = long.join(lists, "token").select(F.col("doc_id").alias("a"), "b")
        pools = written(connected_components(stars).withColumnsRenamed({"node": "doc_id", "component": "pool"}), "pools")

    short = short.select("token", "key", "n", "need").repartition("token")
    x = short.select("token", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("need").alias("need_a"))
    y = short.select("token", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("need").alias("need_b"))
    near = (F.col("n_a") * bottom >= F.col("n_b") * top) & (F.col("n_b") * bottom >= F.col("n_a") * top)
    met = x.join(y, "token").where((F.col("a") < F.col("b")) & near)
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.least("need_a", "need_b")).alias("need")).where(F.col("shared") >= F.col("need")).select("a", "b")
    near_keys = written(pairs, "near")
    forget(posted)
    for side in ("a", "b"):  # from keys to the smallest doc_id of the set
        near_keys = near_keys.join(named.select(F.col("key").alias(side), F.col("rep").alias(f"_{side}")).hint("merge"), side).drop(side)
    pairs = near_keys.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    if has_pools:
        pa_, pb = pools.select(F.col("doc_id").alias("a"), F.col("pool").alias("pool_a")), pools.select(F.col("doc_id").alias("b"), F.col("pool").alias("pool_b"))
        pairs = pairs.join(pa_, "a", "left").join(pb, "b", "left").where(F.col("pool_a").isNull() | F.col("pool_b").isNull() | (F.col("pool_a") != F.col("pool_b"))).select("a", "b")
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    if has_pools:
        wanted = wanted.union(pools.select("doc_id"))
    # Texts move to the wanted ids in the same way at every size.
    sets = written(shingles(docs.select("doc_id", "text").join(wanted.distinct().hint("merge"), "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "sets")

    links = written(_verified(pairs, sets, top, bottom), "verified")
    sizes = members.where("doc_id = rep").select("doc_id", "size").distinct()
    back = links.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).union(links.select("b", "a"))
    counted = back.join(sizes.withColumnRenamed("doc_id", "other"), "other").select("doc_id", F.col("size").alias("linked"))
    if has_pools:
        rows = long.select("doc_id", "n").distinct().join(pools, "doc_id")
        blocks_ = written(_dense(rows, sets, sizes, top, bottom), "dense")
        counted = counted.union(blocks_.select("doc_id", "linked"))
        links = links.union(blocks_.where("doc_id != other").select("doc_id", "other"))
    forget(sets, pairs, long)
    components = connected_components(links).withColumnRenamed("node", "rep")
    counted = counted.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("linked").alias("linked"))
    by_class = written(components.join(counted, "rep", "left"), "by-class")  # its own table, so that a class of very many copies can be split
    return members.join(by_class, "rep", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"),
        F.col("rep").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"),
    )
