"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

Documents with equal shingle sets are one node, named by 128 bits of the set. A node has PERMUTATIONS minima
of its shingle hashes. Groups of ROWS minima make BANDS keys; nodes that share a key are candidates. All minima are
folded into an odd sketch: each (place, minimum) flips one of BITS bits, so the bits in which two sketches differ
count, by parity, the minima that differ. `threshold` is the number of bits that a pair at the asked
similarity exceeds with probability MISS; pairs above it are dropped, the others are confirmed on whole sets.
A pair at a similarity of 0.85 shares no band with probability 6e-11, so links are lost with that chance only.

Only components are asked for, so a group of copies isn't expanded into pairs. First each node is confirmed
with the closest of its bands' smallest nodes. What stays apart inside a band then meets in blocks of about 2 * BLOCK
rows: first each node's closest partner of another component is confirmed, then the sets of what is still apart and alike meet,
and each pair of different components is checked in the first band that it shares. Only links that join two components leave a
task, so rows stay in proportion to nodes. A band that holds one component costs nothing further.

Null and empty texts have no shingles: they link with nothing and are kept. Fewer words than a shingle make one
shingle of all words. Rows are told apart by what they say, so rows that repeat a doc_id link as documents of their own;
if doc_id is the component's, each of them is kept. A row without doc_id takes its component's smallest doc_id, or is kept
with a null component if there is none. Very long texts are read whole. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, maybe
from .components import connected_components
from .jaccard import shingle_sets
from .text import blocks, gather, map_batches, mix, written

BANDS, ROWS, PERMUTATIONS, BITS = 32, 4, 256, 512
MISS = 1e-9
#: Nodes of a block, and bytes of their sets; two blocks meet in one task.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Bytes of text whose sets a task makes at once.
SET_BYTES = 1 << 20
_ODD = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_PLACE = mix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(0x51ED27))


def minima(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row for each set that isn't empty: the least of its hashes under each permutation (odd multipliers of mixed hashes)."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), PERMUTATIONS), np.uint64)
    if len(starts):
        scratch = np.empty_like(tokens)
        for k in range(PERMUTATIONS):
            np.multiply(tokens, _ODD[k], out=scratch)
            out[:, k] = np.minimum.reduceat(scratch, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys a row, each of ROWS minima and its place."""
    groups = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), groups.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ groups[:, :, r])
    return key


def sketches(least: np.ndarray) -> np.ndarray:
    """The odd sketch of each row, as words of 64 bits."""
    place = (mix(least ^ _PLACE) % np.uint64(BITS)).astype(np.int64)
    n = len(least)
    odd = np.bincount((np.arange(n)[:, None] * BITS + place).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def similarity(differ: float) -> float:
    """The Jaccard similarity that a number of differing bits stands for."""
    return 1 - math.log(1 - 2 * differ / BITS) / (2 * PERMUTATIONS * math.log(1 - 2 / BITS)) if 2 * differ < BITS else 0.0


def threshold(similar: float, miss: float = MISS) -> int:
    """The fewest bits that a pair of this similarity exceeds with probability below miss.

    Differing minima are binomial; each flips two bits, and the number of odd bits is a walk that goes up from s
    with probability 1 - s / BITS.
    """
    odd = np.zeros(BITS + 1)
    odd[0] = 1
    s = np.arange(BITS + 1) / BITS
    total = np.zeros(BITS + 1)
    for m in range(PERMUTATIONS + 1):
        log = math.lgamma(PERMUTATIONS + 1) - math.lgamma(m + 1) - math.lgamma(PERMUTATIONS - m + 1) + m * math.log(1 - similar) + (PERMUTATIONS - m) * math.log(similar)
        total += math.exp(log) * odd
        for _ in range(2):
            step = np.zeros(BITS + 1)
            step[1:] += (odd * (1 - s))[:-1]
            step[:-1] += (odd * s)[1:]
            odd = step
    above = 1 - np.cumsum(total)
    return int(np.argmax(above < miss))


def _set_keys(tokens: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(tokens[s:e], digest_size=16).digest() if e > s else None for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, key (128 bits of the shingle set), bands, sketch."""

    def lists(values: np.ndarray, full: np.ndarray) -> pa.Array:
        width = values.shape[1]
        offsets = np.concatenate([[0], np.cumsum(np.where(full, width, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64).ravel()))

    def run(batch):
        for a, b, buf, offs in blocks(batch.column(1), SET_BYTES):
            tokens, at = shingle_sets(buf, offs, words)
            least, full = minima(tokens, at), np.diff(at) > 0
            columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(_set_keys(tokens, at), pa.binary()), lists(band_keys(least), full), lists(sketches(least), full)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "bands", "sketch"])

    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, key binary, bands array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key, tokens of the wanted keys. Tasks send the sets whose key a bitmap of fixed size lets through, a join keeps those that are wanted.

    The bitmap is asked where the sets are made: a second step would need a worker more for each core, and batches of all sets on their way to it.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("key").alias("h")), "h"))

    def send(batch):
        import xxhash

        bits = held.value
        for _, _, buf, offs in blocks(batch.column(0), SET_BYTES):
            tokens, at = shingle_sets(buf, offs, words)
            full, keys = np.flatnonzero(np.diff(at) > 0), _set_keys(tokens, at)
            h = np.array([xxhash.xxh64_intdigest(keys[i], 42) for i in full.tolist()], np.uint64)
            sent = full[maybe(bits, h)]
            if len(sent):
                data, cut = gather(at, tokens, sent)
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in sent.tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(data.view(np.int64)))], ["key", "tokens"])

    sent = map_batches(docs, ["text"], send, "key binary, tokens array<bigint>")
    return sent.join(wanted.hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("tokens").alias("tokens"))


def _differ(x: str, y: str) -> str:
    return " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(BITS // 64))


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, top: int, bottom: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    sets = written(full_sets(docs, wanted, words), "sets")
    one = pairs.hint("merge").join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("mine")), "a")
    both = one.hint("merge").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("theirs")), "b")
    same = both.select("a", "b", F.size(F.array_intersect("mine", "theirs")).alias("same"), (F.size("mine") + F.size("theirs")).alias("sizes"))
    return same.where(f"same * {bottom}L >= (sizes - same) * {top}L").select("a", "b")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (token, key, n, ..) with part, low and high: a band is cut into blocks by hash, and each pair of blocks meets in one task."""
    many = F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)
    parts = rows.groupBy("token").agg(F.ceil(many).cast("int").alias("parts"))
    cut = rows.join(parts.hint("merge"), "token").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")


def _by_meeting(rows: DataFrame, meet, schema: str) -> DataFrame:
    """meet(table) -> iterator of RecordBatch, over the rows of each (token, low, high)."""
    place = ["token", "low", "high"]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            at = [table[c].to_numpy() for c in place]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            bounds = [0, *new.tolist()]
            for s, e in zip(bounds, bounds[1:]):
                if e - s > 1:
                    yield from meet(table.slice(s, e - s))
            held = table.slice(bounds[-1])
        if held is not None and held.num_rows > 1:
            yield from meet(held)

    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, schema)


def _lists(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(rows, -1)


def _candidates(table: pa.Table, component: np.ndarray, most: int, top: int, bottom: int):
    """(first row, bits that differ) of 64 rows at a time against all: beyond BITS where a pair is of one component, in one of two blocks, or too unlike."""
    part, n = table["part"].to_numpy(), table["n"].to_numpy()
    sketch = _lists(table["sketch"], len(part))
    one = table["low"][0] == table["high"][0]
    for s in range(0, len(part), 64):
        block = slice(s, s + 64)
        differ = np.bitwise_count(sketch[block, None, :] ^ sketch[None, :, :]).sum(2, dtype=np.int32)
        small, large = np.minimum(n[block, None], n[None, :]), np.maximum(n[block, None], n[None, :])
        bad = (component[block, None] == component[None, :]) | (differ > most) | (small * bottom < large * top)
        if not one:
            bad |= part[block, None] == part[None, :]
        differ[bad] = BITS + 1
        yield s, differ


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    return np.unique(np.array(column.to_pylist(), object), return_inverse=True)[1]


def _closest(rows: DataFrame, most: int, top: int, bottom: int) -> DataFrame:
    """Pairs (a, b): for each row of each band, its closest partner of another component."""

    def meet(table):
        component = _numbered(table["component"])
        if component.max() == 0:
            return
        keys, out = table["key"].to_pylist(), set()
        for s, differ in _candidates(table, component, most, top, bottom):
            for i, j in enumerate(differ.argmin(1).tolist()):
                if differ[i, j] <= most:
                    out.add((min(keys[s + i], keys[j]), max(keys[s + i], keys[j])))
        yield _pairs(out)

    return _by_meeting(rows.select("token", "low", "high", "part", "key", "component", "n", "sketch"), meet, "a binary, b binary").distinct()


def _first_here(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this band is the first that two rows share: a pair is looked at there alone."""
    bands = _lists(table["bands"], table.num_rows)
    token = np.int64(table["token"][0].as_py()).astype(np.uint64)
    here = int((bands[0] == token).argmax())
    return (bands[i] == bands[j]).argmax(1) == here


def _still_open(rows: DataFrame, most: int, top: int, bottom: int) -> DataFrame:
    """token, low, high, part, key of the rows that have a candidate of another component whose first shared band this is."""

    def meet(table):
        component = _numbered(table["component"])
        if component.max() == 0:
            return
        live = np.zeros(table.num_rows, bool)
        for s, differ in _candidates(table, component, most, top, bottom):
            i, j = np.nonzero(differ <= most)
            ok = _first_here(table, s + i, j)
            live[s + i[ok]] = live[j[ok]] = True
        if live.any():
            yield from table.filter(pa.array(live)).select(["token", "low", "high", "part", "key"]).to_batches()

    return _by_meeting(rows.select("token", "low", "high", "part", "key", "component", "n", "sketch", "bands"), meet, "token long, low int, high int, part int, key binary")


def _linked(rows: DataFrame, most: int, top: int, bottom: int) -> DataFrame:
    """Links (a, b) between components of a band, checked on whole sets where they meet; of those that join the same components one is named."""

    def meet(table):
        component = _numbered(table["component"])
        keys, sets = table["key"].to_pylist(), [np.asarray(x) for x in table["tokens"].combine_chunks().to_numpy(zero_copy_only=False)]
        up, out = np.arange(component.max() + 1), set()
        for s, differ in _candidates(table, component, most, top, bottom):
            i, j = np.nonzero(differ <= most)
            ok = _first_here(table, s + i, j)
            i, j = i[ok], j[ok]
            for k in np.argsort(differ[i, j], kind="stable").tolist():
                x, y = s + int(i[k]), int(j[k])
                if up[component[x]] == up[component[y]]:
                    continue
                same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if same * bottom >= top * (len(sets[x]) + len(sets[y]) - same):
                    out.add((min(keys[x], keys[y]), max(keys[x], keys[y])))
                    up[up == up[component[y]]] = up[component[x]]
        yield _pairs(out)

    return _by_meeting(rows, meet, "a binary, b binary").distinct()


def _pairs(out: set) -> pa.RecordBatch:
    both = sorted(out)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary())], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 3, top: int = 85, bottom: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is the smallest)."""
    most = threshold(top / bottom)
    signed = written(signatures(docs, words), "signatures")
    # Two different sets of n shingles or fewer can't link when n / (n + 1) is too small.
    nodes = signed.where(f"n * {bottom} >= (n + 1) * {top}").groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    posts = nodes.select(F.explode("bands").alias("token"), "key")
    shared = posts.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    posts = written(posts.join(shared.hint("merge"), "token"), "posts")

    mine, hubs = nodes.select("key", "n", "sketch"), nodes.select(F.col("key").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    stars = posts.where("key != hub").select("key", "hub").distinct().join(mine.hint("merge"), "key").join(hubs.hint("merge"), "hub")
    stars = stars.withColumn("differ", F.expr(_differ("sketch", "hub_sketch"))).where(f"differ <= {most} AND least(n, hub_n) * {bottom} >= greatest(n, hub_n) * {top}")
    closest = stars.groupBy("key").agg(F.min(F.struct("differ", "hub")).alias("x")).select(F.least("key", "x.hub").alias("a"), F.greatest("key", "x.hub").alias("b"))
    tested = written(closest.distinct(), "pairs")
    links = written(_confirmed(tested, docs, words, top, bottom), "confirmed")
    component = written(connected_components(links), "components")

    def apart() -> DataFrame:
        """Rows of the bands that hold more than one component, dealt into blocks."""
        placed = posts.join(component.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("token", "key", F.coalesce("component", "key").alias("component"))
        mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
        return written(_dealt(placed.join(mixed.hint("merge"), "token", "left_semi").join(nodes.hint("merge"), "key")), "apart")

    pairs = written(_closest(apart(), most, top, bottom).join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    links = links.union(written(_confirmed(pairs, docs, words, top, bottom), "confirmed"))
    component = written(connected_components(links), "components")

    rest = apart()
    live = written(_still_open(rest, most, top, bottom), "open")
    sets = written(full_sets(docs, live.select("key").distinct(), words), "sets")
    met = live.join(rest.hint("merge"), ["token", "low", "high", "part", "key"]).join(sets.hint("merge"), "key")
    last = written(_linked(met.select("token", "low", "high", "part", "key", "component", "n", "sketch", "bands", "tokens"), most, top, bottom), "linked")
    component = written(connected_components(links.union(last)), "components")

    named = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("low")).join(component.withColumnRenamed("node", "key").hint("merge"), "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_key = written(named.join(least.hint("merge"), "component").select("key", "component_id"), "by-key")  # its own table, so that a set of very many copies can be split
    out = signed.select("doc_id", "n", "key").join(by_key.hint("merge"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT a, b FROM met WHERE 100 * c >= 85 * (n_a + n_b - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r
), lowest AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""
