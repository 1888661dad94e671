"""Collocations: phrases of two to four words that recur, scored by their parts, by direct-address tiles of ranked ids.

Level by level, adjacent units are counted: first word and word, then frequent pair and next word, then frequent triple
and next word. The RANKED most frequent units and words have ids by rank. A task places a pair of ids in
tiles of TILE x TILE cells: tiles where frequent meets frequent are dense arrays that bincount fills, the others hold
sorted coordinates with counts. Pairs with a part that has no rank are sorted coordinates of word hashes.
Tiles travel whole and are added up, the rest is merged by buckets of a hash; phrases of `least` occurrences or more are re-ranked as the units of the next level.

A phrase can't be more frequent than its parts, so only places whose unit and whose last words were frequent a level below are
counted; from three words on, phrases are also counted by slots of a hash first, and those in slots with fewer than `least` are left out, as they can't reach it. Tasks look that up in a ranked table and a bitmap, both of fixed size at any size of the corpus: a phrase
that a bitmap lets through wrongly is counted in vain, never reported.

Words are 64-bit hashes of language and word. The vocabulary is grouped by hash: if two words of the corpus share one, another seed is
taken, so counts are exact. Phrases are tuples of such hashes.

Null texts are empty; a null language is `und`. Repeated rows count again. Very long texts are read whole, in one block each. An
empty table gives an empty result. Ties stand in the order of the phrase's UTF-8 bytes. doc_id and further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, maybe
from .text import LOWER, blocks, map_batches, mix, span_hashes, written

#: Units and words that have a rank at each level, and the side of a tile.
RANKED, TILE = 1 << 16, 256
#: Tiles (i, j) with (i + 1) (j + 1) at most DENSE are dense arrays.
DENSE = 16
#: Coordinates that a task holds before they go out.
HELD = 1 << 21
#: Slots that phrases of three and more words are counted in beforehand, and the parts that these travel in.
SLOTS, PARTS = 1 << 22, 64
#: Words of the corpus for each bucket of unranked phrases.
BUCKET = 1 << 20
LONGEST = 4
_BREAK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True  # fixed values: what parts pieces
_SPACE[[0x20, 0x09]] = True  # fixed values: what parts words


def lang_seeds(langs: pa.Array) -> np.ndarray:
    names = [b"und" if x is None else x.encode() for x in langs.to_pylist()]
    known = {x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in set(names)}
    return np.array([known[x] for x in names], np.uint64)


def words(buf: np.ndarray, offs: np.ndarray, seeds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: hash, start and end of each word, its document, and whether it continues the piece of the word before it."""
    low = LOWER[buf]
    n = len(low)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, np.zeros(0, bool)
    word = ~(_BREAK | _SPACE)[low]
    start, end = np.empty(n, bool), np.empty(n, bool)
    start[0], end[-1] = word[0], word[-1]
    np.logical_and(word[1:], ~word[:-1], out=start[1:])
    np.logical_and(word[:-1], ~word[1:], out=end[:-1])
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] |= word[cut]
    end[cut - 1] |= word[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    broken = np.concatenate([[0], np.cumsum(_BREAK[low])])
    joined = np.zeros(len(starts), bool)
    if len(starts):
        joined[1:] = (broken[starts[1:]] == broken[ends[:-1]]) & (doc[1:] == doc[:-1])
    return mix(span_hashes(low, starts, ends, seed) ^ seeds[doc]), starts, ends, doc, joined


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h (its hash), c (its count), as each task found it."""

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in blocks(batch.column(1)):
                langs = batch.column(0).slice(a, b - a)
                h, starts, ends, doc, _ = words(buf, offs, lang_seeds(langs), seed)
                if len(h):
                    low = LOWER[buf].tobytes()
                    u, at, c = np.unique(h, return_index=True, return_counts=True)
                    names = pa.array([low[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(doc[at])).fill_null("und"), names, pa.array(u.view(np.int64)), pa.array(c)], ["lang", "word", "h", "c"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, h long, c long")


def _fold(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of a tuple of word hashes."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * np.uint64(3) ^ c)
    return h


class Units:
    """What tasks know of a level's frequent phrases: the most frequent ones by rank, all of them as a bitmap. Word hashes tell them apart."""

    def __init__(self, top: np.ndarray, bits: np.ndarray):
        self.tuples, self.bits = top, bits
        folded = _fold(list(top.T)) if len(top) else np.zeros(0, np.uint64)
        self.order = np.argsort(folded, kind="stable")
        self.sorted = folded[self.order]

    def ranks(self, columns: list[np.ndarray], folded: np.ndarray) -> np.ndarray:
        """The rank of each tuple, or -1."""
        if not len(self.sorted):
            return np.full(len(folded), -1)
        at = np.minimum(np.searchsorted(self.sorted, folded), len(self.sorted) - 1)
        rank = self.order[at]
        same = np.ones(len(folded), bool)
        for k, c in enumerate(columns):
            same &= self.tuples[rank, k] == c
        return np.where(same, rank, -1)


class Tiles:
    """What a task has counted: dense tiles, and coordinates of ranked pairs and of tuples, merged when they grow."""

    def __init__(self, ranked: int, side: int, dense: int):
        self.side, self.across = side, ranked // side
        most = min(dense, self.across)
        self.first = [(i, j) for i in range(most) for j in range(most) if (i + 1) * (j + 1) <= dense]
        self.number = np.full((self.across, self.across), -1, np.int32)
        for n, at in enumerate(self.first):
            self.number[at] = n
        self.dense = np.zeros(len(self.first) * side * side, np.int64)
        self.codes: list[tuple[np.ndarray, np.ndarray]] = []
        self.tuples: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, columns: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> None:
        """Counts one phrase a row: its word hashes, the rank of all but the last word, the rank of the last."""
        side, ranked = self.side, (left >= 0) & (right >= 0)
        x, y = left[ranked], right[ranked]
        tile = self.number[x // side, y // side]
        cell = x % side * side + y % side
        hot = tile >= 0
        if hot.any():
            self.dense += np.bincount(tile[hot] * (side * side) + cell[hot], minlength=len(self.dense))
        code, c = np.unique((x[~hot] << 16) | y[~hot], return_counts=True)
        self.codes.append((code, c))
        rest = ~ranked
        if rest.any():
            t, n = _counted(np.stack([c[rest] for c in columns], 1))
            self.tuples.append((t, n))
            self.held += len(t)
        self.held += len(code)

    def packed(self):
        """(tile, cells, counts) of what was counted by rank, one tile after the other."""
        side = self.side
        for number, (i, j) in enumerate(self.first):
            n = self.dense[number * side * side : (number + 1) * side * side]
            cells = np.flatnonzero(n)
            if len(cells):
                yield i * self.across + j, cells, n[cells]
        if self.codes:
            code, order = np.unique(np.concatenate([c for c, _ in self.codes]), return_inverse=True)
            n = np.bincount(order, np.concatenate([c for _, c in self.codes]), len(code)).astype(np.int64)
            x, y = code >> 16, code & 0xFFFF
            tile, cell = x // side * self.across + y // side, x % side * side + y % side
            order = np.argsort(tile, kind="stable")
            tile, cell, n = tile[order], cell[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, int)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)]):
                yield int(tile[s]), cell[s:e], n[s:e]

    def sparse(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(word hashes, counts) of what has a part without a rank."""
        return _counted(np.concatenate([t for t, _ in self.tuples]), np.concatenate([c for _, c in self.tuples])) if self.tuples else None

    def clear(self) -> None:
        self.dense[:] = 0
        self.codes, self.tuples, self.held = [], [], 0


def _counted(tuples: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs, sorted by one hash."""
    order = np.argsort(_fold(list(tuples.T)), kind="stable")
    t = tuples[order]
    f = _fold(list(t.T))
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]).any(1)
    if (new[1:] & (f[1:] == f[:-1])).any():  # different words share a hash: in the order of all words equal ones are neighbours
        order = np.lexsort(tuples.T)
        t = tuples[order]
        new[1:] = (t[1:] != t[:-1]).any(1)
    starts = np.flatnonzero(new)
    w = np.ones(len(t), np.int64) if weights is None else weights[order]
    return t[starts], np.add.reduceat(w, starts) if len(starts) else np.zeros(0, np.int64)


def _phrases(column: pa.Array, langs: pa.Array, size: int, bits: np.ndarray, crowded: np.ndarray | None, seed: int):
    """Word hashes of the phrases of each block whose first and last size - 1 words may be frequent, and which may be themselves by their slot."""
    for a, b, buf, offs in blocks(column):
        h, _, _, _, joined = words(buf, offs, lang_seeds(langs.slice(a, b - a)), seed)
        n = len(h) - size + 1
        if n <= 0:
            continue
        whole = np.ones(n, bool)
        for k in range(1, size):
            whole &= joined[k : k + n]
        at = np.flatnonzero(whole)
        keep = maybe(bits, _fold([h[at + k] for k in range(size - 1)])) & maybe(bits, _fold([h[at + k] for k in range(1, size)]))
        columns = [h[at[keep] + k] for k in range(size)]
        if crowded is not None and len(columns[0]):
            keep = maybe(crowded, _fold(columns))
            columns = [c[keep] for c in columns]
        if len(columns[0]):
            yield columns


def _crowded(docs: DataFrame, size: int, bits: np.ndarray, seed: int, least: int) -> np.ndarray:
    """A bitmap of the slots that hold at least `least` phrases of this size in all: what falls elsewhere is not frequent.

    Tasks count hashes in an array of fixed size and send it in parts, which are added up one after the other.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits)
    kind = np.uint8 if least < 256 else np.uint32

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for columns in _phrases(batch.column(1), batch.column(0), size, held.value, None, seed):
                n += np.bincount((_fold(columns) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        parts = np.minimum(n, least).astype(kind).reshape(PARTS, -1)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used.tolist()], pa.binary())], ["part", "counts"])

    def add(batches):
        part, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != part:
                    if part is not None:
                        yield done()
                    part, total = k, np.zeros(SLOTS // PARTS, np.int64)
                total += np.frombuffer(raw, kind)
        if part is not None:
            yield done()

    sums = docs.select("lang", "text").mapInArrow(count, "part int, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary")
    out = np.zeros((PARTS, SLOTS // PARTS // 64), np.uint64)
    for r in sums.collect():  # PARTS rows of fixed size
        out[r.part] = np.frombuffer(r.bits, np.uint64)
    return out.ravel()


def _level(docs: DataFrame, size: int, units: Units, vocabulary: Units, seed: int, crowded: np.ndarray | None, least: int, buckets: int) -> DataFrame:
    """w1 .. w{size}, f: the phrases of `size` words with f >= least.

    A task sends a tile as one row of cells and counts, and its unranked phrases as rows of sorted words and counts by bucket.
    Tiles are added up one after the other in an array of TILE x TILE, buckets by merging; buckets follow the corpus, so one has a like number of phrases at any size.
    """
    held = docs.sparkSession.sparkContext.broadcast((units, vocabulary, crowded))
    names = [f"w{k + 1}" for k in range(size)]
    kind = np.dtype(np.uint16 if TILE * TILE <= 1 << 16 else np.uint32)
    fields = ["tile", "cells", "counts"]

    def out(tiles: Tiles):
        def rows():
            for t, c, n in tiles.packed():
                yield t, c.astype(kind).tobytes(), n.astype(np.uint32).tobytes()
            if (found := tiles.sparse()) is not None:
                w, n = found
                bucket = (_fold(list(w.T)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                w, n, bucket = w[order], n[order], bucket[order]
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(n)]):
                    yield -1 - int(bucket[s]), np.ascontiguousarray(w[s:e]).tobytes(), n[s:e].astype(np.uint32).tobytes()
            tiles.clear()

        batch, weight = [], 0
        for row in rows():
            batch.append(row)
            weight += len(row[1])
            if weight > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), (pa.int64(), pa.binary(), pa.binary()))], fields)
                batch, weight = [], 0
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), (pa.int64(), pa.binary(), pa.binary()))], fields)

    def run(batches):
        units, vocabulary, crowded = held.value
        tiles = Tiles(RANKED, TILE, DENSE)
        for batch in batches:
            for columns in _phrases(batch.column(1), batch.column(0), size, units.bits, crowded, seed):
                tiles.add(columns, units.ranks(columns[:-1], _fold(columns[:-1])), vocabulary.ranks(columns[-1:], columns[-1]))
                if tiles.held > HELD:
                    yield from out(tiles)
        yield from out(tiles)

    def add(batches):
        units, vocabulary, _ = held.value
        tile, total, parts, waiting = None, np.zeros(TILE * TILE, np.int64), [], 0

        def merged():
            return [_counted(np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]))]

        def done():
            if tile < 0:
                w, n = merged()[0]
                w, n = w[n >= least], n[n >= least]
            else:
                cell = np.flatnonzero(total >= least)
                x, y = tile // (RANKED // TILE) * TILE + cell // TILE, tile % (RANKED // TILE) * TILE + cell % TILE
                w, n = np.concatenate([units.tuples[x], vocabulary.tuples[y]], 1), total[cell]
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(w[:, k]).view(np.int64)) for k in range(size)), pa.array(n)], [*names, "f"])

        for batch in batches:
            for t, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if t != tile:
                    if tile is not None:
                        yield done()
                    tile, parts, waiting = t, [], 0
                    total[:] = 0
                n = np.frombuffer(counts, np.uint32).astype(np.int64)
                if t >= 0:
                    total[np.frombuffer(cells, kind)] += n
                    continue
                parts.append((np.frombuffer(cells, np.uint64).reshape(-1, size), n))
                waiting += len(n)
                if waiting > HELD:
                    parts = merged()
                    waiting = 0
        if tile is not None:
            yield done()

    found = docs.select("lang", "text").mapInArrow(run, "tile long, cells binary, counts binary")
    return found.repartition("tile").sortWithinPartitions("tile").mapInArrow(add, ", ".join(f"{w} long" for w in [*names, "f"]))


def _units(table: DataFrame, size: int) -> Units:
    """The ranked units of a level: at most RANKED rows and a bitmap come to the driver."""
    names = [f"w{k + 1}" for k in range(size)]
    top = table.orderBy(F.desc("f"), *names).limit(RANKED).select(*names).toPandas().to_numpy(np.int64).reshape(-1, size).view(np.uint64)

    def fold(batch):
        h = _fold([c.to_numpy().view(np.uint64) for c in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return Units(np.ascontiguousarray(top), bitmap(map_batches(table, names, fold, "h long"), "h"))


def frequent(docs: DataFrame, least: int = 30, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n: all its words) and, for each length, a table lang, w1 .., phrase, f of the phrases with f >= least."""
    seed = 0
    while True:
        counts = vocabulary(docs, seed).groupBy("lang", "word", "h").agg(F.sum("c").alias("f"))
        counts = written(counts, "vocabulary")
        if counts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        seed += 1  # two words share a hash
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    single = written(counts.where(F.col("f") >= least).select("lang", F.col("h").alias("w1"), F.col("word").alias("phrase"), "f"), "phrases")
    levels, ranked = [single], _units(single, 1)
    buckets = 16 + int(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET
    units = ranked
    for size in range(2, longest + 1):
        names = [f"w{k + 1}" for k in range(size)]
        crowded = _crowded(docs, size, units.bits, seed, least) if size > 2 else None
        counted = _level(docs, size, units, ranked, seed, crowded, least, buckets)
        last = single.select(F.col("w1").alias(names[-1]), F.col("phrase").alias("last"))
        named = counted.join(levels[-1].select("lang", *names[:-1], "phrase"), names[:-1]).join(last, names[-1])
        levels.append(written(named.select("lang", *names, F.concat_ws(" ", "phrase", "last").alias("phrase"), "f"), "phrases"))
        if size < longest:
            units = _units(levels[-1], size)
    return totals, levels


def _scored(levels: list[DataFrame], size: int) -> DataFrame:
    """w (hashes), lang, phrase, a, l, r, score of the phrases of one length: the cut with the lowest score, then the smallest."""
    names = [f"w{k + 1}" for k in range(size)]
    table = levels[size - 1].withColumnRenamed("f", "a")
    for k in range(1, size):
        front = levels[k - 1].select(*names[:k], F.col("f").alias(f"l{k}"))
        back = levels[size - k - 1].select(*[F.col(f"w{i + 1}").alias(names[k + i]) for i in range(size - k)], F.col("f").alias(f"r{k}"))
        table = table.join(front, names[:k]).join(back, names[k:])
    wide = "decimal(38, 0)"
    cut = lambda k: F.struct(
        F.expr(f"(CAST(a AS {wide}) * 2000000) div (CAST(l{k} AS {wide}) + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")
    )
    best = F.array_min(F.array(*[cut(k) for k in range(1, size)]))
    return table.withColumn("x", best).select(F.array(*names).alias("w"), "lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a (its count), l, r (counts of its parts at the cut), n (words of the language), score: the first `top` of each language.

    A phrase that lies in a longer one with at least `inside` per cent of its occurrences is dropped.
    """
    totals, levels = frequent(docs, least, longest)
    scored = _scored(levels, 2)
    for size in range(3, longest + 1):
        scored = scored.union(_scored(levels, size))
    scored = written(scored, "scored")
    parts = [F.slice("w", s, n) for n in range(2, longest) for s in range(1, longest - n + 2)]
    longer = scored.select(F.size("w").alias("size"), F.explode(F.array(*parts)).alias("w"), F.col("a").alias("whole"))
    # A slice that runs over the phrase's end is that phrase's shorter tail, which is a part of it too.
    longer = longer.where((F.size("w") > 1) & (F.size("w") < F.col("size")))
    around = longer.groupBy("w").agg(F.max("whole").alias("whole"))
    wide = "decimal(38, 0)"
    kept = scored.join(around, "w", "left").where(f"whole IS NULL OR CAST(whole AS {wide}) * 100 < CAST(a AS {wide}) * {inside}")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, k, w, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k >= 2
), scores AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, (c.a::HUGEINT * 2000000) // (x.f + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[s : s + n - 1], ' ') AS phrase, max(f) AS whole
  FROM f, (SELECT unnest([2, 3]) AS n), (SELECT unnest([1, 2, 3]) AS s) WHERE k > n AND s + n - 1 <= k GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.whole IS NULL OR 100 * i.whole < 80 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
