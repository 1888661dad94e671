"""Removal of long repeated byte strings by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.

Every window of `length` bytes picks an anchor: the smallest hash of its `gram`-byte strings.
Equal windows pick equal anchors at equal places, so only windows whose anchor recurs somewhere
can repeat; the runs of starts that share an anchor are cut out with what follows them
(contexts), equal contexts are joined, and contexts with one anchor go to one shard. A shard
leaves out what shares no bytes long enough with another context of its anchor (equal windows lie
in equal stretches around the anchor, so stretches whose hash is there once are alone in it), and
sorts all other suffixes by induced sorting: suffixes are classified, the leftmost-smaller
substrings are named in order and their names sorted by repeated renaming of neighbouring pairs,
and the other suffixes are induced bucket by bucket in two linear sweeps. Permuted common
prefixes (computed where they are irreducible, counted down elsewhere) say which suffixes
share `length` bytes with a neighbour. An anchor with
more than HOT bytes of different contexts would load one shard, so it is split by what all the
windows of a few starts have in common; what is still too much in one part is compared by 128-bit
hashes of its windows in a plain aggregation.

Shorter passages are reported, not removed: the anchors of smaller windows (`echo` bytes) cut a
text into pieces, and pieces with the same two anchors at the same distance elsewhere are echoes;
runs of them with at least three quarters of `echo` bytes are counted. This is a report by fingerprints, not exact.

Texts stand for themselves: all tables are keyed by a 128-bit hash of the text, so neither null nor
repeated doc_ids matter. A text that several rows have is represented once; if it reaches
`length`, all of it goes from each of them. Null and empty texts have 0 bytes and lose nothing.
An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blocks, map_batches, mix, powers, written

GRAM, SHARD, HOT = 32, 1 << 21, 1 << 20
#: Starts that a part of a split anchor holds, and bytes of texts that are searched for anchors at once (their hashes fit a core's cache).
STEP, NEAR = 32, 1 << 17
#: Texts that a task remembers, so as to send copies of them once.
REMEMBERED = 200_000


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers, and the factors that make the sum over a string the same wherever it begins."""
    n = len(buf)
    r, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * r[:n], out=total[1:])
    return total, inv


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    n = len(buf)
    if n < gram:
        return np.zeros(0, np.uint64)
    total, inv = _sums(buf)
    return mix((total[gram:] - total[:-gram]) * inv[: n - gram + 1])


def _least(h: np.ndarray, spans: list[int]) -> list[np.ndarray]:
    """For each of the spans (smallest first), where the smallest of each `span` neighbouring hashes is (by 32 bits, the first of equal ones)."""
    low, have, out = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1, []
    for span in spans:
        n = len(h) - span + 1
        if n < 1:
            out.append(np.zeros(0, np.uint32))
            continue
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        out.append((np.minimum(low[:n], low[span - have : span - have + n]) if have < span else low).astype(np.uint32))
    return out


def anchors(offs: np.ndarray, h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """doc, first start, last start, anchor's place and hash of each run of window starts of a block with gram hashes h, least at `at` in each window."""
    n = len(at)
    lens = np.diff(offs)
    begins = offs[:-1][lens >= length]
    first = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, begins)
    doc = np.searchsorted(offs, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, offs[doc + 1] - length)
    fits = last >= first  # others begin where a text has less than a window left
    d, q1, q2 = doc[fits], first[fits], last[fits]
    place = at[q1].astype(np.int64)
    return d, q1 - offs[d], q2 - offs[d], place - offs[d], h[place]


def echo_pieces(offs: np.ndarray, h: np.ndarray, at: np.ndarray, echo: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end and key of each piece between neighbouring anchors of windows of echo bytes."""
    d, _, _, at, anchor = anchors(offs, h, at, echo)
    one = np.flatnonzero((d[1:] == d[:-1]) & (at[1:] != at[:-1]))
    a, b = at[one], at[one + 1]
    key = mix(anchor[one] * np.uint64(0x9E3779B97F4A7C15) ^ mix(anchor[one + 1] + (b - a).astype(np.uint64)))
    return d[one], np.minimum(a, b), np.maximum(a, b) + gram, key


def _sorted_marks(text: np.ndarray, smaller: np.ndarray, marks: np.ndarray, n_texts: int) -> np.ndarray:
    """Order of the leftmost-smaller suffixes: their substrings are named in order, then names are sorted by pairs."""
    m = len(marks)
    ends = np.append(marks[1:], len(text) - 1)
    is_end = text[marks] == 0
    code = (text.astype(np.int64) << 1 | smaller) + 1
    pad = np.concatenate([code, np.zeros(8, np.int64)])
    name = np.zeros(m, np.int64)
    at, todo = marks.copy(), np.arange(m)
    while len(todo):
        part = np.zeros(len(todo), np.int64)
        for k in range(5):
            part = part << 10 | np.where(at[todo] + k <= ends[todo], pad[at[todo] + k], 0)
        if len(todo) == m:
            _, name = np.unique(part, return_inverse=True)
        else:
            # Those with more characters are ranked within their name; the rest of a name's rows have ended.
            _, small = np.unique(part, return_inverse=True)
            key = name[todo] * len(todo) + small
            order = np.argsort(key)
            step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            wide = np.zeros(m, np.int64)
            wide[todo[order]] = step + 1
            _, name = np.unique(name * (m + 1) + wide, return_inverse=True)
        at += 5
        todo = todo[at[todo] <= ends[todo]]
    # A text's end is unlike any other: ends come first, in the order of the texts.
    rank = name + n_texts
    rank[is_end] = np.arange(int(is_end.sum()))
    _, rank = np.unique(rank, return_inverse=True)
    step, live = 1, None
    while True:
        counts = np.bincount(rank)
        if counts.max(initial=0) <= 1:
            break
        live = np.flatnonzero(counts[rank] > 1)
        after = np.where(live + step < m, rank[np.minimum(live + step, m - 1)] + 1, 0)
        key = rank[live] * (m + 1) + after
        order = np.argsort(key)
        a, b = np.divmod(key[order], m + 1)
        fresh = np.concatenate([[True], a[1:] != a[:-1]])
        changed = fresh | np.concatenate([[True], b[1:] != b[:-1]])
        # Ranks of a group are spread over the places it has: the group's rank is its first place.
        place = np.concatenate([[0], np.cumsum(counts)])[:-1]
        i = np.arange(len(a))
        start = np.maximum.accumulate(np.where(fresh, i, 0))
        head = np.maximum.accumulate(np.where(changed, i, 0))
        full = place[rank]
        full[live[order]] = place[a] + head - start
        rank = full
        step *= 2
    out = np.empty(m, np.int64)
    out[rank if rank.max(initial=0) == m - 1 else np.argsort(np.argsort(rank, kind="stable"), kind="stable")] = marks
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order of a run of texts over 1..256, each ended by 0; ends compare by place."""
    n = len(text)
    sign = np.append(np.sign(text[1:].astype(np.int16) - text[:-1]).astype(np.int8), np.int8(1))
    sign[text == 0] = 1  # an end is smaller than what follows, or than the last end
    back = np.where(sign != 0, np.arange(n, dtype=np.int32), np.int32(n))
    smaller = sign[np.minimum.accumulate(back[::-1])[::-1]] > 0
    marks = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if smaller[0] and text[0] == 0:
        marks = np.concatenate([np.zeros(1, np.int32), marks])
    order = _sorted_marks(text, smaller, marks, int((text == 0).sum())).astype(np.int32)
    larger_at, smaller_at = ~smaller, smaller & (text > 0)  # at place -1, the last end, neither holds
    top = int(text.max()) + 1
    larger: list[list[np.ndarray]] = [[] for _ in range(top)]
    less: list[list[np.ndarray]] = [[] for _ in range(top)]
    cuts = np.searchsorted(text[order], np.arange(top + 1)).tolist()

    def deal(rows: np.ndarray, to: list) -> None:
        c = text[rows]
        o = np.argsort(c, kind="stable")
        rows, c = rows[o], c[o]
        at = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
        for s, e in zip(at, at[1:]):
            to[c[s]].append(rows[s:e])

    def sweep(c: int, queue: list, at: np.ndarray, to: list) -> list[np.ndarray]:
        """Takes a bucket's suffixes in turn, and deals out those one place before them."""
        done = []
        while queue:
            rows = queue.pop(0)
            done.append(rows)
            j = rows - 1
            j = j[at[j]]
            if len(j):
                same = text[j] == c
                k = np.count_nonzero(same)
                if k:
                    queue.append(j[same] if k < len(j) else j)
                if k < len(j):
                    deal(j[~same] if k else j, to)
        return done

    whole = []
    for c in range(top):
        whole.append(sweep(c, larger[c], larger_at, larger))
        j = order[cuts[c] : cuts[c + 1]] - 1
        j = j[larger_at[j]]
        if len(j):
            deal(j, larger)
    out = []
    for c in range(top - 1, -1, -1):
        done = sweep(c, less[c] if c else [order[: cuts[1]][::-1]], smaller_at, less)
        for rows in whole[c][::-1]:
            j = rows[::-1] - 1
            j = j[smaller_at[j]]
            if len(j):
                deal(j, less)
        out += [x[::-1] for x in done]
        out += whole[c][::-1]
    return np.concatenate(out[::-1])


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the places where a string of that length begins that also begins at another place."""
    lens = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.uint16)
    ends = np.cumsum(lens + 1) - 1
    text += 1
    text[ends] = 0
    n = len(text)
    sa = suffix_array(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    left = (np.repeat(ends, lens + 1) - np.arange(n)).astype(np.int32)
    # Permuted common prefixes: computed where the characters in front differ or a piece begins.
    i = np.arange(n, dtype=np.int32)
    own = before < 0
    prev = np.where(own, 0, before)
    reducible = (i > 0) & (prev > 0) & (text[i - 1] == text[prev - 1]) & (text[i - 1] > 0) & ~own
    heads = np.flatnonzero(~reducible)
    raw = np.concatenate([(text - 1).astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), np.uint64, raw, 0, (1,))
    p, q = heads, prev[heads]
    most = np.where(own[heads], 0, np.minimum(left[p], left[q]))
    got = np.zeros(len(heads), np.int32)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = words[p[live] + got[live]] ^ words[q[live] + got[live]]
        bit = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(bit, np.uint64(1)).astype(np.float64)) // 8).astype(np.int32))
        got[live] += same
        live = live[(same == 8) & (got[live] < most[live])]
    got = np.minimum(got, most)
    head = np.maximum.accumulate(np.where(reducible, 0, i))
    plcp = np.zeros(n, np.int32)
    plcp[heads] = got
    plcp = plcp[head] - (i - head)
    hit = np.flatnonzero(plcp >= length)
    found = np.zeros(n, bool)
    found[hit] = True
    found[before[hit]] = True
    return [np.flatnonzero(found[s:e]) for s, e in zip((ends - lens).tolist(), ends.tolist())]


def shared_starts(pieces: list[bytes], anchor: np.ndarray, length: int, gram: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last start in each piece of what can begin in another piece of its anchor too (first > last: nothing).

    Windows are taken by their distance to the anchor, `step` distances at a time; the bytes that these windows have in common
    are hashed. Equal windows lie in stretches with equal bytes, so a hash that is there once rules out all windows of its stretch.
    """
    lens = np.array([len(p) for p in pieces], np.int64)
    offs = np.concatenate([[0], np.cumsum(lens)])
    total, inv = _sums(np.frombuffer(b"".join(pieces), np.uint8))
    anchor = anchor.astype(np.int64).view(np.uint64)
    h = mix((total[gram:] - total[:-gram]) * inv[: len(total) - gram]) & ~np.uint64(1)  # as marks_of() has it
    hits = np.flatnonzero(h == np.repeat(anchor, lens)[: len(h)])
    at = hits[np.searchsorted(hits, offs[:-1])] - offs[:-1]  # the first one is that of the piece's windows
    n = lens - length + 1
    low = (at - n + 1) // step
    count = at // step - low + 1
    row = np.repeat(np.arange(len(pieces)), count)
    far = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
    end = at[row] - far * step
    a = offs[row] + end
    key = mix((total[a - step + 1 + length] - total[a]) * inv[a] ^ mix(anchor[row] + far.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    several = np.zeros(len(key), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    row, end = row[several], end[several]
    lo, hi = n.copy(), np.full(len(pieces), -1)
    np.minimum.at(lo, row, np.maximum(end - step + 1, 0))
    np.maximum.at(hi, row, np.minimum(end, n[row] - 1))
    return lo, hi


def _ranges(starts: np.ndarray) -> list[list[int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]], 1).tolist()


def text_key(text: Column) -> list[Column]:
    """t1 and t2: the first 128 bits of the text's SHA-256."""
    sha = F.sha2(text, 256)
    return [F.conv(F.substring(sha, a, 16), 16, -10).cast("long").alias(name) for name, a in (("t1", 1), ("t2", 17))]


def _unseen(column: pa.Array, seen: set[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The texts of a batch that the task has not met (while it can remember them), and their keys."""
    keep, keys = [], []
    for i, t in enumerate(column):
        key = hashlib.sha256(t.as_buffer()).digest()[:16]
        if key not in seen:
            keep.append(i)
            keys.append(key)
            if len(seen) < REMEMBERED:
                seen.add(key)
    return column.take(pa.array(keep, pa.int64())), np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)


TEXT = ["t1", "t2"]


def _several(df: DataFrame, at: str, *by: str) -> DataFrame:
    """Groups with rows of more than one text or place (column at) in it."""
    place = F.xxhash64(*TEXT, at)
    return df.select(*by, place.alias("place")).groupBy(*by).agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select(*by)


def marks_of(texts: DataFrame, length: int, gram: int, echo: int | None) -> DataFrame:
    """t1, t2, cuts (runs whose anchor recurs: q1, q2, anchor), heard (pieces that echo elsewhere: a, b)."""
    names = ["key", *TEXT, "a", "b"]
    spans = sorted({x - gram + 1 for x in (length, echo or length)})

    def find(batches):
        seen: set[bytes] = set()
        for batch in batches:
            column, keys = _unseen(batch.column(0), seen)
            for first, _, buf, offs in blocks(column, NEAR):
                h = _gram_hashes(buf, gram)
                least = dict(zip(spans, _least(h, spans)))
                d, a, b, _, key = anchors(offs, h, least[length - gram + 1], length)
                found = [(d, a, b, key & ~np.uint64(1))]  # the last bit of a key tells pieces from runs
                if echo:
                    d, a, b, key = echo_pieces(offs, h, least[echo - gram + 1], echo, gram)
                    found.append((d, a, b, key | np.uint64(1)))
                d, a, b, key = (np.concatenate(x) for x in zip(*found))
                if len(d):
                    t1, t2 = (keys[first + d, c] for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(t1), pa.array(t2), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names)

    places = written(texts.mapInArrow(find, "key long, t1 long, t2 long, a int, b int"), "places")
    recurring = written(_several(places, "a", "key"), "recurring")
    met = places.join(recurring.hint("merge"), "key", "left_semi").withColumn("kind", F.col("key").bitwiseAND(1))
    cuts = F.collect_set(F.when(F.col("kind") == 0, F.struct(F.col("a").alias("q1"), F.col("b").alias("q2"), F.col("key").alias("anchor"))))
    return written(met.groupBy(*TEXT).agg(cuts.alias("cuts"), F.collect_set(F.when(F.col("kind") == 1, F.struct("a", "b"))).alias("heard")), "marks")


def _contexts(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """anchor, t1, t2, q1, n (starts), c1, c2 (hash of the piece and n), bytes, piece: the runs of marks_of(), cut out. One row at least of each c1, c2 has the piece."""

    def once(batches):
        seen: set[bytes] = set()
        for batch in batches:
            column, keys = _unseen(batch.column(0), seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), column.cast(pa.binary())], [*TEXT, "raw"])

    cuts = marks.where(F.size("cuts") > 0).select(*TEXT, "cuts")
    names = ["anchor", *TEXT, "q1", "n", "c1", "c2", "bytes", "piece"]

    def cut(batches):
        seen: set[tuple] = set()
        sent: set[bytes] = set()
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if key in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                raw = batch.column(2)[row].as_buffer().to_pybytes()
                c = batch.column(3).slice(row, 1).flatten()
                q1, q2 = (c.field(k).to_numpy() for k in range(2))
                pieces = [raw[s : e + length] for s, e in zip(q1.tolist(), q2.tolist())]
                n = q2 - q1 + 1
                each = [hashlib.blake2b(x, digest_size=16, salt=k.to_bytes(8, "big")).digest() for x, k in zip(pieces, n.tolist())]
                digests = np.frombuffer(b"".join(each), np.int64).reshape(-1, 2)
                sizes = [len(x) for x in pieces]
                for k, x in enumerate(each):  # the bytes of equal contexts leave a task once
                    if x in sent:
                        pieces[k] = None
                    elif len(sent) < REMEMBERED:
                        sent.add(x)
                t1, t2 = (np.full(len(pieces), k, np.int64) for k in key)
                for s in range(0, len(pieces), 4096):
                    e = min(s + 4096, len(pieces))
                    ids = [pa.array(x[s:e]) for x in (t1, t2)]
                    yield pa.RecordBatch.from_arrays([c.field(2).slice(s, e - s), *ids, pa.array(q1[s:e]), pa.array(n[s:e]), pa.array(digests[s:e, 0]), pa.array(digests[s:e, 1]), pa.array(sizes[s:e], pa.int32()), pa.array(pieces[s:e], pa.binary())], names)

    whole = texts.mapInArrow(once, "t1 long, t2 long, raw binary")
    joined = whole.join(cuts.hint("merge"), TEXT).select(*TEXT, "raw", "cuts")
    return written(joined.mapInArrow(cut, "anchor long, t1 long, t2 long, q1 int, n int, c1 long, c2 long, bytes int, piece binary"), "contexts")


FOUND = "c1 long, c2 long, a int, b int"


def _sorted_shards(pieces: DataFrame, length: int, shards: int, gram: int | None = None) -> DataFrame:
    """c1, c2, a, b (ranges of starts) of pieces (key, c1, c2, skip, piece): those of one key are compared. gram: the keys are anchors of so many bytes."""
    step = min(STEP, length)

    def sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        skip, which, texts = pdf["skip"].to_numpy(), np.arange(len(pdf)), pdf["piece"].tolist()
        if gram:
            lo, hi = shared_starts(texts, pdf["key"].to_numpy(), length, gram, step)
            which = np.flatnonzero(lo <= hi)
            texts = [texts[k][lo[k] : hi[k] + length] for k in which.tolist()]
            skip = skip + lo
        found = repeated_starts(texts, length) if texts else []
        rows = [(k, a + skip[k], b + skip[k]) for k, x in zip(which.tolist(), found) for a, b in _ranges(x)]
        at, a, b = np.array(rows, np.int64).reshape(-1, 3).T
        return pd.DataFrame({"c1": pdf["c1"].to_numpy()[at], "c2": pdf["c2"].to_numpy()[at], "a": a, "b": b})

    return pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(sort_shard, FOUND)


def _split(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """The pieces of hot anchors in parts of STEP starts; the key of a part is what all its windows share, seen from the anchor."""

    def run(batches):
        for batch in batches:
            for c1, c2, n, piece, anchor in zip(*(batch.column(k).to_pylist() for k in range(5))):
                buf = np.frombuffer(piece, np.uint8)
                at = _anchor_place(buf, n, length, gram)
                out, step = [], min(STEP, length)
                # Starts by their distance to the anchor, in steps, so that equal windows fall in equal parts.
                for far in range((at - n + 1) // step, at // step + 1):
                    s = at - far * step
                    lo, hi = max(0, s - step + 1), min(n - 1, s)
                    if lo > hi:
                        continue
                    core = piece[s : s - step + 1 + length]
                    key = hashlib.blake2b(core, digest_size=8, salt=(far & 0xFFFF).to_bytes(4, "big"), key=(anchor & (1 << 64) - 1).to_bytes(8, "big")).digest()
                    out.append((int.from_bytes(key, "big", signed=True), c1, c2, lo, hi - lo + 1, piece[lo : hi + length]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["key", "c1", "c2", "skip", "n", "piece"])

    return pieces.select("c1", "c2", "n", "piece", "anchor").mapInArrow(run, "key long, c1 long, c2 long, skip int, n int, piece binary")


def _anchor_place(buf: np.ndarray, n: int, length: int, gram: int) -> int:
    """Where the anchor that the first n windows of a piece share begins in it: the smallest hash of the bytes that all of them have."""
    h = _gram_hashes(buf[: n - 1 + length], gram) & np.uint64(0xFFFFFFFF00000000)
    return n - 1 + int(np.argmin(h[n - 1 : length - gram + 1]))


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """c1, c2, a, b of pieces (key, c1, c2, skip, piece) whose windows recur in their key, by 128-bit hashes."""

    def run(batches):
        for batch in batches:
            for key, c1, c2, skip, piece in zip(*(batch.column(k).to_pylist() for k in range(5))):
                k = len(piece) - length + 1
                d = np.frombuffer(b"".join(hashlib.blake2b(piece[s : s + length], digest_size=16).digest() for s in range(k)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(k, x)) for x in (key, c1, c2)], pa.array(np.arange(skip, skip + k, dtype=np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], ["key", "c1", "c2", "at", "h1", "h2"])

    each = written(pieces.select("key", "c1", "c2", "skip", "piece").mapInArrow(run, "key long, c1 long, c2 long, at int, h1 long, h2 long"), "windows")
    by = ["key", "h1", "h2"]
    twice = written(each.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by), "twice")
    return each.join(twice.hint("merge"), by, "left_semi").select("c1", "c2", F.col("at").alias("a"), F.col("at").alias("b"))


def repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, echo: int | None = None) -> DataFrame:
    """t1, t2, rows (with that text), ranges (first and last start of repeated strings), heard (echoes, from a to before b) of texts with repeats."""
    least = min(length, echo or length)
    texts = docs.select("text").where(F.octet_length("text") >= least)
    marks = marks_of(texts, length, gram, echo)
    copies = docs.where(F.octet_length("text") >= least).select(*text_key(F.col("text"))).groupBy(*TEXT).agg(F.count("*").alias("rows")).where("rows > 1")
    contexts = _contexts(texts.where(F.octet_length("text") >= length), marks, length)

    kind = ["anchor", "c1", "c2"]
    slim = written(contexts.groupBy(*kind).agg(F.max("bytes").alias("size")), "kinds")
    by_anchor = written(slim.groupBy("anchor").agg(F.sum("size").alias("bytes"), F.count("*").alias("kinds")).where("kinds > 1"), "anchors")
    total = by_anchor.where(F.col("bytes") <= HOT).agg(F.sum("bytes")).first()[0] or 0
    many = _several(contexts, "q1", *kind).select("c1", "c2")  # equal contexts: every start repeats

    def different(anchors: DataFrame) -> DataFrame:
        # The other columns of a kind are the same in all its rows, but for its place.
        rows = contexts.where("piece IS NOT NULL").select(*kind, "n", "piece").join(anchors.select("anchor").hint("merge"), "anchor", "left_semi")
        return rows.dropDuplicates(["c1", "c2"])

    mild = different(by_anchor.where(F.col("bytes") <= HOT)).withColumn("key", F.col("anchor")).withColumn("skip", F.lit(0))
    found = _sorted_shards(mild, length, max(1, -(-total // SHARD)), gram)
    hot = by_anchor.where(F.col("bytes") > HOT)
    if not hot.isEmpty():
        parts = written(_split(different(hot), length, gram), "parts")
        by_key = written(parts.groupBy("key").agg(F.sum(F.octet_length("piece")).alias("bytes"), F.count("*").alias("kinds")).where("kinds > 1"), "keys")
        small, large = by_key.where(F.col("bytes") <= HOT), by_key.where(F.col("bytes") > HOT)
        total = small.agg(F.sum("bytes")).first()[0] or 0
        take = lambda keys: parts.join(keys.select("key").hint("merge"), "key", "left_semi")
        found = found.union(_sorted_shards(take(small), length, max(1, -(-total // SHARD)))).union(_windows(take(large), length))
    found = written(found, "found")
    rows = contexts.select(*TEXT, "q1", "n", "c1", "c2")
    start = lambda c: (F.col("q1") + c).alias
    part = rows.join(found.hint("merge"), ["c1", "c2"]).select(*TEXT, start(F.col("a"))("a"), start(F.col("b"))("b"))
    full = rows.join(written(many, "many").hint("merge"), ["c1", "c2"], "left_semi").select(*TEXT, F.col("q1").alias("a"), start(F.col("n") - 1)("b"))
    ranges = part.union(full).groupBy(*TEXT).agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    heard = marks.where(F.size("heard") > 0).select(*TEXT, "heard")
    every = ranges.join(heard, TEXT, "full").join(copies, TEXT, "full")
    return every.select(*TEXT, F.coalesce("rows", F.lit(1)).alias("rows"), "ranges", "heard")


def removed(docs: DataFrame, length: int = 400, gram: int = GRAM, echo: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_echoed (bytes removed or in echoes of at least three quarters of echo bytes), kept (the bytes that stay)."""
    kind = dict(docs.dtypes)["doc_id"]
    least = min(length, echo or length)
    marks = written(repeats(docs, length, gram, echo), "repeats")
    named = docs.select("doc_id", *text_key(F.col("text")), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    joined = named.join(marks.hint("merge"), TEXT, "left")

    def cover(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        edge = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
        return np.cumsum(edge[:-1]) > 0

    def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each row's pairs begin, and all pairs' two numbers."""
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        pairs = lists.flatten()
        return at, *((pairs.field(k).to_numpy(zero_copy_only=False) for k in range(2)) if len(pairs) else (np.zeros(0, np.int64),) * 2)

    def strip(batch):
        out = [[], [], [], [], []]
        (at, a, b), (at2, a2, b2) = flat(batch.column(3)), flat(batch.column(4))
        for k, rows in enumerate(batch.column(2).to_pylist()):
            raw = batch.column(1)[k].as_buffer().to_pybytes()
            n, s, e, s2, e2 = len(raw), at[k], at[k + 1], at2[k], at2[k + 1]
            if (rows or 0) > 1 and n >= length:
                row = (n, n, 1, n, b"")
            elif e > s or e2 > s2 or (rows or 0) > 1:
                gone = cover(n, a[s:e], b[s:e] + length)
                heard = gone | cover(n, a2[s2:e2], b2[s2:e2])
                x, y = runs(heard)
                echoed = n if (rows or 0) > 1 and n >= least else int((y - x)[y - x >= min(length, 3 * (echo or length) // 4)].sum())
                row = (n, int(gone.sum()), len(runs(gone)[0]), echoed, np.frombuffer(raw, np.uint8)[~gone].tobytes())
            else:
                row = (n, 0, 0, 0, raw)
            for c, v in zip(out, row):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_echoed", "kept"])

    return map_batches(joined, ["doc_id", "raw", "rows", "ranges", "heard"], strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, n_echoed long, kept binary")
