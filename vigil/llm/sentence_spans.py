"""Removal of repeated passages by sliding spans of sentences.

A span is a run of `run` consecutive sentences (a document of two sentences or more that has
fewer is one span). Every span is hashed by its words (case and spacing aside) to 128 bits and
grouped over all documents; a sentence goes if a span that covers it occurred before, in the
order of doc_id and place. A sentence ends at a mark of any common script or at a line end; one
of more than LONGEST words is cut after words whose hash says so, so that a passage without marks
is cut alike wherever it stands. One or two sentences are a span of their own if they have LEAST words, so that a
passage of few long sentences is found too; shorter ones alone never are.

`n_shared` counts the words of passages (LEAST or more words in a row of sentences) that stand in other documents as
well. It tells so of each of these documents, also of the one whose sentences stay because they occurred first.
A sentence of one word over and over is not cut and counts as one.

A span that very many documents share is summed before it moves, and its sums are written
before they are joined back, so that Spark can split its rows.

Null and empty texts have no sentences and lose nothing. Rows that repeat a doc_id and its text
count as documents like others: one keeps what the document keeps, the others lose every span.
Rows that share a doc_id but not a text are told apart by the text's hash. A null doc_id comes
first in the order. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, blocks, map_batches, mix, span_hashes, word_spans, written

#: Characters that end a sentence.
MARKS = ".!?。．！？।۔؟։"
ENDS = re.compile(f"[^{MARKS}\\n]*(?:[{MARKS}]+|\\n|\\Z)")
LONGEST = 40
#: One word of so many ends a part of an over-long sentence.
PART = np.uint64(12)
#: Words from which fewer sentences than a run are a span, and words from which a passage counts as shared (of 51 words
#: in a row, about so many stand in whole sentences).
LEAST = 25


def sentence_bounds(raw: bytes) -> list[int]:
    """Ends of the marked sentences of a text; together they cover it."""
    text = raw.decode("utf-8", "surrogateescape")
    ends = [m.end() for m in ENDS.finditer(text) if m.end() > m.start()]
    if len(text) == len(raw):
        return ends
    size = np.cumsum([len(text[a:b].encode("utf-8", "surrogateescape")) for a, b in zip([0, *ends], ends)])
    return size.tolist()


def sentences(raw: bytes, ends_only: bool = False) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the sentences of a text, the numbers of those with words, and two hashes and the words of each of these (if more than the ends is asked for)."""
    bounds, none = sentence_bounds(raw), np.zeros(0, np.int64)
    if ends_only and np.diff([0, *bounds]).max(initial=0) <= 2 * LONGEST:
        return bounds, none, np.zeros((0, 2), np.uint64), none  # too short to be cut
    low = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = word_spans(low, np.array([0, len(raw)], np.int64))
    if not len(starts):
        return bounds, none, np.zeros((0, 2), np.uint64), none
    h = span_hashes(low, starts, ends)
    cut = np.searchsorted(starts, np.array([0, *bounds]))
    size = np.repeat(np.diff(cut), np.diff(cut))
    inner = np.flatnonzero((size > LONGEST) & (h % PART == 0))
    if len(inner):
        bounds = np.union1d(bounds, ends[inner]).tolist()
        cut = np.searchsorted(starts, np.array([0, *bounds]))
    full = np.flatnonzero(np.diff(cut) > 0)
    if ends_only:
        return bounds, full, np.zeros((0, 2), np.uint64), np.diff(cut)[full]
    first = cut[full]
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    salted = h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    other = span_hashes(low, starts, ends, 1) ^ mix(place.astype(np.uint64) + np.uint64(9))
    return bounds, full, np.stack([np.add.reduceat(mix(salted), first), np.add.reduceat(mix(other), first)], 1), np.diff(cut)[full]


def _spans(raw: bytes, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence of each span, and its hash (two words of 64 bits)."""
    _, full, h, size = sentences(raw)
    n = len(full)
    parts = []
    for k in range(1, min(run, n) + 1):
        i = np.arange(n - k + 1)
        if k < min(run, n) or n == 1:
            # As few sentences as have enough words, counted from either side.
            total = np.concatenate([[0], np.cumsum(size)])
            i = i[(total[i + k] - total[i] >= LEAST) & (np.minimum(total[i + k - 1] - total[i], total[i + k] - total[i + 1]) < LEAST)]
        out = np.full((len(i), 2), k, np.uint64)
        for j in range(k):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i + j])
        parts.append((full[i], full[i + k - 1], out))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def spans(docs: DataFrame, run: int = 3) -> DataFrame:
    """doc_id, text_hash, first, last (sentences), h1, h2 of every span."""

    def each(batch):
        for a, b, buf, offs in blocks(batch.column(2)):
            raw, parts = buf.tobytes(), []
            for d, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                i, j, h = _spans(raw[s:e], run)
                if len(i):
                    parts.append((np.full(len(i), d), i, j, h))
            if parts:
                d, i, j, h = (np.concatenate(x) for x in zip(*parts))
                of = pa.array(d)
                ids, texts = batch.column(0).slice(a, b - a).take(of), batch.column(1).slice(a, b - a).take(of)
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(np.ascontiguousarray(h[:, c]).view(np.int64)) for c in (0, 1)]], ["doc_id", "text_hash", "first", "last", "h1", "h2"])

    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(named, ["doc_id", "text_hash", "text"], each, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, first int, last int, h1 long, h2 long")


def deduplicated(docs: DataFrame, run: int = 3) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences), removed_bytes, n_spans (removed runs), n_shared (words of passages that other documents have too), kept (the text that stays)."""
    kind = dict(docs.dtypes)["doc_id"]
    found = written(spans(docs, run), "spans")
    at, doc = F.struct("doc_id", "text_hash", "first"), F.struct("doc_id", "text_hash")
    seen = written(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("origin"), (F.struct(F.min(at)["doc_id"], F.min(at)["text_hash"]).eqNullSafe(F.max(doc))).alias("alone")).where("n > 1").select("h1", "h2", "origin", (~F.col("alone")).alias("shared")), "seen")
    placed = found.join(seen.select("h1", "h2", "origin", "shared").hint("merge"), ["h1", "h2"]).withColumn("later", ~at.eqNullSafe(F.col("origin")))
    gone = placed.where("later OR shared").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "later", "shared")).alias("gone"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    again = written(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1"), "again")
    repeated = not again.isEmpty()
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_hash"] == y["text_hash"])
    marks = written(gone, "gone")
    once = rows
    if repeated:
        more = rows.join(again, same(rows, again)).select(rows["doc_id"], rows["text_hash"], "raw", "rows")
        more = more.groupBy("doc_id", "text_hash").agg(F.min("raw").alias("raw"), F.first("rows").alias("rows"))
        once = rows.join(again, same(rows, again), "left_anti").withColumn("rows", F.lit(1).cast("long")).unionByName(more)
    else:
        once = rows.withColumn("rows", F.lit(1).cast("long"))
    joined = once.join(marks, same(once, marks), "left").select(once["doc_id"].alias("doc_id"), "raw", "gone", "rows")

    def strip(batch):
        out, ids, times = [[] for _ in range(6)], [], []
        for k, (raw, ranges, rows) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
            ends, full, _, size = sentences(raw, rows == 1)
            cuts, held = [0, *ends], np.zeros(len(ends) + 1, np.int64)
            whole = rows > 1 and (len(full) > 1 or size.sum() >= LEAST)
            if whole:
                held[full[0]], held[full[-1] + 1] = 1, -1
            for r in ranges or []:
                if r["shared"]:
                    held[r["first"]] += 1
                    held[r["last"] + 1] -= 1
            turns = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(held[:-1]) > 0, [0]]).astype(np.int8))).tolist()
            words = [len(raw[cuts[a] : cuts[b]].split()) for a, b in zip(turns[::2], turns[1::2])]
            shared = sum(n for n in words if n >= LEAST)
            for later, n in ((False, 1), (True, rows - 1)):
                if not n:
                    continue
                edge = np.zeros(len(ends) + 1, np.int64)
                if later and whole:
                    edge[full[0]], edge[full[-1] + 1] = 1, -1
                for r in (ranges or []) if not later else []:
                    if r["later"]:
                        edge[r["first"]] += 1
                        edge[r["last"] + 1] -= 1
                off = np.cumsum(edge[:-1]) > 0
                kept = b"".join(raw[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~off).tolist()) if off.any() else raw
                row = (len(ends), int(off.sum()), len(raw) - len(kept), int((np.diff(np.concatenate([[0], off.astype(np.int8)])) == 1).sum()), shared, kept.decode("utf-8", "replace"))
                for c, v in zip(out, row):
                    c.append(v)
                ids.append(k)
                times.append(n)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, t) for c, t in zip(out, kinds)], pa.array(times, pa.int64())], ["doc_id", "n_sentences", "n_removed", "removed_bytes", "n_spans", "n_shared", "kept", "times"])

    made = map_batches(joined, ["doc_id", "raw", "gone", "rows"], strip, f"doc_id {kind}, n_sentences int, n_removed int, removed_bytes long, n_spans int, n_shared long, kept string, times long")
    if not repeated:
        return made.drop("times")
    return made.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_copy")
