"""Byte-level BPE encoding and decoding.

Pre-tokens are found on whole blocks of bytes: each character gets a class (letter, number,
white space, other), and runs of a class with the pattern's rules for spaces and contractions
give the same spans as the pattern would. Every distinct pre-token of a block is then looked
up in two tiers: a minimal perfect hash (hash and displace) resolves those that are whole
vocabulary entries, in one vectorised step that also compares their bytes; the others are merged by a heap of pair ranks over
a doubly linked list of their bytes. Decoding takes the ids back to bytes through the
vocabulary's offsets.

Null and empty texts give no ids. Rows map one to one: repeated rows give repeated results,
an empty table gives an empty one, and columns other than the two named are not read. A block
holds whole documents; a very long text makes a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import blocks, equal_spans, gather, map_batches, mix, span_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pre-tokens outside the vocabulary whose ids a worker remembers.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks as arrays: a minimal perfect hash over the entries, and their bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        for self.seed in range(64):
            hashes = span_hashes(data, ends - [len(t) for t in tokens], ends, self.seed)
            if len(np.unique(hashes)) == len(hashes):
                break
        self._place(hashes, np.fromiter(ranks.values(), np.int64, len(ranks)))
        by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            by_id[i] = t
        self.offsets = np.zeros(len(by_id) + 1, np.int64)
        np.cumsum([len(t) for t in by_id], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = [ranks[bytes([i])] for i in range(256)]

    def _place(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        """Hash and displace: buckets, largest first, try seeds until all their keys fall on free slots."""
        n = len(hashes)
        self.n, self.n_buckets = n, max(1, n // 4)
        bucket = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        self.seeds = np.zeros(self.n_buckets, np.uint64)
        taken, slots = bytearray(n), np.zeros(n, np.int64)
        for b in np.argsort(first[:-1] - first[1:], kind="stable"):
            keys = order[first[b] : first[b + 1]]
            if len(keys) == 0:
                break
            h, seed = hashes[keys], 0
            while True:
                trial = np.arange(seed, seed + 64, dtype=np.uint64)
                at = (mix(h[None, :] ^ (trial * np.uint64(0xD6E8FEB86659FD93))[:, None]) % np.uint64(n)).tolist()
                k = next((k for k, row in enumerate(at) if len(set(row)) == len(row) and not any(taken[x] for x in row)), None)
                if k is not None:
                    break
                seed += 64
            self.seeds[b] = seed + k
            slots[keys] = at[k]
            for x in at[k]:
                taken[x] = 1
        self.keys, self.ids = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.keys[slots], self.ids[slots] = hashes, ids

    def lookup(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The id of each whole pre-token (a span of buf), or -1. An entry counts if its bytes are the span's."""
        seed = self.seeds[(hashes % np.uint64(self.n_buckets)).astype(np.int64)]
        at = (mix(hashes ^ (seed * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(self.n)).astype(np.int64)
        ids = self.ids[at]
        same = self.keys[at] == hashes
        near = np.flatnonzero(same)
        first = self.offsets[ids[near]]
        same[near] = equal_spans(buf, starts[near], lens[near], self.bytes, first, self.offsets[ids[near] + 1] - first)
        return np.where(same, ids, -1)

    def merge(self, token: bytes) -> list[int]:
        """Merges by lowest rank, leftmost first, with a heap over linked bytes."""
        n, ranks = len(token), self.ranks
        if n == 1:
            return [self.single[token[0]]]
        end = list(range(1, n + 1))  # piece at i spans token[i:end[i]]; end[i] is the next piece
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(token[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        live = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] != stop or not live[j]:
                continue  # one of the two pieces has changed since
            live[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                r = ranks.get(token[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0:
                r = ranks.get(token[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.offsets, self.bytes, ids)[0].tobytes()


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            chars = "".join(map(chr, range(lo, hi)))
            for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
                for m in regex.finditer(pattern, chars):
                    table[lo + m.start() : lo + m.end()] = kind
        _classes.append(table)
    return _classes[0]


def pre_tokens(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of a block of texts; together they cover every byte."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    table = char_classes()
    kind = table[:256][buf]
    lead = (buf & 0xC0) != 0x80
    if not lead.all() or buf.max() >= 0x80:
        at = np.flatnonzero(buf >= 0xC0)
        pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (pad[at + k] for k in range(4))
        cp = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F))
        kind[at] = table[np.minimum(cp, 0x10FFFF)]
        kind = kind[np.maximum.accumulate(np.where(lead, np.arange(n), 0))]
    first = np.zeros(n + 1, bool)
    first[offs[offs < n]] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[:n] &= lead | first[:n]
    start = run.copy()
    # White space before another run: its last character stands apart, or a plain space joins what follows.
    after = np.flatnonzero(run[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
    if len(after):
        last = after - 1
        while (back := ~lead[last]).any():
            last = last - back
        start[last] = True
        start[after[buf[after - 1] == 0x20]] = False
    # A lone apostrophe that begins a match takes the ending after it, and a new match begins behind.
    quote = np.flatnonzero((buf == 0x27) & start[:n] & run[:n] & run[1:])
    if len(quote):
        pad = np.concatenate([buf, np.zeros(2, np.uint8)])
        ended = np.concatenate([first, np.ones(2, bool)])
        one, two = pad[quote + 1], pad[quote + 2]
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        pair = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        size = np.where(pair & ~ended[quote + 2], 2, size)
        size[ended[quote + 1]] = 0
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        stop = quote + 1 + size
        start[stop[stop < n]] |= kind[stop[stop < n]] == LETTER
    return np.flatnonzero(start[:n])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.memo = vocabulary, {}

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, joined, and each text's offsets in them."""
        starts = pre_tokens(buf, offs)
        ends = np.append(starts[1:], len(buf))
        sizes = ends - starts
        unique, where, inverse = np.unique(span_hashes(buf, starts, ends, self.vocabulary.seed), return_index=True, return_inverse=True)
        alike = where[inverse]
        if not equal_spans(buf, starts, sizes, buf, starts[alike], sizes[alike]).all():
            # Two pre-tokens share a hash: tell them apart by their bytes.
            known: dict[bytes, int] = {}
            inverse = np.array([known.setdefault(buf[s:e].tobytes(), len(known)) for s, e in zip(starts.tolist(), ends.tolist())])
            _, where = np.unique(inverse, return_index=True)
            unique = span_hashes(buf, starts[where], ends[where], self.vocabulary.seed)
        whole = self.vocabulary.lookup(unique, buf, starts[where], sizes[where])
        lens = np.ones(len(unique), np.int64)
        miss = np.flatnonzero(whole < 0)
        found, memo, merge = [], self.memo, self.vocabulary.merge
        if len(memo) > REMEMBERED:
            memo.clear()
        for s, e in zip(starts[where[miss]].tolist(), ends[where[miss]].tolist()):
            token = buf[s:e].tobytes()
            ids = memo.get(token)
            if ids is None:
                ids = memo[token] = merge(token)
            found.append(ids)
        lens[miss] = [len(x) for x in found]
        first = np.zeros(len(unique) + 1, np.int64)
        np.cumsum(lens, out=first[1:])
        flat = np.zeros(first[-1], np.int64)
        flat[first[:-1][whole >= 0]] = whole[whole >= 0]
        if len(miss):
            at = np.repeat(first[miss] - np.cumsum(lens[miss]) + lens[miss], lens[miss]) + np.arange(lens[miss].sum())
            flat[at] = [i for x in found for i in x]
        ids, token_offs = gather(first, flat, inverse)
        return ids, token_offs[np.searchsorted(starts, offs)]


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of each whole text."""
    return _mapped(df, vocabulary, id_col, text_col, "ids array<int>", lambda v, ids, offs, buf, at: [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))])


def encode_digests(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of what they decode to."""

    def digests(v, ids, offs, buf, at):
        raw, size = ids.astype("<u4").tobytes(), offs.tolist()
        back, back_offs = gather(v.offsets, v.bytes, ids)
        back, ends = back.tobytes(), back_offs[offs].tolist()
        sha = hashlib.sha256
        return [
            pa.array(np.diff(offs), pa.int64()),
            pa.array([sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(size, size[1:])], pa.string()),
            pa.array([sha(back[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
        ]

    return _mapped(df, vocabulary, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the bytes of each list of ids; null lists give no bytes."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(df.dtypes)[id_col]

    def run(batch):
        v = held.value
        lists = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode(np.asarray(x or [], np.int64)) for x in lists], pa.binary())], ["id", "decoded"])

    return map_batches(df, [id_col, ids_col], run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def _mapped(df: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind, names = dict(df.dtypes)[id_col], [c.split()[0] for c in columns.split(", ")]

    def run(batch):
        encoder = _encoder(held)
        for a, b, buf, offs in blocks(batch.column(1)):
            ids, at = encoder.encode(buf, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *make(encoder.vocabulary, ids, at, buf, offs)], ["id", *names])

    return map_batches(df, [id_col, text_col], run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


_encoders: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    """One encoder for each worker process."""
    key = held.id if hasattr(held, "id") else id(held.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(held.value)
    return _encoders[key]
