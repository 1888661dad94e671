"""Vectorised byte-level helpers that tasks apply to Arrow batches of text.

A null text counts as an empty one everywhere. Texts are handled as UTF-8 bytes, in blocks
that are cut between documents, so the scratch memory of a task follows the block (or its
longest document), not the partition.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once.
BLOCK = 1 << 21
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KEY = np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 128
_powers: dict[str, np.ndarray] = {}

#: Bytes that separate words (space, tab, LF, VT, FF, CR).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the n + 1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most limit bytes, or one row."""
    buf, offs = packed(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("r")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("r", _R), ("inv", _R_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["r"], _powers["inv"]


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place of buf (and at its end), zeros beyond."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), np.uint64, raw, 0, (1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A keyed 64-bit hash of the bytes of each span. Seeds give independent hashes.

    Eight bytes at a time go through a finaliser that carries the state on, so no sum over places
    can cancel; spans of more than LONG_SPAN bytes go by BLAKE2b.
    """
    lens = ends - starts
    h = mix(lens.astype(np.uint64) * _R + np.uint64(seed * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D & (1 << 64) - 1))
    eight = words_at(buf)
    live = np.flatnonzero((lens > 0) & (lens <= LONG_SPAN))
    at = 0
    while len(live):
        left = lens[live] - at
        w = eight[starts[live] + at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ w * _KEY)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(lens > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_lens: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_lens: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of a are those of the span of b beside it."""
    same = a_lens == b_lens
    wide_a, wide_b = words_at(a), words_at(b)
    live = np.flatnonzero(same & (a_lens > 0) & (a_lens <= LONG_SPAN))
    at = 0
    while len(live):
        left = a_lens[live] - at
        ok = (wide_a[a_starts[live] + at] ^ wide_b[b_starts[live] + at]) & _MASKS[np.minimum(left, 8)] == 0
        same[live[~ok]] = False
        at += 8
        live = live[ok & (left > 8)]
    for i in np.flatnonzero(same & (a_lens > LONG_SPAN)).tolist():
        n = a_lens[i]
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    return same


def word_spans(buf: np.ndarray, offs: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and each document's first word (n + 1 values). parts: bytes between words."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~parts[buf]
    start, end = np.empty(n, bool), np.empty(n, bool)
    start[0], end[-1] = word[0], word[-1]
    np.logical_and(word[1:], ~word[:-1], out=start[1:])
    np.logical_and(word[:-1], ~word[1:], out=end[:-1])
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] |= word[cut]
    end[cut - 1] |= word[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def gather(offs: np.ndarray, data: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values data[offs[i]:offs[i + 1]] for each i of which, joined; and the n + 1 offsets."""
    lens = (offs[1:] - offs[:-1])[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    index = np.repeat(offs[which] - out[:-1], lens) + np.arange(out[-1])
    return data[index], out


def map_batches(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """fn(RecordBatch) -> iterator of RecordBatch over the named columns."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.select(*[df[c] for c in columns]).mapInArrow(run, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a written table below spark.checkpoint.dir, which all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None and re.match(r"local(\[|$)", spark.sparkContext.master):
        root = tempfile.gettempdir()  # one process: its folder is shared by all tasks
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark then deletes a query's shuffle files when it ends, instead of when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, which cuts its lineage. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path, was = shared_dir(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
