"""How quality filters interact: an incremental audit of five filters in every order, as a stream with retractions.

The files of a table are taken in available-now micro-batches. Each text is judged once in a task (word count,
distinct words, capitals, marks) and goes on as a 128-bit digest with a mask of what it fails. The fifth filter
(identical to the text of a smaller doc_id) needs the whole table: rows count at first as if no smaller doc_id came, and keyed
state holds, for each text, the smallest doc_id so far and which part and label have it. When a smaller one arrives, or a row
that is not the smallest, the earlier mask is retracted from its part's counters and counted again with the fifth failure.
The counters (part, mask, label) then answer all 120 orders, as each question depends on masks alone.

Before the state, each task combines its rows: counters are summed, and only the smallest doc_id of a text goes to the text's
key, so a text that holds a third of all rows sends one row from each task. Keys are dealt into buckets, in proportion to the
shuffle partitions, and a bucket's state is a list of its texts: a micro-batch reads it once and adds what is new, where a state
for each text would cost each of them several requests. Rerun with the same folder, the audit reads new files only.

Null texts count as empty; a null source is part ''. Rows that repeat a doc_id and its text are no copies of
each other (no smaller doc_id). A null doc_id is smaller than nothing and nothing is smaller than it: such a row
never fails E. A text without words fails A and not B. Very long texts are read whole. An empty table
gives an empty result. Labels that repeat a doc_id count if any row has the value 1. Further columns of either table are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .text import blocks, map_batches, shared_dir, span_hashes, word_spans

#: A code: bits 0 to 4 for what fails (A to E), bit 5 for quality, bit 6 for toxic.
GOOD, TOXIC = 32, 64
#: The filters' thresholds: words, per cent of distinct words and of capitals, marks.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
LETTERS = "ABCDE"
COPY = 16
#: Rows that a task combines at once, and the micro-batches that a table is dealt into (at least as many files each).
COMBINED, BATCHES = 200_000, 4
#: Buckets of texts for each shuffle partition.
BUCKETS = 64
COUNTER = "part string, code int, n long"
#: The state store: on disk, which typed state asks for; many small stores reserve no space ahead, and a batch uploads its changes only.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def masks(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """What each text of a block fails of A (1), B (2), C (4) and D (8)."""
    starts, ends, first = word_spans(buf, offs)
    words = np.diff(first)
    hashes, distinct = span_hashes(buf, starts, ends), np.zeros(len(words), np.int64)
    for d, (s, e) in enumerate(zip(first.tolist(), first[1:].tolist())):
        h = np.sort(hashes[s:e])
        distinct[d] = (h[1:] != h[:-1]).sum() + (e > s)

    def count(which: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(which)])
        return at[offs[1:]] - at[offs[:-1]]

    marks = np.zeros(256, bool)
    marks[list(MARKS)] = True
    points, capitals = count((buf & 0xC0) != 0x80), count((buf >= 65) & (buf <= 90))
    failed = [words < LEAST_WORDS, 100 * distinct < DISTINCT * words, 100 * capitals > CAPITALS * points, count(marks[buf]) > 0]
    return sum(x.astype(np.int32) << k for k, x in enumerate(failed))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_key (16 bytes), mask of A to D."""

    def run(batch):
        for a, b, buf, offs in blocks(batch.column(1)):
            keys = [hashlib.blake2b(buf[s:e], digest_size=16).digest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            part = batch.column(2).slice(a, b - a).fill_null("")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, pa.array(keys, pa.binary()), pa.array(masks(buf, offs))], ["doc_id", "part", "text_key", "mask"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return map_batches(plain, ["doc_id", "text", "source"], run, "doc_id long, part string, text_key binary, mask int")


def _combine(batches):
    """Rows of one task: every row as counters under keys of the task's own, as if no smaller doc_id came; and the smallest doc_id of each text by its key."""
    task = TaskContext.get().partitionId()
    held, rows = [], 0

    def flush():
        df = pa.Table.from_batches(held).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        low = df.groupby("text_key")["doc_id"].transform("min")
        late = (df["doc_id"] > low).fillna(False).astype(bool)
        done = df.assign(code=df["code"] | np.where(late, COPY, 0)).groupby(["part", "code"], as_index=False).size()
        done["text_key"] = [b"=" + hashlib.blake2b(f"{task} {c} {p}".encode(), digest_size=15).digest() for p, c in zip(done["part"], done["code"])]
        done["doc_id"] = pd.array([pd.NA] * len(done), "Int64")
        first = df[~late & df["doc_id"].notna()].groupby(["text_key", "doc_id", "part", "code"], as_index=False).size()
        first["text_key"] = [b"#" + k for k in first["text_key"]]
        both = pd.concat([x for x in (done, first) if len(x)]).astype({"code": "int32"}).rename(columns={"size": "n"})
        return pa.RecordBatch.from_pandas(both[["text_key", "doc_id", "part", "code", "n"]], preserve_index=False)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= COMBINED:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


class Retractions(StatefulProcessor):
    """For a bucket of texts: retracts and counts again the rows of a text that turn out to have a smaller doc_id before them; counters are summed.

    State: rows of each text's smallest doc_id so far, by part and code. They are only added to: those of a doc_id that is no longer
    the smallest are passed over, until they are most of the list.
    """

    def init(self, handle) -> None:
        self.least = handle.getListState("least", "text_key binary, low long, part string, code int, n long")

    def handleInputRows(self, key, rows, timerValues):
        counted, fresh, held = Counter(), defaultdict(list), defaultdict(list)
        for r in rows:
            if r.text_key[:1] == b"=":
                counted[r.part, r.code] += r.n
            else:
                fresh[bytes(r.text_key)].append((r.doc_id, r.part, r.code, r.n))
        for text, *row in self.least.get() if fresh else ():
            held[bytes(text)].append(tuple(row))
        new = []
        for text, came in fresh.items():
            had = held[text]
            before = min((r[0] for r in had), default=None)
            low = min(r[0] for r in came)
            if before is not None and before < low:
                low = before
            gone = [r for r in came if r[0] > low]
            if before is not None and before > low:
                gone += [r for r in had if r[0] == before]
            for _, part, code, n in gone:
                counted[part, code] -= n
                counted[part, code | COPY] += n
            mine = [r for r in came if r[0] == low]
            new += [(text, *r) for r in mine]
            held[text] = had + mine
        if new:
            kept = [(text, *r) for text, had in held.items() for low in [min(r[0] for r in had)] for r in had if r[0] == low]
            if 2 * len(kept) < sum(map(len, held.values())):
                self.least.put(kept)
            else:
                self.least.appendList(new)
        for (part, code), n in counted.items():
            if n:
                yield Row(part=part, code=code, n=n)


def _buckets(spark: SparkSession, folder: str) -> int:
    """How many buckets the texts are dealt into, as the folder's first run had it."""
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(0, 1, 1, 1).select(F.lit(n).alias("n")).write.mode("ignore").parquet(f"{folder}/buckets")
    return spark.read.schema("n int").parquet(f"{folder}/buckets").first()[0]


def counters(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, batches: int = BATCHES) -> DataFrame:
    """part, mask, good, toxic, n: how many documents fail what. folder: shared, kept between runs to read new files only."""
    folder = folder or shared_dir(spark, "filter-audit")
    table = spark.read.parquet(path)
    each = max(1, -(-len(table.inputFiles()) // batches))
    docs = spark.readStream.schema(table.select("doc_id", "text", "source").schema).option("maxFilesPerTrigger", each).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name one file, a plain path to a stream may not
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((GOOD * flag("quality") + TOXIC * flag("toxic")).alias("label"))
    marked = judged(docs).join(known, "doc_id", "left").select("doc_id", "part", "text_key", (F.col("mask") + F.coalesce("label", F.lit(0))).alias("code"))
    combined = marked.mapInArrow(_combine, "text_key binary, doc_id long, part string, code int, n long")
    bucket = F.pmod(F.xxhash64("text_key"), F.lit(_buckets(spark, folder)))
    changes = combined.withColumn("bucket", bucket).groupBy("bucket").transformWithState(Retractions(), COUNTER, "append", "none")
    was = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    query = changes.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    for name, value in was.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    total = spark.read.schema(COUNTER).parquet(f"{folder}/changes").groupBy("part", "code").agg(F.sum("n").alias("n"))
    return total.where("n != 0").select("part", F.col("code").bitwiseAND(31).alias("mask"), (F.col("code").bitwiseAND(GOOD) > 0).alias("good"), (F.col("code").bitwiseAND(TOXIC) > 0).alias("toxic"), "n")


def report(cells: DataFrame) -> DataFrame:
    """One row per part, order and step. A part has at most 32 masks, so its cells fit one row."""
    tests = [{"filter_order": "".join(o), "step": k + 1, "own": 1 << LETTERS.index(x), "before": sum(1 << LETTERS.index(y) for y in o[:k])} for o in itertools.permutations(LETTERS) for k, x in enumerate(o)]
    n = F.col("n")
    by_mask = cells.groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(F.from_json(F.lit(json.dumps(tests)), "array<struct<filter_order string, step int, own int, before int>>")).alias("t")).select("part", "cells", "t.*")

    def total(of: str, which: str):
        return F.expr(f"aggregate(filter(cells, c -> {which}), 0L, (s, c) -> s + {of})")

    here = "c.mask & own != 0 AND c.mask & before = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("c.n", "c.mask & (own | before) = 0").alias("kept"),
        total("c.n", here).alias("removed"),
        total("c.n", "c.mask & own != 0 AND c.mask & before != 0").alias("redundant"),
        total("c.n", "c.mask = own").alias("unique_fails"),
        total("c.good", here).alias("good_lost"),
        total("c.toxic", here).alias("toxic_lost"),
        # Of the 120 orders, the filter stands first among a mask's k failures in 120 / k.
        total("c.n * (120L div bit_count(c.mask))", "c.mask & own != 0").alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, batches: int = BATCHES) -> DataFrame:
    return report(counters(spark, path, labels, folder, batches))


SQL = r"""
WITH known AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), low AS (
  SELECT text, min(doc_id) AS low FROM docs GROUP BY text
), masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask
  FROM docs JOIN low USING (text) LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), tests AS (
  SELECT filter_order, step, own::BIGINT AS own, coalesce(earlier, 0)::BIGINT AS before FROM steps
), counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own != 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own != 0 AND mask & before != 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own != 0 AND mask & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own != 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cells, tests GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
