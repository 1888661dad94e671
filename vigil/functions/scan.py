"""Sums in an order, along ranges of like size, whatever a key holds.

Rows are dealt by ranges of (place, moment) and sorted; each task sums along its range and gives, with its rows, its first
and last place with their totals. A place that runs over several ranges begins in each with what the ranges before it
hold. So no key is one task, however many rows it has; only rows of one moment of one place stay together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.sources.store import store


def _sums_in_order(batches, place: list[str], names: list[str], moment: list[str]):
    """Rows of one task, sorted by (place, moment), with the sum of _v before their moment within the task and at it; then the task's first and last place with their totals."""
    part, held, first, begin, place_total = TaskContext.get().partitionId(), None, None, None, 0

    def done(table: pa.Table):
        """Rows of whole moments."""
        nonlocal first, begin, place_total
        keys = np.stack([table[c].to_numpy() for c in place])
        new_place = np.any(keys[:, 1:] != keys[:, :-1], axis=0)
        new_moment = new_place.copy()
        for c in moment:
            x = table[c].combine_chunks()
            new_moment |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new_moment) + 1])
        ends = np.concatenate([starts[1:], [table.num_rows]])
        v = pc.fill_null(table["_v"], 0).to_numpy()
        upto = np.concatenate([[0], np.cumsum(v)])
        of_place = np.concatenate([[True], new_place])[starts]  # moments that begin a place within the table
        of_place[0] = begin is None or tuple(keys[:, 0]) != begin
        base = np.maximum.accumulate(np.where(of_place, np.arange(len(starts)), -1))
        before = np.where(base >= 0, upto[starts] - upto[starts[np.maximum(base, 0)]], upto[starts] + place_total)
        own = upto[ends] - upto[starts]
        if first is None:
            first = [tuple(keys[:, 0]), None]
        changes = np.flatnonzero(of_place[1:]) + 1
        if of_place[0] and begin is not None and first[1] is None:
            first[1] = place_total
        if len(changes) and first[1] is None:
            first[1] = int(before[changes[0] - 1] + own[changes[0] - 1])
        place_total, begin = int(before[-1] + own[-1]), tuple(keys[:, starts[-1]])
        lens = ends - starts
        columns = [*(table[n].combine_chunks() for n in names), pa.array(np.repeat(before, lens)), pa.array(np.repeat(own, lens)), pa.array(np.full(table.num_rows, part, np.int32)), pa.array(np.zeros(table.num_rows, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*names, "_before", "_own", "_part", "_edge"])

    schema = None
    for batch in batches:
        schema = batch.schema
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([table[c].to_numpy() for c in place])
        same = np.all(keys == keys[:, -1:], axis=0)
        for c in moment:
            x = table[c].combine_chunks()
            same &= pc.fill_null(pc.equal(x, x[-1]), False).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from done(table.slice(0, cut))
        held = table.slice(cut)
    if held is None:
        return
    yield from done(held)
    edges = [(first[0], place_total if first[1] is None else first[1], 1), (begin, place_total, 2)]
    columns = [pa.array([e[0][place.index(n)] for e in edges], schema.field(n).type) if n in place else pa.nulls(2, schema.field(n).type) for n in names]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([e[1] for e in edges], pa.int64()), pa.array([0, 0], pa.int64()), pa.array([part] * 2, pa.int32()), pa.array([e[2] for e in edges], pa.int32())], [*names, "_before", "_own", "_part", "_edge"])


def summed_ranges(rows: DataFrame, place: list[str], moment: list[str], value: str) -> DataFrame:
    """rows with _before and _own as their task knows them, _part (the task) and _edge: 0, or 1 and 2 for a task's first and last place with its total in _before."""
    rows = rows.withColumn("_v", F.col(value).cast("long"))
    dealt = rows.repartitionByRange(*place, *moment).sortWithinPartitions(*place, *moment)
    columns, kinds = rows.columns, dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["_before long", "_own long", "_part int", "_edge int"])
    return store(dealt.mapInArrow(lambda batches: _sums_in_order(batches, place, columns, moment), schema))


def scan(rows: DataFrame, place: list[str], moment: list[str], value: str) -> DataFrame:
    """rows with _before, the sum of value over rows of the same place with a smaller moment, and _own, that of the row's own moment.

    place: integer columns. value: whole numbers, or null for none.
    """
    summed = summed_ranges(rows, place, moment, value)
    edges = summed.where("_edge > 0").select("_part", "_edge", *place, "_before").orderBy("_part", "_edge").collect()  # two rows a task
    starts, reached, n = [], (None, 0), len(place)
    for a, b in zip(edges[::2], edges[1::2]):
        first, last = tuple(a[2 : 2 + n]), tuple(b[2 : 2 + n])
        start = reached[1] if first == reached[0] else 0
        if start:
            starts.append((a._part, *first, start))
        reached = (last, b._before + (start if first == last else 0))
    kinds = dict(rows.dtypes)
    begun = rows.sparkSession.createDataFrame(starts, ", ".join(["_part int", *[f"`{c}` {kinds[c]}" for c in place], "_start long"]))
    # At most one row a task, so it is sent to each.
    placed = summed.where("_edge = 0").join(F.broadcast(begun), ["_part", *place], "left").withColumn("_before", F.col("_before") + F.coalesce("_start", F.lit(0)))
    return placed.select(*rows.columns, "_before", "_own")


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float, name: str) -> DataFrame:
    """Adds h = (1 - rate) h + rate x along each key's rows, which begins with the first x.

    Steps are affine maps, which compose: within a chunk of rows as one weighted window sum, over chunks by the sums of the few
    chunks before, as older ones weigh less than the double format resolves. No row waits for another's result.
    """
    keep = 1 - rate
    chunk = max(1, int(math.log(1e3) / -math.log(keep)))  # weights within a chunk stay within a factor of 1000
    back = math.ceil(math.log(1e-18) / (chunk * math.log(keep)))
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    rows = rows.withColumns({"_chunk": F.floor(F.col("_i") / chunk), "_k": F.col("_i") % chunk, "_term": F.when(F.col("_i") == 0, F.col(value)).otherwise(rate * F.col(value))})
    power = lambda e: F.pow(F.lit(keep), e)
    own = Window.partitionBy(*keys, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", power(F.col("_k")) * F.sum(F.col("_term") * power(-F.col("_k"))).over(own))
    ends = rows.where(F.col("_k") == chunk - 1).select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_own").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_chunk")
    carried = sum((keep ** (chunk * j) * F.coalesce(F.lag("_end", j).over(before), F.lit(0.0)) for j in range(1, back + 1)), F.col("_end"))
    starts = ends.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_at"), carried.alias("_start"))
    on = [rows[k].eqNullSafe(starts[f"_of{i}"]) for i, k in enumerate(keys)] + [rows["_chunk"] == starts["_at"]]
    joined = rows.join(starts, on, "left")
    return joined.withColumn(name, F.col("_own") + power(F.col("_k") + 1) * F.coalesce("_start", F.lit(0.0))).select(*df.columns, name)
