"""Exact weighted draws: cumulative weights with a lookup by cell for tables, alias tables for fixed lists."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scan import scan

#: Cells of a group's range; an item with a share s of the weight is in s * CELLS + 1 of them at most.
CELLS, UNIT = 4096, 1_000_000


def draw_by_weight(draws: DataFrame, at: Column, table: DataFrame, item: str, weight: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """draws with `name`: an item of the table, each with its share of the weight, at a uniform number `at` (0 to 1); within equal values of `by`.

    Weights count in millionths. Items stand in the order of their names along a range as long as their weights' sum; a draw
    falls into one cell of the range and meets the items that touch it.
    """
    group = F.xxhash64(*by).alias("_g") if by else F.lit(0).cast("long").alias("_g")
    rows = table.select(group, F.col(item).alias("_item"), F.round(F.col(weight) * UNIT).cast("long").alias("_w")).where("_w > 0")
    totals = rows.groupBy("_g").agg(F.sum("_w").alias("_all"))
    placed = scan(rows, ["_g"], ["_item"], "_w").join(totals, "_g")
    first, last = F.expr(f"_before * {CELLS} div _all"), F.expr(f"(_before + _w - 1) * {CELLS} div _all")
    spans = placed.select("_g", "_item", F.col("_before").alias("_from"), (F.col("_before") + F.col("_w")).alias("_to"), F.explode(F.sequence(first, last)).alias("_cell"))
    asked = draws.withColumns({"_g": group, "_at": at}).join(totals, "_g").withColumn("_ticket", F.floor(F.col("_at") * F.col("_all")))
    asked = asked.withColumn("_cell", F.expr(f"_ticket * {CELLS} div _all"))
    met = asked.join(spans, ["_g", "_cell"]).where((F.col("_ticket") >= F.col("_from")) & (F.col("_ticket") < F.col("_to")))
    return met.select(*draws.columns, F.col("_item").alias(name))


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share, other) of each slot: a draw takes a slot evenly and stays with probability `share`, else takes `other`."""
    p = np.asarray(weights, float) / np.sum(weights) * len(weights)
    share, other = np.ones(len(p)), np.arange(len(p))
    small, large = [i for i in range(len(p)) if p[i] < 1], [i for i in range(len(p)) if p[i] >= 1]
    while small and large:
        i, j = small.pop(), large[-1]
        share[i], other[i] = p[i], j
        p[j] -= 1 - p[i]
        if p[j] < 1:
            small.append(large.pop())
    return share, other


def draw_from(weights: np.ndarray, slot: Column, stay: Column) -> Column:
    """The number of an item of a fixed list, drawn by weight from two uniform numbers."""
    share, other = alias_table(weights)
    held = lambda x, kind: F.from_json(F.lit(json.dumps(x.tolist())), f"array<{kind}>")
    i = F.floor(slot * len(share)).cast("int")
    return F.when(stay < F.get(held(share, "double"), i), i).otherwise(F.get(held(other, "int"), i))
