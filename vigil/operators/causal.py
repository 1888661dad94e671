"""Windows over strictly earlier events, in the total order (timestamp, event_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scan import scan

ORDER = ("timestamp", "event_id")


def prepare(log: DataFrame) -> DataFrame:
    """Adds sec (whole seconds), hour and ncmd to an event log."""
    t = F.col("timestamp").cast("timestamp")
    return log.withColumn("timestamp", t).withColumn("sec", F.unix_timestamp(t)).withColumn("hour", F.hour(t)).withColumn("ncmd", F.coalesce(F.array_size("command_sequence"), F.lit(0)))


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def prior(*keys: str) -> Window:
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, -1)


def trailing_sum(value: Column, keys: list[str], seconds: int) -> Column:
    """Sum over earlier events at most `seconds` ago; within one second only those that come before count. Null values count as none.

    The sum so far less that of what is out of reach: both grow along the key, so a row costs the same however many are in reach.
    """
    gone = Window.partitionBy(*keys).orderBy("sec").rangeBetween(Window.unboundedPreceding, -seconds - 1)
    total = lambda w: F.coalesce(F.sum(value).over(w), F.lit(0))
    return total(prior(*keys)) - F.when(F.col("sec").isNull(), 0).otherwise(total(gone))  # rows without a time are in reach of each other


def pairs_alive(begins: Column, ends: Column, keys: list[str], seconds: int) -> Column:
    """How many pairs of rows are alive at a row: begins marks, at their second row, pairs at most `seconds` apart; ends marks the same pairs at their first row.

    A pair lives from its second row (later rows count it) until its first is more than `seconds` ago.
    """
    gone = Window.partitionBy(*keys).orderBy("sec").rangeBetween(Window.unboundedPreceding, -seconds - 1)
    count = lambda c, w: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
    return count(begins, prior(*keys)) - count(ends, gone)


def first_seen(*keys: str) -> Column:
    return F.row_number().over(ordered(*keys)) == 1


def prior_totals(df: DataFrame, sets: dict[str, tuple[list, Column]], ids: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """ids, carry and, for each name: (keys, value) of sets, the sum of value over the key's rows of earlier events as name, and of the row's own event as name_own.

    Populations have keys with few values and many rows, for which a window would be one task. All sets are counted
    in one pass, along ranges of (set, key, time) with like numbers of rows. ids tell the rows of df apart, and rows are brought together by the first of them; carry are further columns to keep. Keys go by 128 bits.
    """
    null = lambda keys: F.concat_ws(",", *[F.col(k).isNull().cast("string") for k in keys]) if keys else F.lit("")
    each = [F.struct(F.lit(i).alias("_set"), F.xxhash64(F.lit(i), null(keys), *keys).alias("_key"), F.xxhash64(*keys, null(keys), F.lit(~i)).alias("_more"), value.cast("long").alias("_value")) for i, (keys, value) in enumerate(sets.values())]
    names = list(dict.fromkeys([*ids, *ORDER]))
    kept = [c for c in carry if c not in names]
    rows = df.select(*names, *kept, F.explode(F.array(*each)).alias("_x")).select(*names, "_x.*", *[F.when(F.col("_x._set") == 0, F.col(c)).alias(c) for c in kept])
    placed = scan(rows, ["_set", "_key", "_more"], list(ORDER), "_value")
    of = lambda i, c: F.max(F.when(F.col("_set") == i, F.col(c)))
    return placed.repartition(ids[0]).groupBy(*ids).agg(*[F.max(c).alias(c) for c in kept if c not in ids], *[f for i, n in enumerate(sets) for f in (of(i, "_before").alias(n), of(i, "_own").alias(f"{n}_own"))])


def is_first(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Adds whether a row is the first of its keys, found by a grouped minimum that is joined back, so a busy key is no one task's."""
    at = F.struct(*ORDER)
    least = df.groupBy(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).agg(F.min(at).alias("_least"))
    return df.join(least, [df[k].eqNullSafe(least[f"_f{i}"]) for i, k in enumerate(keys)]).withColumn(name, at == F.col("_least")).drop("_least", *[f"_f{i}" for i in range(len(keys))])
