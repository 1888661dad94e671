"""Mixing sources to target weights by capped water-filling.

Every source has a weight; targets are proportional to the weights until a source reaches its
cap of max_epochs times its own size, and what is above goes to the others by weight, until no
target is above its cap. The level is found in closed form: in the order of cap / weight, the
capped sources are a prefix, which running sums give. Then each document is taken as often as
the whole part of target / size says, and a seeded order of the source's documents takes the
rest: documents from the start of the order once more, the last of them in part.

A source may hold a third of all rows, so its order is laid in 16 ** digits buckets of the
seeded hash: bucket totals and their running sums say where a bucket starts, and only the rows
of one bucket of one source are sorted together.

Null texts have size 0 and a null source is a source of its own, last in order. Rows that tie
in the order (repeated rows) have equal sizes or differ by doc_id. An empty table gives an
empty result. Only doc_id, text and source are read; further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The mix has NUM / DEN times all words.
SHARE = (3, 2)


def sizes(docs: DataFrame, seed: str = "mix-1", digits: int = 3) -> DataFrame:
    """doc_id, source_key, size, place: what the plan needs of each document."""
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("x"), "source"), F.lit("z")).alias("source_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))).alias("place"),
    ).withColumn("bucket", F.substring("place", 1, digits))


def targets(by_source: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs: int = 2) -> DataFrame:
    """source_key, source_size -> also target, whole, rest. One row for each source."""
    ranked = by_source.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights) + 1))
    by_level = Window.orderBy((F.col("cap") / F.col("w")), "source_key")
    all_rows = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up, down = share
    x = (
        ranked.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("k", F.row_number().over(by_level))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", F.sum("source_size").over(all_rows) * up - F.col("capped") * down)
        .withColumn("over", F.col("cap") * F.col("open_w") * down > F.col("w") * F.col("left"))
        .withColumn("level", F.min(F.when(F.col("over"), F.struct("k", "left", "open_w"))).over(all_rows))
    )
    free = F.col("level").isNotNull() & (F.col("k") >= F.col("level.k"))
    x = x.withColumn("num", F.col("w") * F.col("level.left")).withColumn("den", F.col("level.open_w") * down)
    return (
        x.withColumn("target", F.when(free, F.col("num").cast("double") / F.col("den").cast("double")).otherwise(F.col("cap").cast("double")))
        .withColumn("words", F.when(free, F.expr("num div den")).otherwise(F.col("cap")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div nullif(source_size, 0)")).otherwise(F.lit(0)).cast("long"))
        .select("source_key", "source_size", "target", "whole", (F.col("words") - F.col("whole") * F.col("source_size")).alias("rest"))
    )


def mix(docs: DataFrame, seed: str = "mix-1", digits: int = 3, weights=WEIGHTS, share=SHARE, max_epochs: int = 2) -> DataFrame:
    """doc_id, source_key, size, source_size, target, whole (full repetitions), extra (words of one more), taken."""
    rows = written(sizes(docs, seed, digits), "mix-sizes")  # texts are read once
    buckets = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    plan = targets(buckets.groupBy("source_key").agg(F.sum("in_bucket").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).join(plan, "source_key").drop("in_bucket")
    within = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, ["source_key", "bucket"])
        .withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at"))))
        .select("doc_id", "source_key", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))
    )


def repeated(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as the plan takes it; a part of a document is its first words.

    Rows that share a doc_id take their own rows of the plan: by source and size, in the order of the
    text and of what is taken, so a rerun agrees. A null doc_id is one like others.
    """
    wanted = ["_mix_id", "_mix_source", "_mix_size"]
    plan = plan.select(F.col("doc_id").alias("_p_id"), F.col("source_key").alias("_p_source"), F.col("size").alias("_p_size"), F.col("whole").alias("_mix_whole"), F.col("extra").alias("_mix_extra"))
    named = docs.withColumns({"_mix_id": F.col("doc_id"), "_mix_source": F.coalesce(F.concat(F.lit("x"), "source"), F.lit("z")), "_mix_size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")})
    on = named["_mix_id"].eqNullSafe(plan["_p_id"])
    if not plan.groupBy("_p_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        named = named.withColumn("_mix_nth", F.row_number().over(Window.partitionBy(*wanted).orderBy("text")))
        plan = plan.withColumn("_p_nth", F.row_number().over(Window.partitionBy("_p_id", "_p_source", "_p_size").orderBy(F.desc("_mix_whole"), F.desc("_mix_extra"))))
        on = named["_mix_id"].eqNullSafe(plan["_p_id"]) & (named["_mix_source"] == plan["_p_source"]) & (named["_mix_size"] == plan["_p_size"]) & (named["_mix_nth"] == plan["_p_nth"])
    n = F.col("_mix_whole") + (F.col("_mix_extra") > 0).cast("long")
    copies = named.join(plan, on).where(n > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    part = (F.col("_mix_copy") > F.col("_mix_whole")) & (F.col("_mix_extra") < F.col("_mix_size"))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_mix_extra").cast("int")), " ")
    return copies.withColumn("text", F.when(part, words).otherwise(F.col("text"))).select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('x' || source, 'z') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS place
  FROM documents),
src AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, 2 * source_size AS cap,
  CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
levels AS (SELECT *, row_number() OVER o AS k,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY cap / w, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
  sum(source_size) OVER () AS everything
  FROM weighed WINDOW o AS (ORDER BY cap / w, source_key)),
cutoff AS (SELECT k AS k0, 3 * everything - 2 * capped AS lft, open_w AS ow FROM levels
  WHERE cap * open_w * 2 > w * (3 * everything - 2 * capped) ORDER BY k LIMIT 1),
planned AS (SELECT source_key, source_size,
  CASE WHEN k0 IS NOT NULL AND k >= k0 THEN (w * lft)::DOUBLE / (2 * ow)::DOUBLE ELSE cap::DOUBLE END AS target,
  CASE WHEN k0 IS NOT NULL AND k >= k0 THEN ((w * lft) // (2 * ow))::BIGINT ELSE cap END AS words
  FROM levels LEFT JOIN cutoff ON true),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM planned),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY place, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sized)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, words - whole * source_size - pos)))::BIGINT AS taken
FROM placed JOIN whole USING (source_key)
"""
