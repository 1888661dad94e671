"""What a running stream knows of populations and levels, and how a new version reaches it without a restart.

A version is one file of a shared folder: priors (bounded counts that a batch job made of a log) and fitted
fusions. publish() writes it, hands the file to Spark for its executors and names it in a small table; each
micro-batch joins its events to the newest name, so the next batch after publish() uses the new version. Tasks
load a file once in a process.
"""

from __future__ import annotations

import hashlib
import math
import os
import pickle
from dataclasses import dataclass, field

import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.schema import LONG_WINDOW

#: Most rows of each prior table, and first accesses kept of a resource by a role.
MOST_PRIORS, MOST_FIRSTS = 100_000, 32


@dataclass
class Priors:
    """What the last batch job counted of populations: rows by type, type and hour, role, role and resource, and tokens."""

    types: dict = field(default_factory=dict)
    hours: dict = field(default_factory=dict)  # (type, hour)
    roles: dict = field(default_factory=dict)  # role -> rows, resources
    resources: dict = field(default_factory=dict)  # (role, resource)
    firsts: dict = field(default_factory=dict)  # (role, resource) -> (second, entity) of first accesses
    bigrams: dict = field(default_factory=dict)  # (type, before, token)
    contexts: dict = field(default_factory=dict)  # (type, before)
    tokens: dict = field(default_factory=dict)
    n_tokens: int = 0

    def p_hour(self, kind, hour: int) -> float:
        n = self.types.get(kind, 0)
        return (self.hours.get((kind, hour), 0) + 1) / (n + 24) if n else 1 / 24

    def p_role(self, role, resource) -> float:
        n, d = self.roles.get(role, (0, 0))
        return (self.resources.get((role, resource), 0) + 0.5) / (n + 0.5 * (d + 1)) if n else 1e-3

    def second_peer(self, role, resource, entity, sec: int) -> float:
        """When the second other entity had taken up a resource, if within a week of this second."""
        near = [at for at, who in self.firsts.get((role, resource), ()) if who != entity and abs(at - sec) <= LONG_WINDOW]
        return near[1] if len(near) > 1 else math.inf


def build_priors(log: DataFrame, most: int = MOST_PRIORS) -> Priors:
    """Counts of a log by populations; of each table the `most` largest counts, so that it can be sent out at any size."""
    t = F.col("timestamp").cast("timestamp")
    ev = log.withColumn("hour", F.hour(t)).withColumn("sec", F.unix_timestamp(t))

    def counts(df, *keys):
        top = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(most).collect()
        return {(r[0] if len(keys) == 1 else tuple(r[: len(keys)])): r.n for r in top}

    parts = [F.format_string("hr:%02d", "hour"), F.concat(F.lit("res:"), "resource_accessed"), F.concat(F.lit("auth:"), "auth_method"), F.when(F.col("auth_result") == "success", "ok").otherwise("fail")]
    every = F.concat(F.array(*parts), F.transform(F.coalesce("command_sequence", F.array().cast("array<string>")), lambda c: F.concat(F.lit("cmd:"), c)))
    pairs = F.transform(every, lambda x, i: F.struct(F.when(i > 0, F.get(every, i - 1)).otherwise("<BOS>").alias("before"), x.alias("token")))
    grams = ev.select("entity_type", F.explode(pairs).alias("g")).select("entity_type", "g.before", "g.token")
    roles = {r.role: (r.n, r.d) for r in ev.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("resource_accessed").alias("d")).orderBy(F.desc("n"), "role").limit(most).collect()}
    own = ev.groupBy("role", "resource_accessed", "entity_id").agg(F.min("sec").alias("at"))
    place = F.row_number().over(Window.partitionBy("role", "resource_accessed").orderBy(F.desc("at"), "entity_id"))
    last = own.withColumn("k", place).where(F.col("k") <= MOST_FIRSTS).groupBy("role", "resource_accessed").agg(F.sort_array(F.collect_list(F.struct("at", "entity_id"))).alias("f"), F.max("at").alias("newest"))
    firsts = {(r.role, r.resource_accessed): [(x.at, x.entity_id) for x in r.f] for r in last.orderBy(F.desc("newest"), "role", "resource_accessed").limit(most).collect()}
    return Priors(counts(ev, "entity_type"), counts(ev, "entity_type", "hour"), roles, counts(ev, "role", "resource_accessed"), firsts, counts(grams, "entity_type", "before", "token"), counts(grams, "entity_type", "before"), counts(grams, "token"), grams.count())


class LiveModel:
    """The versions of a shared folder. A new process finds the newest one there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.view = f"vigil_model_{hashlib.blake2b(self.folder.encode(), digest_size=6).hexdigest()}"
        spark.createDataFrame([], "one int, version long, name string").write.mode("append").parquet(f"{self.folder}/versions")
        spark.read.parquet(f"{self.folder}/versions").createOrReplaceTempView(self.view)
        if self.version:
            self._send(self.version)

    @property
    def version(self) -> int:
        """The newest version, 0 before the first."""
        return self.spark.table(self.view).agg(F.max("version")).first()[0] or 0

    def _send(self, version: int) -> str:
        file = self.spark.read.parquet(f"{self.folder}/version-{version}").inputFiles()[0]
        self.spark.sparkContext.addFile(file)
        return os.path.basename(file)

    def publish(self, priors: Priors, fusions: dict | None = None) -> int:
        """Writes a version; micro-batches that start from now on use it."""
        version = self.version + 1
        row = [(version, bytearray(pickle.dumps((priors, fusions or {}))))]
        self.spark.createDataFrame(row, "version long, blob binary").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version-{version}")
        name = self._send(version)
        self.spark.createDataFrame([(1, version, name)], "one int, version long, name string").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        self.spark.catalog.refreshTable(self.view)
        return version

    def attach(self, events: DataFrame) -> DataFrame:
        """events with `model`, the name of the newest version's file (null before the first)."""
        newest = self.spark.table(self.view).groupBy("one").agg(F.max(F.struct("version", "name")).alias("newest"))  # one row
        joined = events.withColumn("one", F.lit(1)).join(F.broadcast(newest), "one", "left")
        return joined.withColumn("model", F.col("newest.name")).drop("one", "newest")


_loaded: dict[str, tuple[Priors, dict]] = {}


def load(name: str | None) -> tuple[Priors, dict]:
    """The priors and fusions of a file, in a task."""
    if name is None:
        return Priors(), {}
    if name not in _loaded:
        while len(_loaded) > 1:
            _loaded.pop(next(iter(_loaded)))
        _loaded[name] = pickle.loads(pq.read_table(SparkFiles.get(name))["blob"][0].as_py())
    return _loaded[name]
