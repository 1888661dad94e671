"""Online scoring: the 21 causal signals over a stream as one query, with typed state per address and per entity.

events -> the newest model version -> state by source_ip -> state by entity_id -> scores and reasons. Both stateful steps
are in one query with one checkpoint: the first hands its events and the watermark on to the second in the same
micro-batch. Events of a key are taken in the order (timestamp, event_id) within a micro-batch. What a signal needs of
a population or of peers comes from the published priors, so the four surprisals and the corroboration signals
see a population as of the newest version, where the batch counts up to the event.

Spark drops events that are older than the watermark. serve() finds them by comparing each micro-batch's input with
its output and writes them to a table of their own. Its tables have a folder for each micro-batch, which a repeated batch
overwrites, so every alert and every late event is there once.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vigil.operators import explain as X
from vigil.schema import COLD_MIN, EVENT_SCHEMA, SIGNALS

from .model import LiveModel, Priors, build_priors, load  # noqa: F401
from .state import ENTITY_SIGNALS, IP_SIGNALS, POPULATION_SIGNALS, AddressState, EntityState, Scoring  # noqa: F401

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Typed state needs the store on disk. Many small stores don't reserve space ahead, and a batch uploads its changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _ready(events: DataFrame, model: LiveModel | None, late: str) -> DataFrame:
    t = F.col("timestamp").cast("timestamp")
    ready = events.withColumn("timestamp", t).withWatermark("timestamp", late)
    ready = ready.withColumns({"sec": F.unix_timestamp("timestamp"), "hour": F.hour("timestamp"), "ncmd": F.coalesce(F.array_size("command_sequence"), F.lit(0))})
    return model.attach(ready) if model else ready.withColumn("model", F.lit(None).cast("string"))


def _stateful(ready: DataFrame, key: str, make, names: tuple[str, ...], idle: str | None, decide=None) -> DataFrame:
    kept = [f for f in ready.schema.fields if f.name not in (*names, "n_after", f"{make.__name__}_ms")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} double" for n in (*names, "n_after", f"{make.__name__}_ms")])
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return ready.groupBy(key).transformWithState(Scoring(make, names, [f.name for f in kept], idle_ms, decide), schema, "append", "eventTime", eventTimeColumnName="timestamp")


def address_signals(events: DataFrame, late: str = "1 hour", idle: str | None = "1 day", model: LiveModel | None = None) -> DataFrame:
    """events with the three signals of each address."""
    return _stateful(_ready(events, model, late), "source_ip", AddressState, IP_SIGNALS, idle).drop("n_after", "AddressState_ms", "sec", "hour", "ncmd", "model")


def entity_signals(events: DataFrame, late: str = "1 hour", idle: str | None = "30 days", model: LiveModel | None = None, decide=None) -> DataFrame:
    """events with the signals of each entity. decide(signals, event, state) -> whether to learn from an event; it may set state.quarantined."""
    out = _stateful(_ready(events, model, late), "entity_id", EntityState, ENTITY_SIGNALS, idle, decide)
    return out.withColumn("cold_start", F.col("n_after") <= COLD_MIN).drop("EntityState_ms", "sec", "hour", "ncmd", "model")


def all_signals(events: DataFrame, model: LiveModel | None = None, late: str = "1 hour", idle: tuple[str | None, str | None] = ("1 day", "30 days"), decide=None) -> DataFrame:
    """events with all 21 signals, n_after (what the entity's state has learned), cold_start, model and took_ms (spent on the event in both steps)."""
    one = _stateful(_ready(events, model, late), "source_ip", AddressState, IP_SIGNALS, idle[0]).drop("n_after")
    two = _stateful(one, "entity_id", EntityState, ENTITY_SIGNALS, idle[1], decide)
    took = F.col("AddressState_ms") + F.col("EntityState_ms")
    return two.withColumns({"cold_start": F.col("n_after") <= COLD_MIN, "took_ms": took}).drop("AddressState_ms", "EntityState_ms", "sec", "hour", "ncmd")


def quarantine(theta: float, spike: float = 2.5, alone: float = 2.0, memory: float = 0.02):
    """A decide() for entity_signals(): no learning from flagged events; a jump in new resources that no peers share freezes the entity's baseline."""

    def decide(s: dict, e, state: EntityState) -> bool:
        usual, new = state.usual, s["new_resource_rate_7d"]
        state.usual = new if usual is None else (1 - memory) * usual + memory * new
        jump = new > spike * max(usual or 0.0, 0.5)
        if jump and s["uncorroborated_new_edges_7d"] >= alone:
            state.quarantined = True
        risk = s["resource_surprisal"] + 0.6 * new + 0.9 * s["uncorroborated_new_edges_7d"] - 0.7 * s["corroboration_7d"]
        return not state.quarantined and not jump and risk < theta

    return decide


def session_alerts(scored: DataFrame, gap: str = "60 minutes", late: str = "10 minutes", key: str = "entity_id") -> DataFrame:
    """Alerts of a stream of scored events: sessions per key, closed when the watermark passes their gap."""
    w = F.session_window("timestamp", gap)
    return scored.withWatermark("timestamp", late).groupBy(F.col(key), w).agg(F.count("*").alias("n_events"), F.max("score").alias("max_score"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("top"))


def scored_stream(signals: DataFrame, fusions=None, k: int = 3) -> DataFrame:
    """One alert row for each event: level (that of the highest raw score), raw, score (its probability), band, and why (its strongest signals).

    fusions: the fitted levels by name, or one of them; None: those of the version that `model` names, row by row.
    Events without a fitted level have no level, score 0 and band LOW.
    """
    fixed = fusions if fusions is None or isinstance(fusions, dict) else {fusions.level: fusions}
    held = signals.sparkSession.sparkContext.broadcast(fixed)
    columns = signals.columns
    plain = [s.name for s in SIGNALS if not s.mitigating and s.name in columns and (fixed is None or any(s in f.signals for f in fixed.values()))]

    def scored(pdf: pd.DataFrame, levels: list) -> pd.DataFrame:
        if not levels:
            return pdf.assign(level=None, raw=np.nan, score=0.0, band="LOW", **{f"z_{n}": np.nan for n in plain})
        raws = np.stack([f.raw(pdf) for _, f in levels], 1)
        best = raws.argmax(1)
        pick = lambda per: np.stack(per, 1)[np.arange(len(pdf)), best]
        raw, theta = pick(list(raws.T)), np.array([f.theta for _, f in levels])[best]
        pdf = pdf.assign(level=np.array([n for n, _ in levels], object)[best], raw=raw, score=pick([f.probability(x) for (_, f), x in zip(levels, raws.T)]), band=np.where(raw >= theta, "HIGH", np.where(raw >= theta / 2, "MEDIUM", "LOW")))
        z = {f"z_{n}": np.nan for n in plain}
        for _, f in levels:
            if f.signals:
                z |= {f"z_{s.name}": v for s, v in zip(f.signals, f.z(pdf, f.signals).T)}
        return pdf.assign(**{n: z[n] for n in (f"z_{x}" for x in plain)})

    def run(batches):
        for pdf in batches:
            pdf = pdf[columns]
            if held.value is not None:
                parts = [(held.value, pdf)]
            else:
                parts = [(load(name if isinstance(name, str) else None)[1], part) for name, part in pdf.groupby("model", dropna=False)]
            for levels, part in parts:
                if len(part):
                    yield scored(part, list(levels.items()))

    more = ["level string", "raw double", "score double", "band string", *[f"z_{n} double" for n in plain]]
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in signals.schema] + more)
    out = signals.mapInPandas(run, schema)
    why = X.explanation({n: F.col(f"z_{n}") for n in plain}, {n: F.col(n) for n in plain}, k)
    return out.withColumn("why", why).drop(*[f"z_{n}" for n in plain])


def serve(events: DataFrame, model: LiveModel, folder: str, late: str = "1 hour", idle: tuple[str | None, str | None] = ("1 day", "30 days"), decide=None, trigger: dict | None = None):
    """Starts the query: alert rows go to <folder>/alerts, events behind the watermark to <folder>/late, by micro-batch. A restart goes on from its checkpoint."""
    use_state_store(events.sparkSession)
    alerts = scored_stream(all_signals(events, model, late, idle, decide)).withColumn("_input", F.lit(False))
    given = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("_input", F.lit(True))
    columns = events.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        done = batch.where("NOT _input").drop("_input")
        done.write.mode("overwrite").parquet(f"{folder}/alerts/batch_id={batch_id}")
        missed = batch.where("_input").select(*columns).join(done.select("event_id"), "event_id", "left_anti")
        missed.select(*columns).write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        batch.unpersist()

    both = alerts.unionByName(given, allowMissingColumns=True)
    return both.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_log(spark, source: str, schema=EVENT_SCHEMA, kind: str = "parquet", **options) -> DataFrame:
    """A stream of events: files of a folder, or a Kafka topic keyed by entity whose values are JSON."""
    if kind == "kafka":
        raw = spark.readStream.format("kafka").option("subscribe", source).options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
    return spark.readStream.schema(schema).format(kind).options(**options).load(source)


class Progress(StreamingQueryListener):
    """Collects the progress of each micro-batch of this session's queries: rows, durations, dropped rows and state."""

    def __init__(self, spark: SparkSession):
        self.spark, self.batches = spark, []
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches.append(json.loads(event.progress.json))

    def onQueryTerminated(self, event) -> None:
        pass

    def stop(self) -> None:
        self.spark.streams.removeListener(self)


def latency_report(progress) -> dict[str, float]:
    """Percentiles of batch duration, throughput and state size, from a query or from a list of its micro-batches' progress."""
    every = progress if isinstance(progress, list) else progress.recentProgress
    p = [x for x in every if x["numInputRows"]]
    if not p:
        return {"batches": 0}
    ms = np.array([x["durationMs"]["triggerExecution"] for x in p], float)
    rows = sum(x["numInputRows"] for x in p)
    last = p[-1]["stateOperators"]
    total = lambda name: float(sum(s.get(name, 0) for s in last))
    return {"batches": len(ms), "rows": rows, "rows_per_s": rows / max(ms.sum() / 1000, 1e-9), **{f"p{q}_ms": float(np.percentile(ms, q)) for q in (50, 95, 99, 100)}, "state_bytes": total("memoryUsedBytes"), "state_rows": total("numRowsTotal")}


def benchmark(events: DataFrame, folder: str, model: LiveModel | None = None, files: int = 10, warm_up: int = 1) -> dict[str, float]:
    """Serves a log dealt into files in the order of time, one a micro-batch; the first warm_up batches aren't counted.

    events/s counts whole micro-batches; the percentiles are of the time that tasks spend on an event in both steps.
    """
    spark = events.sparkSession
    events.repartitionByRange(files, "timestamp").write.mode("overwrite").parquet(f"{folder}/log")
    progress = Progress(spark)
    source = read_log(spark, f"{folder}/log", events.schema, maxFilesPerTrigger=1)
    query = serve(source, model or LiveModel(spark, f"{folder}/model"), f"{folder}/out", late="3650 days", idle=(None, None), trigger={"availableNow": True})
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    progress.stop()
    counted = [p for p in progress.batches if p["numInputRows"] and p["batchId"] >= warm_up]
    out = latency_report(counted)
    alerts = spark.read.parquet(f"{folder}/out/alerts").where(F.col("batch_id") >= warm_up)
    row = alerts.agg(F.count("*").alias("events"), F.percentile("took_ms", [0.5, 0.95, 0.99]).alias("p"), F.max("took_ms").alias("most"), F.countDistinct("entity_id").alias("entities")).first()
    seconds = sum(p["durationMs"]["triggerExecution"] for p in counted) / 1000
    return {"n_events": row.events, "wall_seconds": seconds, "events_per_second": row.events / max(seconds, 1e-9), "p50_ms": row.p[0], "p95_ms": row.p[1], "p99_ms": row.p[2], "max_ms": row.most, "n_entities": row.entities, "batch_p50_ms": out["p50_ms"], "batch_p95_ms": out["p95_ms"], "state_rows": out["state_rows"]}
