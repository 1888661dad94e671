import datetime as dt
import math
import os
import random
from types import SimpleNamespace

import pytest

from tests import streaming_model as plain_model
from tests.test_signals import plain, small_log
from vigil.operators import fusion as U
from vigil.operators.signals import signal_frame
from vigil.schema import EVENT_SCHEMA, SIGNALS
from vigil.streaming import scorer, state
from vigil.streaming.model import LiveModel, Priors, build_priors


class Store:
    """One state variable of one key, in memory; counts what is read or written."""

    def __init__(self, book):
        self.book, self.held = book, {}

    def _touch(self, n=1):
        self.book["touched"] += n

    def get(self):
        self._touch()
        return self.held.get("value", [] if "list" in self.held else None)

    def update(self, value):
        self._touch()
        self.held["value"] = value

    def put(self, rows):
        self._touch(len(rows))
        self.held["value"] = rows

    def clear(self):
        self.held = {}

    def getValue(self, key):
        self._touch()
        return self.held.get(key)

    def containsKey(self, key):
        return key in self.held

    def updateValue(self, key, value):
        self._touch()
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        self._touch(len(self.held))
        return iter(list(self.held.items()))


class Handle:
    def __init__(self):
        self.book = {"touched": 0}
        self.getValueState = self.getMapState = self.getListState = lambda *a: Store(self.book)


def event(rng, i, sec, many=6):
    return SimpleNamespace(
        event_id=f"{i:06d}", entity_id="e", entity_type="user", role="r", sec=sec, hour=sec // 3600 % 24, geo_lat=rng.choice([52.5, 48.9]), geo_lon=rng.choice([13.4, 2.35]), geo_country=rng.choice(["DE", "FR"]),
        source_ip=f"ip{rng.randrange(many * 20)}", resource_accessed=f"res{rng.randrange(many * 80)}" if rng.random() < 0.8 else f"once{i}", auth_method=rng.choice("pq"), auth_result=rng.choice(["success", "failure"]), session_duration=rng.uniform(1, 100),
        command_sequence=rng.choice([None, [], ["a"], ["a", "b", f"c{rng.randrange(many)}"]]), device_id=f"d{rng.randrange(many * 15)}", device_os=rng.choice("abc"), device_mac=rng.choice("uvw"), device_firmware="f", device_protocol="p", ncmd=rng.randrange(4),
    )


def priors_of(rng):
    firsts = {("r", f"res{k}"): [(rng.randrange(4_000_000), f"x{j}") for j in range(4)] for k in range(0, 480, 3)}
    return Priors({"user": 50}, {("user", h): h for h in range(24)}, {"r": (90, 9)}, {("r", "res1"): 30}, firsts, {("user", "<BOS>", "hr:03"): 4}, {("user", "<BOS>"): 50}, {"ok": 60}, 400)


@pytest.mark.parametrize("freeze", [False, True])
def test_typed_state_equals_the_plain_model(freeze):
    """Over bounds, windows, repeats, peers that take a resource up later, and quarantine; the state is written and opened again all the time."""
    rng = random.Random(3)
    priors, handle = priors_of(rng), Handle()
    typed, model = state.EntityState(handle), plain_model.EntityState()
    decide = scorer.quarantine(theta=1e9, spike=2.5 if freeze else 1e9)
    sec, typed_open = 0, False
    model.usual = None
    for i in range(4000):
        sec += rng.choice([0, 0, 5, 200, 900, 4000])
        e = event(rng, i, sec)
        if not typed_open:
            typed.open()
            typed_open = True
        want, got = model.score(e, priors), typed.score(e, priors)
        assert {n: pytest.approx(v, abs=1e-9) for n, v in want.items()} == got, (i, {n: (v, got[n]) for n, v in want.items() if abs(v - got[n]) > 1e-9})
        model.observe(e, priors, decide(want, e, model))
        typed.observe(e, priors, decide(got, e, typed))
        if rng.random() < 0.3:
            typed.close()
            typed_open = False
    assert typed.quarantined == model.quarantined == freeze
    assert max(m.size / m.most for m in typed.maps if m.most) <= 9 / 8


def test_what_an_event_touches_does_not_grow_with_the_state():
    rng = random.Random(4)
    handle = Handle()
    typed, spent = state.EntityState(handle), []
    for i in range(3000):
        before = handle.book["touched"]
        typed.open()
        e = event(rng, i, i * 40, 3)
        typed.score(e, Priors())
        typed.observe(e, Priors())
        typed.close()
        spent.append(handle.book["touched"] - before)
    held = sum(len(m.state.held) for m in typed.maps) + len(typed.rows.held)
    assert held > 1500
    assert sorted(spent[-500:])[450] < 2 * sorted(spent[100:600])[450] < 200


def test_addresses_equal_the_plain_model():
    rng = random.Random(5)
    handle = Handle()
    typed, model, sec = state.AddressState(handle), plain_model.AddressState(), 0
    for i in range(1500):
        sec += rng.choice([0, 1, 60, 500, 5000])
        e = event(rng, i, sec)
        e.entity_id = f"e{rng.randrange(20)}"
        typed.open()
        assert typed.score(e, None) == pytest.approx(model.score(e, None))
        typed.observe(e, None)
        typed.close()
        model.observe(e, None)


def test_quarantine_freezes_the_baseline():
    typed, none, rng = state.EntityState(Handle()), Priors(), random.Random(1)
    decide = scorer.quarantine(theta=100.0)
    typed.open()
    for i in range(300):
        e = event(rng, i, i * 3600)
        e.resource_accessed = "usual" if i < 250 else f"odd{i}"
        signals = typed.score(e, none)
        typed.observe(e, none, decide(signals, e, typed))
    assert typed.quarantined and typed.n < 260 and signals["new_resource_rate_7d"] > 40


def put(spark, rows, folder, i):
    """One file, which one micro-batch takes."""
    spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for f in os.listdir(folder):
        if f.endswith(".parquet") and not f.startswith("b"):
            os.rename(f"{folder}/{f}", f"{folder}/b{i}-{f}")
            os.utime(f"{folder}/b{i}-{f}", (1000 + i, 1000 + i))


def expected(rows, priors_by_row):
    """Signals of a stream, by the plain model; priors_by_row: those that each event saw."""
    entities, addresses, out = {}, {}, {}
    for r, priors in zip(rows, priors_by_row):
        e = SimpleNamespace(**dict(zip(EVENT_SCHEMA.names, r)))
        e.sec, e.hour, e.ncmd = int((e.timestamp - dt.datetime(1970, 1, 1)).total_seconds() // 1), e.timestamp.hour, len(e.command_sequence or ())
        a, x = addresses.setdefault(e.source_ip, plain_model.AddressState()), entities.setdefault(e.entity_id, plain_model.EntityState())
        out[e.event_id] = a.score(e, priors) | x.score(e, priors)
        a.observe(e, priors)
        x.observe(e, priors)
    return out


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    """A log served in one query: two files, a restart, a new model while it runs, two more files, a late event and a file that closes."""
    tmp = tmp_path_factory.mktemp("served")
    old, rows = small_log(5, 300), sorted(small_log(3, 160), key=lambda r: (r[4], r[0]))
    log = spark.createDataFrame(old, EVENT_SCHEMA)
    one, two = build_priors(log), build_priors(spark.createDataFrame(old[:80], EVENT_SCHEMA))
    fusions = U.fit(signal_frame(log, ("entity_type",)))
    folder = f"{tmp}/log"
    model = LiveModel(spark, f"{tmp}/model")
    model.publish(one, fusions)
    put(spark, rows[:40], folder, 0)
    put(spark, rows[40:80], folder, 1)
    source = lambda: scorer.read_log(spark, folder, maxFilesPerTrigger=1)
    progress = scorer.Progress(spark)
    q = scorer.serve(source(), model, f"{tmp}/out", late="1 day", trigger={"availableNow": True})
    q.awaitTermination(300)
    model = LiveModel(spark, f"{tmp}/model")  # as a new driver would find it
    assert model.version == 1
    q = scorer.serve(source(), model, f"{tmp}/out", late="1 day", trigger={"processingTime": "1 second"})
    put(spark, rows[80:120], folder, 2)
    q.processAllAvailable()
    model.publish(two, fusions)
    put(spark, rows[120:], folder, 3)
    q.processAllAvailable()
    late = [("late", *rows[50][1:4], rows[-1][4] - dt.timedelta(days=3), *rows[50][5:])]
    put(spark, late, folder, 4)
    q.processAllAvailable()
    q.stop()
    progress.stop()
    alerts = {r.event_id: r for r in spark.read.parquet(f"{tmp}/out/alerts").collect()}
    return SimpleNamespace(tmp=tmp, rows=rows, one=one, two=two, fusions=fusions, alerts=alerts, late=late, progress=progress, source=source, model=model)


def test_one_query_has_all_signals_after_a_restart_and_with_live_priors(spark, served):
    want = expected(served.rows, [served.one] * 120 + [served.two] * 40)
    assert set(served.alerts) == set(want)
    assert spark.read.parquet(f"{served.tmp}/out/alerts").count() == len(want)
    for i, r in served.alerts.items():
        for s in SIGNALS:
            assert r[s.name] == pytest.approx(want[i][s.name], abs=1e-9), (s.name, i)
    assert len({r.model for r in served.alerts.values()}) == 2
    batch = plain(served.rows)
    for i, r in served.alerts.items():
        for name in (*scorer.ENTITY_SIGNALS, *scorer.IP_SIGNALS):
            if name in batch[i] and name not in scorer.POPULATION_SIGNALS:
                assert r[name] == pytest.approx(batch[i][name], abs=1e-9), (name, i)


def test_late_events_are_in_their_own_table_and_alerts_have_reasons(spark, served):
    late = spark.read.parquet(f"{served.tmp}/out/late").collect()
    assert [(r.event_id, r.timestamp) for r in late] == [("late", served.late[0][4])]
    for r in served.alerts.values():
        theta = served.fusions[r.level].theta
        assert len(r.why) <= 3 and (r.band == "HIGH") == (r.raw >= theta) and r.took_ms > 0
    assert sum(p["numInputRows"] for p in served.progress.batches) >= 160
    assert scorer.latency_report(served.progress.batches)["state_rows"] > 0


def test_a_repeated_batch_writes_nothing_twice(spark, served, tmp_path):
    """The last commit is lost, as if the driver had died after writing: the batch runs again over the same rows."""
    commits = f"{served.tmp}/out/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    q = scorer.serve(served.source(), served.model, f"{served.tmp}/out", late="1 day", trigger={"availableNow": True})
    q.awaitTermination(300)
    ids = [r.event_id for r in spark.read.parquet(f"{served.tmp}/out/alerts").select("event_id").collect()]
    assert sorted(ids) == sorted(served.alerts) and spark.read.parquet(f"{served.tmp}/out/late").count() == 1


def test_idle_state_goes_by_a_timer():
    """The timer of a key that is still in use is set anew; that of an idle one clears its state."""
    handle, timers = Handle(), []
    handle.registerTimer = timers.append
    p = scorer.Scoring(state.EntityState, scorer.ENTITY_SIGNALS, ["event_id"], 1000_000)
    p.init(handle)
    rng = random.Random(2)
    for sec in (100, 900):
        e = event(rng, sec, sec)
        e.timestamp, e.model = sec, None
        list(p.handleInputRows(("e",), [SimpleNamespace(asDict=lambda e=e: vars(e))], None))
    assert timers == [1100_000]
    at = SimpleNamespace(getExpiryTimeInMs=lambda: timers[-1])
    list(p.handleExpiredTimer(("e",), None, at))
    assert timers == [1100_000, 1900_000] and p.held.core.held
    list(p.handleExpiredTimer(("e",), None, at))
    assert not p.held.core.held and not any(m.state.held for m in p.held.maps) and not p.held.rows.held


def test_session_alerts_close_after_the_gap(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=m), s) for m, s in ((0, 0.1), (60, 0.9), (125, 0.5), (600, 0.2))]
    folder = f"{tmp_path}/s"
    spark.createDataFrame(rows, "entity_id string, timestamp timestamp, score double").write.parquet(folder)
    src = spark.readStream.schema("entity_id string, timestamp timestamp, score double").parquet(folder)
    q = scorer.session_alerts(src).writeStream.format("memory").queryName("sess").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.n_events, r.max_score) for r in spark.table("sess").select("n_events", "max_score").collect())
    assert got[:2] == [(1, 0.5), (2, 0.9)]


def test_a_fixed_fusion_and_no_fusion(spark, served):
    rows = spark.read.parquet(f"{served.tmp}/out/alerts").drop("level", "raw", "score", "band", "why")
    own = scorer.scored_stream(rows, served.fusions["entity"]).collect()
    assert {r.level for r in own} == {"entity"} and all(math.isfinite(r.raw) for r in own)
    none = scorer.scored_stream(rows.withColumn("model", rows.model.substr(1, 0)).replace("", None, "model")).collect()
    assert {(r.level, r.score, r.band, len(r.why)) for r in none} == {(None, 0.0, "LOW", 0)}
