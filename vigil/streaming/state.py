"""Typed keyed state of the stream: what entities and addresses keep between micro-batches.

An entity's state is one row of numbers (value state), maps of counts, and queues of trailing windows (maps by number,
of which only the ends are touched). A micro-batch reads an entry when it needs it and writes back what changed, so what
an event touches doesn't grow with what its key holds. Totals that a window would have to be read for (new resources
in all, touched once, taken up by peers) are kept as numbers and changed as events come, go and repeat.

Bounds: when a map passes its bound by an eighth, its least used entries go, down to the bound, in the order (count, key).
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from vigil.schema import BURST_FLOOR, BURST_MIN, COLD_N0, EARTH_KM, FAIL_WINDOW, GEO_CAP_KMH, GEO_GATE_KM, IP_WINDOW, LONG_WINDOW, NGRAM, OFFHOURS

from .model import Priors, load

#: Most addresses, resources, sets of device properties, devices and bigrams that a key's state holds.
MOST_IPS, MOST_RESOURCES, MOST_DEVICE_SETS, MOST_DEVICES, MOST_GRAMS = 96, 384, 6, 64, 2048
ENTITY_SIGNALS = ("geo_velocity", "fail_rate_entity", "burst_ratio", "fingerprint_mismatch", "ip_novelty", "country_novelty", "auth_method_novelty", "duration_z", "ncmd_z", "new_resource_rate_7d", "breadth_ratio_7d", "hour_surprisal", "resource_surprisal", "peer_incongruence", "cmd_surprisal", "offhours_rate_7d", "uncorroborated_new_edges_7d", "corroboration_7d")
#: Those that read priors: they see the population as of the newest published version.
POPULATION_SIGNALS = ENTITY_SIGNALS[-7:]
IP_SIGNALS = ("fail_rate_ip", "ip_entity_fanout", "ip_fail_ratio")
QUEUES = ("times", "fails", "off", "edges")


class Counts:
    """A map of counts. Entries are read once and written once in a micro-batch."""

    def __init__(self, state, most: int = 0):
        self.state, self.most = state, most

    def open(self, size: int) -> None:
        self.size, self.seen, self.changed = size, {}, set()

    def get(self, *key) -> int:
        if key not in self.seen:
            got = self.state.getValue(key)
            self.seen[key] = got[0] if got is not None else 0
        return self.seen[key]

    def add(self, *key, by: int = 1) -> list[tuple[tuple, int]]:
        """Changes a count; gives the entries that had to go."""
        was = self.get(*key)
        self.seen[key] = was + by
        self.changed.add(key)
        self.size += (was + by > 0) - (was > 0)
        return self._shed(key) if self.most and self.size > self.most + self.most // 8 else []

    def _shed(self, new: tuple) -> list[tuple[tuple, int]]:
        self.flush()
        every = sorted(((n[0], tuple(k)) for k, n in self.state.iterator() if tuple(k) != new), key=lambda x: (x[0], repr(x[1])))
        gone = [(k, n) for n, k in every[: len(every) + 1 - self.most]]
        for k, _ in gone:
            self.state.removeKey(k)
            self.seen[k] = 0
        self.size = self.most
        return gone

    def flush(self) -> None:
        for k in self.changed:
            if self.seen[k] > 0:
                self.state.updateValue(k, (self.seen[k],))
            elif self.state.containsKey(k):
                self.state.removeKey(k)
        self.changed.clear()


class Queue:
    """(second, text, number) of a trailing window, numbered from head to tail."""

    def __init__(self, state, number: int):
        self.state, self.number = state, number

    def open(self, head: int, tail: int, oldest: int) -> None:
        self.head, self.tail, self.oldest, self.pushed = head, tail, oldest, {}

    def __len__(self) -> int:
        return self.tail - self.head

    def push(self, sec: int, text: str | None = None, number: float | None = None) -> None:
        if self.head == self.tail:
            self.oldest = sec
        self.pushed[self.tail] = (sec, text, number)
        self.tail += 1

    def prune(self, now: int, seconds: int) -> Iterator[tuple]:
        """Takes off and gives what is more than `seconds` old at the head."""
        while self.head < self.tail and now - self.oldest > seconds:
            at = self.head
            item = self.pushed.pop(at, None)
            if item is None:
                item = self.state.getValue((self.number, at))
                self.state.removeKey((self.number, at))
            self.head += 1
            if self.head < self.tail:
                self.oldest = (self.pushed.get(self.head) or self.state.getValue((self.number, self.head)))[0]
            yield tuple(item)

    def flush(self) -> None:
        for at, item in self.pushed.items():
            self.state.updateValue((self.number, at), item)
        self.pushed = {}


class Moments:
    def __init__(self, n: float, mean: float, m2: float):
        self.n, self.mean, self.m2 = n, mean, m2

    def z(self, x: float, floor: float, least: int = 5) -> float:
        if self.n < least:
            return 0.0
        return abs(x - self.mean) / max(max(self.m2 / max(self.n - 1, 1), 1e-6) ** 0.5, floor)

    def add(self, x: float) -> None:
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)


def bits(p: float, floor: float = 1e-9) -> float:
    return -math.log2(max(p, floor))


def tokens_of(e) -> list[str]:
    commands = [] if e.command_sequence is None else [f"cmd:{c}" for c in e.command_sequence]
    return [f"hr:{e.hour:02d}", f"res:{e.resource_accessed}", f"auth:{e.auth_method}", "ok" if e.auth_result == "success" else "fail", *commands]


def device_of(e) -> tuple:
    return e.device_os, e.device_mac, e.device_firmware, e.device_protocol


def _km(lat: float, lon: float, e) -> float:
    a = math.sin(math.radians(e.geo_lat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(e.geo_lat)) * math.sin(math.radians(e.geo_lon - lon) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(a)))


class EntityState:
    """One entity's state over the typed states of a handle: open() for a key, then score() and observe() each event, then close()."""

    #: n: events learned from; last: seconds of the last event; alone: edges whose resource was touched once; together: those that two peers share.
    CORE = "n long, first long, last long, lat double, lon double, moments array<double>, hours array<long>, sizes array<long>, queues array<long>, alone long, together long, next_met double, quarantined boolean, usual double"
    EMPTY = (0, None, None, None, None, [0.0] * 9, [0] * 24, [0] * 8, [0] * 12, 0, 0, math.inf, False, None)

    def __init__(self, handle):
        self.core = handle.getValueState("core", self.CORE)
        text = lambda name, most=0: Counts(handle.getMapState(name, "value string", "n long"), most)
        self.ips, self.countries, self.methods = text("ips", MOST_IPS), text("countries", MOST_IPS), text("methods", MOST_IPS)
        self.touched, self.resources = text("touched", MOST_RESOURCES), text("resources", MOST_RESOURCES)
        self.bigrams = Counts(handle.getMapState("bigrams", "before string, token string", "n long"), MOST_GRAMS)
        self.contexts, self.edge_counts = text("contexts", MOST_GRAMS), text("edge_counts")
        self.maps = (self.ips, self.countries, self.methods, self.touched, self.resources, self.bigrams, self.contexts, self.edge_counts)
        self.devices = handle.getMapState("devices", "device string", "sets array<struct<os string, mac string, firmware string, protocol string, n long>>")
        self.rows = handle.getMapState("queues", "queue int, place long", "sec long, text string, number double")
        self.queues = {name: Queue(self.rows, i) for i, name in enumerate(QUEUES)}
        self.times, self.fails, self.off, self.edges = self.queues.values()
        self.pending = handle.getListState("pending", "met double")

    def open(self) -> None:
        got = self.core.get()
        self.new = got is None
        self.n, self.first, self.last, self.lat, self.lon, moments, hours, sizes, queues, self.alone, self.together, self.next_met, self.quarantined, self.usual = self.EMPTY if got is None else got
        self.duration, self.commands, self.sequence = (Moments(*moments[i : i + 3]) for i in (0, 3, 6))
        self.hours = list(hours)
        for m, size in zip(self.maps, sizes):
            m.open(size)
        for i, q in enumerate(self.queues.values()):
            q.open(*queues[3 * i : 3 * i + 3])
        self.sets, self.changed_devices, self.met = {}, set(), None

    def close(self) -> None:
        for m in self.maps:
            m.flush()
        for q in self.queues.values():
            q.flush()
        for d in self.changed_devices:
            self.devices.updateValue((d,), ([(*k, n) for k, n in self.sets[d].items()],))
        if self.met is not None:
            self.pending.put([(m,) for m in self.met]) if self.met else self.pending.clear()
        moments = [float(x) for m in (self.duration, self.commands, self.sequence) for x in (m.n, m.mean, m.m2)]
        queues = [x for q in self.queues.values() for x in (q.head, q.tail, q.oldest)]
        self.core.update((self.n, self.first, self.last, self.lat, self.lon, moments, self.hours, [m.size for m in self.maps], queues, self.alone, self.together, self.next_met, self.quarantined, self.usual))

    def clear(self) -> None:
        for s in (self.core, self.devices, self.rows, self.pending, *[m.state for m in self.maps]):
            s.clear()

    def _device(self, device) -> dict:
        if device not in self.sets:
            got = self.devices.getValue((device,))
            self.sets[device] = {} if got is None else {tuple(x)[:4]: x[4] for x in got[0]}
        return self.sets[device]

    def _pending(self) -> list[float]:
        if self.met is None:
            self.met = [m[0] for m in self.pending.get()] if self.next_met < math.inf else []
        return self.met

    def _pass(self, now: int) -> None:
        """Moves time on for the new resources of a week."""
        if self.next_met < now:
            held = self._pending()
            self.together += sum(m < now for m in held)
            self.met = [m for m in held if m >= now]
            self.next_met = min(self.met, default=math.inf)
        for _, resource, met in self.edges.prune(now, LONG_WINDOW):
            self.edge_counts.add(resource, by=-1)
            self.alone -= self.touched.get(resource) <= 1
            self.together -= met is not None

    def p_hour(self, e, priors: Priors) -> float:
        lam = self.n / (self.n + COLD_N0)
        own = (self.hours[e.hour] + 0.5) / (self.n + 12) if self.n else 1 / 24
        return lam * own + (1 - lam) * priors.p_hour(e.entity_type, e.hour)

    def token_bits(self, e, priors: Priors) -> float:
        """Mean bits of the event's tokens by the entity's bigrams, its type's and single tokens."""
        part = lambda a, b: a / b if b else 0.0
        before, total, tokens = "<BOS>", 0.0, tokens_of(e)
        for t in tokens:
            p = NGRAM["entity"] * part(self.bigrams.get(before, t), self.contexts.get(before))
            p += NGRAM["group"] * part(priors.bigrams.get((e.entity_type, before, t), 0), priors.contexts.get((e.entity_type, before), 0))
            total += bits(p + NGRAM["unigram"] * part(priors.tokens.get(t, 0), priors.n_tokens) + NGRAM["floor"], 1e-12)
            before = t
        return total / len(tokens)

    def score(self, e, priors: Priors) -> dict[str, float]:
        lam, now = self.n / (self.n + COLD_N0), e.sec
        out = dict.fromkeys(ENTITY_SIGNALS, 0.0)
        if self.last is not None and None not in (self.lat, self.lon, e.geo_lat, e.geo_lon):
            km = _km(self.lat, self.lon, e)
            out["geo_velocity"] = min(km / max((now - self.last) / 3600, 1 / 60), GEO_CAP_KMH) if km > GEO_GATE_KM else 0.0
        for q, seconds in ((self.fails, FAIL_WINDOW), (self.times, FAIL_WINDOW), (self.off, LONG_WINDOW)):
            for _ in q.prune(now, seconds):
                pass
        self._pass(now)
        out["fail_rate_entity"] = float(len(self.fails))
        if self.n >= BURST_MIN:
            out["burst_ratio"] = len(self.times) / max(self.n * FAIL_WINDOW / max(now - self.first, 1), BURST_FLOOR)
        sets = self._device(e.device_id)
        if sets:
            usual = max(sets, key=sets.get)
            out["fingerprint_mismatch"] = float(sum(a != b for a, b in zip(usual, device_of(e))))
        for name, held, value in (("ip_novelty", self.ips, e.source_ip), ("country_novelty", self.countries, e.geo_country), ("auth_method_novelty", self.methods, e.auth_method)):
            out[name] = 0.0 if held.get(value) else lam
        out["duration_z"] = self.duration.z(math.log1p(e.session_duration or 0.0), 0.15)
        out["ncmd_z"] = self.commands.z(float(e.ncmd), 0.75)
        edges = len(self.edges)
        out["new_resource_rate_7d"] = float(edges)
        out["breadth_ratio_7d"] = self.alone / edges if edges else 0.0
        out["hour_surprisal"] = bits(self.p_hour(e, priors))
        p_role = priors.p_role(e.role, e.resource_accessed)
        own = (self.resources.get(e.resource_accessed) + 0.5) / (self.n + 32) if self.n else 1e-3
        out["peer_incongruence"] = bits(p_role)
        out["resource_surprisal"] = max(0.0, bits(lam * own + (1 - lam) * p_role) - out["peer_incongruence"])
        if self.sequence.n >= 8:
            spread = max(max(self.sequence.m2 / (self.sequence.n - 1), 1e-6) ** 0.5, 0.5)
            out["cmd_surprisal"] = (self.token_bits(e, priors) - self.sequence.mean) / spread
        out["offhours_rate_7d"] = float(len(self.off))
        out["corroboration_7d"], out["uncorroborated_new_edges_7d"] = float(self.together), float(edges - self.together)
        return out

    def observe(self, e, priors: Priors, learn: bool = True) -> None:
        """Observations always advance; the baseline only from events that may be learned from. A quarantined one learns no more."""
        learn, resource = learn and not self.quarantined, e.resource_accessed
        if not (self.resources if self.quarantined else self.touched).get(resource):
            met = priors.second_peer(e.role, resource, e.entity_id, e.sec)
            self.edges.push(e.sec, resource, met if met < math.inf else None)
            self.edge_counts.add(resource)
            self.alone += self.touched.get(resource) <= 1
            if met < e.sec:
                self.together += 1
            elif met < math.inf:
                self._pending().append(met)
                self.next_met = min(self.next_met, met)
        if self.p_hour(e, priors) < OFFHOURS:
            self.off.push(e.sec)
        if self.touched.get(resource) == 1:
            self.alone -= self.edge_counts.get(resource)
        for (gone,), n in self.touched.add(resource):
            if n > 1:
                self.alone += self.edge_counts.get(gone)
        self.lat, self.lon, self.last = e.geo_lat, e.geo_lon, e.sec
        self.times.push(e.sec)
        self.first = e.sec if self.first is None else self.first
        if e.auth_result == "failure":
            self.fails.push(e.sec)
        if learn:
            self.n += 1
            self.hours[e.hour] += 1
            self.resources.add(resource)
            before = "<BOS>"
            for t in tokens_of(e):
                self.bigrams.add(before, t)
                self.contexts.add(before)
                before = t
            self.sequence.add(self.token_bits(e, priors))
            self.ips.add(e.source_ip)
            self.countries.add(e.geo_country)
            self.methods.add(e.auth_method)
            self._learn_device(e)
            self.duration.add(math.log1p(e.session_duration or 0.0))
            self.commands.add(float(e.ncmd))

    def _learn_device(self, e) -> None:
        sets, own = self._device(e.device_id), device_of(e)
        sets[own] = sets.get(own, 0) + 1
        if len(sets) > MOST_DEVICE_SETS:
            del sets[min((k for k in sets if k != own), key=sets.get)]
        self.changed_devices.add(e.device_id)
        if len(sets) == 1 and sets[own] == 1:  # a new device
            for d in self.changed_devices:
                self.devices.updateValue((d,), ([(*k, n) for k, n in self.sets[d].items()],))
            every = sorted(((sum(x[4] for x in s[0]), repr(k[0]), k[0]) for k, s in self.devices.iterator() if k[0] != e.device_id), key=lambda x: x[:2])
            for _, _, d in every[: max(0, len(every) + 1 - MOST_DEVICES)]:
                self.devices.removeKey((d,))
                self.sets.pop(d, None)
                self.changed_devices.discard(d)


class AddressState:
    CORE = "last long, queues array<long>, fanout long"

    def __init__(self, handle):
        self.core = handle.getValueState("core", self.CORE)
        self.rows = handle.getMapState("queues", "queue int, place long", "sec long, text string, number double")
        self.fails, self.tries = Queue(self.rows, 0), Queue(self.rows, 1)
        self.entities = Counts(handle.getMapState("entities", "value string", "n long"))

    def open(self) -> None:
        got = self.core.get()
        self.new = got is None
        self.last, queues, size = (None, [0] * 6, 0) if got is None else got
        self.fails.open(*queues[:3])
        self.tries.open(*queues[3:])
        self.entities.open(size)

    def close(self) -> None:
        for x in (self.fails, self.tries, self.entities):
            x.flush()
        self.core.update((self.last, [x for q in (self.fails, self.tries) for x in (q.head, q.tail, q.oldest)], self.entities.size))

    def clear(self) -> None:
        for s in (self.core, self.rows, self.entities.state):
            s.clear()

    def score(self, e, priors: Priors) -> dict[str, float]:
        for _ in self.fails.prune(e.sec, FAIL_WINDOW):
            pass
        for _, entity, _ in self.tries.prune(e.sec, IP_WINDOW):
            self.entities.add(entity, by=-1)
        fails, tries = len(self.fails), len(self.tries)
        return {"fail_rate_ip": float(fails), "ip_entity_fanout": float(self.entities.size), "ip_fail_ratio": fails / tries if tries >= 5 else 0.0}

    def observe(self, e, priors: Priors, learn: bool = True) -> None:
        if e.auth_result == "failure":
            self.fails.push(e.sec)
        self.tries.push(e.sec, e.entity_id)
        self.entities.add(e.entity_id)
        self.last = e.sec


class Scoring(StatefulProcessor):
    """Adds the signals of one kind of state to a key's events, taken in the order (timestamp, event_id).

    A timer removes the state of a key `idle_ms` of event time after its last event.
    """

    def __init__(self, make, names: tuple[str, ...], columns: list[str], idle_ms: int | None, decide=None):
        self.make, self.names, self.columns, self.idle_ms, self.decide = make, names, columns, idle_ms, decide

    def init(self, handle) -> None:
        self.handle, self.held = handle, self.make(handle)
        self.row = Row(*self.columns, *self.names, "n_after", f"{self.make.__name__}_ms")

    def handleInputRows(self, key, rows, timerValues):
        held = self.held
        held.open()
        for e in sorted((SimpleNamespace(**r.asDict()) for r in rows), key=lambda e: (e.timestamp, e.event_id)):
            began = time.perf_counter()
            priors = load(e.model)[0]
            s = held.score(e, priors)
            held.observe(e, priors, True if self.decide is None else bool(self.decide(s, e, held)))
            took = (time.perf_counter() - began) * 1000
            yield self.row(*[getattr(e, c) for c in self.columns], *[float(s[n]) for n in self.names], float(getattr(held, "n", 0)), took)
        if held.new and self.idle_ms is not None:
            self.handle.registerTimer(held.last * 1000 + self.idle_ms)
        held.close()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.open()
        due = (self.held.last or 0) * 1000 + self.idle_ms
        if due <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        else:
            self.handle.registerTimer(due)
        return iter(())
