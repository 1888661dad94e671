"""The signals of a stream as a plain model, event by event, over deques and dicts."""

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from vigil.schema import BURST_FLOOR, BURST_MIN, COLD_N0, EARTH_KM, FAIL_WINDOW, GEO_CAP_KMH, GEO_GATE_KM, IP_WINDOW, LONG_WINDOW, NGRAM, OFFHOURS
from vigil.streaming.model import Priors
from vigil.streaming.state import ENTITY_SIGNALS, MOST_DEVICE_SETS, MOST_DEVICES, MOST_GRAMS, MOST_IPS, MOST_RESOURCES


def _prune(times: deque, now: int, seconds: int) -> deque:
    while times and now - (times[0][0] if isinstance(times[0], tuple) else times[0]) > seconds:
        times.popleft()
    return times


def _bump(counts: dict, key, most: int) -> None:
    """Counts a key; an eighth above `most`, the least used of the others go."""
    counts[key] = counts.get(key, 0) + 1
    if len(counts) > most + most // 8:
        tup = lambda k: repr(k if isinstance(k, tuple) else (k,))
        for k in sorted((k for k in counts if k != key), key=lambda k: (counts[k], tup(k)))[: len(counts) - most]:
            del counts[k]


def _bits(p: float, floor: float = 1e-9) -> float:
    return -math.log2(max(p, floor))


def tokens_of(e) -> list[str]:
    commands = [] if e.command_sequence is None else [f"cmd:{c}" for c in e.command_sequence]
    return [f"hr:{e.hour:02d}", f"res:{e.resource_accessed}", f"auth:{e.auth_method}", "ok" if e.auth_result == "success" else "fail", *commands]


class Moments:
    def __init__(self):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def z(self, x: float, floor: float, least: int = 5) -> float:
        if self.n < least:
            return 0.0
        return abs(x - self.mean) / max(max(self.m2 / max(self.n - 1, 1), 1e-6) ** 0.5, floor)

    def add(self, x: float) -> None:
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)


@dataclass
class EntityState:
    n: int = 0
    first: int | None = None
    last: tuple | None = None
    times: deque = field(default_factory=deque)
    fails: deque = field(default_factory=deque)
    ips: dict = field(default_factory=dict)
    countries: dict = field(default_factory=dict)
    methods: dict = field(default_factory=dict)
    touched: dict = field(default_factory=dict)
    new: deque = field(default_factory=deque)
    devices: dict = field(default_factory=dict)
    duration: Moments = field(default_factory=Moments)
    commands: Moments = field(default_factory=Moments)
    hours: list = field(default_factory=lambda: [0] * 24)
    resources: dict = field(default_factory=dict)
    off: deque = field(default_factory=deque)
    bigrams: dict = field(default_factory=dict)
    contexts: dict = field(default_factory=dict)
    sequence: Moments = field(default_factory=Moments)
    quarantined: bool = False

    def p_hour(self, e, priors: Priors) -> float:
        lam = self.n / (self.n + COLD_N0)
        own = (self.hours[e.hour] + 0.5) / (self.n + 12) if self.n else 1 / 24
        return lam * own + (1 - lam) * priors.p_hour(e.entity_type, e.hour)

    def token_bits(self, e, priors: Priors) -> float:
        """Mean bits of the event's tokens by the entity's bigrams, its type's and single tokens."""
        part = lambda a, b: a / b if b else 0.0
        before, bits = "<BOS>", []
        for t in tokens_of(e):
            p = NGRAM["entity"] * part(self.bigrams.get((before, t), 0), self.contexts.get(before, 0))
            p += NGRAM["group"] * part(priors.bigrams.get((e.entity_type, before, t), 0), priors.contexts.get((e.entity_type, before), 0))
            bits.append(_bits(p + NGRAM["unigram"] * part(priors.tokens.get(t, 0), priors.n_tokens) + NGRAM["floor"], 1e-12))
            before = t
        return sum(bits) / len(bits)

    def score(self, e, priors: Priors) -> dict[str, float]:
        lam, now = self.n / (self.n + COLD_N0), e.sec
        out = dict.fromkeys(ENTITY_SIGNALS, 0.0)
        if self.last:
            lat, lon, sec = self.last
            a = np.sin(np.radians(e.geo_lat - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(e.geo_lat)) * np.sin(np.radians(e.geo_lon - lon) / 2) ** 2
            km = 2 * EARTH_KM * np.arcsin(min(1.0, np.sqrt(a)))
            out["geo_velocity"] = float(min(km / max((now - sec) / 3600, 1 / 60), GEO_CAP_KMH)) if km > GEO_GATE_KM else 0.0
        out["fail_rate_entity"] = float(len(_prune(self.fails, now, FAIL_WINDOW)))
        recent = len(_prune(self.times, now, FAIL_WINDOW))
        if self.n >= BURST_MIN:
            out["burst_ratio"] = recent / max(self.n * FAIL_WINDOW / max(now - self.first, 1), BURST_FLOOR)
        sets = self.devices.get(e.device_id)
        if sets:
            usual = max(sets, key=sets.get)
            out["fingerprint_mismatch"] = float(sum(a != b for a, b in zip(usual, _device(e))))
        for name, held, value in (("ip_novelty", self.ips, e.source_ip), ("country_novelty", self.countries, e.geo_country), ("auth_method_novelty", self.methods, e.auth_method)):
            out[name] = 0.0 if value in held else lam
        out["duration_z"] = self.duration.z(float(np.log1p(e.session_duration)), 0.15)
        out["ncmd_z"] = self.commands.z(float(e.ncmd), 0.75)
        edges = _prune(self.new, now, LONG_WINDOW)
        out["new_resource_rate_7d"] = float(len(edges))
        out["breadth_ratio_7d"] = sum(self.touched.get(r, 0) <= 1 for _, r, _ in edges) / len(edges) if edges else 0.0
        out["hour_surprisal"] = _bits(self.p_hour(e, priors))
        p_role = priors.p_role(e.role, e.resource_accessed)
        own = (self.resources.get(e.resource_accessed, 0) + 0.5) / (self.n + 32) if self.n else 1e-3
        out["peer_incongruence"] = _bits(p_role)
        out["resource_surprisal"] = max(0.0, _bits(lam * own + (1 - lam) * p_role) - out["peer_incongruence"])
        if self.sequence.n >= 8:
            spread = max(max(self.sequence.m2 / (self.sequence.n - 1), 1e-6) ** 0.5, 0.5)
            out["cmd_surprisal"] = (self.token_bits(e, priors) - self.sequence.mean) / spread
        out["offhours_rate_7d"] = float(len(_prune(self.off, now, LONG_WINDOW)))
        together = sum(met < now for _, _, met in edges)
        out["corroboration_7d"], out["uncorroborated_new_edges_7d"] = float(together), float(len(edges) - together)
        return out

    def observe(self, e, priors: Priors, learn: bool = True) -> None:
        """Observations always advance; the baseline only from events that may be learned from. A quarantined one learns no more."""
        learn = learn and not self.quarantined
        if e.resource_accessed not in (self.resources if self.quarantined else self.touched):
            self.new.append((e.sec, e.resource_accessed, priors.second_peer(e.role, e.resource_accessed, e.entity_id, e.sec)))
        if self.p_hour(e, priors) < OFFHOURS:
            self.off.append(e.sec)
        _bump(self.touched, e.resource_accessed, MOST_RESOURCES)
        self.last = (e.geo_lat, e.geo_lon, e.sec)
        self.times.append(e.sec)
        self.first = e.sec if self.first is None else self.first
        if e.auth_result == "failure":
            self.fails.append(e.sec)
        if learn:
            self.n += 1
            self.hours[e.hour] += 1
            _bump(self.resources, e.resource_accessed, MOST_RESOURCES)
            before = "<BOS>"
            for t in tokens_of(e):
                _bump(self.bigrams, (before, t), MOST_GRAMS)
                _bump(self.contexts, before, MOST_GRAMS)
                before = t
            self.sequence.add(self.token_bits(e, priors))
            _bump(self.ips, e.source_ip, MOST_IPS)
            _bump(self.countries, e.geo_country, MOST_IPS)
            _bump(self.methods, e.auth_method, MOST_IPS)
            sets, own = self.devices.setdefault(e.device_id, {}), _device(e)
            sets[own] = sets.get(own, 0) + 1
            if len(sets) > MOST_DEVICE_SETS:
                del sets[min((k for k in sets if k != own), key=sets.get)]
            if len(self.devices) > MOST_DEVICES:
                del self.devices[min((d for d in self.devices if d != e.device_id), key=lambda d: (sum(self.devices[d].values()), repr(d)))]
            self.duration.add(float(np.log1p(e.session_duration)))
            self.commands.add(float(e.ncmd))


def _device(e) -> tuple:
    return e.device_os, e.device_mac, e.device_firmware, e.device_protocol


@dataclass
class AddressState:
    fails: deque = field(default_factory=deque)
    tries: deque = field(default_factory=deque)

    def score(self, e, priors: Priors) -> dict[str, float]:
        fails = len(_prune(self.fails, e.sec, FAIL_WINDOW))
        tries = _prune(self.tries, e.sec, IP_WINDOW)
        return {"fail_rate_ip": float(fails), "ip_entity_fanout": float(len({x for _, x in tries})), "ip_fail_ratio": fails / len(tries) if len(tries) >= 5 else 0.0}

    def observe(self, e, priors: Priors, learn: bool = True) -> None:
        if e.auth_result == "failure":
            self.fails.append(e.sec)
        self.tries.append((e.sec, e.entity_id))
