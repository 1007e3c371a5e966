"""A resumable search with median pruning; its journal is a file of JSON lines.

The first trials are drawn at random, later ones by tree-structured Parzen estimators: what the
best trials have in common against the others.
"""

from __future__ import annotations

import contextlib
import json
import math
import os
import random
import statistics
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tidewheel.plans.settings import Range, Tuning

TRIAL_SCHEMA = "trial int, state string, value double, seconds double"
#: The share of the complete trials that count as good, how many of them at most, and points tried for each draw.
GOOD, MOST_GOOD, TRIED = 0.1, 25, 24


class Pruned(Exception):
    """A trial that falls behind the median of earlier ones."""


def draw(space: dict[str, Range], rng: random.Random) -> dict:
    """One point of the space: uniform, or log-uniform where the range says so."""
    return {name: rng.choice(r.choices) if r.choices else _value(r, rng.uniform(*_ends(r))) for name, r in space.items()}


def _ends(r: Range) -> tuple[float, float]:
    """The range on the scale that it is drawn on; whole numbers have a unit each."""
    low, high = (r.low - 0.5, r.high + 0.5) if r.method == "suggest_int" else (r.low, r.high)
    return (math.log(max(low, 1e-300)), math.log(high)) if r.log else (low, high)


def _scaled(r: Range, value: float) -> float:
    return math.log(value) if r.log else value


def _value(r: Range, x: float) -> float | int:
    x = math.exp(x) if r.log else x
    return min(int(r.high), max(int(r.low), round(x))) if r.method == "suggest_int" else min(r.high, max(r.low, x))


class _Parzen:
    """A density over a range: a wide bell for the range and one for each point."""

    def __init__(self, r: Range, points: list):
        self.r = r
        if r.choices:
            self.weights = [1 + sum(p == c for p in points) for c in r.choices]
            return
        low, high = _ends(r)
        self.bells = [((low + high) / 2, high - low), *((_scaled(r, p), max(0.05, 1 / (1 + len(points))) * (high - low)) for p in points)]

    def sample(self, rng: random.Random):
        if self.r.choices:
            return rng.choices(self.r.choices, self.weights)[0]
        low, high = _ends(self.r)
        while True:
            x = rng.gauss(*rng.choice(self.bells))
            if low <= x <= high:
                return _value(self.r, x)

    def log_density(self, value) -> float:
        if self.r.choices:
            return math.log(self.weights[self.r.choices.index(value)] / sum(self.weights))
        x, (low, high) = _scaled(self.r, value), _ends(self.r)
        mass = lambda m, s: 0.5 * (math.erf((high - m) / s / math.sqrt(2)) - math.erf((low - m) / s / math.sqrt(2)))
        return math.log(sum(math.exp(-((x - m) ** 2) / (2 * s * s)) / (s * mass(m, s)) for m, s in self.bells) / len(self.bells) + 1e-300)


def suggest(space: dict[str, Range], complete: list[tuple[float, dict]], rng: random.Random) -> dict:
    """A point where good trials are dense against the others; ``complete`` has (loss, params)."""
    ranked = [p for _, p in sorted(complete, key=lambda t: t[0])]
    n = min(MOST_GOOD, math.ceil(GOOD * len(ranked)))
    out = {}
    for name, r in space.items():
        good, others = (_Parzen(r, [p[name] for p in part if name in p]) for part in (ranked[:n], ranked[n:]))
        out[name] = max((good.sample(rng) for _ in range(TRIED)), key=lambda v: good.log_density(v) - others.log_density(v))
    return out


class Journal:
    """Trials that ended, appended one line at a time; a half-written last line is ignored.

    Threads and processes of one machine take turns: the file is on the driver, and a lock file
    beside it is held while a line is written.
    """

    def __init__(self, folder: str, study: str):
        os.makedirs(folder, exist_ok=True)
        self.path = os.path.join(folder, f"{study}.journal")
        self.lock = threading.Lock()

    def read(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        out = []
        with open(self.path, encoding="utf-8") as lines:
            for line in lines:
                try:
                    out.append(json.loads(line))
                except ValueError:
                    continue
        return out

    def append(self, trial: dict) -> None:
        with self.lock, self._alone(), open(self.path, "a+b") as lines:
            end = lines.seek(0, os.SEEK_END)
            if end and (lines.seek(end - 1), lines.read(1))[1] != b"\n":
                lines.write(b"\n")  # after a line that a crash cut off
            lines.write(json.dumps(trial).encode() + b"\n")
            lines.flush()
            os.fsync(lines.fileno())

    @contextlib.contextmanager
    def _alone(self):
        try:
            import fcntl
        except ImportError:  # no such locks here; threads still take turns
            yield
            return
        with open(f"{self.path}.lock", "a") as held:
            fcntl.flock(held, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(held, fcntl.LOCK_UN)


class Study:
    """Runs trials until the journal holds ``num_trials`` finished (complete or pruned) ones.

    Parameters of a trial depend on the seed, its number and the complete trials before it, so a
    study that runs one trial at a time draws the same if it is resumed. ``objective(params,
    report)`` returns a loss; ``report(round, loss)`` may stop it, and ``report.trial`` is the
    trial's number. A trial that fails is journalled as such and its error raised; it does not
    count as finished, and the number is not used again.
    """

    def __init__(self, journal: Journal, space: dict[str, Range], tuning: Tuning):
        self.journal, self.space, self.tuning = journal, space, tuning

    def finished(self) -> list[dict]:
        return [t for t in self.journal.read() if t["state"] in ("COMPLETE", "PRUNED")]

    def remaining(self) -> int:
        return max(0, self.tuning.num_trials - len(self.finished()))

    def _report(self, trial: int, curve: dict[str, float]) -> Callable[[int, float], None]:
        def report(step: int, loss: float) -> None:
            curve[str(step)] = min(loss, curve.get(str(step - 1), math.inf))
            earlier = [t["curve"][str(step)] for t in self.finished() if t["state"] == "COMPLETE" and str(step) in t.get("curve", {})]
            if len(earlier) >= self.tuning.num_startup_trials and curve[str(step)] > statistics.median(earlier):
                raise Pruned

        report.trial = trial
        return report

    def _run(self, trial: int, objective, deadline: float) -> None:
        if time.time() >= deadline:
            return
        rng = random.Random(f"{self.tuning.seed}:{trial}")
        complete = [(t["value"], t["params"]) for t in self.finished() if t["state"] == "COMPLETE"]
        params = suggest(self.space, complete, rng) if len(complete) >= self.tuning.num_startup_trials else draw(self.space, rng)
        began, curve = time.time(), {}
        made = {"trial": trial, "params": params, "value": None, "curve": curve}
        try:
            value, extra = objective(params, self._report(trial, curve))
            made |= {"state": "COMPLETE", "value": value} | extra
        except Pruned:
            made["state"] = "PRUNED"
        except Exception as error:
            self.journal.append(made | {"state": "FAIL", "error": repr(error)[:500], "seconds": time.time() - began})
            raise
        self.journal.append(made | {"seconds": time.time() - began})

    def optimize(self, objective: Callable[[dict, Callable[[int, float], None]], tuple[float, dict]]) -> dict | None:
        """The best complete trial, or None."""
        done = {t["trial"] for t in self.journal.read()}
        todo = [k for k in range(self.tuning.num_trials + len(done)) if k not in done][: self.remaining()]
        deadline = time.time() + self.tuning.timeout
        with ThreadPoolExecutor(self.tuning.num_jobs if self.tuning.num_jobs > 0 else min(4, os.cpu_count() or 1)) as pool:
            list(pool.map(lambda k: self._run(k, objective, deadline), todo))
        return self.best()

    def best(self) -> dict | None:
        complete = [t for t in self.finished() if t["state"] == "COMPLETE"]
        return min(complete, key=lambda t: (t["value"], t["trial"])) if complete else None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t["trial"], t["state"], t["value"], float(t["seconds"])) for t in self.finished()], TRIAL_SCHEMA)
