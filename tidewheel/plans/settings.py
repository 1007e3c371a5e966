"""Validated configuration, from dictionaries or YAML files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

UNITS = ("days", "weeks", "months", "years")
METHODS = ("suggest_int", "suggest_float", "suggest_categorical")


def _positive(owner: object, *names: str) -> None:
    for name in names:
        value = getattr(owner, name)
        if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
            raise ValueError(f"{name} must be a positive integer")


def offsets(units: dict[str, list[int]]) -> tuple[tuple[str, int], ...]:
    """(unit, n) pairs in the order days, weeks, months, years, whatever the input's order."""
    if bad := set(units) - set(UNITS):
        raise ValueError(f"unit must be one of {UNITS}, not {sorted(bad)[0]}")
    for values in units.values():
        if any(not isinstance(n, int) or n < 0 for n in values):
            raise ValueError("offsets must be non-negative integers")
    return tuple((unit, n) for unit in UNITS for n in units.get(unit, ()))


@dataclass(frozen=True)
class Paths:
    input_dir: str
    output_dir: str
    stores: str = "store.csv"
    train: str = "train.csv"
    predictions: str = "predictions.csv"
    store_trial_artifacts: bool = False

    def __post_init__(self):
        for name, base in (("stores", self.input_dir), ("train", self.input_dir), ("predictions", self.output_dir)):
            object.__setattr__(self, name, _absolute(os.path.join(base, getattr(self, name))))
        for name in ("input_dir", "output_dir"):
            object.__setattr__(self, name, _absolute(getattr(self, name)))


def _absolute(path: str) -> str:
    """Paths with a scheme are left as they are; they need not be on this machine."""
    return path if "://" in path else os.path.abspath(path)


# The default features.
@dataclass(frozen=True)
class Features:
    windows: tuple[str | int, ...] = ("7D", "14D", "30D", "60D")
    diffs: tuple[tuple[str, int], ...] = tuple(("days", n) for n in (1, 2, 3, 4, 5, 6, 14, 30))
    lags: tuple[tuple[str, int], ...] = (
        *(("days", n) for n in range(15)), ("weeks", 3), ("weeks", 4), *(("months", n) for n in range(2, 7)), ("years", 1),
    )
    sigma: float = 1.3
    extension_devs: float = 3.0
    country: str = "DE"
    language: str = "en_US"
    #: The competitor's opening month is read as an ISO week unless this is off.
    competition_month_as_week: bool = True


@dataclass(frozen=True)
class CrossValidation:
    n_outer_splits: int = 3
    n_inner_splits: int = 3

    def __post_init__(self):
        _positive(self, "n_outer_splits", "n_inner_splits")


@dataclass(frozen=True)
class Tuning:
    num_trials: int = 100
    timeout: int = 10800
    seed: int = 42
    monitor_periods: int = 100
    num_startup_trials: int = 10
    num_jobs: int = -1
    early_stopping_rounds: int = 50
    num_boost_rounds: int = 10000
    refit_val_fraction: float = 0.1

    def __post_init__(self):
        _positive(self, "num_trials", "timeout", "seed", "monitor_periods", "num_startup_trials", "early_stopping_rounds", "num_boost_rounds")
        if self.num_jobs != -1 and self.num_jobs <= 0:
            raise ValueError("num_jobs must be a positive integer or -1 for all cores")
        if not 0.0 < self.refit_val_fraction < 1.0:
            raise ValueError("refit_val_fraction must lie between 0 and 1")


@dataclass(frozen=True)
class Model:
    tree_method: str = "hist"
    device: str = "cpu"
    objective: str = "reg:squarederror"
    eval_metric: str = "rmse"
    verbosity: int = 0

    def __post_init__(self):
        if self.verbosity not in (0, 1, 2, 3):
            raise ValueError("verbosity must be 0, 1, 2 or 3")


@dataclass(frozen=True)
class Range:
    """What a hyperparameter is drawn from: numbers from low to high, or one of the choices."""

    method: str
    low: float = 0
    high: float = 0
    log: bool = False
    choices: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "choices", tuple(self.choices))
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.method == "suggest_categorical":
            if not self.choices:
                raise ValueError("suggest_categorical needs choices")
        elif self.choices:
            raise ValueError(f"{self.method} has no choices")
        elif self.low >= self.high:
            raise ValueError(f"low ({self.low}) must be less than high ({self.high})")


# The default search space.
SPACE = {
    "max_depth": Range("suggest_int", 3, 10),
    "learning_rate": Range("suggest_float", 0.005, 0.2, True),
    "subsample": Range("suggest_float", 0.6, 1.0),
    "colsample_bytree": Range("suggest_float", 0.6, 1.0),
    "min_child_weight": Range("suggest_int", 1, 20),
    "reg_alpha": Range("suggest_float", 0.001, 1.0, True),
    "reg_lambda": Range("suggest_float", 0.001, 5.0, True),
    "gamma": Range("suggest_float", 0.0, 2.0),
}


@dataclass(frozen=True)
class Settings:
    path: Paths
    horizon: int = 30
    features: Features = field(default_factory=Features)
    cross_validation: CrossValidation = field(default_factory=CrossValidation)
    tuning: Tuning = field(default_factory=Tuning)
    model: Model = field(default_factory=Model)
    space: dict[str, Range] = field(default_factory=lambda: dict(SPACE))

    def __post_init__(self):
        if not isinstance(self.horizon, int) or self.horizon < 0:
            raise ValueError("horizon must be a non-negative number of days")

    @classmethod
    def from_dict(cls, data: dict, input_dir: str, output_dir: str) -> Settings:
        made = {"path": Paths(input_dir, output_dir, **data.get("path", {}))}
        if "horizon" in data:
            made["horizon"] = data["horizon"]
        if f := data.get("feature_engineering"):
            given = dict(f.get("holidays", {}))
            if "windows" in f:
                given["windows"] = tuple(f["windows"])
            for key in ("diffs", "lags"):
                if key in f:
                    given[key] = offsets(f[key])
            made["features"] = Features(**given)
        for key, name, kind in (("cross_validation", "cross_validation", CrossValidation), ("hypertuning", "tuning", Tuning), ("model_constants", "model", Model)):
            if key in data:
                made[name] = kind(**data[key])
        if "hyperparameters" in data:
            made["space"] = {name: Range(**spec) for name, spec in data["hyperparameters"].items()}
        return cls(**made)

    @classmethod
    def from_yaml(cls, path: str, input_dir: str, output_dir: str) -> Settings:
        with open(path, encoding="utf-8") as lines:
            return cls.from_dict(load_yaml(lines.read()), input_dir, output_dir)


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None if text in ("", "null", "~") else text


def load_yaml(text: str):
    """The subset of YAML that configurations use: nested maps, lists of scalars, comments."""
    lines = []
    for raw in text.splitlines():
        quoted, kept = "", raw
        for k, c in enumerate(raw):
            if c in "\"'" and quoted in ("", c):
                quoted = "" if quoted else c
            elif c == "#" and not quoted and (k == 0 or raw[k - 1] in " \t"):
                kept = raw[:k]
                break
        if kept.strip():
            lines.append((len(kept) - len(kept.lstrip()), kept.strip()))

    def block(k: int, indent: int):
        if lines[k][1].startswith("- "):
            items = []
            while k < len(lines) and lines[k][0] == indent and lines[k][1].startswith("- "):
                items.append(_scalar(lines[k][1][2:]))
                k += 1
            return items, k
        made = {}
        while k < len(lines) and lines[k][0] == indent:
            name, _, rest = lines[k][1].partition(":")
            k += 1
            if rest.strip():
                made[name.strip()] = _scalar(rest)
            elif k < len(lines) and (lines[k][0] > indent or lines[k][0] == indent and lines[k][1].startswith("- ")):
                made[name.strip()], k = block(k, lines[k][0])
            else:
                made[name.strip()] = None
        return made, k

    return block(0, lines[0][0])[0] if lines else {}
