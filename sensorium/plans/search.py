"""Search for parameters over folds: a sampler proposes each trial from the table of those before, and poor ones stop early.

The table of trials is small and lives on the driver; what a trial costs are its fits, which are Spark jobs.

The sampler is a tree-structured Parzen estimator: after `startup` trials drawn evenly, finished ones are split into a
share of best ones and the rest; each parameter is drawn from the density of the best (normal kernels on its scale, and
an even part), and of several draws the one is taken that is likeliest under it compared with the rest. A trial is
stopped after a fold if its mean so far is worse than the median of what whole trials had after as many folds.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import median

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame, SparkSession

from sensorium.operators import splits

from .forecast import boosted


@dataclass(frozen=True)
class Span:
    """Numbers from low to high; log: evenly over their logarithms; whole: integers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def __post_init__(self):
        if not self.low <= self.high or self.log and self.low <= 0:
            raise ValueError(f"no span from {self.low} to {self.high}")

    def ends(self) -> tuple[float, float]:
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        return (math.log(low), math.log(high)) if self.log else (low, high)

    def value(self, u: float) -> float | int:
        low, high = self.ends()
        x = low + u * (high - low)
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return min(max(round(x), math.ceil(self.low)), math.floor(self.high)) if self.whole else x

    def share(self, x: float) -> float:
        low, high = self.ends()
        return ((math.log(x) if self.log else x) - low) / (high - low) if high > low else 0.5


@dataclass(frozen=True)
class Choice:
    options: tuple


@dataclass
class Trial:
    number: int
    params: dict
    errors: list[float] = field(default_factory=list)
    state: str = "whole"

    @property
    def value(self) -> float:
        """The mean error of its folds so far."""
        return sum(self.errors) / len(self.errors) if self.errors else math.inf


@dataclass(frozen=True)
class Rules:
    startup: int = 5  # trials that are drawn evenly, and whole ones that the median needs
    warmup: int = 1  # folds before a trial may be stopped
    best: float = 0.25
    draws: int = 24


def _density(u: float, centres: list[float], width: float) -> float:
    """Normal kernels cut to [0, 1], and an even part that counts as one of them."""
    inside = lambda c: 0.5 * (math.erf((1 - c) / (width * math.sqrt(2))) - math.erf(-c / (width * math.sqrt(2))))
    kernels = sum(math.exp(-(((u - c) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi) * inside(c)) for c in centres)
    return (kernels + 1.0) / (len(centres) + 1)


def _near(rnd: random.Random, centres: list[float], width: float) -> float:
    k = rnd.randrange(len(centres) + 1)
    if k == len(centres):
        return rnd.random()
    while not 0 <= (u := rnd.gauss(centres[k], width)) <= 1:
        pass
    return u


def propose(space: dict[str, Span | Choice], trials: list[Trial], rnd: random.Random, rules: Rules = Rules()) -> dict:
    """The next trial's parameters; stopped trials count by what they had, after all whole ones."""
    done = sorted((t for t in trials if t.errors), key=lambda t: (t.state != "whole", t.value, t.number))
    if len(done) < rules.startup:
        return {n: s.value(rnd.random()) if isinstance(s, Span) else rnd.choice(s.options) for n, s in space.items()}
    few = max(1, math.ceil(rules.best * len(done)))
    good, rest = done[:few], done[few:]
    out = {}
    for name, s in space.items():
        if isinstance(s, Choice):
            weight = lambda some, o: (sum(t.params[name] == o for t in some) + 1) / (len(some) + len(s.options))  # noqa: B023, E731
            drawn = rnd.choices(s.options, [weight(good, o) for o in s.options], k=rules.draws)
            out[name] = max(drawn, key=lambda o: weight(good, o) / weight(rest, o))  # noqa: B023
            continue
        centres = [[s.share(t.params[name]) for t in some] for some in (good, rest)]
        widths = [max(0.05, len(c) ** -0.2 * 0.3) if c else 1.0 for c in centres]
        drawn = [_near(rnd, centres[0], widths[0]) for _ in range(rules.draws)]
        out[name] = s.value(max(drawn, key=lambda u: _density(u, centres[0], widths[0]) / _density(u, centres[1], widths[1])))  # noqa: B023
    return out


def poor(trial: Trial, trials: list[Trial], rules: Rules = Rules()) -> bool:
    """Whether a trial should stop after the folds that it has."""
    n = len(trial.errors)
    whole = [sum(t.errors[:n]) / n for t in trials if t.state == "whole" and len(t.errors) > n]
    return n >= rules.warmup and len(whole) >= rules.startup and trial.value > median(whole)


def run_trials(space: dict[str, Span | Choice], folds: list[int], error: Callable[[dict, int], float], number: int, seed: int = 1, rules: Rules = Rules(), before: list[Trial] = ()) -> list[Trial]:
    """The trials of a search, those before included (so a search can be taken up again); error(params, fold) is to be least."""
    trials = list(before)
    for k in range(len(trials), number):
        now = Trial(k, propose(space, trials, random.Random(f"{seed}-{k}"), rules))
        for i, f in enumerate(folds):
            now.errors.append(error(now.params, f))
            if i + 1 < len(folds) and poor(now, trials, rules):
                now.state = "stopped"
                break
        trials.append(now)
    return trials


def fold_error(df: DataFrame, table: DataFrame, features: list[str], target: str) -> Callable[[dict, int], float]:
    """The error (RMSE) on a fold's validation blocks of boosted trees with some parameters."""

    def error(params: dict, fold: int) -> float:
        _, got = boosted(splits.part(df, table, fold, "train"), splits.part(df, table, fold, "validation"), features, target, **params)
        return RegressionEvaluator(labelCol="y", predictionCol="p", metricName="rmse").evaluate(got)

    return error


def trial_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    """trial, params (JSON), state, errors by fold, value: whole trials first, the best one first of all."""
    done = sorted(trials, key=lambda t: (t.state != "whole", t.value, t.number))
    return spark.createDataFrame([(t.number, json.dumps(t.params, sort_keys=True), t.state, t.errors, t.value) for t in done], "trial int, params string, state string, errors array<double>, value double")


def read_trials(table: DataFrame) -> list[Trial]:
    """The trials of a table, to go on from."""
    return [Trial(r.trial, json.loads(r.params), list(r.errors), r.state) for r in table.orderBy("trial").collect()]


def search(df: DataFrame, table: DataFrame, folds: list[int], features: list[str], target: str, space: dict[str, Span | Choice], number: int = 20, seed: int = 1, rules: Rules = Rules()) -> DataFrame:
    """The table of a search for boosted trees' parameters over folds of a split table."""
    return trial_table(df.sparkSession, run_trials(space, folds, fold_error(df, table, features, target), number, seed, rules))
