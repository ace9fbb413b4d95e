"""Sequential search by tree-structured Parzen estimators (Bergstra, Bardenet, Bengio and Kégl, 2011).

Finished trials are divided into a better and a worse part. For each setting both
parts give a density, and of some candidates drawn from the better one the proposal is
that with the largest ratio of the two. A space is a tree: a choice leads to settings
that only it has, so a setting's densities come from the trials that had it.

This module only proposes settings and remembers results. What a trial costs, its
fits on Spark, is the caller's.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Uniform:
    """A number between ``low`` and ``high``, in steps if ``step`` is given."""

    low: float
    high: float
    step: float = 0.0

    def draw(self, rng: random.Random) -> float:
        return self.rounded(rng.uniform(self.low, self.high))

    def rounded(self, value: float) -> float:
        if not self.step:
            return value
        digits = max(0, -math.floor(math.log10(self.step)))
        return round(round(value / self.step) * self.step, digits)


@dataclass(frozen=True)
class LogNormal:
    """A positive number whose logarithm is normal."""

    mean: float
    deviation: float

    def draw(self, rng: random.Random) -> float:
        return rng.lognormvariate(self.mean, self.deviation)


@dataclass(frozen=True)
class Choice:
    """One of some options; an option may be a value, a range or a tree of further settings."""

    options: tuple


#: A tree of settings by name. Names are unique within a path; the same name in two options is two settings.
Space = dict


def draw(space: Space, rng: random.Random, pick: Callable | None = None, path: tuple = ()) -> tuple[dict, dict]:
    """``(settings, places)`` of one point: the values by name, and what was drawn at each place of the tree.

    ``pick(place, kind)`` draws at a place; without it the point is drawn from the prior.
    """
    settings, places = {}, {}

    def at(place: tuple, kind):
        value = pick(place, kind) if pick else prior(kind, rng)
        places[place] = (kind, value)
        return value

    def resolve(name: str, kind, place: tuple) -> None:
        if isinstance(kind, Choice):
            index = at(place, kind)
            option = kind.options[index]
            if isinstance(option, dict):
                walk(option, (*place, index))
            else:
                resolve(name, option, (*place, index))
        elif isinstance(kind, (Uniform, LogNormal)):
            settings[name] = at(place, kind)
        else:
            settings[name] = kind

    def walk(tree: dict, place: tuple) -> None:
        for name, kind in tree.items():
            resolve(name, kind, (*place, name))

    walk(space, path)
    return settings, places


def prior(kind, rng: random.Random):
    return rng.randrange(len(kind.options)) if isinstance(kind, Choice) else kind.draw(rng)


class _Density:
    """A mixture of normals around the observed values and the prior, cut off at the ends of the range."""

    def __init__(self, kind: Uniform | LogNormal, values: list[float]):
        self.kind, self.logs = kind, isinstance(kind, LogNormal)
        if self.logs:
            self.low, self.high = -math.inf, math.inf
            centre, width = kind.mean, kind.deviation
            values = [math.log(v) for v in values]
        else:
            self.low, self.high = kind.low, kind.high
            centre, width = (kind.low + kind.high) / 2, kind.high - kind.low
        points = sorted([*values, centre])
        # A value's width is its distance to the farther neighbour, within bounds that narrow as values come in.
        least = width / min(100, len(points) + 1)
        self.parts = []
        for i, point in enumerate(points):
            near = [abs(point - points[j]) for j in (i - 1, i + 1) if 0 <= j < len(points)]
            self.parts.append((point, min(width, max(least, max(near, default=width)))))
        at = points.index(centre)
        self.parts[at] = (centre, width)

    def draw(self, rng: random.Random) -> float:
        while True:
            centre, width = rng.choice(self.parts)
            value = rng.gauss(centre, width)
            if self.low <= value <= self.high:
                return math.exp(value) if self.logs else self.kind.rounded(value)

    def log_density(self, value: float) -> float:
        value = math.log(value) if self.logs else value
        total = 0.0
        for centre, width in self.parts:
            inside = _normal((self.high - centre) / width) - _normal((self.low - centre) / width)
            total += math.exp(-0.5 * ((value - centre) / width) ** 2) / (width * inside)
        return math.log(max(total / len(self.parts), 1e-300))


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class _Shares:
    """Shares of the options, each counted once more than it was seen."""

    def __init__(self, kind: Choice, values: list[int]):
        counts = [1.0] * len(kind.options)
        for v in values:
            counts[v] += 1
        self.shares = [c / sum(counts) for c in counts]

    def draw(self, rng: random.Random) -> int:
        return rng.choices(range(len(self.shares)), self.shares)[0]

    def log_density(self, value: int) -> float:
        return math.log(self.shares[value])


@dataclass
class Sampler:
    """Proposes points of ``space`` to maximise a value, the same for the same seed and results.

    The first ``random_first`` points come from the prior. Later ones are drawn setting
    by setting: the better part are the best ``share`` of the finished trials (25 at
    most, 2 at least), ``candidates`` are tried for each. Trials under way count as
    neither.
    """

    space: Space
    seed: int = 0
    random_first: int = 20
    share: float = 0.1
    candidates: int = 24
    finished: list[tuple[dict, float]] = field(default_factory=list)
    proposed: int = 0

    def propose(self) -> tuple[dict, dict]:
        """The settings of the next trial, and their places, which ``tell`` wants back."""
        rng = random.Random(f"{self.seed}/{self.proposed}")
        self.proposed += 1
        if self.proposed <= self.random_first or len(self.finished) < 4:
            return draw(self.space, rng)
        ranked = sorted(range(len(self.finished)), key=lambda i: (-self.finished[i][1], i))
        n_better = min(25, max(2, math.ceil(self.share * len(ranked))))
        parts = [[self.finished[i][0] for i in ranked[:n_better]], [self.finished[i][0] for i in ranked[n_better:]]]

        def pick(place, kind):
            make = _Shares if isinstance(kind, Choice) else _Density
            better, worse = (make(kind, [p[place][1] for p in part if place in p]) for part in parts)
            found = [better.draw(rng) for _ in range(self.candidates)]
            return max(found, key=lambda v: better.log_density(v) - worse.log_density(v))

        return draw(self.space, rng, pick)

    def tell(self, places: dict, value: float) -> None:
        """The result of a trial; one that failed is the worst there is."""
        self.finished.append((places, value if value == value else -math.inf))
