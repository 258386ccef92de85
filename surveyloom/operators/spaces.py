"""Search spaces: typed dimensions, seeded draws, and the default space of each classifier family."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from surveyloom.operators.classifiers.bayes import fit_bayes
from surveyloom.operators.classifiers.boosted_stumps import adaboost_candidates, fit_adaboost
from surveyloom.operators.classifiers.candidates import bayes_margin, discriminant_margin, from_moments
from surveyloom.operators.classifiers.linear import fit_discriminant, fit_logistic, fit_svm
from surveyloom.operators.classifiers.neighbours import fit_neighbours
from surveyloom.operators.classifiers.newton import logistic_candidates
from surveyloom.operators.classifiers.perceptron import fit_perceptron
from surveyloom.operators.classifiers.random_trees import fit_extra_trees
from surveyloom.operators.classifiers.trees import fit_boosting, fit_forest, fit_tree


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, rng: random.Random) -> Any:
        return rng.choice(self.values)


@dataclass(frozen=True)
class Whole:
    """Integers low..high."""

    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Real:
    """Numbers low..high, even on a plain or a logarithmic scale."""

    low: float
    high: float
    log: bool = False

    def draw(self, rng: random.Random) -> float:
        if self.log:
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return rng.uniform(self.low, self.high)


Space = Mapping[str, "Choice | Whole | Real"]


def draw_params(space: Space, n: int, seed: int = 1) -> list[dict]:
    """n different parameter maps; all of them when the space holds fewer."""
    rng = random.Random(seed)
    size = 1.0
    for dim in space.values():
        if isinstance(dim, Choice):
            size *= len({repr(v) for v in dim.values})
        elif isinstance(dim, Whole):
            size *= dim.high - dim.low + 1
        elif dim.low < dim.high:
            size = math.inf
    out: list[dict] = []
    seen = set()
    while len(out) < min(n, size):
        params = {k: dim.draw(rng) for k, dim in space.items()}
        mark = repr(sorted(params.items()))
        if mark not in seen:
            seen.add(mark)
            out.append(params)
    return out


def density_draws(space: Space, tried: Sequence[tuple[Mapping[str, Any], float]], n: int, seed: int = 1, good: float = 0.25, pool: int = 24) -> list[dict]:
    """n different parameter maps where good trials are denser than the others.

    The best ``good`` share of the trials and the rest each give a density per dimension: counts with one added for choices, normal bumps round
    the trials and an even floor for numbers. Each map is the best of ``pool`` draws from the good density, by the ratio of both.
    """
    ranked = sorted(tried, key=lambda t: -t[1])
    cut = max(1, math.ceil(good * len(ranked)))
    if len(ranked) < 4:
        return draw_params(space, n, seed)
    rng = random.Random(seed)
    sides = [[p for p, _ in ranked[:cut]], [p for p, _ in ranked[cut:]]]
    densities = {k: [_density(dim, [p[k] for p in side]) for side in sides] for k, dim in space.items()}
    seen = {repr(sorted(p.items())) for p, _ in tried}
    out: list[dict] = []
    for _ in range(50 * n):
        if len(out) == n:
            break
        drawn = [{k: densities[k][0].draw(rng) for k in space} for _ in range(pool)]
        gains = [sum(math.log(densities[k][0].at(p[k]) / densities[k][1].at(p[k])) for k in space) for p in drawn]
        params = drawn[max(range(pool), key=lambda i: gains[i])]
        mark = repr(sorted(params.items()))
        if mark not in seen:
            seen.add(mark)
            out.append(params)
    more = [p for p in draw_params(space, 2 * n + len(tried), seed) if repr(sorted(p.items())) not in seen]
    return out + more[: n - len(out)]


@dataclass(frozen=True)
class _Shares:
    dim: Choice
    values: list

    def _weight(self, value: Any) -> float:
        return 1.0 + sum(repr(v) == repr(value) for v in self.values)

    def at(self, value: Any) -> float:
        return self._weight(value) / sum(self._weight(v) for v in self.dim.values)

    def draw(self, rng: random.Random) -> Any:
        return rng.choices(self.dim.values, [self._weight(v) for v in self.dim.values])[0]


@dataclass(frozen=True)
class _Bumps:
    """An even floor and a normal bump at each value, on the scale of the dimension."""

    dim: Whole | Real
    values: list

    def _scale(self, x: float) -> float:
        return math.log(x) if isinstance(self.dim, Real) and self.dim.log else float(x)

    @property
    def _ends(self) -> tuple[float, float]:
        return self._scale(self.dim.low), self._scale(self.dim.high)

    def _width(self) -> float:
        low, high = self._ends
        return max((high - low) / (1 + len(self.values)) ** 0.5 / 2, 1e-12)

    def at(self, value: Any) -> float:
        low, high = self._ends
        x, width = self._scale(value), self._width()
        bumps = sum(math.exp(-0.5 * ((x - self._scale(v)) / width) ** 2) for v in self.values) / (width * math.sqrt(2 * math.pi))
        return (1 / max(high - low, 1e-12) + bumps) / (1 + len(self.values))

    def draw(self, rng: random.Random) -> Any:
        low, high = self._ends
        k = rng.randrange(len(self.values) + 1)
        x = rng.uniform(low, high) if k == len(self.values) else min(high, max(low, rng.gauss(self._scale(self.values[k]), self._width())))
        if isinstance(self.dim, Whole):
            return min(self.dim.high, max(self.dim.low, round(x)))
        return min(self.dim.high, max(self.dim.low, math.exp(x) if self.dim.log else x))


def _density(dim: Choice | Whole | Real, values: list) -> _Shares | _Bumps:
    return _Shares(dim, values) if isinstance(dim, Choice) else _Bumps(dim, values)


@dataclass(frozen=True)
class Family:
    """A classifier family: its fit function, search space and fixed options."""

    name: str
    fit: Callable
    space: Space
    needs_key: bool = False
    many: Callable | None = None  # fits all candidates on all folds at once, where the family can

    def train(self, df, features: Sequence[str], label: str, key: str, params: Mapping[str, Any]):
        extra = {"key": key} if self.needs_key else {}
        return self.fit(df, features, label, **params, **extra)


# The default search ranges of each family.
FAMILIES = {
    f.name: f
    for f in (
        Family(
            "Logistic Regression",
            fit_logistic,
            {"C": Real(1e-3, 1e2, log=True), "penalty": Choice(("l1", "l2", "elasticnet", None)), "fit_intercept": Choice((True, False))},
            many=logistic_candidates,
        ),
        Family(
            "Decision Tree",
            fit_tree,
            {"max_depth": Whole(3, 20), "min_samples_leaf": Whole(1, 10), "criterion": Choice(("gini", "entropy"))},
        ),
        Family(
            "Random Forest",
            fit_forest,
            {"n_estimators": Whole(50, 200), "max_depth": Whole(3, 20), "min_samples_leaf": Whole(1, 10), "bootstrap": Choice((True, False))},
        ),
        Family(
            "Extra Trees",
            fit_extra_trees,
            {"n_estimators": Whole(50, 200), "max_depth": Whole(3, 20), "min_samples_split": Whole(2, 20), "min_samples_leaf": Whole(1, 4)},
        ),
        Family(
            "Gradient Boosting",
            fit_boosting,
            {"n_estimators": Whole(50, 200), "learning_rate": Real(0.01, 0.3), "max_depth": Whole(3, 10), "subsample": Real(0.6, 1.0)},
        ),
        Family(
            "XGBoost",
            fit_boosting,
            {
                "n_estimators": Whole(10, 10_000),
                "learning_rate": Real(0.01, 0.3),
                "max_depth": Whole(3, 10),
                "subsample": Real(0.6, 1.0),
                "colsample": Real(0.6, 1.0),
                "gamma": Real(0.0, 0.5),
            },
        ),
        Family(
            "LightGBM",
            fit_boosting,
            {
                "n_estimators": Whole(50, 200),
                "max_depth": Whole(3, 14),
                "learning_rate": Real(0.01, 0.3),
                "num_leaves": Whole(20, 99),
                "subsample": Real(0.6, 1.0),
            },
        ),
        Family(
            "SVM",
            fit_svm,
            {"C": Real(0.1, 1e2, log=True), "gamma": Real(1e-3, 1e2, log=True), "kernel": Choice(("linear", "rbf", "poly"))},
        ),
        Family(
            "K-Nearest Neighbors",
            fit_neighbours,
            {"n_neighbors": Whole(3, 30), "weights": Choice(("uniform", "distance")), "p": Choice((1, 2))},
            needs_key=True,
        ),
        Family("Naive Bayes", fit_bayes, {"var_smoothing": Real(1e-11, 1e-7, log=True)}, many=from_moments(bayes_margin)),
        Family("LDA", fit_discriminant, {"solver": Choice(("svd", "lsqr", "eigen")), "shrinkage": Real(0.0, 1.0)}, many=from_moments(discriminant_margin)),
        Family(
            "MLP Neural Network",
            fit_perceptron,
            {
                "hidden": Choice(((50,), (100,), (50, 50), (100, 50))),
                "activation": Choice(("relu", "tanh", "logistic")),
                "alpha": Real(1e-4, 0.1),
                "schedule": Choice(("constant", "adaptive")),
            },
        ),
        Family("AdaBoost", fit_adaboost, {"n_estimators": Whole(50, 199), "learning_rate": Real(0.01, 0.31)}, many=adaboost_candidates),
    )
}
