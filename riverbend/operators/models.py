"""Normality models: a protocol, a registry, and the models that need no deep-learning library.

A forecaster adds y_<feature> (its forecast) to records, null where it makes none; a reconstructor adds r_<feature>.
Further models register themselves in FORECASTERS or RECONSTRUCTORS.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ordered
from .scale import _moments


class Model(Protocol):
    """Fit on training records; predict on any."""

    features: Sequence[str]

    def fit(self, train: DataFrame) -> Model: ...

    def predict(self, records: DataFrame) -> DataFrame: ...


class NaiveForecaster:
    """The last record."""

    n_back = 1

    def __init__(self, features: Sequence[str], keys: Sequence[str] = KEYS):
        self.features, self.keys = list(features), keys

    def fit(self, train: DataFrame) -> NaiveForecaster:
        return self

    def predict(self, records: DataFrame) -> DataFrame:
        return records.withColumns({f"y_{c}": F.lag(c).over(ordered(self.keys)) for c in self.features})


class LinearForecaster:
    """Each feature from the n_back records before it, by least squares with a ridge.

    The normal equations come from one aggregation of products of lags, so training data is never collected."""

    def __init__(self, features: Sequence[str], n_back: int = 3, keys: Sequence[str] = KEYS, ridge: float = 1e-6):
        self.features, self.n_back, self.keys, self.ridge = list(features), n_back, keys, ridge
        self.weights: np.ndarray | None = None

    def _lags(self) -> dict[str, Column]:
        return {f"_l{k}_{c}": F.lag(c, k).over(ordered(self.keys)) for k in range(1, self.n_back + 1) for c in self.features}

    def fit(self, train: DataFrame) -> LinearForecaster:
        lags = self._lags()
        held = train.withColumns(lags).where(F.col(f"_l{self.n_back}_{self.features[0]}").isNotNull())
        xs = [F.lit(1.0), *[F.col(c).cast("double") for c in lags]]
        ys = [F.col(c).cast("double") for c in self.features]
        n = len(xs)
        sums = held.agg(*[F.sum(xs[i] * xs[j]) for i in range(n) for j in range(i, n)], *[F.sum(x * y) for x in xs for y in ys]).first()
        values = [v or 0.0 for v in sums]
        xx = np.zeros((n, n))
        xx[np.triu_indices(n)] = values[: n * (n + 1) // 2]
        xx = xx + np.triu(xx, 1).T
        xy = np.array(values[n * (n + 1) // 2 :]).reshape(n, len(ys))
        self.weights = np.linalg.solve(xx + self.ridge * np.eye(n), xy)
        return self

    def predict(self, records: DataFrame) -> DataFrame:
        lags = self._lags()
        terms = [F.lit(1.0), *[F.col(c) for c in lags]]
        made = {f"y_{c}": reduce(lambda a, b: a + b, [t * float(w) for t, w in zip(terms, self.weights[:, i], strict=True)]) for i, c in enumerate(self.features)}
        return records.withColumns(lags).withColumns(made).drop(*lags)


class LinearReconstructor:
    """A linear autoencoder: each record from its leading principal components. No record depends on another."""

    def __init__(self, features: Sequence[str], components: int = 1, keys: Sequence[str] = KEYS):
        self.features, self.components, self.keys = list(features), components, keys
        self.mean = self.axes = None

    def fit(self, train: DataFrame) -> LinearReconstructor:
        self.mean, cov, _ = _moments(train, self.features)
        self.axes = np.linalg.eigh(cov)[1].T[::-1][: self.components]
        return self

    def predict(self, records: DataFrame) -> DataFrame:
        project = self.axes.T @ self.axes
        centred = [F.col(c) - float(m) for c, m in zip(self.features, self.mean, strict=True)]
        made = {f"r_{c}": reduce(lambda a, b: a + b, [x * float(w) for x, w in zip(centred, project[i], strict=True)]) + float(self.mean[i]) for i, c in enumerate(self.features)}
        return records.withColumns(made)


FORECASTERS: dict[str, Callable[..., Model]] = {"naive.forecasting": NaiveForecaster, "linear.forecasting": LinearForecaster}
RECONSTRUCTORS: dict[str, Callable[..., Model]] = {"linear.ae": LinearReconstructor}


def errors(predicted: DataFrame, features: Sequence[str], prefix: str = "y_") -> DataFrame:
    """Mean squared and mean absolute error over records and features, one row."""
    diff = [F.col(c) - F.col(f"{prefix}{c}") for c in features]
    held = predicted.where(F.col(f"{prefix}{features[0]}").isNotNull())
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    return held.agg((F.sum(add([d * d for d in diff])) / (F.count("*") * len(features))).alias("mse"), (F.sum(add([F.abs(d) for d in diff])) / (F.count("*") * len(features))).alias("mae"))
