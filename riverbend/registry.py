"""Families of interchangeable parts by name. Each value is a function or class; users add their own with register()."""

from __future__ import annotations

from collections.abc import Callable

from .operators import clean, edeval, evaluate, explain, features, models, nets, ranges, resample, scale, score, split, threshold
from .sources import io
from .streaming import jobs

FAMILIES: dict[str, dict] = {
    "readers": {"traces": io.read_traces, "truth": io.read_truth},
    "aggregates": resample.AGGREGATES,
    "alterations": features.FUNCTIONS,
    "bundles": features.BUNDLES,
    "transformers": scale.STEPS,
    "splitters": {"random.split": split.random_split, "stratified.split": split.stratified_split},
    "forecasters": models.FORECASTERS | {"rnn.forecasting": nets.RecurrentForecaster},
    "reconstructors": models.RECONSTRUCTORS | {"ae": nets.DenseAutoencoder, "bigan": nets.BiGAN},
    "scorers": score.SCORERS,
    "window_scorers": {"mse": nets.DenseAutoencoder.score_windows, "re": nets.RecurrentForecaster.score_windows, "mse.dis": nets.BiGAN.score_windows, "mse.ft": nets.BiGAN.score_windows},
    "thresholds": threshold.SELECTORS,
    "evaluations": {"point": evaluate.point_metrics, "range": evaluate.range_metrics} | {k: v for k, v in ranges.LEVELS.items()},
    "explainers": explain.EXPLAINERS,
    "explanation_evaluations": {"model_free": edeval.anomaly_instances, "model_dependent": edeval.expanded_instances},
    "cleaners": {"counter": clean.fill_counter_gaps, "inactive": clean.fill_inactive},
    "jobs": jobs.JOBS,
}


def register(family: str, name: str, part: Callable) -> None:
    FAMILIES[family][name] = part


def find(family: str, name: str) -> Callable:
    try:
        return FAMILIES[family][name]
    except KeyError:
        raise ValueError(f"{name!r} is not one of the {family}: {', '.join(map(str, FAMILIES.get(family, {})))}") from None
