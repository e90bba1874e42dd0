"""The whole analysis as one chain of lazy frames: datasets, features, model, scores, detection, evaluation, explanations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import numbered
from ..operators import clean, edeval, evaluate, models, rangejoin, ranges, resample, scale, score, threshold
from ..operators import features as alteration
from ..operators.explain import exstream, macrobase
from ..operators.windows import class_ranges


@dataclass(frozen=True)
class Settings:
    """Defaults: 1 s records pruned and averaged to 15 s, trace scaling, naive forecast, STD threshold, level 2."""

    raw_period: int = 1
    period: int = 15
    prune_head: int = 0
    prune_tail: int = 0
    transform: str = "trace_scaling"
    components: float = 13
    threshold: str = "std"
    factor: float = 2.0
    iterations: int = 1
    level: str = "ad2"
    beta: float = 1.0
    explainer: str = "exstream"


def datasets(raw: DataFrame, events: DataFrame, features: Sequence[str], normal: Sequence[str], s: Settings = Settings()) -> DataFrame:
    """Raw records (trace, trace_type, ts, features) to labelled, cleaned, resampled records with dataset and idx."""
    labelled = rangejoin.label_records(clean.null_to_inactive(raw, features), events)
    even = resample.resample_time(labelled, s.raw_period, features, "max", "label")
    kept = numbered(clean.prune(clean.fill_inactive(even, features), s.prune_head, s.prune_tail))
    out = resample.resample_time(kept, s.period, features, "mean", "label")
    kinds = raw.select("trace", "trace_type").distinct()
    return clean.split_by_type(out.join(kinds, "trace"), normal)


#: Where records are downsampled: before features are altered, between that and their transformation, or after both.
POSITIONS = ("first", "middle", "last")
#: Scorer, forecaster or reconstructor by name: the pairs that reports compare unless told otherwise.
COMPARED = (("rnn.forecasting", "re"), ("ae", "mse"), ("bigan", "mse.ft"))


def build_features(records: DataFrame, features: Sequence[str], alter: str = "", chain: str = "trace_scaling", raw_period: int = 1, period: int = 1, position: str = "first", **params) -> tuple[DataFrame, list[str]]:
    """(trace, idx, features) and the features' names: altered by one chain, transformed by another, downsampled from raw_period
    to period at a position, where the two periods differ."""
    if position not in POSITIONS:
        raise ValueError(f"position must be one of {POSITIONS}")
    out, names = records.select("trace", "idx", *features), list(features)

    def thinned(df: DataFrame, at: str) -> DataFrame:
        return resample.resample_rank(numbered(df, by=["idx"]), raw_period, period, names) if position == at and period != raw_period else df

    out = thinned(out, "first")
    if alter:
        out, names = alteration.apply_chain(out, names, alter)
    out = thinned(out.select("trace", "idx", *names), "middle")
    if chain:
        out, names = scale.transform(out, names, chain, **params)
    return thinned(out, "last"), names


def scores(data: DataFrame, features: Sequence[str], s: Settings = Settings(), model=None) -> DataFrame:
    """(trace, idx, score) by a forecaster fitted on the training records."""
    train: Column = F.col("dataset") == "train"
    scaled, names = scale.transform(data, features, s.transform, components=s.components, train=train)
    model = model or models.NaiveForecaster(names)
    return score.relative_error(model.fit(scaled.where(train)).predict(scaled), names)


def detections(data: DataFrame, scored: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(trace, idx, score, pred, label, dataset): the threshold is that of the training records."""
    known = scored.join(data.select("trace", "idx", "label", "dataset"), ["trace", "idx"])
    limit = threshold.threshold(known.where("dataset = 'train'"), s.threshold, s.factor, s.iterations)
    return threshold.detect(scored, limit).join(data.select("trace", "idx", "label", "dataset"), ["trace", "idx"])


def evaluation(detected: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Range-based metrics on the test records."""
    test = detected.where("dataset = 'test'")
    return evaluate.range_metrics(class_ranges(test), evaluate.predicted_ranges(test), ranges.LEVELS[s.level], beta=s.beta)


def explanations(data: DataFrame, features: Sequence[str], s: Settings = Settings()) -> DataFrame:
    """Important features and ranges of every labelled anomaly of the test records."""
    test = data.where("dataset = 'test'")
    records = edeval.instance_records(edeval.anomaly_instances(class_ranges(test)), test, features)
    return {"exstream": exstream, "macrobase": macrobase}[s.explainer](records.select("instance", "idx", "y", *features), features)
