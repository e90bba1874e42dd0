"""Outlier scores of records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, one_row, rows, whole
from .windows import window_to_record


def _sum(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def relative_error(predicted: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, idx, score): norm of a record's forecast error over the norm of all scored records together.

    The whole set's norm is one aggregated row, so the scores of a period depend on what it is scored with."""
    held = predicted.where(F.col(f"y_{features[0]}").isNotNull())
    error = F.sqrt(_sum([F.pow(F.col(c) - F.col(f"y_{c}"), 2) for c in features]))
    total = held.agg(F.sqrt(F.sum(_sum([F.pow(F.col(c), 2) for c in features]))).alias("_total"))
    return one_row(held, total).select(*keys, "idx", F.try_divide(error, F.col("_total")).alias("score"))


def record_mse(predicted: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS, prefix: str = "r_") -> DataFrame:
    """(keys, idx, score): mean squared error of each record over its features."""
    return predicted.select(*keys, "idx", (_sum([F.pow(F.col(c) - F.col(f"{prefix}{c}"), 2) for c in features]) / len(features)).alias("score"))


def window_mse(predicted: DataFrame, features: Sequence[str], size: int, keys: Sequence[str] = KEYS, prefix: str = "r_") -> DataFrame:
    """(keys, w_start, score): mean over the records of each window of `size` records."""
    scored = record_mse(predicted, features, keys, prefix)
    out = scored.select(*keys, F.col("idx").alias("w_start"), F.avg("score").over(rows(0, size - 1, keys)).alias("score"), F.count("*").over(whole(keys)).alias("_n"))
    return out.where(F.col("w_start") + size <= F.col("_n")).drop("_n")


def enclosing_window_mse(predicted: DataFrame, features: Sequence[str], size: int, keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    """(keys, idx, score): window scores averaged over the windows that hold a record."""
    return window_to_record(window_mse(predicted, features, size, keys), size, "score", keys, strict)


def blended(a: Column, b: Column, weight: float) -> Column:
    """weight * a + (1 - weight) * b, for scores that join a reconstruction error with a discriminator's loss."""
    return F.lit(weight) * a + F.lit(1 - weight) * b


def cross_entropy(truth: Column, p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(truth * F.ln(q) + (1 - truth) * F.ln(1 - q))


#: Name to scorer: re for forecasts, mse for reconstructions; the two with a discriminator need a model that has one.
SCORERS: dict[str, Callable] = {"re": relative_error, "mse": enclosing_window_mse}
