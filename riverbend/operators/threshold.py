"""Outlier-score thresholds from robust statistics, their grid, and the detector built on them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, one_row
from .clean import predict

MAD_SCALE = 1.4826


def std_threshold(scores: DataFrame, factor: float) -> DataFrame:
    """Mean plus factor times the population deviation."""
    return scores.agg((F.avg("score") + factor * F.stddev_pop("score")).alias("threshold"))


def mad_threshold(scores: DataFrame, factor: float) -> DataFrame:
    """Median plus factor times 1.4826 times the median distance from it; exact medians."""
    middle = scores.agg(F.median("score").alias("_m"))
    return one_row(scores, middle).agg((F.max("_m") + factor * MAD_SCALE * F.median(F.abs(F.col("score") - F.col("_m")))).alias("threshold"))


def iqr_threshold(scores: DataFrame, factor: float) -> DataFrame:
    """Third quartile plus factor times the interquartile range; exact, with linear interpolation."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.75)))
    return scores.agg(q.alias("_q")).select((F.col("_q")[1] + factor * (F.col("_q")[1] - F.col("_q")[0])).alias("threshold"))


SELECTORS: dict[str, Callable[[DataFrame, float], DataFrame]] = {"std": std_threshold, "mad": mad_threshold, "iqr": iqr_threshold}


def threshold(scores: DataFrame, method: str = "std", factor: float = 2.0, iterations: int = 1, removal: float = 1.0) -> DataFrame:
    """One row: the threshold of the last iteration. Each iteration after the first sees the original scores that
    do not exceed removal times the threshold before."""
    scores = scores.select("score")
    out = SELECTORS[method](scores, factor)
    for _ in range(iterations - 1):
        kept = one_row(scores, out.withColumnRenamed("threshold", "_t")).where(F.col("score") <= removal * F.col("_t")).select("score")
        out = SELECTORS[method](kept, factor)
    return out


def grid(methods: Sequence[str] = ("std", "mad", "iqr"), factors: Sequence[float] = (1.5, 2.0, 2.5, 3.0), iterations: Sequence[int] = (1, 2), removals: Sequence[float] = (1.0,)) -> list[tuple[str, float, int, float]]:
    """All combinations; the removal factor is 1 where there is one iteration."""
    return list(dict.fromkeys((m, f, n, r if n > 1 else 1.0) for m, f, n, r in itertools.product(methods, factors, iterations, removals)))


def threshold_grid(scores: DataFrame, combinations: Sequence[tuple[str, float, int, float]] | None = None) -> DataFrame:
    """(method, factor, iterations, removal, threshold), one row per combination.

    The grid is a small parameter table and statistics of the scores are conditional aggregates, so each round of
    iterations is one pass over the scores for all combinations, not one per combination."""
    combos = combinations or grid()
    spark = scores.sparkSession
    params = spark.createDataFrame([(i, *map(_cast, c)) for i, c in enumerate(combos)], "_id int, method string, factor double, iterations int, removal double")
    scores = scores.select("score")
    most = max(c[2] for c in combos)
    limits = params.withColumn("_limit", F.lit(None).cast("double"))
    for n in range(1, most + 1):
        open_ = [(i, c) for i, c in enumerate(combos) if c[2] >= n]
        limits = _round(scores, params, limits, [i for i, _ in open_])
    return limits.select("method", "factor", "iterations", "removal", F.col("_limit").alias("threshold"))


def _cast(x):
    return float(x) if isinstance(x, float) else x


def _round(scores: DataFrame, params: DataFrame, limits: DataFrame, ids: Sequence[int]) -> DataFrame:
    """One iteration for the combinations in ids; the others keep their limit."""
    todo = limits.where(F.col("_id").isin(*ids))
    crossed = scores.crossJoin(F.broadcast(todo)).where(F.col("_limit").isNull() | (F.col("score") <= F.col("removal") * F.col("_limit")))
    stats = crossed.groupBy("_id").agg(F.avg("score").alias("_avg"), F.stddev_pop("score").alias("_std"), F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    mad = crossed.where("method = 'mad'").join(F.broadcast(stats.select("_id", F.col("_q")[1].alias("_m"))), "_id").groupBy("_id").agg(F.median(F.abs(F.col("score") - F.col("_m"))).alias("_mad"))
    q = F.col("_q")
    value = F.when(F.col("method") == "std", F.col("_avg") + F.col("factor") * F.col("_std")).when(F.col("method") == "mad", q[1] + F.col("factor") * MAD_SCALE * F.col("_mad")).otherwise(q[2] + F.col("factor") * (q[2] - q[0]))
    fresh = todo.drop("_limit").join(stats, "_id").join(mad, "_id", "left").select("_id", value.alias("_new"))
    return limits.join(F.broadcast(fresh), "_id", "left").withColumn("_limit", F.coalesce("_new", "_limit")).drop("_new")


def detect(scores: DataFrame, fitted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, idx, score, pred) by a one-row threshold."""
    return one_row(scores, fitted).select(*keys, "idx", "score", predict(F.col("score"), F.col("threshold")).alias("pred"))


def best(results: DataFrame, metric: Column | str, *ties: str) -> DataFrame:
    """The row with the largest metric; ties by the given columns, ascending."""
    return results.orderBy(F.desc(metric) if isinstance(metric, str) else metric.desc(), *ties).limit(1)
