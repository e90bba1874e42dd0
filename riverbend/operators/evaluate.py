"""Evaluation of scores and predictions: points, ranges, curves and roll-ups.

Metrics come as long tables: (…, cls, metric, value), with cls 'global', 'avg' or the class number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, one_row
from .ranges import range_precisions, range_recalls
from .windows import class_ranges, ranges

INFINITY = float("inf")


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    """0 where both are 0."""
    return F.when((p == 0) & (r == 0), 0.0).otherwise(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r))


def auc(points: DataFrame, x: str, y: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc): trapezoids under y over x, in order of x and of tie where x repeats."""
    over = Window.partitionBy(*by).orderBy(x, tie)
    step = (F.col(x) - F.lag(x).over(over)) * (F.col(y) + F.lag(y).over(over)) / 2
    return points.withColumn("_a", step).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("auc"))


def _share(hit: Column, of: Column) -> Column:
    """1 where there is nothing to share."""
    return F.when(of == 0, 1.0).otherwise(F.try_divide(hit, of))


def _classes(per_class: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, cls, recall) from per_class (by, cls, hit, n), one row per class that occurs: the classes, all of them together and
    their average. A group's classes are few, so they are unfolded from one row per group; the input is read once."""
    each = F.collect_list(F.struct("cls", F.try_divide(F.col("hit"), F.col("n")).alias("recall"))).alias("each")
    grouped = per_class.groupBy(*by).agg(each, F.coalesce(F.sum("hit"), F.lit(0)).alias("_h"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    mean = F.aggregate("each", F.lit(0.0), lambda acc, x: acc + x["recall"]) / F.nullif(F.size("each"), F.lit(0))
    row = lambda name, v: F.array(F.struct(F.lit(name).alias("cls"), v.cast("double").alias("recall")))
    rows = F.concat(row("global", _share(F.col("_h"), F.col("_n"))), F.col("each"), row("avg", mean))
    return grouped.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.cls", "_r.recall")


def _joined(recalls: DataFrame, precision: DataFrame, by: Sequence[str], beta: float) -> DataFrame:
    out = recalls.join(precision, list(by), "left") if by else one_row(recalls, precision)
    p = F.coalesce("precision", F.lit(1.0))
    return out.select(*by, "cls", p.alias("precision"), "recall", f_beta(p, F.col("recall"), beta).alias("f"))


def point_metrics(records: DataFrame, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """(by, cls, precision, recall, f) from records with label and pred; precision is that of all classes together.

    One aggregation per (by, label) feeds both; nothing else sees single records."""
    counts = records.groupBy(*by, "label").agg(F.count("*").alias("n"), F.sum("pred").alias("hit"))
    real = F.col("label") > 0
    totals = counts.groupBy(*by).agg(F.sum(F.when(real, F.col("hit")).otherwise(0)).alias("tp"), F.sum("hit").alias("pp"))
    precision = totals.select(*by, _share(F.col("tp"), F.col("pp")).alias("precision"))
    return _joined(_classes(counts.where(real).withColumn("cls", F.col("label").cast("string")), by), precision, by, beta)


def range_metrics(real: DataFrame, predicted: DataFrame, params: Mapping[str, object], by: Sequence[str] = (), keys: Sequence[str] = KEYS, beta: float = 1.0, strict: bool = False) -> DataFrame:
    """(by, cls, precision, recall, f) from real (keys, class, r_start, r_end) and predicted ranges.

    Precision is the mean over predicted ranges, 1 without any; a class's recall the mean over its ranges; avg the mean of the classes."""
    precision = range_precisions(predicted, real, params, keys, strict).groupBy(*by).agg(F.avg("reward").alias("precision"))
    per_class = range_recalls(real, predicted, params, keys, strict).groupBy(*by, F.col("class").cast("string").alias("cls")).agg(F.sum("reward").alias("hit"), F.count("*").alias("n"))
    return _joined(_classes(per_class, by), precision, by, beta)


def thresholds(scores: DataFrame, n: int = 500) -> DataFrame:
    """(t, threshold): n values from the lowest to the highest score, and infinity."""
    limits = scores.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    grid = limits.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("t"))
    return grid.select("t", threshold_at(F.col("t"), F.col("_lo"), F.col("_hi"), n).alias("threshold"))


def threshold_at(t: Column, lo: Column, hi: Column, n: int) -> Column:
    return F.when(t == n, F.lit(INFINITY)).when(t == n - 1, hi).otherwise(lo + t * ((hi - lo) / (n - 1)))


def _reached(score: Column, lo: Column, hi: Column, n: int) -> Column:
    """The last threshold number that a score reaches, by the same arithmetic as thresholds(): the guess from the quotient is put right by one."""
    step = (hi - lo) / (n - 1)
    at = lambda t: F.when(t >= n - 1, hi).otherwise(lo + t * step)
    guess = F.when(step > 0, F.least(F.greatest(F.floor(F.try_divide(score - lo, step)), F.lit(0)), F.lit(n - 1))).otherwise(F.lit(n - 1))
    return F.when(at(guess) > score, guess - 1).when((guess < n - 1) & (at(guess + 1) <= score), guess + 1).otherwise(guess).cast("int")


def point_curve(records: DataFrame, n: int = 500, beta: float = 1.0) -> DataFrame:
    """(t, threshold, cls, precision, recall, f) from records with label and score.

    One histogram of the last threshold that each record reaches, by label, then counts summed from above: the records are
    read once whatever the number of thresholds."""
    limits = records.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    cells = one_row(records, limits).groupBy("label", _reached(F.col("score"), F.col("_lo"), F.col("_hi"), n).alias("t")).agg(F.count("*").alias("c"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    # at most n cells a label: one row per label, unfolded over the thresholds
    labels = cells.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("at"), F.sum("c").alias("n"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    grid = labels.select("label", "n", "at", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("t"))
    above = Window.partitionBy("label").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.sum(F.coalesce(F.element_at("at", F.col("t")), F.lit(0))).over(above)
    counts = grid.select("t", "label", "n", "_lo", "_hi", hit.alias("hit"))
    per_t = counts.groupBy("t").agg(F.collect_list(F.struct("label", "hit", "n")).alias("_l"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    real = F.filter("_l", lambda x: x["label"] > 0)
    total = lambda xs, name: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    per_t = per_t.select("t", threshold_at(F.col("t"), F.col("_lo"), F.col("_hi"), n).alias("threshold"), _share(total(real, "hit"), total(F.col("_l"), "hit")).alias("precision"), F.explode_outer(real).alias("_c"))
    per_class = per_t.select("t", "threshold", "precision", F.col("_c.label").cast("string").alias("cls"), F.col("_c.hit").alias("hit"), F.col("_c.n").alias("n"))
    out = _classes(per_class.where("cls IS NOT NULL"), ["t", "threshold", "precision"])
    return out.select("t", "threshold", "cls", "precision", "recall", f_beta(F.col("precision"), F.col("recall"), beta).alias("f"))


def range_curve(records: DataFrame, params: Mapping[str, object], n: int = 500, beta: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(t, threshold, cls, precision, recall, f) of range-based metrics.

    A predicted range can only start or end where the last threshold reached changes between neighbours, so records are first
    reduced to such change points; only these are crossed with the thresholds that lie between."""
    limits = records.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    level = one_row(records, limits).select(*keys, "idx", _reached(F.col("score"), F.col("_lo"), F.col("_hi"), n).alias("_at"))
    over = Window.partitionBy(*keys).orderBy("idx")
    was, will = F.coalesce(F.lag("_at").over(over), F.lit(-1)), F.coalesce(F.lead("_at").over(over), F.lit(-1))
    edges = level.withColumn("_was", was).withColumn("_will", will)
    # a range of threshold t starts where _was < t <= _at and ends where _will < t <= _at
    begin = edges.where("_at > _was").select(*keys, F.col("idx").alias("r_start"), F.explode(F.sequence(F.col("_was") + 1, F.col("_at"))).alias("t"))
    end = edges.where("_at > _will").select(*keys, (F.col("idx") + 1).alias("r_end"), F.explode(F.sequence(F.col("_will") + 1, F.col("_at"))).alias("t"))
    nth = lambda c: F.row_number().over(Window.partitionBy("t", *keys).orderBy(c))
    predicted = begin.withColumn("_k", nth("r_start")).join(end.withColumn("_k", nth("r_end")), [*keys, "t", "_k"]).drop("_k")
    real = class_ranges(records, keys=keys)
    grid = thresholds(records, n)
    crossed = real.crossJoin(F.broadcast(grid.select("t")))
    out = range_metrics(crossed, predicted, params, ["t"], ["t", *keys], beta)
    return F.broadcast(grid).join(out, "t").select("t", "threshold", "cls", "precision", "recall", "f")


def areas(curve: DataFrame) -> DataFrame:
    """(cls, auc): area under precision over recall; where recalls repeat, higher thresholds come first.

    Recalls are taken to nine decimals, so that the order of a sum's terms decides no tie."""
    return auc(curve.withColumn("_tie", -F.col("t")).withColumn("recall", F.round("recall", 9)), "recall", "precision", "_tie", ["cls"])


def best_points(curve: DataFrame) -> DataFrame:
    """The point of the largest F of each class; the lowest threshold of equals."""
    return curve.groupBy("cls").agg(F.max_by(F.struct("t", "threshold", "precision", "recall", "f"), F.struct("f", -F.col("t"))).alias("m")).select("cls", "m.*")


def rolled_up(real: DataFrame, predicted: DataFrame, params: Mapping[str, object], app: str = "app", trace: str = "trace", beta: float = 1.0) -> DataFrame:
    """(granularity, cls, precision, recall, f): global, per application and per trace, each recomputed on its ranges, and the means
    of the application rows and of the trace rows. real and predicted have the columns app and trace.

    The rewards of the ranges do not depend on the granularity, so they are computed once and averaged by grouping sets."""
    keys = [app, trace]
    p = range_precisions(predicted, real, params, keys).select(app, trace, "reward")
    r = range_recalls(real, predicted, params, keys).select(app, trace, F.col("class").cast("string").alias("cls"), "reward")
    level = F.when(F.col("_g") == 3, F.lit("global")).when(F.col("_g") == 1, F.concat(F.lit("app_"), F.col(app).cast("string"))).otherwise(F.concat(F.lit("trace_"), F.col(trace).cast("string")))
    sets = [[], [app], [app, trace]]
    precision = p.groupingSets(sets, app, trace).agg(F.avg("reward").alias("precision"), F.grouping_id(app, trace).alias("_g")).select(level.alias("granularity"), "precision")
    per_class = r.groupBy(app, trace, "cls").agg(F.sum("reward").alias("hit"), F.count("*").alias("n"))
    per_class = per_class.groupingSets([[*s, "cls"] for s in sets], app, trace, "cls").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"), (F.grouping(app) * 2 + F.grouping(trace)).alias("_g"))
    recalls = _classes(per_class.select(level.alias("granularity"), "cls", "hit", "n"), ["granularity"])
    out = _joined(recalls, precision, ["granularity"], beta)
    means = [out.where(F.col("granularity").startswith(f"{k}_")).groupBy("cls").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f")]).select(F.lit(f"{k}_avg").alias("granularity"), "cls", "precision", "recall", "f") for k in ("app", "trace")]
    return out.unionByName(means[0]).unionByName(means[1])


def named(metrics: DataFrame, dataset: str = "test") -> DataFrame:
    """(granularity, column, value) with column names such as TEST_GLOBAL_RECALL."""
    long = metrics.unpivot(["granularity", "cls"], ["precision", "recall", "f"], "metric", "value")
    return long.select("granularity", F.upper(F.concat_ws("_", F.lit(dataset), "cls", "metric")).alias("column"), "value")


def metric_row(long: DataFrame, columns: Sequence[str], key: str = "granularity") -> DataFrame:
    """One row per granularity with the named columns of named(), in their order; null where a metric is missing."""
    return long.where(F.col("column").isin(*columns)).groupBy(key).pivot("column", list(columns)).agg(F.first("value"))


def predicted_ranges(records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return ranges(records, F.col("pred") == 1, keys)
