"""Reports over the long table of metrics: (method, granularity, cls, metric, value), and the data behind figures."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AVERAGES = ("all", "reported", "all_but_unknown")


def argument_grid(args: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(args, values, strict=True)) for values in itertools.product(*args.values())]


def validate(average: str, classes: Sequence[str]) -> None:
    """Reject averages that the reported classes cannot give."""
    if average not in AVERAGES:
        raise ValueError(f"average must be one of {AVERAGES}")
    if average == "reported" and not classes:
        raise ValueError("an average over reported classes needs classes")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("method", "granularity", "cls", "metric")) -> DataFrame:
    """old with its rows replaced where new has their key, and the other rows of new added."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def latest(runs: DataFrame, name: str = "run", by: Sequence[str] = ("config",)) -> DataFrame:
    """The latest run of each configuration; run names end with a time such as 2024.01.31.10.00.00."""
    stamp = F.to_timestamp(F.regexp_extract(name, r"(\d{4}(?:\.\d{2}){5})$", 1), "yyyy.MM.dd.HH.mm.ss")
    order = Window.partitionBy(*by).orderBy(F.desc(stamp), F.desc(name))
    return runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def report(metrics: DataFrame, by: Sequence[str] = ("method",), granularity: str = "global", metric: str = "F1", aggregate: str = "median") -> DataFrame:
    """(by, value): median (or mean, min, max) of a metric over the configurations of each method. Names match exactly."""
    f = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}[aggregate]
    held = metrics.where((F.col("granularity") == granularity) & (F.col("metric") == metric))
    return held.groupBy(*by).agg(f("value").alias("value"))


def class_average(metrics: DataFrame, average: str = "all_but_unknown", reported: Sequence[str] = (), unknown: str = "7", by: Sequence[str] = ("method", "granularity", "metric")) -> DataFrame:
    """(by, value): mean over classes: all of them, those reported, or all but the unknown one."""
    validate(average, reported)
    single = ~F.col("cls").isin("global", "avg")
    chosen = {"all": single, "reported": F.col("cls").isin(*reported), "all_but_unknown": single & (F.col("cls") != unknown)}[average]
    return metrics.where(chosen).groupBy(*by).agg(F.avg("value").alias("value"))


def wide(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per method and granularity, a column per CLS_METRIC name."""
    return metrics.withColumn("_n", F.upper(F.concat_ws("_", "cls", "metric"))).groupBy("method", "granularity").pivot("_n", list(names)).agg(F.first("value"))


def learning_curve(runs: DataFrame, grid: Sequence[float], x: str = "share", y: str = "f1") -> DataFrame:
    """(model, x, mean, std): each seed's curve interpolated linearly on a grid, then mean and population deviation over seeds."""
    spark = runs.sparkSession
    points = runs.groupBy("model", "seed", x).agg(F.median(y).alias("y"))
    by = Window.partitionBy("model", "seed").orderBy(x)
    spans = points.withColumn("_x1", F.lead(x).over(by)).withColumn("_y1", F.lead("y").over(by))
    at = spark.createDataFrame([(float(g),) for g in grid], "g double")
    inside = (F.col("g") >= F.col(x)) & ((F.col("g") < F.col("_x1")) | (F.col("_x1").isNull() & (F.col("g") == F.col(x))))
    joined = spans.crossJoin(F.broadcast(at)).where(inside)
    value = F.when(F.col("_x1").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("g") - F.col(x)) / (F.col("_x1") - F.col(x)) * (F.col("_y1") - F.col("y")))
    return joined.withColumn("v", value).groupBy("model", F.col("g").alias("x")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def score_distribution(records: DataFrame, bins: int = 30, unknown: int | None = None, factor: float = 3.0) -> DataFrame:
    """(label, bin, n, share, capped): a histogram per class of the scores up to the third quartile plus factor times the interquartile
    range, as shares of the class, with the share of the class that was above."""
    held = records.where(F.col("label") != unknown) if unknown is not None else records
    q = held.agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.min("score").alias("lo"), F.max("score").alias("top"))
    q = q.select("lo", F.least(F.col("top"), F.col("q")[1] + factor * (F.col("q")[1] - F.col("q")[0])).alias("hi"))
    crossed = held.crossJoin(F.broadcast(q))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.least("score", "hi") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    cells = crossed.groupBy("label", F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("score") > F.col("hi")).cast("int")).alias("c"))
    over = Window.partitionBy("label")
    total = F.sum("n").over(over)
    return cells.select("label", "bin", "n", (F.col("n") / total).alias("share"), (F.sum("c").over(over) / total).alias("capped"))


def spans(records: DataFrame, real: DataFrame, keys: Sequence[str] = ("trace",)) -> DataFrame:
    """Scored records with the class of the anomaly that holds them (0 outside), for a plot of a period."""
    inside = real.select(*keys, "class", F.explode(F.sequence("r_start", F.col("r_end") - 1)).alias("idx"))
    return records.join(inside, [*keys, "idx"], "left").withColumn("class", F.coalesce("class", F.lit(0)))


