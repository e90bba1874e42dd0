"""Resampling and alignment of traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, filled, ordered, whole

AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median}


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, for timestamps with or without zone."""
    return F.unix_timestamp(ts)


def _binned(df: DataFrame, features: Sequence[str], agg: str | Mapping[str, str], label: str | None, keys: Sequence[str], fill: bool) -> DataFrame:
    """Aggregated bins with a row for every bin between the first and the last of a period. Each bin is unfolded up to the next
    one that has records, so the input is read once and no grid is joined."""
    kinds = agg if isinstance(agg, Mapping) else dict.fromkeys(features, agg)
    names = [*features, *([label] if label else [])]
    aggs = [AGGREGATES[kinds[c]](c).alias(c) for c in features] + ([F.max(label).alias(label)] if label else [])
    bins = df.groupBy(*keys, "_bin").agg(*aggs)
    following = F.coalesce(F.lead("_bin").over(ordered(keys, "_bin")), F.col("_bin") + 1)
    dense = bins.withColumn("_next", following).withColumn("_at", F.explode(F.sequence("_bin", F.col("_next") - 1)))
    own = F.col("_at") == F.col("_bin")
    out = dense.select(*keys, F.col("_at"), *[F.when(own, F.col(c)).alias(c) for c in names]).withColumnRenamed("_at", "_bin")
    if fill:
        out = out.select(*keys, "_bin", *[filled(F.col(c), keys, "_bin").alias(c) for c in names])
    return out


def resample_time(df: DataFrame, period: int, features: Sequence[str], agg: str | Mapping[str, str] = "mean", label: str | None = None, keys: Sequence[str] = KEYS, ts: str = "ts", fill: bool = True) -> DataFrame:
    """Records per bin of `period` seconds: agg of the features, maximum of the label; bins without records are
    filled from before, then from after. Bins are aligned to the epoch."""
    binned = df.withColumn("_bin", F.floor(seconds(F.col(ts)) / period).cast("long"))
    out = _binned(binned, features, agg, label, keys, fill)
    idx = (F.col("_bin") - F.min("_bin").over(whole(keys))).alias("idx")
    return out.select(*keys, idx, F.timestamp_seconds(F.col("_bin") * period).alias(ts), *features, *([label] if label else []))


def resample_rank(df: DataFrame, pre_period: int, period: int, features: Sequence[str], agg: str | Mapping[str, str] = "mean", label: str | None = None, keys: Sequence[str] = KEYS, fill: bool = True) -> DataFrame:
    """The same where time is the record number times pre_period seconds, so bins depend on the order alone."""
    binned = df.withColumn("_bin", F.floor(F.col("idx") * pre_period / period).cast("long"))
    return _binned(binned, features, agg, label, keys, fill).withColumnRenamed("_bin", "idx")


def resample_labels(df: DataFrame, pre_period: int, period: int, label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """Maximum of the labels per bin."""
    return df.groupBy(*keys, F.floor(F.col("idx") * pre_period / period).cast("long").alias("idx")).agg(F.max(label).alias(label))


def upsample(df: DataFrame, lengths: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Each record repeated round(target / n) times (half to even), then cut or padded with the last record.

    lengths: keys and target."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    plan = counts.join(lengths.select(*keys, F.col("target").cast("long")), list(keys))
    slots = plan.where("target > 0").select(*keys, "_n", F.bround(F.col("target") / F.col("_n"), 0).cast("long").alias("_rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("target") - 1)).alias("_slot"))
    source = F.least(F.floor(F.col("_slot") / F.greatest(F.col("_rep"), F.lit(1))), F.col("_n") - 1).cast("long")
    return slots.select(*keys, source.alias("idx"), "_slot").join(df.select(*keys, "idx", *features), [*keys, "idx"]).select(*keys, F.col("_slot").alias("idx"), *features)


def downsample(df: DataFrame, lengths: DataFrame, features: Sequence[str], agg: str = "max", keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows of round(n / target) records, each aggregated. Where whole windows leave records over and the target
    is not yet reached, the last window is made of the last records instead, so it overlaps the one before."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).join(lengths.select(*keys, F.col("target").cast("long")), list(keys))
    plan = counts.withColumn("_w", F.greatest(F.bround(F.col("_n") / F.col("target"), 0).cast("long"), F.lit(1)))
    joined = df.join(plan, list(keys))
    full = F.floor(F.col("_n") / F.col("_w")).cast("long")
    rest = (F.col("_w") * F.col("target") >= F.col("_n")) & (full * F.col("_w") != F.col("_n"))
    own = F.when(F.col("idx") < full * F.col("_w"), F.floor(F.col("idx") / F.col("_w")).cast("long"))
    tail = F.when(rest & (F.col("idx") >= F.col("_n") - F.col("_w")), full)
    windows = joined.withColumn("_window", F.explode(F.filter(F.array(own, tail), lambda x: x.isNotNull())))
    return windows.groupBy(*keys, F.col("_window").alias("idx")).agg(*[AGGREGATES[agg](c).alias(c) for c in features])


def match_sampling(df: DataFrame, lengths: DataFrame, features: Sequence[str], agg: str = "max", keys: Sequence[str] = KEYS) -> DataFrame:
    """upsample for the periods that are not longer than their target, downsample for the others."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).join(lengths, list(keys))
    up, down = (counts.where(c).select(*keys, "target") for c in ("_n <= target", "_n > target"))
    return upsample(df.join(up.select(*keys), list(keys), "left_semi"), up, features, keys).unionByName(downsample(df.join(down.select(*keys), list(keys), "left_semi"), down, features, agg, keys))
