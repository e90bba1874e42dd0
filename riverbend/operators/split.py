"""Sampling and splitting by hash order instead of a random generator, so any engine and any partitioning gives the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, shuffled, whole


def shuffle(df: DataFrame, key: Column, seed: int = 21) -> DataFrame:
    """Rows with their order in a shuffle; what lies on a row stays together."""
    return df.withColumn("shuffle_key", shuffled(key, seed))


def select_periods(df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Records of the largest period and n - 1 others; n = -1 keeps all. One row per period is ranked."""
    if n == -1:
        return df
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    largest = sizes.orderBy(F.desc("_size"), *keys).limit(1).select(*keys)
    others = sizes.join(largest, list(keys), "left_anti").orderBy(shuffled(F.concat_ws("/", *keys), seed), *keys).limit(n - 1).select(*keys)
    return df.join(largest.union(others), list(keys), "left_semi")


def _cut(rank: Column, total: Column, val: float, test: float) -> Column:
    """train, val or test by rank (from 0) in a shuffle: cut-offs are the integer parts of the shares."""
    first, second = F.floor((1 - test - val) * total), F.floor((1 - test) * total)
    return F.when(rank < first, "train").when(rank < second, "val").otherwise("test")


#: A share of the hash space in which ranks are counted separately.
_DIGITS = 2


def _ranked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with _rank (from 0) by shuffle_key and _total, within keys. Ranks are counted in parts of the hash space and offset by the
    parts before, so no task sorts all rows."""
    parted = df.withColumn("_part", F.substring("shuffle_key", 1, _DIGITS))
    sizes = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_m"))
    by = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_m").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_part", before.alias("_before"), F.sum("_m").over(by).alias("_total"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("shuffle_key")) - 1
    return parted.withColumn("_own", own).join(sizes, [*keys, "_part"]).withColumn("_rank", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_part")


def random_split(samples: DataFrame, key: Column, val: float = 0.15, test: float = 0.15, seed: int = 21) -> DataFrame:
    """samples with the column dataset, cut by their rank in a shuffle of all of them."""
    ranked = _ranked(shuffle(samples, key, seed), [])
    return ranked.withColumn("dataset", _cut(F.col("_rank"), F.col("_total"), val, test)).drop("_rank", "_total", "shuffle_key")


def strata(df: DataFrame, n: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Records with stratum and stratum_end: n parts of each period, the first of them one longer where the length leaves a rest."""
    size = F.count("*").over(whole(keys))
    out = df.withColumn("_size", size).withColumn("_q", F.floor(F.col("_size") / n)).withColumn("_r", F.col("_size") % n)
    head = F.col("_r") * (F.col("_q") + 1)
    part = F.when(F.col("idx") < head, F.floor(F.col("idx") / (F.col("_q") + 1))).otherwise(F.col("_r") + F.floor((F.col("idx") - head) / F.greatest(F.col("_q"), F.lit(1))))
    out = out.withColumn("stratum", part.cast("int"))
    end = F.when(F.col("stratum") < F.col("_r"), (F.col("stratum") + 1) * (F.col("_q") + 1)).otherwise(head + (F.col("stratum") - F.col("_r") + 1) * F.col("_q"))
    return out.withColumn("stratum_end", end.cast("long")).drop("_size", "_q", "_r")


def stratified_split(df: DataFrame, size: int, step: int = 1, n: int = 3, val: float = 0.15, test: float = 0.15, seed: int = 21, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, stratum, w_start, dataset): windows of `size` records that lie inside a stratum, split inside each stratum."""
    parted = strata(df.select(*keys, "idx"), n, keys)
    first = F.min("idx").over(Window.partitionBy(*keys, "stratum"))
    windows = parted.withColumn("_first", first).where((F.col("idx") + size <= F.col("stratum_end")) & ((F.col("idx") - F.col("_first")) % step == 0))
    windows = shuffle(windows, F.concat_ws("/", *keys, F.col("idx")), seed)
    ranked = _ranked(windows.select(*keys, "stratum", F.col("idx").alias("w_start"), "shuffle_key"), [*keys, "stratum"])
    return ranked.select(*keys, "stratum", "w_start", _cut(F.col("_rank"), F.col("_total"), val, test).alias("dataset"))


def proportion(df: DataFrame, share: float, key: Column, by: Sequence[str] = ("dataset",), seed: int = 21) -> DataFrame:
    """The first share of each set, in shuffle order."""
    ranked = _ranked(shuffle(df, key, seed), list(by))
    return ranked.where(F.col("_rank") < F.floor(F.lit(share) * F.col("_total"))).drop("_rank", "_total", "shuffle_key")


def subsample(df: DataFrame, share: float, key: Column, repetitions: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """`repetitions` samples without replacement of a share of the rows of each group, with the column repetition."""
    every = df.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    every = every.withColumn("shuffle_key", shuffled(F.concat_ws("/", F.col("repetition"), key), seed))
    ranked = _ranked(every, [*by, "repetition"])
    return ranked.where(F.col("_rank") < F.floor(F.lit(share) * F.col("_total"))).drop("_rank", "_total", "shuffle_key")


def train_test(df: DataFrame, test: float, key: Column, repetitions: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """`repetitions` splits of each group with the columns repetition and dataset (train or test)."""
    every = df.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    every = every.withColumn("shuffle_key", shuffled(F.concat_ws("/", F.col("repetition"), key), seed))
    ranked = _ranked(every, [*by, "repetition"])
    return ranked.withColumn("dataset", F.when(F.col("_rank") < F.floor((1 - test) * F.col("_total")), "train").otherwise("test")).drop("_rank", "_total", "shuffle_key")
