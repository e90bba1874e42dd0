"""Windows over records: sliding windows, sequences with targets, differences, running statistics and ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, START, ordered, rows, whole


def sliding_windows(df: DataFrame, features: Sequence[str], size: int, step: int = 1, remainder: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, w_start, window): arrays of `size` consecutive records from every `step`-th on, within a period.

    remainder: where records are left over, one more window of the last `size` records."""
    record = F.array(*[F.col(c).cast("double") for c in features])
    if step == 1:  # every record starts a window
        held = df.select(*keys, F.col("idx").alias("w_start"), F.collect_list(record).over(rows(0, size - 1, keys)).alias("window"))
        return held.where(F.size("window") == size)
    # each record goes to the windows that hold it, so that only windows of the result are built
    idx, n = F.col("idx"), F.col("_n")
    first, last = F.greatest(F.ceil((idx - size + 1) / step), F.lit(0)).cast("long"), F.floor(idx / step).cast("long")
    starts = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))
    starts = F.filter(starts, lambda s: s + size <= n)
    if remainder:
        tail = (n - size).cast("long")
        more = (tail >= 0) & (tail % step != 0) & (idx >= tail)
        starts = F.concat(starts, F.when(more, F.array(tail)).otherwise(F.array().cast("array<bigint>")))
    held = df.withColumn("_n", F.count("*").over(whole(keys))).select(*keys, "idx", record.alias("_r"), F.explode(starts).alias("w_start"))
    windows = held.groupBy(*keys, "w_start").agg(F.array_sort(F.collect_list(F.struct("idx", "_r"))).alias("window"))
    return windows.select(*keys, "w_start", F.col("window._r").alias("window"))


def window_means(df: DataFrame, features: Sequence[str], size: int, step: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Means of the same windows without building them."""
    frame = rows(0, size - 1, keys)
    out = df.select(*keys, F.col("idx").alias("w_start"), *[F.avg(c).over(frame).alias(c) for c in features], F.count("*").over(whole(keys)).alias("_n"))
    return out.where((F.col("w_start") % step == 0) & (F.col("w_start") + size <= F.col("_n"))).drop("_n")


def sequence_pairs(df: DataFrame, features: Sequence[str], n_back: int, n_forward: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, idx, sequence, target): the n_back records before idx, and the record n_forward - 1 after it."""
    record = F.array(*[F.col(c).cast("double") for c in features])
    past = F.collect_list(record).over(rows(-n_back, -1, keys))
    out = df.select(*keys, "idx", past.alias("sequence"), F.lead(record, n_forward - 1).over(ordered(keys)).alias("target"))
    return out.where((F.size("sequence") == n_back) & F.col("target").isNotNull())


def difference(col: Column, k: int = 1, keys: Sequence[str] = KEYS, order: str = ORDER) -> Column:
    return col - F.lag(col, k).over(ordered(keys, order))


def running(col: Column, stat: str, size: int | None = None, keys: Sequence[str] = KEYS, order: str = ORDER) -> Column:
    """mean, std (of a sample), min or max over all records before this one, or over the last `size` of them, which must be there."""
    frame = rows(START if size is None else -size, -1, keys, order)
    value = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[stat](col).over(frame)
    return value if size is None else F.when(F.count(col).over(frame) == size, value)


def ranges(df: DataFrame, flag: Column, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """(keys, r_start, r_end), the end excluded: runs of consecutive records where flag holds. order must be dense."""
    hit = df.where(flag).select(*keys, F.col(order).alias("_i"))
    hit = hit.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys).orderBy("_i")))
    return hit.groupBy(*keys, "_run").agg(F.min("_i").alias("r_start"), (F.max("_i") + 1).alias("r_end")).drop("_run")


def class_ranges(df: DataFrame, label: str = "label", keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """(keys, class, r_start, r_end): runs of each class other than 0; neighbours of different classes stay apart."""
    return ranges(df.withColumnRenamed(label, "class"), F.col("class") > 0, [*keys, "class"], order)


def window_to_record(windows: DataFrame, size: int, score: str = "score", keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    """(keys, idx, score): a record's score is the mean of those of the windows it lies in, from (keys, w_start, score).

    The last size - 1 records lie in fewer windows; their sum is divided by size all the same, as is known of the
    method's published form, unless strict."""
    limits = windows.groupBy(*keys).agg(F.count("*").alias("_n"))
    grid = limits.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") + size - 2)).alias("idx"))
    scored = grid.join(windows.select(*keys, F.col("w_start").alias("idx"), F.col(score).alias("_s")), [*keys, "idx"], "left")
    frame = rows(-(size - 1), 0, keys)
    total, held = F.sum("_s").over(frame), F.count("_s").over(frame)
    value = total / held if strict else total / F.least(F.col("idx") + 1, F.lit(size))
    return scored.select(*keys, "idx", value.alias("score"))


def fifths(df: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS, parts: int = 5) -> DataFrame:
    """(keys, ft, monotone): whether the means of jumping windows of a fifth of the records strictly rise or fall.

    Where records are left over, a last window of the last records counts too."""
    sized = df.withColumn("_n", F.count("*").over(whole(keys))).withColumn("_w", F.greatest(F.floor(F.col("_n") / parts), F.lit(1)).cast("long"))
    full = F.floor(F.col("_n") / F.col("_w")).cast("long")
    own = F.when(F.col("idx") < full * F.col("_w"), F.floor(F.col("idx") / F.col("_w")).cast("long"))
    tail = F.when((full * F.col("_w") != F.col("_n")) & (F.col("idx") >= F.col("_n") - F.col("_w")), full)
    long = sized.withColumn("_window", F.explode(F.filter(F.array(own, tail), lambda x: x.isNotNull())))
    long = long.select(*keys, "_window", F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("ft", "value"))
    means = long.groupBy(*keys, "ft", "_window").agg(F.avg("value").alias("m"))
    step = F.col("m") - F.lag("m").over(Window.partitionBy(*keys, "ft").orderBy("_window"))
    steps = means.withColumn("_d", step)
    return steps.groupBy(*keys, "ft").agg((F.coalesce(F.min("_d") > 0, F.lit(True)) | F.coalesce(F.max("_d") < 0, F.lit(True))).alias("monotone"))

