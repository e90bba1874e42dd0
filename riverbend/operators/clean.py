"""Row-level cleaning, trimming, splitting and thresholding of records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import END, KEYS, ORDER, START, after, before, ordered, rows

INACTIVE = -1.0


def rename(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    """All columns renamed by a rule at plan time, in order of the new names."""
    out = df.toDF(*[rule(c) for c in df.columns])
    return out.select(*sorted(out.columns))


def strip_name_parts(name: str, first: int = 1, last: int = 9, sep: str = "_") -> str:
    """A metric name without its parts first to last, where a job's own prefix stands."""
    parts = name.split(sep)
    return sep.join([*parts[:first], *parts[last + 1 :]])


def null_to_inactive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(INACTIVE, subset=list(columns))


def fill_counter_gaps(df: DataFrame, counter: str, columns: Sequence[str], keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Inside a period, a gap of inactive records of `counter` takes the values of the record before it, in all
    columns, if the counter goes on after the gap at no less than it had before; otherwise nothing changes."""
    active = F.col(counter) != INACTIVE
    held = F.when(active, F.struct(F.col(counter).alias("_c"), *[F.col(c) for c in columns]))
    was, comes = before(held, keys, order), after(F.when(active, F.col(counter)), keys, order)
    marked = df.withColumn("_was", was).withColumn("_comes", comes)
    use = ~active & F.col("_was").isNotNull() & F.col("_comes").isNotNull() & (F.col("_comes") >= F.col("_was._c"))
    return marked.withColumns({c: F.when(use, F.col(f"_was.{c}")).otherwise(F.col(c)) for c in columns}).drop("_was", "_comes")


def fill_inactive(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Inactive values from before, then from after; columns without any stay inactive."""
    known = {c: F.nullif(F.col(c), F.lit(INACTIVE)) for c in columns}
    return df.withColumns({c: F.coalesce(before(v, keys, order), after(v, keys, order), F.lit(INACTIVE)) for c, v in known.items()})


def prune(df: DataFrame, head: int, tail: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Without the first `head` and last `tail` records of each period."""
    n = F.row_number().over(ordered(keys, order))
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).withColumn("_size", size).where((F.col("_n") > head) & (F.col("_n") <= F.col("_size") - tail)).drop("_n", "_size")


def trim_head(df: DataFrame, n: int, order: str = ORDER) -> DataFrame:
    return df.where(F.col(order) >= n)


def split_by_type(df: DataFrame, normal: Sequence[str], column: str = "trace_type") -> DataFrame:
    """With the column dataset: train for the undisturbed types, test for the others."""
    return df.withColumn("dataset", F.when(F.col(column).isin(*normal), "train").otherwise("test"))


def mask_label(df: DataFrame, unknown: int = 7, label: str = "label") -> DataFrame:
    """Records of the unknown class count as normal."""
    return df.withColumn(label, F.when(F.col(label) == unknown, 0).otherwise(F.col(label)))


def predict(score: Column, threshold: Column) -> Column:
    """1 where the score reaches the threshold."""
    return (score >= threshold).cast("int")


def prepend_negatives(records: DataFrame, predictions: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """A prediction for every record: 0 where the model made none, as at the head of a forecast."""
    return records.select(*keys, order).join(predictions.select(*keys, order, "pred"), [*keys, order], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))


def by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Normal and anomalous records."""
    return df.where(F.col(label) == 0), df.where(F.col(label) > 0)


def merged(normal: DataFrame, anomalous: DataFrame, label: str = "label") -> DataFrame:
    """One sample of both, labelled 0 and 1."""
    return normal.withColumn(label, F.lit(0)).unionByName(anomalous.withColumn(label, F.lit(1)))


def having(counts: DataFrame, more_than: int, count: str = "n") -> DataFrame:
    return counts.where(F.col(count) > more_than)


def known_only(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Records whose key occurs in known."""
    return df.join(known.select(on), on, "left_semi")


def interior_gaps(df: DataFrame, counter: str, keys: Sequence[str] = KEYS, order: str = ORDER) -> Column:
    """Whether a record lies in a gap that has active records on both sides."""
    active = F.when(F.col(counter) != INACTIVE, 1)
    return (F.col(counter) == INACTIVE) & (F.max(active).over(rows(START, 0, keys, order)) == 1) & (F.max(active).over(rows(0, END, keys, order)) == 1)
