"""Window specifications and the fills built on them.

All operators over records take keys (what makes a period; by default the column trace) and an order column (idx).
They build their windows here, so Catalyst finds equal specifications and sorts each period once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("trace",)
ORDER = "idx"
START, END = Window.unboundedPreceding, Window.unboundedFollowing


def ordered(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rows(low: int, high: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return ordered(keys, order).rowsBetween(low, high)


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def before(col: Column, keys: Sequence[str] = KEYS, order: str = ORDER) -> Column:
    """The last value that is not null, up to this record."""
    return F.last(col, ignorenulls=True).over(rows(START, 0, keys, order))


def after(col: Column, keys: Sequence[str] = KEYS, order: str = ORDER) -> Column:
    """The first value that is not null, from this record on."""
    return F.first(col, ignorenulls=True).over(rows(0, END, keys, order))


def filled(col: Column, keys: Sequence[str] = KEYS, order: str = ORDER) -> Column:
    """Forward fill, then backward fill."""
    return F.coalesce(before(col, keys, order), after(col, keys, order))


def numbered(df: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = ("ts",), name: str = ORDER) -> DataFrame:
    """df with a dense 0-based record number inside each period."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1).cast("long"))


def one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """df with the columns of stats, a single row (an aggregate without keys), by broadcast."""
    return df.crossJoin(F.broadcast(stats))


def shuffled(key: Column, seed: int | str) -> Column:
    """A pseudo-random order that any engine can repeat: the MD5 of the key's text and a seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
