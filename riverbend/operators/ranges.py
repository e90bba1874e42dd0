"""Range-based rewards in closed form.

A range of N records [r_start, r_end) and an overlap that covers its records [a, b) of them, k = b - a:

    flat  = k / N
    front = (k (N - 1) - (a + b - 1) k / 2) / (N (N - 1) / 2)
    back  = ((a + b - 1) k / 2) / (N (N - 1) / 2)

With a positional bias, records at the front (back) weigh more; flat.normalized scales the flat share by the reward over
that of the best placed overlap of this length. The front and back bias of a single record is undefined and counts as flat.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS
from .rangejoin import overlapping

SIZES = ("default", "flat.normalized")
BIASES = ("flat", "front", "back")
CARDINALITIES = ("no.dup", "dup", "inv.poly")

# The four levels of range-based evaluation, each stricter than the one before.
LEVELS: dict[str, dict[str, object]] = {
    "ad1": {"alpha": 1.0, "recall_size": "default", "recall_bias": "flat", "recall_card": "dup", "precision_size": "default", "precision_bias": "flat", "precision_card": "dup"},
    "ad2": {"alpha": 0.0, "recall_size": "default", "recall_bias": "flat", "recall_card": "dup", "precision_size": "default", "precision_bias": "flat", "precision_card": "dup"},
    "ad3": {"alpha": 0.0, "recall_size": "flat.normalized", "recall_bias": "front", "recall_card": "dup", "precision_size": "default", "precision_bias": "flat", "precision_card": "dup"},
    "ad4": {"alpha": 0.0, "recall_size": "flat.normalized", "recall_bias": "front", "recall_card": "no.dup", "precision_size": "default", "precision_bias": "flat", "precision_card": "no.dup"},
}


def size_reward(n: Column, a: Column, b: Column, size: str = "default", bias: str = "flat") -> Column:
    """Share of a range's reward that an overlap of its records [a, b) earns."""
    k = b - a
    flat = k / n
    if bias == "flat":
        return flat
    if size not in SIZES or bias not in BIASES:
        raise ValueError("unknown size or bias")
    whole, place = n * (n - 1) / 2, (a + b - 1) * k / 2
    biased = F.when(n == 1, flat).otherwise(F.try_divide(k * (n - 1) - place if bias == "front" else place, whole))
    if size == "default":
        return biased
    best = F.when(n == 1, flat).otherwise(F.try_divide(k * (n - 1) - (k - 1) * k / 2, whole))
    return F.when(best == 0, F.lit(0.0)).otherwise(flat * F.try_divide(biased, best))


def cardinality(overlaps: Column, kind: str) -> Column:
    """Factor for a range with so many overlaps; one counts in full, and none leaves nothing to weigh."""
    several = {"dup": F.lit(1.0), "no.dup": F.lit(0.0), "inv.poly": F.try_divide(F.lit(1.0), overlaps)}[kind]
    return F.when(overlaps == 1, 1.0).when(overlaps == 0, 0.0).otherwise(several)


def rewards(of: DataFrame, against: DataFrame, alpha: float, size: str, bias: str, card: str, keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    """of with the column reward: alpha for being met at all, and 1 - alpha by what is covered.

    of: keys, r_start, r_end and further columns; against: keys, o_start, o_end."""
    pairs = overlapping(of.select(*keys, "r_start", "r_end").distinct(), against.select(*keys, "o_start", "o_end"), keys, strict)
    n = F.col("r_end") - F.col("r_start")
    a = F.greatest("r_start", "o_start") - F.col("r_start")
    b = F.least("r_end", "o_end") - F.col("r_start")
    met = pairs.groupBy(*keys, "r_start", "r_end").agg(F.count("*").alias("_n"), F.sum(size_reward(n, a, b, size, bias)).alias("_sum"))
    covered = cardinality(F.col("_n"), card) * F.col("_sum")
    out = of.join(met, [*keys, "r_start", "r_end"], "left")
    value = F.when(F.col("_n").isNull(), 0.0).otherwise(alpha + (1 - alpha) * covered)
    return out.withColumn("reward", value).drop("_n", "_sum")


def as_others(ranges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return ranges.select(*keys, F.col("r_start").alias("o_start"), F.col("r_end").alias("o_end"))


def range_recalls(real: DataFrame, predicted: DataFrame, params: Mapping[str, object], keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    """Real ranges (keys, class, r_start, r_end) with their recall as reward."""
    return rewards(real, as_others(predicted, keys), params["alpha"], params["recall_size"], params["recall_bias"], params["recall_card"], keys, strict)


def range_precisions(predicted: DataFrame, real: DataFrame, params: Mapping[str, object], keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    """Predicted ranges with their precision as reward, against the real ranges of all classes."""
    return rewards(predicted, as_others(real, keys), 0.0, params["precision_size"], params["precision_bias"], params["precision_card"], keys, strict)
