"""Evaluation of explanations: instances, coverage, conciseness, consistency and accuracy of rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS
from ..functions.store import stored
from . import split
from .explain import classify, sample

POLICIES = ("none", "before", "after", "both")


def anomaly_instances(real: DataFrame, min_normal: int = 2, min_anomaly: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, class, n_start, r_start, r_end): each anomaly with the normal records since the anomaly before it, of whatever class.

    Dropped where either part is too short."""
    was = F.lag("r_end").over(Window.partitionBy(*keys).orderBy("r_start"))
    out = real.withColumn("n_start", F.coalesce(was, F.lit(0)))
    return out.where((F.col("r_start") - F.col("n_start") >= min_normal) & (F.col("r_end") - F.col("r_start") >= min_anomaly)).select(*keys, "class", "n_start", "r_start", "r_end")


def instance_records(instances: DataFrame, records: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(instance, class, idx, y, features) of the records of instances; an instance is named by its keys and start."""
    name = F.concat_ws("/", *keys, "r_start").alias("instance")
    spans = instances.select(*keys, "class", "n_start", "r_start", "r_end", name, F.explode(F.sequence("n_start", F.col("r_end") - 1)).alias("idx"))
    y = (F.col("idx") >= F.col("r_start")).cast("int").alias("y")
    return spans.select(*keys, "instance", "class", "idx", y).join(records.select(*keys, "idx", *features), [*keys, "idx"]).drop(*keys)


def expanded_instances(real: DataFrame, sizes: DataFrame, sample_length: int, disturbances: int = 5, policy: str = "both", min_anomaly: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, class, r_start, r_end, e_start, e_end): anomalies widened to sample_length + disturbances - 1 records by neighbours.

    policy: take them before, after or on both sides (the odd one after); what one side lacks comes from the other, and an instance
    that finds too few is dropped. With none, anomalies shorter than sample_length are dropped and longer ones still
    widened after themselves. sizes: keys, n records."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    length = F.col("r_end") - F.col("r_start")
    held = real.join(sizes.select(*keys, "n"), list(keys)).where(length >= min_anomaly)
    if policy == "none":
        held = held.where(length >= sample_length)
    need = F.greatest(F.lit(sample_length + disturbances - 1) - length, F.lit(0)).cast("long")
    before = {"before": need, "both": F.floor(need / 2), "none": F.lit(0), "after": F.lit(0)}[policy].cast("long")
    held = held.withColumn("_b", before).withColumn("_a", need - F.col("_b"))
    # what does not fit before goes after, then what does not fit after goes before
    start = F.greatest(F.col("r_start") - F.col("_b"), F.lit(0))
    end = F.col("r_end") + F.greatest(F.col("_b") - F.col("r_start"), F.lit(0))
    held = held.withColumn("_s", start).withColumn("_e", end).where("_e <= n")
    over = F.greatest(F.col("_e") + F.col("_a") - F.col("n"), F.lit(0))
    held = held.withColumn("e_end", F.least(F.col("_e") + F.col("_a"), F.col("n"))).withColumn("e_start", F.col("_s") - over)
    return held.where("e_start >= 0").select(*keys, "class", "r_start", "r_end", "e_start", "e_end")


def disturbed(instances: DataFrame, sample_length: int, disturbances: int = 5, coverage: str = "all", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, r_start, variant, s_start, s_end): `disturbances` shifted samples of an expanded instance: from its start on, around its
    centre, or up to its end, by the coverage policy (all and start, center, end)."""
    span = F.lit(sample_length + disturbances - 1)
    first = {"all": F.col("e_start"), "start": F.col("e_start"), "center": F.col("e_start") + F.floor((F.col("e_end") - F.col("e_start") - span) / 2), "end": F.col("e_end") - span}[coverage]
    out = instances.select(*keys, "r_start", first.cast("long").alias("_f"), F.explode(F.sequence(F.lit(0), F.lit(disturbances - 1))).alias("variant"))
    return out.select(*keys, "r_start", "variant", (F.col("_f") + F.col("variant")).alias("s_start"), (F.col("_f") + F.col("variant") + sample_length).alias("s_end"))


def proportions(real: DataFrame, instances: DataFrame, explained: DataFrame) -> DataFrame:
    """(class, n, covered, explained): shares of the anomalies that became instances, and of instances that got an explanation."""
    counts = [df.groupBy("class").agg(F.count("*").alias(n)) for df, n in ((real, "n"), (instances, "_i"), (explained, "_e"))]
    out = counts[0].join(counts[1], "class", "left").join(counts[2], "class", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("class", "n", (zero("_i") / F.col("n")).alias("covered"), F.try_divide(zero("_e"), zero("_i")).alias("explained"))


def conciseness(explanations: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """(by, conciseness): mean number of features. explanations: by, instance, ft."""
    sizes = explanations.groupBy(*by, "instance").agg(F.count_distinct("ft").alias("s"))
    return sizes.groupBy(*by).agg(F.avg("s").alias("conciseness"))


def entropy2(p: Column) -> Column:
    return F.sum(-p * F.log2(p))


def consistency(explanations: DataFrame, by: Sequence[str] = ("class",), normalise: bool = True) -> DataFrame:
    """(by, consistency): 2 to the entropy of the features over all explanations of a group, over their mean size; null for one explanation."""
    once = explanations.select(*by, "instance", "ft").distinct()
    counts = once.groupBy(*by, "ft").agg(F.count("*").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("t"))
    sizes = once.groupBy(*by).agg(F.count_distinct("instance").alias("m"))
    shares = counts.join(total, list(by)).withColumn("p", F.col("c") / F.col("t"))
    out = shares.groupBy(*by).agg(F.pow(F.lit(2.0), entropy2(F.col("p"))).alias("v"), F.max("t").alias("t")).join(sizes, list(by))
    value = F.col("v") / (F.col("t") / F.col("m")) if normalise else F.col("v")
    return out.select(*by, F.when(F.col("m") > 1, value).alias("consistency"))


def accuracy(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, precision, recall, f1) of rules from y and pred; 0 where there is nothing to divide by."""
    tp, pp, rp = (F.sum(c) for c in (F.col("y") * F.col("pred"), F.col("pred"), F.col("y")))
    out = judged.groupBy(*by).agg(tp.alias("tp"), pp.alias("pp"), rp.alias("rp"))
    p, r = F.coalesce(F.try_divide("tp", "pp"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "rp"), F.lit(0.0))
    return out.select(*by, p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def cross_accuracy(rules: DataFrame, long: DataFrame, classes: DataFrame, half_open: bool = False) -> DataFrame:
    """(rule, instance, precision, recall, f1): each rule on the records of the other instances of its class.

    rules: instance, ft, lo, hi; long: instance, idx, ft, value, y; classes: instance, class. Classes without a second explained
    instance give no rows."""
    owners = rules.select("instance").distinct().join(classes, "instance").select(F.col("instance").alias("rule"), "class")
    others = owners.join(classes.withColumnRenamed("instance", "other"), "class").where("rule <> other").select("rule", F.col("other").alias("instance"))
    named = rules.withColumnRenamed("instance", "rule").join(others, "rule")
    inside = (F.col("value") >= F.col("lo")) & ((F.col("value") < F.col("hi")) if half_open else (F.col("value") <= F.col("hi")))
    judged = named.join(long, ["instance", "ft"]).withColumn("_in", F.coalesce(inside, F.lit(False)))
    each = judged.groupBy("rule", "instance", "idx", "y", "ft").agg(F.bool_or("_in").alias("_in"))
    pred = each.groupBy("rule", "instance", "idx", "y").agg(F.bool_and("_in").cast("int").alias("pred"))
    return accuracy(pred, ["rule", "instance"])


def ed1_accuracy(records: DataFrame, features: Sequence[str], explainer: Callable, test: float = 0.2, repetitions: int = 5, half_open: bool = False, seed: int = 0) -> DataFrame:
    """(instance, precision, recall, f1): rules found on a part of an instance's records, judged on the rest of them, averaged over
    the repetitions that gave a rule.

    records: instance, idx, y, features; explainer: from such a frame and features to (instance, ft, lo, hi). Normal and
    anomalous records are split apart, so both parts have their share of each."""
    parts = split.train_test(records, test, F.concat_ws("/", "instance", "idx"), repetitions, ["instance", "y"], seed)
    named = stored(parts.withColumn("instance", F.concat_ws("#", "instance", "repetition")))
    held = named.where("dataset = 'test'").select("instance", "idx", "y", *features)
    rules = explainer(named.where("dataset = 'train'").select("instance", "idx", "y", *features), features).select("instance", "ft", "lo", "hi")
    judged = classify(rules.withColumn("rule", F.col("instance")), sample(held, features, "instance"), half_open, ("instance", "idx"))
    known = judged.join(held.select("instance", "idx", "y"), ["instance", "idx"])
    each = accuracy(known, ["instance"]).withColumn("instance", F.regexp_extract("instance", "^(.*)#", 1))
    return each.groupBy("instance").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def explanation_row(metrics: DataFrame, values: Sequence[str], classes: Sequence[int], weight: str = "n") -> DataFrame:
    """One row: each value per class as <class>_<VALUE> and, weighed by the classes' numbers, as GLOBAL_<VALUE>. metrics: class, weight, values."""
    known = lambda v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double"))
    own = [F.max(F.when(F.col("class") == c, known(v))).alias(f"{c}_{v.upper()}") for c in classes for v in values]
    total = [F.try_divide(F.sum(known(v) * F.col(weight)), F.sum(F.when(known(v).isNotNull(), F.col(weight)))).alias(f"GLOBAL_{v.upper()}") for v in values]
    return metrics.agg(*total, *own)


def weighted_mean(metrics: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the mean of the classes' values by weight; classes without a value count for nothing, and without any it is null."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return metrics.agg(F.try_divide(F.sum(F.when(v.isNotNull(), v * F.col(weight))), F.sum(F.when(v.isNotNull(), F.col(weight)))).alias(value))
