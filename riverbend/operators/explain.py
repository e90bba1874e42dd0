"""Explanation discovery: value segments and entropy rewards, histogram items and risk ratios, and rules built from them.

Samples are long tables: (instance, ft, value, y) with y 0 for normal and 1 for anomalous records; unpivot a wide frame with
sample(). Explanations are rows (instance, ft, lo, hi): a record is anomalous where each ft has one of its ranges hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import START
from .windows import fifths

INF = float("inf")
FALSE_POSITIVE_STD = 1.64
BINS, SUPPORT, RISK = 10, 0.4, 1.5
CLASSES = ("normal", "anomalous", "mixed")


def sample(df: DataFrame, features: Sequence[str], instance: str, y: str = "y", extra: Sequence[str] = ("idx",)) -> DataFrame:
    """(instance, extra, ft, value, y) with ft the number of a feature."""
    values = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(instance).alias("instance"), *extra, F.col(y).alias("y"), F.posexplode(values).alias("ft", "value"))


# ---------------------------------------------------------------- entropy rewards


def segments(long: DataFrame) -> DataFrame:
    """(instance, ft, seg, kind, lo, hi, n): maximal runs, in order of value, of values that occur in normal records only, in anomalous
    only, or in both. n counts records; the lowest and the highest record's value is opened to infinity.

    Values are counted first, so the runs are over distinct values."""
    by = Window.partitionBy("instance", "ft").orderBy("value")
    kind = F.when(F.col("n1") == 0, "normal").when(F.col("n0") == 0, "anomalous").otherwise("mixed")
    values = long.groupBy("instance", "ft", "value").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    values = values.withColumn("kind", kind).withColumn("n", F.col("n0") + F.col("n1"))
    change = F.when(F.col("kind") == F.lag("kind").over(by), 0).otherwise(1)
    runs = values.withColumn("_c", change).withColumn("seg", F.sum("_c").over(by.rowsBetween(START, 0)))
    runs = runs.withColumn("_first", F.row_number().over(by) == 1).withColumn("_last", F.lead("value").over(by).isNull())
    # a single record at either end becomes infinite itself
    low = F.when(F.col("_first"), -INF).when(F.col("_last") & (F.col("n") == 1), INF).otherwise(F.col("value"))
    high = F.when(F.col("_last"), INF).when(F.col("_first") & (F.col("n") == 1), -INF).otherwise(F.col("value"))
    out = runs.withColumn("_lo", low).withColumn("_hi", high).groupBy("instance", "ft", "seg", "kind")
    return out.agg(F.min_by("_lo", "value").alias("lo"), F.max_by("_hi", "value").alias("hi"), F.sum("n").alias("n"))


def rewards(segs: DataFrame, counts: DataFrame) -> DataFrame:
    """(instance, ft, reward): class entropy over segmentation entropy with the entropy of mixed segments added; 0 where all is mixed.

    counts: instance, n0, n1, the records of either class."""
    joined = segs.join(counts, "instance").withColumn("_p", F.col("n") / (F.col("n0") + F.col("n1")))
    regular = F.sum(-F.col("_p") * F.ln("_p")) + F.sum(F.when(F.col("kind") == "mixed", F.ln("n")).otherwise(0.0))
    p = lambda c: F.max(F.col(c) / (F.col("n0") + F.col("n1")))
    term = lambda q: F.when(q > 0, -q * F.ln(q)).otherwise(0.0)
    out = joined.groupBy("instance", "ft").agg(regular.alias("_r"), p("n0").alias("_p0"), p("n1").alias("_p1"), F.sum(F.when(F.col("kind") == "mixed", 0).otherwise(1)).alias("_pure"))
    return out.select("instance", "ft", F.when(F.col("_pure") == 0, 0.0).otherwise(F.try_divide(term(F.col("_p0")) + term(F.col("_p1")), F.col("_r"))).alias("reward"))


def class_counts(records: DataFrame) -> DataFrame:
    """(instance, n0, n1) from one row per record."""
    return records.groupBy("instance").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))


def false_positives(wide: DataFrame, features: Sequence[str], scaled_std: float = FALSE_POSITIVE_STD) -> DataFrame:
    """(instance, ft): features of normal records (instance, idx dense in the instance, features) whose deviation stands out
    among the features, or that rise or fall throughout."""
    long = wide.select("instance", F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("ft", "value"))
    stds = long.groupBy("instance", "ft").agg(F.stddev_pop("value").alias("s"))
    over = Window.partitionBy("instance")
    spread = F.stddev_pop("s").over(over)
    z = (F.col("s") - F.avg("s").over(over)) / F.when(spread == 0, 1.0).otherwise(spread)
    wild = stds.withColumn("z", z).where(F.col("z") >= scaled_std).select("instance", "ft")
    steady = fifths(wide, features, ["instance"]).where("monotone").select("instance", "ft")
    return wild.union(steady).distinct()


def reward_leap(scored: DataFrame) -> DataFrame:
    """scored (instance, ft, reward) with the rewards below the sharpest drop set to 0; the first of equal drops counts."""
    by = Window.partitionBy("instance").orderBy(F.desc("reward"), "ft")
    drop = scored.withColumn("_r", F.row_number().over(by)).withColumn("_d", F.col("reward") - F.lead("reward").over(by))
    level = drop.where("_d IS NOT NULL").groupBy("instance").agg(F.max_by("reward", F.struct("_d", -F.col("_r"))).alias("_level"))
    out = scored.join(level, "instance", "left")
    return out.select("instance", "ft", F.when(F.col("reward") < F.col("_level"), 0.0).otherwise(F.col("reward")).alias("reward"))


def correlations(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """(instance, ft1, ft2, corr) for ft1 < ft2, one aggregation; constants correlate with nothing."""
    n = len(features)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    made = wide.groupBy("instance").agg(*[F.corr(features[i], features[j]).alias(f"_{i}_{j}") for i, j in pairs])
    each = F.array(*[F.struct(F.lit(i).alias("ft1"), F.lit(j).alias("ft2"), F.coalesce(F.nanvl(f"_{i}_{j}", F.lit(0.0)), F.lit(0.0)).alias("corr")) for i, j in pairs])
    return made.select("instance", F.explode(each).alias("p")).select("instance", "p.*")


def complete_linkage(distance: np.ndarray, limit: float) -> np.ndarray:
    """Cluster number of each item: the closest clusters are joined while their farthest members are within limit; the first of equals first."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        best = min((max(distance[a, b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if best[0] > limit:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(distance), int)
    for k, g in enumerate(groups, 1):
        out[g] = k
    return out


def clusters(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """(instance, ft, cluster): complete linkage on 1 - |correlation|, cut at half the largest distance. Python sees a matrix per instance."""
    n = len(features)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros((n, n))
        d[pdf.ft1, pdf.ft2] = d[pdf.ft2, pdf.ft1] = np.maximum(0, 1 - pdf["corr"].abs())
        return pd.DataFrame({"instance": pdf.instance.iloc[0], "ft": range(n), "cluster": complete_linkage(d, d.max() / 2)})

    found = correlations(wide, features)
    kind = dict(found.dtypes)["instance"]
    return found.groupBy("instance").applyInPandas(work, f"instance {kind}, ft int, cluster int")


def exstream(wide: DataFrame, features: Sequence[str], scaled_std: float = FALSE_POSITIVE_STD) -> DataFrame:
    """(instance, ft, reward, lo, hi): the important features of each instance with their anomalous ranges, both ends included.

    wide: instance, idx, y and the features; normal records of an instance are numbered by idx in order."""
    segs = segments(sample(wide, features, "instance"))
    scored = rewards(segs, class_counts(wide))
    order = Window.partitionBy("instance").orderBy("idx")
    normal = wide.where("y = 0").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    doubtful = false_positives(normal, features, scaled_std).withColumn("_fp", F.lit(True))
    scored = scored.join(doubtful, ["instance", "ft"], "left").select("instance", "ft", F.when(F.col("_fp"), 0.0).otherwise(F.col("reward")).alias("reward"))
    scored = reward_leap(scored).join(clusters(wide, features), ["instance", "ft"])
    rank = F.row_number().over(Window.partitionBy("instance", "cluster").orderBy(F.desc("reward"), "ft"))
    kept = scored.withColumn("_r", rank).where("_r = 1 AND reward <> 0").select("instance", "ft", "reward")
    usable = segs.where("kind <> 'normal' AND lo <> hi").select("instance", "ft", "lo", "hi")
    return kept.join(usable, ["instance", "ft"], "left")


# ---------------------------------------------------------------- histogram items


def binned(long: DataFrame, bins: int = BINS) -> DataFrame:
    """long with bin: equal widths between the extremes of the normal records, the outer bins open."""
    lim = long.where("y = 0").groupBy("instance", "ft").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    out = long.join(lim, ["instance", "ft"]).withColumn("lo", lo).withColumn("hi", hi)
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return out.withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")).drop("_lo", "_hi")


def risk_ratio(hits1, hits0, n1, n0):
    """Share of anomalous among the records with an item over that among the records without; counts of 0 below become 1."""
    a, b = hits1 + hits0, n1 + n0 - hits1 - hits0
    out1 = n1 - hits1
    one = lambda c: F.when(c == 0, 1).otherwise(c)
    return (hits1 / one(a)) / (one(out1) / one(b))


def items(long: DataFrame, counts: DataFrame, bins: int = BINS, risk: float = RISK) -> DataFrame:
    """(instance, ft, bin, lo, hi, a1, a0, ratio): bins with as many anomalous records as an even histogram has and enough risk."""
    held = binned(long, bins).groupBy("instance", "ft", "bin").agg(F.sum("y").alias("a1"), F.sum(1 - F.col("y")).alias("a0"), F.max("lo").alias("_lo"), F.max("hi").alias("_hi"))
    out = held.join(counts, "instance").withColumn("ratio", risk_ratio(F.col("a1"), F.col("a0"), F.col("n1"), F.col("n0")))
    out = out.where((F.col("a1") >= F.greatest(F.floor(F.col("n1") / bins), F.lit(1))) & (F.col("ratio") >= risk))
    width = (F.col("_hi") - F.col("_lo")) / bins
    lo = F.when(F.col("bin") == 0, -INF).otherwise(F.col("_lo") + F.col("bin") * width)
    hi = F.when(F.col("bin") == bins - 1, INF).otherwise(F.col("_lo") + (F.col("bin") + 1) * width)
    return out.select("instance", "ft", "bin", lo.alias("lo"), hi.alias("hi"), "a1", "a0", "ratio")


def baskets(long: DataFrame, kept: DataFrame, bins: int = BINS) -> DataFrame:
    """(instance, y, basket, n): how many records of either class have which kept items. Records without any are left out."""
    names = kept.select("instance", "ft", "bin", F.concat_ws("_", "ft", "bin").alias("item"))
    hit = binned(long, bins).join(names, ["instance", "ft", "bin"])
    return hit.groupBy("instance", "idx", "y").agg(F.array_sort(F.collect_list("item")).alias("basket")).groupBy("instance", "y", "basket").agg(F.count("*").alias("n"))


def itemsets(held: DataFrame, counts: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(instance, items, size, support, ratio): sets of items with enough support among anomalous records, with their risk ratio.

    Python grows the sets of an instance level by level on its distinct baskets, whose number the items bound."""
    kind = dict(held.dtypes)["instance"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(set(b), int(y), int(n)) for b, y, n in zip(pdf.basket, pdf.y, pdf.n, strict=True)]
        n1, n0 = int(pdf.n1.iloc[0]), int(pdf.n0.iloc[0])
        level = [(i,) for i in sorted({x for b, _, _ in rows for x in b})]
        out = []
        while level:
            kept = []
            for s in level:
                a1 = sum(n for b, y, n in rows if y and b.issuperset(s))
                if n1 and a1 / n1 >= support:
                    a0 = sum(n for b, y, n in rows if not y and b.issuperset(s))
                    a, b_ = a1 + a0 or 1, n1 + n0 - a1 - a0 or 1
                    out.append((pdf.instance.iloc[0], list(s), len(s), a1 / n1, (a1 / a) / ((n1 - a1 or 1) / b_)))
                    kept.append(s)
            known = set(kept)
            level = sorted({(*s, t[-1]) for s in kept for t in kept if s[:-1] == t[:-1] and s[-1] < t[-1] and all((*s, t[-1])[:i] + (*s, t[-1])[i + 1 :] in known for i in range(len(s) + 1))})
        return pd.DataFrame(out, columns=["instance", "items", "size", "support", "ratio"])

    return held.join(counts, "instance").groupBy("instance").applyInPandas(work, f"instance {kind}, items array<string>, size int, support double, ratio double")


def macrobase(wide: DataFrame, features: Sequence[str], bins: int = BINS, support: float = SUPPORT, risk: float = RISK) -> DataFrame:
    """(instance, ft, ratio, lo, hi): the set of items with the largest risk ratio, then support, then size, then by its text; lo included, hi excluded."""
    long, counts = sample(wide, features, "instance"), class_counts(wide)
    kept = items(long, counts, bins, risk)
    sets = itemsets(baskets(long, kept, bins), counts, support)
    order = Window.partitionBy("instance").orderBy(F.desc("ratio"), F.desc("support"), F.desc("size"), F.concat_ws(",", "items"))
    top = sets.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("instance", F.explode("items").alias("item"), F.col("ratio").alias("_ratio"))
    return top.join(kept.withColumn("item", F.concat_ws("_", "ft", "bin")), ["instance", "item"]).select("instance", "ft", F.col("_ratio").alias("ratio"), "lo", "hi")


# ---------------------------------------------------------------- rules


def classify(rules: DataFrame, long: DataFrame, half_open: bool = False, keys: Sequence[str] = ("instance", "idx")) -> DataFrame:
    """(rule, keys, pred): 1 where every feature of the rule has a range that holds the record's value.

    rules: rule, ft, lo, hi and, to name the records to judge, instance; long: instance, idx, ft, value."""
    inside = (F.col("value") >= F.col("lo")) & ((F.col("value") < F.col("hi")) if half_open else (F.col("value") <= F.col("hi")))
    judged = rules.join(long, ["instance", "ft"]).withColumn("_in", F.coalesce(inside, F.lit(False)))
    each = judged.groupBy("rule", *keys, "ft").agg(F.bool_or("_in").alias("_in"))
    return each.groupBy("rule", *keys).agg(F.bool_and("_in").cast("int").alias("pred"))


def lime(wide: DataFrame, features: Sequence[str], score, records: DataFrame, n_features: int = 5, samples: int = 500, seed: int = 0) -> DataFrame:
    """(instance, idx, ft, weight): per record the features whose deciles matter most to a score near it.

    score: a function of a numpy matrix to scores. Perturbed records are drawn from the deciles of wide; a ridge weighs whether each
    feature stayed in the record's decile, nearer ones more. Each record is explained by itself, in Python batches, with draws
    that depend on its instance, idx and the seed alone."""
    cuts = wide.agg(*[F.percentile(c, F.array(*[F.lit(q / 10) for q in range(11)])).alias(c) for c in features]).first()
    edges = np.array([cuts[c] for c in features], float)
    kind = dict(records.dtypes)["instance"]

    def work(batches):
        for pdf in batches:
            rows = []
            for instance, idx, x in zip(pdf.instance, pdf.idx, pdf[list(features)].to_numpy(float), strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(f"{instance}/{idx}".encode())])
                own = np.array([min(9, max(0, np.searchsorted(e[1:-1], v, side="right"))) for e, v in zip(edges, x, strict=True)])
                bins = rng.integers(0, 10, (samples, len(x)))
                same = bins == own
                low = np.take_along_axis(edges, bins.T, 1).T
                high = np.take_along_axis(edges, bins.T + 1, 1).T
                data = np.where(same, x, low + rng.random(bins.shape) * (high - low))
                z = np.hstack([np.ones((samples, 1)), same])
                w = np.sqrt(np.exp(-(~same).sum(1) / (0.75**2 * len(x))))  # the squared distance of 0-1 vectors is their number of differences
                beta = np.linalg.solve((z * w[:, None]).T @ z + np.eye(z.shape[1]), (z * w[:, None]).T @ score(data))[1:]
                rows += [(instance, idx, int(f), float(beta[f])) for f in np.argsort(-np.abs(beta), kind="stable")[:n_features]]
            yield pd.DataFrame(rows, columns=["instance", "idx", "ft", "weight"])

    return records.mapInPandas(work, f"instance {kind}, idx long, ft int, weight double")


def lime_windows(windows: DataFrame, features: Sequence[str], score: Callable, size: int, n_features: int = 5, samples: int = 500, seed: int = 0) -> DataFrame:
    """(instance, idx, ft, weight): lime() on windows of `size` records (instance, w_start, window, y), for those with y = 1.

    score: of a model on windows, such as nets' score_windows. Every position of a feature is an input of its own; ft is the
    feature and idx the window's start, so a feature can come up to n_features times."""
    d = len(features)
    names = [f"_p{t}_{i}" for t in range(size) for i in range(d)]
    cells = [F.col("window")[t][i].alias(f"_p{t}_{i}") for t in range(size) for i in range(d)]
    flat = windows.select("instance", F.col("w_start").cast("long").alias("idx"), "y", *cells)
    found = lime(flat, names, lambda x: score(x.reshape(len(x), size, d)), flat.where("y = 1").drop("y"), n_features, samples, seed)
    return found.withColumn("ft", (F.col("ft") % d).cast("int"))


def union_of(explanations: DataFrame) -> DataFrame:
    """(instance, fts): features that explain any record of an instance."""
    return explanations.groupBy("instance").agg(F.array_sort(F.collect_set("ft")).alias("fts"))


EXPLAINERS = {"exstream": exstream, "macrobase": macrobase, "lime": lime}
