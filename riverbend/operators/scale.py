"""Scaling of features: over training periods, per trace, by the head of a trace, or online; and chains of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, one_row, whole
from .windows import running

HEAD = 240
KINDS = ("std", "minmax", "robust")


def _stats(col: Column, kind: str, over=None) -> tuple[Column, Column]:
    """Offset and scale: mean and population deviation, minimum and span, or median and interquartile range."""
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    if kind == "std":
        return on(F.avg(col)), on(F.stddev_pop(col))
    if kind == "minmax":
        return on(F.min(col)), on(F.max(col)) - on(F.min(col))
    if kind == "robust":
        q = on(F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
        return q[1], q[2] - q[0]
    raise ValueError(f"scaler must be one of {KINDS}")


def _apply(col: Column, offset: Column, scale: Column) -> Column:
    """A scale of zero counts as one."""
    return (col - offset) / F.when(scale == 0, 1.0).otherwise(scale)


def scale_regular(df: DataFrame, features: Sequence[str], kind: str = "std", train: Column | None = None) -> DataFrame:
    """By statistics of all records for which train holds, applied to all: one aggregation and a broadcast row."""
    source = df.where(train) if train is not None else df
    made = {c: _stats(F.col(c).cast("double"), kind) for c in features}
    stats = source.agg(*[x.alias(f"_{n}_{c}") for c, pair in made.items() for n, x in zip("os", pair, strict=True)])
    out = one_row(df, stats).withColumns({c: _apply(F.col(c), F.col(f"_o_{c}"), F.col(f"_s_{c}")) for c in features})
    return out.drop(*stats.columns)


def _by_period(df: DataFrame, source: DataFrame, features: Sequence[str], kind: str, keys: Sequence[str]) -> DataFrame:
    """df by the statistics of its period in source. Percentiles are an aggregate, since a window would hold the trace once per record."""
    made = {c: _stats(F.col(c).cast("double"), kind) for c in features}
    stats = source.groupBy(*keys).agg(*[x.alias(f"_{n}_{c}") for c, pair in made.items() for n, x in zip("os", pair, strict=True)])
    out = df.join(stats, list(keys), "left").withColumns({c: _apply(F.col(c), F.col(f"_o_{c}"), F.col(f"_s_{c}")) for c in features})
    return out.select(*df.columns)


def scale_trace(df: DataFrame, features: Sequence[str], kind: str = "std", keys: Sequence[str] = KEYS) -> DataFrame:
    """By statistics of the whole trace."""
    if kind == "robust":
        return _by_period(df, df, features, kind, keys)
    return df.withColumns({c: _apply(F.col(c), *_stats(F.col(c), kind, whole(keys))) for c in features})


def _head(col: Column, kind: str, size: int, keys: Sequence[str]) -> tuple[Column, Column]:
    return _stats(F.when(F.col("idx") < size, col), kind, whole(keys))


def scale_head(df: DataFrame, features: Sequence[str], kind: str = "std", size: int = HEAD, keys: Sequence[str] = KEYS, regular_weight: float = 0.0, train: Column | None = None) -> DataFrame:
    """By statistics of the first `size` records of the trace.

    With regular_weight w, offset and scale are w times those of the training records and 1 - w times the head's, and
    training records themselves take the training statistics alone. The robust kind cannot be combined so."""
    if not regular_weight:
        if kind == "robust":
            return _by_period(df, df.where(F.col("idx") < size), features, kind, keys)
        return df.withColumns({c: _apply(F.col(c), *_head(F.col(c), kind, size, keys)) for c in features})
    if kind == "robust":
        raise ValueError("the robust scaler cannot be combined with training statistics")
    train = F.lit(True) if train is None else train
    made = {c: _stats(F.col(c).cast("double"), kind) for c in features}
    stats = df.where(train).agg(*[x.alias(f"_{n}_{c}") for c, pair in made.items() for n, x in zip("os", pair, strict=True)])
    out = one_row(df, stats)
    for c in features:
        offset, scale = _head(F.col(c), kind, size, keys)
        o, s = F.col(f"_o_{c}"), F.col(f"_s_{c}")
        mixed = _apply(F.col(c), regular_weight * o + (1 - regular_weight) * offset, regular_weight * s + (1 - regular_weight) * scale)
        out = out.withColumn(f"_new_{c}", F.when(train, _apply(F.col(c), o, s)).otherwise(mixed))
    return out.drop(*features).withColumnsRenamed({f"_new_{c}": c for c in features}).select(*df.columns)


def scale_head_online(df: DataFrame, features: Sequence[str], kind: str = "std", size: int = HEAD, keys: Sequence[str] = KEYS, rolling: bool = False) -> DataFrame:
    """The head by its own statistics; each later record by those of the records before it, all of them or the last `size`."""
    if kind == "robust":
        raise ValueError("the robust scaler has no online form")
    window = size if rolling else None
    out = {}
    for c in features:
        x = F.col(c)
        if kind == "std":
            offset, scale = running(x, "mean", window, keys), running(x, "std", window, keys)
        else:
            offset = running(x, "min", window, keys)
            scale = running(x, "max", window, keys) - offset
        out[c] = F.when(F.col("idx") < size, _apply(x, *_head(x, kind, size, keys))).otherwise(_apply(x, offset, scale))
    return df.withColumns(out)


def _moments(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (population) and count from one aggregation of sums and products."""
    xs = [F.col(c).cast("double") for c in features]
    n = len(xs)
    means = df.agg(F.count("*"), *[F.avg(x) for x in xs]).first()
    mean = np.array([m or 0.0 for m in means[1:]])
    centred = [x - float(m) for x, m in zip(xs, mean, strict=True)]
    products = df.agg(*[F.avg(centred[i] * centred[j]) for i in range(n) for j in range(i, n)]).first()
    cov = np.zeros((n, n))
    cov[np.triu_indices(n)] = [p or 0.0 for p in products]
    return mean, cov + np.triu(cov, 1).T, means[0]


def _project(df: DataFrame, features: Sequence[str], mean: np.ndarray, axes: np.ndarray, prefix: str) -> DataFrame:
    """df with a column per axis instead of the features, as JVM-side expressions."""
    terms = lambda w: reduce(lambda a, b: a + b, [(F.col(c) - float(m)) * float(v) for c, m, v in zip(features, mean, w, strict=True)])
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, *[terms(w).alias(f"{prefix}{i}") for i, w in enumerate(axes)])


def pca(df: DataFrame, features: Sequence[str], components: float, train: Column | None = None) -> tuple[DataFrame, np.ndarray]:
    """Projection on the leading principal axes of the training records, by number or by share of variance; and the shares.

    Each axis is signed so that its largest weight is positive."""
    mean, cov, _ = _moments(df.where(train) if train is not None else df, features)
    values, vectors = np.linalg.eigh(cov)
    values, axes = values[::-1], vectors.T[::-1]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    shares = values / values.sum() if values.sum() else values
    k = int(components) if components >= 1 else int(np.searchsorted(np.cumsum(shares), components) + 1)
    return _project(df, features, mean, axes[:k], "pc"), shares


def kernel_pca(df: DataFrame, features: Sequence[str], components: int, sample: int = 512, gamma: float | None = None, seed: int = 0, train: Column | None = None) -> DataFrame:
    """Projection by a Gaussian kernel on the principal axes of all training records.

    The kernel is that of `sample` random frequencies, a cosine and a sine each (error about 1 / sqrt(sample) of a kernel value).
    Centre and axes come from one aggregation of their sums and products; records with missing values have none in it."""
    rest = [c for c in df.columns if c not in features]
    gamma = gamma or 1.0 / max(1, len(features))
    waves = np.random.default_rng(seed).normal(size=(len(features), sample)) * np.sqrt(2 * gamma)

    def mapped(pdf):
        x = pdf[list(features)].to_numpy(float) @ waves
        return np.hstack([np.cos(x), np.sin(x)]) / np.sqrt(sample)

    def moments(batches):
        n, total, products = 0, np.zeros(2 * sample), np.zeros((2 * sample, 2 * sample))
        for pdf in batches:
            z = mapped(pdf)
            z = z[np.isfinite(z).all(1)]
            n, total, products = n + len(z), total + z.sum(0), products + z.T @ z
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tobytes()], "products": [products.tobytes()]})

    def added(batches):
        n, total, products = 0, np.zeros(2 * sample), np.zeros(4 * sample * sample)
        for pdf in batches:
            n += int(pdf.n.sum())
            for a, b in zip(pdf.total, pdf.products, strict=True):
                total, products = total + np.frombuffer(a), products + np.frombuffer(b)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tobytes()], "products": [products.tobytes()]})

    kind = "n long, total binary, products binary"
    source = (df.where(train) if train is not None else df).select(*[F.col(c).cast("double").alias(c) for c in features])
    row = source.mapInPandas(moments, kind).repartition(8).mapInPandas(added, kind).coalesce(1).mapInPandas(added, kind).first()
    mean, axes = np.zeros(2 * sample), np.zeros((2 * sample, components))
    if row:
        mean = np.frombuffer(row.total) / row.n
        values, vectors = np.linalg.eigh(np.frombuffer(row.products).reshape(2 * sample, -1) / row.n - np.outer(mean, mean))
        axes = vectors[:, ::-1][:, :components]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    names = [f"kpc{i}" for i in range(components)]

    def work(batches):
        for pdf in batches:
            z = (mapped(pdf) - mean) @ axes
            out = pdf[rest].copy()
            for i, n in enumerate(names):
                out[n] = z[:, i]
            yield out

    kinds = dict(df.dtypes)
    return df.mapInPandas(work, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"{n} double" for n in names]))


def factor_analysis(df: DataFrame, features: Sequence[str], components: int, rounds: int = 200, train: Column | None = None) -> DataFrame:
    """Posterior means of the factors, fitted by expectation maximisation to the covariance, which is one aggregation."""
    mean, cov, _ = _moments(df.where(train) if train is not None else df, features)
    noise = np.maximum(np.diag(cov).copy(), 1e-12)
    values, vectors = np.linalg.eigh(cov)
    load = vectors[:, ::-1][:, :components] * np.sqrt(np.maximum(values[::-1][:components], 1e-12))
    for _ in range(rounds):
        inner = np.linalg.inv(np.eye(components) + (load / noise[:, None]).T @ load)
        beta = inner @ (load / noise[:, None]).T
        second = inner + beta @ cov @ beta.T
        load = cov @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(cov - load @ beta @ cov), 1e-12)
    inner = np.linalg.inv(np.eye(components) + (load / noise[:, None]).T @ load)
    axes = inner @ (load / noise[:, None]).T
    axes = axes * np.sign(axes[np.arange(components), np.abs(axes).argmax(axis=1)])[:, None]
    return _project(df, features, mean, axes, "fa")


#: Step of a chain to function (df, features, params) -> (df, features).
STEPS: dict[str, Callable] = {
    "regular_scaling": lambda df, f, p: (scale_regular(df, f, p.get("kind", "std"), p.get("train")), f),
    "trace_scaling": lambda df, f, p: (scale_trace(df, f, p.get("kind", "std"), p.get("keys", KEYS)), f),
    "head_scaling": lambda df, f, p: (scale_head(df, f, p.get("kind", "std"), p.get("head", HEAD), p.get("keys", KEYS), p.get("regular_weight", 0.0), p.get("train")), f),
    "head_online_scaling": lambda df, f, p: (scale_head_online(df, f, p.get("kind", "std"), p.get("head", HEAD), p.get("keys", KEYS), p.get("rolling", False)), f),
    "pca": lambda df, f, p: (lambda out: (out, [c for c in out.columns if c.startswith("pc")]))(pca(df, f, p.get("components", 13), p.get("train"))[0]),
    "fa": lambda df, f, p: (lambda out: (out, [c for c in out.columns if c.startswith("fa")]))(factor_analysis(df, f, p.get("components", 13), train=p.get("train"))),
}


def transform(df: DataFrame, features: Sequence[str], chain: str = "trace_scaling", **params) -> tuple[DataFrame, list[str]]:
    """The steps of a chain such as trace_scaling.pca, each fitted on what the one before made."""
    for step in chain.split("."):
        df, features = STEPS[step](df, list(features), params)
    return df, list(features)
