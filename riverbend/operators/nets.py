"""Small neural models in numpy on windows of records, trained on all windows.

Training is by full gradients: in each round every task sends the sum of its windows' gradients, one vector of the model's
size, and the driver takes a step of Adam. Nothing is sampled and no window reaches the driver. Random numbers come from the
seed and from hashes of the windows' keys, so partitioning changes a model by rounding alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS
from ..functions.store import stored
from .windows import sliding_windows, window_to_record


def _unflat(flat: np.ndarray, shapes: Sequence[tuple]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def _flat(parts: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def _start(shapes: Sequence[tuple], rng: np.random.Generator) -> np.ndarray:
    return _flat([rng.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(s) for s in shapes])


def _dense_shapes(sizes: Sequence[int]) -> list[tuple]:
    return [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]


def _dense(ps: Sequence[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Activations of a net of dense layers, x first: tanh inside, linear at the end."""
    held = [x]
    for i in range(0, len(ps), 2):
        x = x @ ps[i] + ps[i + 1]
        held.append(np.tanh(x) if i + 2 < len(ps) else x)
        x = held[-1]
    return held


def _dense_back(ps: Sequence[np.ndarray], held: Sequence[np.ndarray], d: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the parameters and of the input, from that of the output."""
    grads: list[np.ndarray] = []
    for i in range(len(ps) - 2, -1, -2):
        x = held[i // 2]
        grads = [x.T @ d, d.sum(0), *grads]
        d = d @ ps[i].T
        if i:
            d = d * (1 - x**2)
    return grads, d


def _windows(pdf: pd.DataFrame, size: int, width: int) -> np.ndarray:
    return np.stack([np.stack(w) for w in pdf.window]).reshape(len(pdf), size, width) if len(pdf) else np.zeros((0, size, width))


_SUMS = "n long, loss double, grads binary"


def gradient_sums(windows: DataFrame, gradient: Callable, size: int, width: int) -> tuple[int, float, np.ndarray]:
    """Number of windows, and the sums of loss and gradient over all of them; gradient(x, keys) gives those of a batch."""

    def work(batches):
        n, loss, grads = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                value, g = gradient(_windows(pdf, size, width), pdf["_key"].to_numpy(np.int64))
                n, loss, grads = n + len(pdf), loss + value, grads + g
        if n:
            yield pd.DataFrame({"n": [n], "loss": [loss], "grads": [grads.tobytes()]})

    def added(batches):
        n, loss, grads = 0, 0.0, 0.0
        for pdf in batches:
            for m, value, g in zip(pdf.n, pdf.loss, pdf.grads, strict=True):
                n, loss, grads = n + int(m), loss + value, grads + np.frombuffer(g)
        if n:
            yield pd.DataFrame({"n": [n], "loss": [loss], "grads": [grads.tobytes()]})

    row = windows.mapInPandas(work, _SUMS).repartition(1).mapInPandas(added, _SUMS).first()  # one vector a task
    return (row.n, row.loss, np.frombuffer(row.grads)) if row else (0, 0.0, np.zeros(0))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, 0.0, 0.0

    def step(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        return params - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class _WindowNet:
    """What the models share: windows of `size` records, the rounds of training, scores of windows and of records."""

    def __init__(self, features: Sequence[str], size: int, rounds: int, rate: float, seed: int, keys: Sequence[str]):
        self.features, self.size, self.rounds, self.rate, self.seed, self.keys = list(features), size, rounds, rate, seed, list(keys)
        self.params: np.ndarray | None = None
        self.losses: list[float] = []  # mean loss of each round

    def windows(self, records: DataFrame) -> DataFrame:
        return sliding_windows(records, self.features, self.size, keys=self.keys).withColumn("_key", F.xxhash64(*self.keys, "w_start"))

    def _train(self, records: DataFrame, gradient: Callable) -> None:
        held, width, adam = stored(self.windows(records)), len(self.features), Adam(self.rate)
        for number in range(self.rounds):
            params = self.params
            n, loss, grad = gradient_sums(held, lambda x, k, p=params, i=number: gradient(p, x, k, i), self.size, width)
            if not n:
                return
            self.losses.append(loss / n)
            self.params = adam.step(params, grad / n)

    def score_windows(self, x: np.ndarray) -> np.ndarray:
        """Scores of windows (n, size, features): what scorers and explainers call."""
        raise NotImplementedError

    def window_scores(self, records: DataFrame) -> DataFrame:
        """(keys, w_start, score)."""
        size, width, keys, scorer = self.size, len(self.features), self.keys, self.score_windows
        source = sliding_windows(records, self.features, size, keys=keys)

        def work(batches):
            for pdf in batches:
                yield pdf[[*keys, "w_start"]].assign(score=scorer(_windows(pdf, size, width)))

        kinds = ", ".join(f"`{n}` {t}" for n, t in source.dtypes if n != "window")
        return source.mapInPandas(work, f"{kinds}, score double")

    def scores(self, records: DataFrame, strict: bool = False) -> DataFrame:
        """(keys, idx, score): averages over the windows that hold a record."""
        return window_to_record(self.window_scores(records), self.size, "score", self.keys, strict)


class DenseAutoencoder(_WindowNet):
    """A window from a code of a few numbers: dense tanh layers down to the code, and the same sizes back."""

    def __init__(self, features: Sequence[str], size: int = 10, hidden: Sequence[int] = (16,), code: int = 4, rounds: int = 60, rate: float = 0.01, seed: int = 0, keys: Sequence[str] = KEYS):
        super().__init__(features, size, rounds, rate, seed, keys)
        d = size * len(self.features)
        self.shapes = _dense_shapes([d, *hidden, code, *reversed(hidden), d])

    def gradient(self, params, x, key=None, number=0) -> tuple[float, np.ndarray]:
        x, ps = x.reshape(len(x), -1), _unflat(params, self.shapes)
        held = _dense(ps, x)
        error = held[-1] - x
        return float((error**2).mean(1).sum()), _flat(_dense_back(ps, held, 2 * error / x.shape[1])[0])

    def fit(self, train: DataFrame) -> DenseAutoencoder:
        self.params = _start(self.shapes, np.random.default_rng(self.seed))
        self._train(train, self.gradient)
        return self

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        return _dense(_unflat(self.params, self.shapes), x.reshape(len(x), -1))[-1].reshape(x.shape)

    def score_windows(self, x: np.ndarray) -> np.ndarray:
        return ((self.rebuild(x) - x) ** 2).mean((1, 2))


class RecurrentForecaster(_WindowNet):
    """The next record from the n_back before it: a recurrent tanh layer, and a dense one on its last state."""

    def __init__(self, features: Sequence[str], n_back: int = 5, units: int = 16, rounds: int = 60, rate: float = 0.01, seed: int = 0, keys: Sequence[str] = KEYS):
        super().__init__(features, n_back + 1, rounds, rate, seed, keys)
        d = len(self.features)
        self.n_back, self.shapes = n_back, [(d, units), (units, units), (units,), (units, d), (d,)]

    def _states(self, ps: Sequence[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        held = [np.zeros((len(x), len(ps[2])))]
        for t in range(self.n_back):
            held.append(np.tanh(x[:, t] @ ps[0] + held[-1] @ ps[1] + ps[2]))
        return held

    def gradient(self, params, x, key=None, number=0) -> tuple[float, np.ndarray]:
        ps = _unflat(params, self.shapes)
        held = self._states(ps, x)
        error = held[-1] @ ps[3] + ps[4] - x[:, -1]
        d = 2 * error / x.shape[2]
        grads = [np.zeros(s) for s in self.shapes[:3]] + [held[-1].T @ d, d.sum(0)]
        d = d @ ps[3].T
        for t in range(self.n_back - 1, -1, -1):
            d = d * (1 - held[t + 1] ** 2)
            grads[0] += x[:, t].T @ d
            grads[1] += held[t].T @ d
            grads[2] += d.sum(0)
            d = d @ ps[1].T
        return float((error**2).mean(1).sum()), _flat(grads)

    def fit(self, train: DataFrame) -> RecurrentForecaster:
        self.params = _start(self.shapes, np.random.default_rng(self.seed))
        self._train(train, self.gradient)
        return self

    def forecast(self, x: np.ndarray) -> np.ndarray:
        """Forecasts from windows whose first n_back records are known."""
        ps = _unflat(self.params, self.shapes)
        return self._states(ps, x)[-1] @ ps[3] + ps[4]

    def score_windows(self, x: np.ndarray) -> np.ndarray:
        """Norm of the error on the last record over the norm of all last records scored together."""
        total = np.sqrt((x[:, -1] ** 2).sum())
        return np.sqrt(((self.forecast(x) - x[:, -1]) ** 2).sum(1)) / (total or 1.0)

    def predict(self, records: DataFrame) -> DataFrame:
        size, width, keys, n_back, names = self.size, len(self.features), self.keys, self.n_back, [f"y_{c}" for c in self.features]
        source, forecast = sliding_windows(records, self.features, size, keys=keys), self.forecast

        def work(batches):
            for pdf in batches:
                made = forecast(_windows(pdf, size, width))
                yield pdf[keys].assign(idx=pdf.w_start + n_back, **{n: made[:, i] for i, n in enumerate(names)})

        kinds = ", ".join(f"`{n}` {t}" for n, t in source.dtypes if n in keys)
        made = source.mapInPandas(work, f"{kinds}, idx long, " + ", ".join(f"`{n}` double" for n in names))
        return records.join(made, [*keys, "idx"], "left")


def normals(key: np.ndarray, width: int, number: int) -> np.ndarray:
    """(len(key), width) normal numbers from 64-bit keys and the round's number."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64)[:, None] + np.arange(1, 2 * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.sqrt(-2 * np.log(1 - u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGAN(_WindowNet):
    """An encoder and a generator trained against a discriminator of pairs (window, code).

    The discriminator is to give 1 for a window with its code and 0 for a window made from a random code. A window's score
    joins its reconstruction error with the discriminator's: by its loss (mse.dis) or by its features (mse.ft), weighed by alpha."""

    def __init__(self, features: Sequence[str], size: int = 10, hidden: int = 16, code: int = 4, rounds: int = 80, rate: float = 0.005, alpha: float = 0.5, kind: str = "mse.ft", seed: int = 0, keys: Sequence[str] = KEYS):
        super().__init__(features, size, rounds, rate, seed, keys)
        if kind not in ("mse", "mse.dis", "mse.ft"):
            raise ValueError("kind must be mse, mse.dis or mse.ft")
        d = size * len(self.features)
        self.code, self.alpha, self.kind = code, alpha, kind
        self.nets = [_dense_shapes(s) for s in ([d, hidden, code], [code, hidden, d], [d + code, hidden, 1])]
        self.shapes = [s for net in self.nets for s in net]

    def _parts(self, params: np.ndarray) -> list[list[np.ndarray]]:
        ps = _unflat(params, self.shapes)
        a, b = len(self.nets[0]), len(self.nets[0]) + len(self.nets[1])
        return [ps[:a], ps[a:b], ps[b:]]

    def gradient(self, params, x, key, number=0) -> tuple[float, np.ndarray]:
        """The discriminator's loss, its gradient, and that of the other two on the opposite labels."""
        x = x.reshape(len(x), -1)
        enc, gen, dis = self._parts(params)
        z = normals(key, self.code, number)
        he, hg = _dense(enc, x), _dense(gen, z)
        real, made = _dense(dis, np.hstack([x, he[-1]])), _dense(dis, np.hstack([hg[-1], z]))
        p, q = _sigmoid(real[-1]), _sigmoid(made[-1])
        loss = float(-(np.log(p + 1e-12) + np.log(1 - q + 1e-12)).sum())
        gd = [a + b for a, b in zip(_dense_back(dis, real, p - 1)[0], _dense_back(dis, made, q)[0], strict=True)]
        d = x.shape[1]
        ge = _dense_back(enc, he, _dense_back(dis, real, p)[1][:, d:])[0]
        gg = _dense_back(gen, hg, _dense_back(dis, made, q - 1)[1][:, :d])[0]
        return loss, _flat([*ge, *gg, *gd])

    def fit(self, train: DataFrame) -> BiGAN:
        self.params = _start(self.shapes, np.random.default_rng(self.seed))
        self._train(train, self.gradient)
        return self

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        enc, gen, _ = self._parts(self.params)
        return _dense(gen, _dense(enc, x.reshape(len(x), -1))[-1])[-1].reshape(x.shape)

    def score_windows(self, x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1)
        enc, gen, dis = self._parts(self.params)
        code = _dense(enc, flat)[-1]
        made = _dense(gen, code)[-1]
        mse = ((made - flat) ** 2).mean(1)
        if self.kind == "mse":
            return mse
        real = _dense(dis, np.hstack([flat, code]))
        if self.kind == "mse.dis":
            other = -np.log(_sigmoid(real[-1][:, 0]) + 1e-12)
        else:
            other = np.abs(real[-2] - _dense(dis, np.hstack([made, code]))[-2]).sum(1)
        return self.alpha * mse + (1 - self.alpha) * other
