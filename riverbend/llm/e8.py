"""The lattice E8: nearest points, and the cells around a point. Points are held doubled, as integers."""

from __future__ import annotations

import itertools

import numpy as np


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    odd = (near.sum(axis=-1) % 2) != 0
    worst = np.abs(off).argmax(axis=-1)
    rows = np.arange(len(x))
    turn = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows[odd], worst[odd]] += turn[odd]
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Doubled nearest lattice points (n, 8) of x (n, 8): the nearer of D8 and D8 + 1/2."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    better = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.rint(2 * np.where(better[:, None], b, a)).astype(np.int64)


def _minimal() -> np.ndarray:
    """The 240 shortest vectors, doubled: two entries of +-2, or all +-1 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


MINIMAL = _minimal()


def around(x: np.ndarray, point: np.ndarray, probes: int) -> np.ndarray:
    """The doubled lattice points next to point (n, probes, 8) whose cells lie nearest to x, nearest first."""
    return point[:, None, :] + MINIMAL[steps(x, point, probes)[0]]


def steps(x: np.ndarray, point: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Which steps of MINIMAL from point (n, 8) come nearest to x, nearest first, and how much nearer each is (n, probes)."""
    # |x - (p + v)|^2 grows with |v|^2 - 2 v.(x - p), and all v are as long
    gain = (x - point / 2) @ (MINIMAL.T / 2)
    best = np.argpartition(-gain, probes, axis=1)[:, :probes]
    near = np.take_along_axis(gain, best, axis=1)
    order = near.argsort(axis=1)[:, ::-1]
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(near, order, axis=1)
