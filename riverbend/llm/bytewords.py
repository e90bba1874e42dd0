"""Words of whole Arrow batches in numpy: where they are and 64-bit hashes of them, without a Python loop over words.

A word is a run of bytes other than space and U+0009 to U+000D. In hashes A-Z count as a-z. The hash of bytes
b_0..b_k is mix(sum of T[b_i] * P**i mod 2**64) with a fixed random table T and odd P: one running sum over a
slice gives the hash of any span in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_ODD = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    letters[65:91] = letters[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return letters, space


class _Powers:
    """P**i and its inverse for i up to the longest slice so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(max(n, SLICE + 4096), _ODD, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(_ODD, -1, 1 << 64)
            self.down = np.cumprod(steps)
        return self.up, self.down


class Spans:
    """Words of a batch: doc (index of the text), start and end (bytes from the batch's first), hash; heads and tails: hashes of the first and last k bytes for each k asked for. Bytes that
    trim marks don't count at the ends of a word, unless the word has no others."""

    def __init__(self, texts: pa.Array, heads: tuple[int, ...] = (), tails: tuple[int, ...] = (), trim: np.ndarray | None = None):
        letters, space = _tables()
        powers = _Powers()
        data, offsets = buffers(texts)
        self.data, self.offsets, self.count = data, offsets, len(offsets) - 1
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        parts: list[list[np.ndarray]] = []
        at = 0
        while at < len(data):
            end = _edge(data, first, space, min(len(data), at + SLICE))
            d = data[at:end]
            word = ~space[d]
            fresh = first[at:end]
            begins = word.copy()
            begins[1:] &= ~word[:-1] | fresh[1:]
            closes = word.copy()
            closes[:-1] &= ~word[1:] | fresh[1:]
            s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
            a, b = s, e
            if trim is not None:
                a, b = _trimmed(d, s, e, trim)
            up, down = powers.to(len(d) + 1)
            sums = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(letters[d] * up[: len(d)], out=sums[1:])
            span = lambda a, b: mix((sums[b] - sums[a]) * down[a])
            row = [s + at, e + at, span(a, b)]
            row += [span(a, np.minimum(a + k, b)) for k in heads] + [span(np.maximum(b - k, a), b) for k in tails]
            parts.append(row)
            at = end
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * (1 + len(heads) + len(tails))
        self.start, self.end, self.hash, *rest = columns
        self.heads, self.tails = rest[: len(heads)], rest[len(heads) :]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1


def _trimmed(d: np.ndarray, s: np.ndarray, e: np.ndarray, trim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner = np.flatnonzero(~trim[d])
    if not len(inner) or not len(s):
        return s, e
    low, high = np.searchsorted(inner, s), np.searchsorted(inner, e) - 1
    some = low <= high
    low, high = np.minimum(low, len(inner) - 1), np.maximum(high, 0)
    return np.where(some, inner[low], s), np.where(some, inner[high] + 1, e)


def _edge(data: np.ndarray, first: np.ndarray, space: np.ndarray, at: int) -> int:
    """The first place from at on where no word is cut."""
    while at < len(data):
        stop = min(len(data), at + 4096)
        hits = np.flatnonzero(space[data[at:stop]] | first[at:stop])
        if len(hits):
            return at + int(hits[0])
        at = stop
    return at


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, null as empty, and where each text begins, with the end of the last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
