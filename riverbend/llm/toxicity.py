"""Operator 8: toxic spans by a linear-chain conditional random field.

Tokens (words between white space in lower case, punctuation at the ends aside) have two states. A token's features are
its word, its first 3 to 9 and its last 3 and 4 bytes; states of neighbours are tied by transition weights. Token
labels come from the documents' labels: a feature that occurs in toxic documents far more often than chance explains
(see marking) marks the tokens that carry it in toxic documents. The field is trained on these labelled tokens by maximum
likelihood, with exact forward-backward sums. To score a text its marginals are added up over all of it; a logistic
model of the largest marginal and of their sum, fitted to the training documents, gives the document's score, and runs
of tokens with a marginal of SPAN or more are its offending spans.

Training uses at most MAX_TOXIC and MAX_CLEAN labelled rows, those with the lowest hashes of doc_id, and every feature of
their toxic tokens, so the model is bounded by that sample and travels with the tasks; it is trained in one task, which
Spark repeats elsewhere if its executor is lost. In training alone the chains of long texts are cut every WINDOW
tokens. Scoring is narrow and covers whole texts, each as one chain: features are taken in pieces of STEP bytes, and
the sums of a long chain are joined from those of its parts. Labels, language, source and doc_id are no inputs of a score.

Defined results: null and empty texts get a score like any text without toxic tokens; without labelled rows of both
kinds every score is 0; a null doc_id is never held out and never trained on; of several labels of a document the
highest counts; repeated rows are scored each; extra columns are kept by reject() and ignored by score(); an empty
table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Spans, buffers, mix, sliced
from .common import cut, lean, small_batches

MAX_TOXIC, MAX_CLEAN = 600, 1_200
#: For features that mark tokens: least documents, least shares of toxic ones among them (the next only for
#: documents that the one before leaves unexplained), false discovery rate.
LEAST, SHARES, FALSE = 3, (1.0, 0.9, 0.75), 0.005
#: Tokens of a chain in training.
WINDOW = 200
#: Tokens from which on a chain is swept in parts.
LONG = 4_096
#: Bytes of text scored at a time.
STEP = 2 << 20
STEPS = 50
THRESHOLD = 0.3
SPAN = 0.5
HEADS, TAILS = (3, 4, 5, 6, 7, 8, 9), (3, 4)
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_BITS = 20


def tokens(texts: pa.Array) -> tuple[Spans, np.ndarray]:
    """Words of the texts and, for each, the hashes of its features, one column a kind."""
    # simple case mapping: as many characters as before, so offsets in characters hold
    words = Spans(pc.utf8_lower(texts.cast(pa.string())), HEADS, TAILS, trim=_EDGE)
    kinds = [words.hash, *words.heads, *words.tails]
    words.heads = words.tails = ()
    feats = np.empty((len(words.hash), len(kinds)), np.uint64)
    for i in range(len(kinds)):
        feats[:, i] = mix(kinds[i] + np.uint64(i + 1))
        kinds[i] = None  # each is as large as a column
    return words, feats


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # log weights of the four transitions
    blend: np.ndarray  # of the document score: constant, largest log odds, log of 1 + sum

    def __post_init__(self):
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.features >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def active(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, index of a known feature that it has), for all of them."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tok, kind = np.nonzero(self.maybe[(feats >> np.uint64(64 - _BITS)).astype(np.int64)])
        value = feats[tok, kind]
        at = np.minimum(np.searchsorted(self.features, value), len(self.features) - 1)
        hit = self.features[at] == value
        return tok[hit], at[hit]

    def emission(self, feats: np.ndarray) -> np.ndarray:
        tok, at = self.active(feats)
        return self.bias + np.bincount(tok, self.weights[at], minlength=len(feats))


def _chain(x: np.ndarray, m00: float, m01: float, m10: float, m11: float) -> np.ndarray:
    """r[0] = x[0], r[t] = x[t] * (m01 + m11 * r[t - 1]) / (m00 + m10 * r[t - 1]) for one long chain.

    Each step is a two by two matrix; the products of parts of equal length are taken side by side, then the
    ratios with which the parts begin one after the other, then the steps of all parts again."""
    n, width = len(x) - 1, math.isqrt(len(x)) + 1
    rows = -(-n // width)
    steps = np.ones(rows * width)
    steps[:n] = x[1:]
    steps = steps.reshape(rows, width)
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(width):
        y = steps[:, t]
        a, b, c, d = y * (m11 * a + m01 * c), y * (m11 * b + m01 * d), m10 * a + m00 * c, m10 * b + m00 * d
        most = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / most, b / most, c / most, d / most
    begin, r = np.empty(rows), float(x[0])
    for i in range(rows):
        begin[i] = r
        r = float((a[i] * r + b[i]) / (c[i] * r + d[i]))
    out = np.empty((rows, width))
    r = begin
    for t in range(width):
        r = steps[:, t] * (m01 + m11 * r) / (m00 + m10 * r)
        out[:, t] = r
    return np.concatenate([x[:1], out.reshape(-1)[:n]])


def sweep(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (state 1 over state 0) at each token of sequences that lie one after the other."""
    (m00, m01), (m10, m11) = np.exp(moves.reshape(2, 2))
    x = np.exp(np.clip(emission, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    long = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    n = len(x)
    forward, backward = np.empty(n), np.ones(n)
    apart = int((long > LONG).sum())
    for at, size in zip(begin[:apart].tolist(), long[:apart].tolist(), strict=True):
        y = x[at : at + size]
        forward[at : at + size] = _chain(y, m00, m01, m10, m11)
        backward[at : at + size] = _chain(y[::-1], m00, m10, m01, m11)[::-1] / y
    long, begin = long[apart:], begin[apart:]
    most = int(long[0]) if len(long) else 0
    live = np.searchsorted(-long, -np.arange(most), side="left")  # sequences longer than t
    r = np.ones(len(long))
    for t in range(most):
        k = live[t]
        at = begin[:k] + t
        r = x[at] if t == 0 else x[at] * (r[:k] * m11 + m01) / (r[:k] * m10 + m00)
        forward[at] = r
    q = np.ones(0)
    for t in range(most - 2, -1, -1):
        k = live[t + 1]
        q = np.concatenate([q, np.ones(k - len(q))])  # those that end at t + 1 start here
        at = begin[:k] + t
        y = x[at + 1] * q
        q = (m10 + m11 * y) / (m00 + m01 * y)
        backward[at] = q
    return forward, backward


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    forward, backward = sweep(emission, lengths, moves)
    both = forward * backward
    return both / (1 + both)


def _expected_moves(emission, forward, backward, moves, inner) -> np.ndarray:
    """Expected counts of the four transitions into the tokens `inner`."""
    m = np.exp(moves.reshape(2, 2))
    r, x, q = forward[inner - 1], np.exp(np.clip(emission[inner], -30, 30)), backward[inner]
    p00, p01, p10, p11 = m[0, 0] * np.ones_like(r), m[0, 1] * x * q, r * m[1, 0], r * m[1, 1] * x * q
    z = p00 + p01 + p10 + p11
    return np.array([(p / z).sum() for p in (p00, p01, p10, p11)])


def apart(doc: np.ndarray, word: np.ndarray, count: int, looks: int = 4) -> np.ndarray:
    """Documents that are no near copies of an earlier one, as far as the least hashes of their word triples tell; copies are no evidence of their own."""
    triple = mix(mix(mix(word) + np.roll(word, -1)) + np.roll(word, -2))
    bounds = np.searchsorted(doc, np.arange(count + 1))
    least = np.zeros((looks, count), np.uint64)
    some = np.flatnonzero(np.diff(bounds) > 2)
    inner = np.arange(len(doc)) < bounds[np.minimum(doc + 1, count)] - 2 if len(doc) else np.zeros(0, bool)
    for k in range(looks):
        h = np.where(inner, mix(triple + np.uint64(k)), np.uint64((1 << 64) - 1)) if len(doc) else triple
        if len(some):
            least[k, some] = np.minimum.reduceat(h, bounds[:-1][some])
    fresh, seen = np.ones(count, bool), [set() for _ in range(looks)]
    for i in some.tolist():
        keys = least[:, i].tolist()
        fresh[i] = not any(x in s for x, s in zip(keys, seen, strict=True))
        for x, s in zip(keys, seen, strict=True):
            s.add(x)
    return fresh


def marking(doc: np.ndarray, feats: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features that mark toxic tokens, sorted.

    A feature in n documents, a of them toxic, gets the Chernoff bound of so large a share by chance; the significant
    ones are chosen by Benjamini and Hochberg's rule. Then the same is done with the toxic documents that have none
    of the chosen features, until nothing more is found or left."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for kind in range(feats.shape[1]):  # one kind of feature after the other, so that little is held at once
        order = np.lexsort((doc, feats[:, kind]))
        flat, owner = feats[order, kind], doc[order].astype(np.int32)
        once = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]
        flat, owner = flat[once], owner[once]
        edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        often = np.add.reduceat((y[owner] == 1).astype(np.int64), edge) >= LEAST
        keep = np.repeat(often, np.diff(np.r_[edge, len(flat)]))
        parts.append((flat[keep], owner[keep]))
    known, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    at, owner = at.astype(np.int32), np.concatenate([p[1] for p in parts])
    del parts
    clean = np.bincount(at, y[owner] == 0, minlength=len(known))
    chosen, open_, level = np.zeros(len(known), bool), y == 1, 0
    while open_.any() and level < len(SHARES):
        a = np.bincount(at, open_[owner], minlength=len(known))
        n, base = a + clean, open_.sum() / max(1, open_.sum() + (y == 0).sum())
        tried = np.flatnonzero(n >= LEAST)
        share = a[tried] / n[tried]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = a[tried] * np.log(share / base) + np.nan_to_num((n - a)[tried] * np.log((1 - share) / (1 - base)))
        chance = np.where(share >= max(SHARES[level], base), np.exp(-np.nan_to_num(far)), 1.0)
        rank = np.sort(chance)
        passed = np.flatnonzero(rank <= FALSE * np.arange(1, len(rank) + 1) / max(1, len(rank)))
        fresh = tried[chance <= rank[passed[-1]]] if len(passed) else tried[:0]
        fresh = fresh[~chosen[fresh]]
        if not len(fresh):
            level += 1
            continue
        chosen[fresh] = True
        open_[owner[chosen[at]]] = False
    return known[chosen]


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """Fit the field and the document score to labelled documents."""
    y = np.asarray(toxic, np.int64)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -5.0, np.zeros(4), np.array([-30.0, 0.0, 0.0]))
    if not len(y) or y.min() == y.max():
        return empty
    words, feats = tokens(pa.array(texts, pa.string()))
    alone = apart(words.doc, words.hash, len(texts))
    take = alone[words.doc]
    mark = Model(marking(words.doc[take], feats[take], np.where(alone, y, -1)), np.zeros(0), 0.0, np.zeros(4), np.zeros(3))
    if not len(mark.features):
        return empty
    label = np.zeros(len(feats), np.int64)
    label[mark.active(feats)[0]] = 1
    label &= y[words.doc]

    inside = np.unique(feats[label == 1].ravel())
    model = Model(inside, np.zeros(len(inside)), -3.0, np.zeros(4), np.zeros(3))
    tok, at = model.active(feats)
    per_doc = np.bincount(words.doc, minlength=len(texts))
    lengths = np.concatenate([np.r_[np.full(c // WINDOW, WINDOW), [c % WINDOW] * (c % WINDOW > 0)] for c in per_doc.tolist()]).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(feats), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    seen_moves = np.bincount(2 * label[inner - 1] + label[inner], minlength=4).astype(float)
    seen = np.bincount(at, label[tok], minlength=len(inside))
    total, l2 = float(label.sum()), 1e-2
    params, m1, m2 = np.concatenate([model.weights, [model.bias], model.moves]), 0.0, 0.0
    for step in range(1, STEPS + 1):
        w, bias, moves = params[: len(inside)], params[len(inside)], params[len(inside) + 1 :]
        emission = bias + np.bincount(tok, w[at], minlength=len(feats))
        forward, backward = sweep(emission, lengths, moves)
        p = forward * backward
        p /= 1 + p
        grad = np.concatenate([seen - np.bincount(at, p[tok], minlength=len(inside)) - l2 * w, [total - p.sum()], seen_moves - _expected_moves(emission, forward, backward, moves, inner)])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        params = params + 0.3 * (1 - step / (STEPS + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    model = Model(inside, params[: len(inside)], float(params[len(inside)]), params[len(inside) + 1 :], np.zeros(3))
    x = summary(model, words.doc, feats, len(texts))
    blend = np.zeros(3)
    for _ in range(60):  # Newton steps of a logistic regression with a weak prior
        z = 1 / (1 + np.exp(-np.clip(x @ blend, -30, 30)))
        slope = x.T @ (y - z) - 1e-2 * blend
        blend = blend + np.linalg.solve((x * (z * (1 - z))[:, None]).T @ x + np.diag([1e-2] * 3), slope)
    model.blend = blend
    return model


def summary(model: Model, doc: np.ndarray, feats: np.ndarray, count: int, p: np.ndarray | None = None) -> np.ndarray:
    """Per document: 1, the largest log odds of its tokens (at least -6, at most 6), and log(1 + sum of marginals)."""
    if p is None:
        p = marginals(model.emission(feats), np.bincount(doc, minlength=count), model.moves)
    top = np.full(count, -6.0)
    np.maximum.at(top, doc, np.clip(np.log(np.maximum(p, 1e-9)) - np.log(np.maximum(1 - p, 1e-9)), -6, 6))
    return np.stack([np.ones(count), top, np.log1p(np.bincount(doc, p, minlength=count))], axis=1)


SCORED = "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in lower case, with the byte at which they begin: all of them, or a longer one in pieces of about STEP bytes between words."""
    data, offsets = buffers(texts)
    if len(texts) != 1 or len(data) <= STEP:
        yield 0, texts
        return
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    at = 0
    while at < len(data):
        end = min(len(data), at + STEP)
        while end < len(data):
            near = np.flatnonzero(space[data[end : end + (1 << 16)]])
            end += int(near[0]) if len(near) else 1 << 16
            if len(near):
                break
        end = min(end, len(data))
        yield at, pa.array([data[at:end].tobytes().decode()], pa.large_string())
        at = end


def judge(model: Model, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text, and its offending spans by offsets in characters."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    count, parts = len(lower), []
    for at, piece in _pieces(lower):
        words, feats = tokens(piece)
        parts.append((words.doc, words.start + at, words.end + at, model.emission(feats)))
        del words, feats
    doc, start, end, emission = (np.concatenate(c) for c in zip(*parts, strict=True))
    p = marginals(emission, np.bincount(doc, minlength=count), model.moves)
    x = summary(model, doc, np.zeros((len(doc), 0)), count, p)
    score = 1 / (1 + np.exp(-np.clip(x @ model.blend, -30, 30)))
    found: list[list[dict]] = [[] for _ in range(count)]
    hits = np.flatnonzero(p >= SPAN) if spans else []
    if len(hits):
        data, offsets = buffers(lower)
        first = np.flatnonzero(np.r_[True, (np.diff(hits) > 1) | (np.diff(doc[hits]) > 0)])
        last = np.r_[first[1:], len(hits)] - 1
        owner, begin, stop, best = doc[hits[first]], start[hits[first]], end[hits[last]], np.maximum.reduceat(p[hits], first)
        # characters before each place: the bytes that begin one, summed from mark to mark
        marks = np.unique(np.concatenate([offsets[:-1][owner], begin, stop]))
        marks = marks[marks < len(data)]
        leads = ((data & 0xC0) != 0x80).view(np.uint8)
        sums = np.concatenate([[0], np.cumsum(np.add.reduceat(leads, marks, dtype=np.int64))])
        chars = lambda at: sums[np.searchsorted(marks, at)]
        base = chars(offsets[:-1][owner])
        for d, a, b, q in zip(owner.tolist(), (chars(begin) - base).tolist(), (chars(stop) - base).tolist(), best.tolist(), strict=True):
            found[d].append({"start": a, "end": b, "p": q})
    return score, found


def _score(batches: Iterator[pa.RecordBatch], model: Model, spans: bool) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, most=STEP):
        score, found = judge(model, batch.column("text"), spans)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(found, _SPANS)], names=["doc_id", "score", "spans"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of a model of all rows, pickled."""
    rows: dict[int, tuple[str, int]] = {}
    for batch in batches:
        for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_toxic")), strict=True):
            rows[doc_id] = min(rows.get(doc_id, (text or "", toxic)), (text or "", toxic))  # one text of a repeated doc_id
    held = [rows[i] for i in sorted(rows)]
    m = train([t for t, _ in held], [x for _, x in held])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.features, m.weights, m.bias, m.moves, m.blend))], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Train on labelled rows that are not held out: of either label those with the lowest hashes, up to the bounds."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    pick = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, max_toxic), (0, max_clean))]
    chosen = cut(pick[0].union(pick[1]).select("doc_id", F.col("toxic").cast("int").alias("_toxic")))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # at most max_toxic + max_clean rows, trained on in one task
    rows = texts.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_toxic")
    held = rows.repartition(1).mapInArrow(lean(_fit), "model binary").first()
    return Model(*pickle.loads(held[0])) if held else train([], [])


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans), one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(lambda it: _score(it, model, spans)), SCORED)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans)."""
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def _keep(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, most=STEP):
        scores, _ = judge(model, batch.column("text"), spans=False)
        yield batch.filter(pa.array(scores < threshold))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    model = fit(docs, labels)
    return docs.mapInArrow(lean(lambda it: _keep(it, model, threshold)), docs.schema)
