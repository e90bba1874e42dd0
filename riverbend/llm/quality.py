"""Operator 3: quality by an interpolated modified Kneser-Ney model of trusted text.

The model is of words, as 64-bit hashes of their bytes (A-Z as a-z), up to three in a row, and grows with the trusted
text: no vocabulary is fixed and all trusted text is counted. Below one word stands its spelling: an order-4 model of the
same kind over 64 classes of bytes, of at most 64**4 n-grams, which only rates words that are not known.

The log probability of a text is a sum of weights of its known n-grams, as endings and as contexts (see train_words).
Tables of n-grams would take more disk than the texts, so none is kept. Every word goes with its two neighbours to the
bucket of the middle one, where all that pairs and triples need of each other meets: counts, continuation counts,
contexts, and the texts that are to be scored. Only the probabilities of single words come from elsewhere; each bucket
asks for those of its words. Rounds take one range of words after the other, reading all texts in each, and only sums by
text outlive a round. All triples around one word meet in one task, so the most frequent word sets its size.

Trusted documents are judged without the n-grams, and without the contexts, that no other trusted document has, else
each would know itself by heart.

Thresholds are quantiles of the perplexities of trusted documents of one language and of about one length, since those
of short texts spread far more than those of long ones: bands are powers of two of the bytes. They are taken from counts of
perplexities on a fixed grid of GRID nats, so no language's rows meet in one task; a document above its threshold is
not kept. A band with less than ENOUGH trusted documents, too few to have such a quantile, takes that of its language.

Defined results: null and empty texts have no perplexity and are kept as False; a language without trusted documents
takes the threshold over all trusted ones, and without any trusted document nothing is kept; a null language is one of
its own; of several labels of a document the highest counts; repeated rows are scored each; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import buffers, mix, sliced
from .common import cut, lean, new_folder, shuffle_parts, small_batches

ORDER, BITS = 4, 6
SIZE = 1 << (ORDER * BITS)
QUANTILE = 0.995
GRID = 0.001
#: Trusted documents of a band of lengths that make up a quantile of their own.
ENOUGH = 200
SHARDS = 64
#: Bytes of text taken at a time.
STEP = 1 << 20
#: Bytes up to which words are hashed eight bytes at a time; the word before a text.
LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
MARK = np.uint64(0x5851F42D4C957F2D)
#: Rounds of training and of scoring by the middle words of triples, and of scoring by single words. A round reads all texts and
#: sends one range of words, so that what is on disk at a time is that part; more rounds take less disk and more time.
TRAIN_ROUNDS, ROUNDS, SINGLE_ROUNDS = 2, 4, 2
#: Bytes of all texts to a bucket of middle words, and triples that a task holds before it sends them.
BUCKET_BYTES = 8 << 20
HELD = 600_000
#: In place of the key of an only document, where there are several.
SEVERAL = np.iinfo(np.int64).min
#: Ids of trusted documents up to which they are broadcast.
IDS = 8_000_000


def alphabet() -> np.ndarray:
    """Class of each byte."""
    kind = np.zeros(256, np.int64)
    kind[97:123] = np.arange(1, 27)
    kind[65:91] = np.arange(27, 53)
    kind[48:58] = 53
    kind[32] = 54
    kind[[10, 13]] = 55
    kind[46], kind[44] = 56, 57
    kind[[33, 63, 58, 59]] = 58
    kind[[ord(c) for c in "\"'()-"]] = 59
    kind[128:192] = 60
    kind[192:224] = 61
    kind[224:256] = 62
    return kind  # 0: the rest; 63 stands before the first byte of a text


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, where each text begins, and how many bytes it has."""
    data, offsets = buffers(texts)
    lengths = np.diff(offsets)
    n = len(lengths)
    pad = ORDER - 1
    own = np.ones(len(data) + n * pad, bool)
    own[(np.arange(pad) + (offsets[:-1] + pad * np.arange(n))[:, None]).reshape(-1)] = False
    symbols = np.full(len(own), 63, np.int32)
    symbols[own] = alphabet().astype(np.int32)[data]
    code = symbols.copy()
    for back in range(1, pad + 1):
        code[back:] |= symbols[:-back] << (BITS * back)
    code = code[own]
    return code, offsets[:-1], lengths


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in sliced(batches, most=STEP):
        code, _, _ = grams(batch.column("text"))
        if total is None:
            total = np.zeros(SIZE, np.int32)
        seen, n = np.unique(code, return_counts=True)
        total[seen] += n.astype(np.int32)
    if total is not None:
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 50_000):
            part = seen[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["g", "c"])


def _discounts(n: Sequence[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    out = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else float(k + 1) / 2 for k in range(3)]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(out)]


def train(texts: DataFrame, folder: str) -> str:
    """Count the column text of all rows and store the model in folder: order 4 in sorted shards, lower orders beside it."""
    raw = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(_tally), "g long, c long")
    counts = cut(raw.groupBy("g").agg(F.sum("c").alias("c")))
    by_order = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols come before
        suffix = F.col("g").bitwiseAND((1 << (BITS * order)) - 1)
        by_order[order] = cut(by_order[order + 1].groupBy(suffix.alias("g")).agg(F.count("*").alias("c")))
    lower = None
    for order in range(1, ORDER + 1):
        table = by_order[order]
        d = _discounts([r or 0 for r in table.agg(*[F.sum(F.when(F.col("c") == k, 1).otherwise(0)) for k in (1, 2, 3, 4)]).first()])
        kinds = [F.sum(F.when(F.col("c") == k if k < 3 else F.col("c") >= 3, 1).otherwise(0)) for k in (1, 2, 3)]
        stats = table.groupBy(F.shiftright("g", BITS).alias("x")).agg(F.sum("c").alias("all"), (kinds[0] * d[0] + kinds[1] * d[1] + kinds[2] * d[2]).alias("_off"))
        stats = stats.select("x", "all", (F.col("_off") / F.col("all")).alias("back"))
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        own = table.withColumn("x", F.shiftright("g", BITS)).join(stats, "x")
        own = own.withColumn("s", F.col("g").bitwiseAND((1 << (BITS * (order - 1))) - 1))
        base = F.lit(1.0 / (1 << BITS))
        if lower is not None:
            own, base = own.join(lower.select(F.col("g").alias("s"), F.col("p").alias("_below")), "s"), F.col("_below")
        probs = own.select("g", (F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("all") + F.col("back") * base).alias("p"))
        lower = cut(probs) if order < ORDER else probs
        shards = min(SHARDS, shuffle_parts(texts.sparkSession)) if order == ORDER else 1
        lower.repartitionByRange(shards, "g").sortWithinPartitions("g").write.parquet(f"{folder}/p{order}")
        stats.select("x", "back").repartition(1).write.parquet(f"{folder}/b{order}")
    return folder


def _read(at: str, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(at)
    table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=list(names))
    return table[names[0]].to_numpy(), table[names[1]].to_numpy()


@lru_cache(maxsize=1)
def load(folder: str) -> np.ndarray:
    """Log probability of every n-gram of the highest order, seen or not (float32, 64 MB); a worker keeps the last one."""
    below = np.full(1, 1.0 / (1 << BITS), np.float32)
    for order in range(1, ORDER + 1):
        x, back = _read(f"{folder}/b{order}", ("x", "back"))
        weight = np.ones(1 << (BITS * (order - 1)), np.float32)
        weight[x] = back
        # an unseen n-gram: its context's weight times its suffix; contexts lead, suffixes repeat
        dense = (weight.reshape(-1, 1, 1) if order == 1 else weight.reshape(1 << BITS, -1, 1)) * below.reshape(1, -1, 1 if order == 1 else 1 << BITS)
        dense = dense.reshape(-1) if order > 1 else np.full(1 << BITS, weight[0] * below[0], np.float32)
        g, p = _read(f"{folder}/p{order}", ("g", "p"))
        dense[g] = p
        below = dense
    return np.log(below, out=below)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each word its start, its end, its text and a hash of its bytes (A-Z as a-z); and the lengths of the texts.

    Eight bytes are hashed at a time, all words at once; the few very long words one by one."""
    data, offsets = buffers(texts)
    word = (data != 32) & ((data - np.uint8(9)) > 4)
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # words end where texts do
    begins[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    length = end - start
    held = np.zeros(len(data) + 8, np.uint8)
    np.bitwise_or(data, ((data - np.uint8(65)) < 26).view(np.uint8) << 5, out=held[: len(data)])
    eight = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
    h = length.astype(np.uint64)
    kept = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    at = np.arange(len(start))
    for k in range(0, LONG, 8):
        if k:
            at = at[(length[at] > k) & (length[at] <= LONG)]
        if not len(at):
            break
        rest = length[at] - k
        chunk = eight[start[at] + k]
        chunk = np.where(rest < 8, chunk & kept[np.minimum(rest, 7)], chunk)
        h[at] = mix((h[at] if k else h) * _STEP + chunk)
    for i in np.flatnonzero(length > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(held[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return start, end, np.searchsorted(offsets, start, side="right") - 1, h, np.diff(offsets)


def _words(texts: pa.Array, table: np.ndarray | None) -> dict[str, np.ndarray]:
    """For each word: its text (doc), its hash (c), its place among the hashes h, where two marks stand before each text, and with
    a table the log probability of its spelling, up to the next word. all, bytes: those of whole texts."""
    start, _, doc, own, lengths = _tokens(texts)
    n, count = len(doc), len(lengths)
    h = np.full(n + 2 * count, MARK, np.uint64)
    place = np.arange(n) + 2 * (doc + 1)
    h[place] = own
    out = {"doc": doc, "c": own, "h": h, "place": place, "bytes": lengths, "all": np.zeros(count)}
    if table is not None:
        code, _, _ = grams(texts)
        sums = np.zeros(len(code) + 1)
        np.cumsum(table[code], dtype=np.float64, out=sums[1:])
        ends = np.cumsum(lengths)
        out["all"] = sums[ends] - sums[ends - lengths]
        same = np.zeros(n, bool)
        same[1:] = doc[1:] == doc[:-1]
        begins = np.where(same, start, (ends - lengths)[doc])
        stops = np.where(np.append(same[1:], False), np.append(start[1:], 0), ends[doc])
        out["spell"] = sums[stops] - sums[begins]
    return out


# What tasks send each other: packed arrays, each to a bucket, of a kind, from a slice of texts or a bucket.
PACKED = "bucket int, kind int, src long, body binary"
TRIPLES, SINGLES, TEXTS, BELOW, ONE, TIMES, SPELLINGS, SUMS = range(8)
PARTIAL = "_key long, rows long, bytes long, every double, held double"
_NAMES = [f.split()[0] for f in PACKED.split(", ")]


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of a column that is mostly sorted, which take less room; np.cumsum undoes them, also where they wrap."""
    return np.diff(x, prepend=x.dtype.type(0))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte planes apart, since the high bytes of small numbers are alike."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append((a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()))
    raw = pickle.dumps(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(body: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    kinds = ((np.dtype(kind), data) for kind, data in pickle.loads(raw))
    return [np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind) for kind, data in kinds]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=_NAMES)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The part of the range of hashes, so that sorted hashes lie in buckets one after the other."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _ids(*words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes, sorted, and the place of each of the given ones among them."""
    code = pa.array(np.concatenate(words).view(np.int64)).dictionary_encode()
    known = code.dictionary.to_numpy().view(np.uint64)
    order = np.argsort(known)
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(len(known), dtype=np.int32)
    at = rank[code.indices.to_numpy()]
    return known[order], np.split(at, np.cumsum([len(w) for w in words])[:-1])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    first = _starts(x)
    return list(zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=False))


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of asked values among the known, sorted ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def _send(batches: Iterator[pa.RecordBatch], plan: Plan, rounds: int, at: int, singles: bool = False, spell_to: int = 0) -> Iterator[pa.RecordBatch]:
    """The words of texts in one round's range of hashes: each with the two beside it, by the middle one, or singles, each with
    its count and spelling in a text. spell_to: also the likeliest spelling of every word, to so many groups of words."""
    from pyspark import TaskContext

    table = load(plan.folder) if singles or spell_to else None
    buckets = plan.singles if singles else plan.buckets
    each = buckets // rounds
    src = TaskContext.get().partitionId() << 32
    held, texts, spells, n, size = [], [], [], 0, 0

    def out() -> pa.RecordBatch:
        rows = []
        key, flag, length, every = (np.concatenate(x) for x in zip(*texts, strict=True))
        rows.append((src % each, TEXTS, src, _pack(key, flag, *((length, every) if singles and at == 0 else ()))))
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        if singles:
            known, (c,) = _ids(columns[0])
            doc, spell = columns[1:]
            order = np.argsort(doc * len(known) + c, kind="stable")
            c, doc, spell = c[order], doc[order], spell[order]
            first = _starts(doc * len(known) + c)
            total = np.add.reduceat(spell, first) if len(first) else spell
            c, doc, times, total = c[first], doc[first], np.diff(np.append(first, len(spell))).astype(np.int32), total.astype(np.float32)
            to = _bucket(known, buckets)[c]
            order = np.argsort(to, kind="stable")
            lanes, body = to[order], [x[order] for x in (c, doc.astype(np.int32), times, total)]
        else:
            known, (a, b, c) = _ids(*columns[:3])
            order = np.argsort(b.astype(np.int64) * len(known) + a, kind="stable")
            body = [x[order] for x in (a, b, c, columns[3].astype(np.int32))]
            lanes = _bucket(known, buckets)[body[1]]
        lut, some = np.zeros(len(known), np.int32), np.zeros(len(known), bool)
        for lo, hi in _runs(lanes):
            ids, rest = [x[lo:hi] for x in (body[:1] if singles else body[:3])], [x[lo:hi] for x in (body[1:] if singles else body[3:])]
            some[:] = False
            for x in ids:
                some[x] = True
            used = np.flatnonzero(some)
            lut[used] = np.arange(len(used), dtype=np.int32)
            ids = [lut[x] for x in ids]
            if singles:
                packed = _pack(_steps(known[used]), _steps(ids[0]), _steps(rest[0]), *rest[1:])
            else:
                taught = np.unique(rest[0][(flag[rest[0]] & 1) == 1])
                packed = _pack(_steps(known[used]), _steps(ids[0]), _steps(ids[1]), ids[2], rest[0], taught, key[taught])
            rows.append((int(lanes[lo]) - at * each, SINGLES if singles else TRIPLES, src, packed))
        if spells:
            known, (c,) = _ids(np.concatenate([x for x, _ in spells]))
            best = np.full(len(known), -np.inf)
            np.maximum.at(best, c, np.concatenate([x for _, x in spells]))
            to = _bucket(known, spell_to)
            rows += [(int(to[lo]) % each, SPELLINGS, int(to[lo]), _pack(known[lo:hi], best[lo:hi])) for lo, hi in _runs(to)]
        return _batch(rows)

    for batch in sliced(batches, most=STEP // 2):
        w = _words(batch.column("text"), table)
        key, flag = batch.column("_key").to_numpy(), batch.column("flag").to_numpy()
        texts.append((key, flag, w["bytes"].astype(np.int64), w["all"]))
        if singles:
            pick = np.flatnonzero((_bucket(w["c"], rounds) == at) & ((flag[w["doc"]] & 2) == 2))
            held.append((w["c"][pick], w["doc"][pick] + n, w["spell"][pick]))
        else:
            pick = np.flatnonzero(_bucket(w["h"], rounds)[w["place"] - 1] == at)
            place = w["place"][pick]
            held.append((w["h"][place - 2], w["h"][place - 1], w["c"][pick], w["doc"][pick] + n))
        if spell_to and len(w["c"]):
            known, (c,) = _ids(w["c"])
            best = np.full(len(known), -np.inf)
            np.maximum.at(best, c, w["spell"])
            spells.append((known, best))
        n += batch.num_rows
        size += len(pick) + sum(len(x) for x, _ in spells[-1:])
        if size >= HELD:
            yield out()
            held, texts, spells, n, size, src = [], [], [], 0, 0, src + 1
    if n:
        yield out()


class _Counted:
    """Counts of the trusted word triples (a, b, c) of a bucket, all those around its words b: of each triple (times), of the
    distinct words before each pair (b, c), and both summed by context. lo, hi: the least and largest number of a document."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, doc: np.ndarray, mark: int):
        self.n = n
        low = lambda x, at: np.minimum.reduceat(x, at) if len(at) else x[:0]
        high = lambda x, at: np.maximum.reduceat(x, at) if len(at) else x[:0]
        total = lambda x, at: np.add.reduceat(x, at) if len(at) else x[:0]
        self.low, self.high, self.total = low, high, total
        before = b.astype(np.int64) * n + a
        self.x3 = np.unique(before)
        g = np.searchsorted(self.x3, before) * n + c
        order = np.argsort(g, kind="stable")
        g, doc = g[order], doc[order]
        first = _starts(g)
        self.g3, self.c3 = g[first], np.diff(np.append(first, len(g)))
        lo, hi = low(doc, first), high(doc, first)
        self.own3 = lo == hi
        self.at3 = self.g3 // n
        self.first3 = _starts(self.at3)
        self.ownx3 = low(lo, self.first3) == high(hi, self.first3)
        middle = self.x3[self.at3] // n
        pair = middle * n + self.g3 % n
        order = np.argsort(pair, kind="stable")
        first = _starts(pair[order])
        self.g2 = pair[order][first]
        # before the first words of texts nothing comes, so these are counted as they occur
        self.c2 = total(np.where(middle == mark, self.c3, 1)[order], first)
        self.of2 = np.empty(len(pair), np.int64)
        self.of2[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        self.lo2, self.hi2 = low(lo[order], first), high(hi[order], first)
        self.own2 = self.lo2 == self.hi2
        self.first2 = _starts(self.g2 // n)
        self.x2 = np.full(n, -1, np.int32)  # the place of a word's context
        self.x2[self.g2[self.first2] // n] = np.arange(len(self.first2), dtype=np.int32)
        self.ownx2 = low(self.lo2, self.first2) == high(self.hi2, self.first2)

    def weights(self, below: np.ndarray, two: list[float], three: list[float]) -> None:
        """The weights of pairs, triples and contexts; below: the probability of the second word of each pair."""
        each = lambda c, first: np.diff(np.append(first, len(c)))
        off, all_ = _off(self.c2, two), np.repeat(self.total(self.c2, self.first2), each(self.c2, self.first2))
        back = self.total(off, self.first2) / self.total(self.c2, self.first2) if len(self.first2) else off
        rest = np.repeat(back, each(self.c2, self.first2)) * below
        p = np.maximum(self.c2 - off, 0) / all_ + rest
        self.end2, self.pass2 = np.log(p) - np.log(rest), np.log(back)
        off, all_ = _off(self.c3, three), np.repeat(self.total(self.c3, self.first3), each(self.c3, self.first3))
        back = self.total(off, self.first3) / self.total(self.c3, self.first3) if len(self.first3) else off
        rest = np.repeat(back, each(self.c3, self.first3)) * p[self.of2]
        self.end3, self.pass3 = np.log(np.maximum(self.c3 - off, 0) / all_ + rest) - np.log(rest), np.log(back)

    def gains(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What knowing pairs, triples and contexts adds to the log probability of each c, of all and of those of several documents."""
        every, held = np.zeros(len(c)), np.zeros(len(c))

        def add(at, seen, weight, own, of=None):
            at = at[seen if of is None else of]
            every[seen] += weight[at]
            held[seen] += np.where(own[at], 0.0, weight[at])

        b = b.astype(np.int64)
        add(self.x2[b], self.x2[b] >= 0, self.pass2, self.ownx2)
        at, seen = _find(self.g2, b * self.n + c)
        add(at, seen, self.end2, self.own2)
        before, led = _find(self.x3, b * self.n + a)
        add(before, led, self.pass3, self.ownx3)
        both = np.flatnonzero(seen & led)  # a known triple has a known pair and context
        at, seen = _find(self.g3, before[both] * self.n + c[both])
        add(at, both[seen], self.end3, self.own3, seen)
        return every, held


def _off(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.asarray(d)[np.minimum(c, 3) - 1]


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """The rows by kind, in the order of where they come from, so that sums repeat."""
    rows = {}
    for batch in batches:
        for row in batch.to_pylist():
            rows.setdefault(row["kind"], []).append((row["src"], row["bucket"], row["body"]))
    return {kind: sorted(x, key=lambda r: r[:2]) for kind, x in rows.items()}


def _opened(body: bytes) -> tuple[np.ndarray, ...]:
    """Of packed triples the words, the places of a, b and c among them, the texts, and the trusted of these with their keys."""
    words, a, b, *rest = _unpack(body)
    return np.cumsum(words), np.cumsum(a, dtype=np.int32), np.cumsum(b, dtype=np.int32), *rest


def _counted(rows: list[tuple]) -> tuple[np.ndarray, _Counted, np.ndarray]:
    """The hashes of all words of a bucket, the counts of its trusted triples, and the keys of their documents by number.

    Triples that are only to be scored stay packed until their turn."""
    known = np.unique(np.concatenate([_opened(body)[0] for _, _, body in rows]))
    parts = []
    for _, _, body in rows:
        words, a, b, c, doc, mine, keys = _opened(body)
        place, seen = _find(mine, doc)
        lut = np.searchsorted(known, words).astype(np.int32)
        parts.append((*(lut[x[seen]] for x in (a, b, c)), keys[place[seen]] if len(keys) else np.zeros(0, np.int64)))
    a, b, c, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    keys, number = np.unique(key, return_inverse=True)
    mark = np.searchsorted(known, MARK)
    mark = int(mark) if mark < len(known) and known[mark] == MARK else -1
    return known, _Counted(max(len(known), 1), a, b, c, number.astype(np.int32), mark), keys


def _count(batches: Iterator[pa.RecordBatch], first: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Of a bucket of trusted triples the numbers of pairs and triples by their counts, and for each word the number of distinct
    words before it among those of the bucket, with the key of the only document where there is one, to its group of words."""
    rows = _gather(batches)
    out = [(src, SPELLINGS, 0, body) for src, _, body in rows.get(SPELLINGS, [])]
    if TRIPLES in rows:
        known, got, keys = _counted(rows[TRIPLES])
        at = first + rows[TRIPLES][0][1]
        out.append((0, TIMES, at, _pack(*[np.bincount(np.minimum(c, 5), minlength=6)[1:] for c in (got.c2, got.c3)])))
        order = np.argsort(got.g2 % got.n, kind="stable")
        c = (got.g2 % got.n)[order]
        begins = _starts(c)
        lo, hi = got.low(got.lo2[order], begins), got.high(got.hi2[order], begins)
        words, n = known[c[begins]], np.diff(np.append(begins, len(c))).astype(np.int32)
        only = np.where(lo == hi, keys[lo], SEVERAL)
        to = _bucket(words, groups)
        out += [(int(to[i]), BELOW, at, _pack(_steps(words[i:j]), n[i:j], only[i:j])) for i, j in _runs(to)]
    if out:
        yield _batch(out)


def _singles(batches: Iterator[pa.RecordBatch], plan: Plan, one: tuple | None) -> Iterator[pa.RecordBatch]:
    """Of a group of words the numbers of words by the number of distinct words before; or with the discounts, sum and weight of
    the spelling, the probabilities of words for those who asked and for scoring single words."""
    rows = _gather(batches)
    if BELOW not in rows:
        return
    asked = []
    for src, _, body in rows[BELOW]:
        words, *rest = _unpack(body)
        asked.append((src, np.cumsum(words), *rest))
    known = np.unique(np.concatenate([x[1] for x in asked]))
    c, lo, hi = np.zeros(len(known), np.int64), np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    for _, words, n, only in asked:
        at = np.searchsorted(known, words)
        c[at] += n
        lo[at], hi[at] = np.minimum(lo[at], only), np.maximum(hi[at], only)
    if one is None:
        yield _batch([(0, TIMES, 0, _pack(np.bincount(np.minimum(c, 5), minlength=6)[1:], np.array([c.sum()])))])
        return
    spell = np.full(len(known), -np.inf)
    for _, _, body in rows.get(SPELLINGS, []):
        words, best = _unpack(body)
        at, seen = _find(known, words)
        spell[at[seen]] = np.maximum(spell[at[seen]], best[seen])
    d, total, back = one
    p = np.maximum(c - _off(c, d), 0) / total + back * np.exp(spell)
    own = (lo == hi) & (lo != SEVERAL)
    out = [(src, BELOW, 0, _pack(_steps(words), p[np.searchsorted(known, words)].astype(np.float32))) for src, words, _, _ in asked]
    to = _bucket(known, plan.singles)
    out += [(int(to[i]), ONE, 0, _pack(known[i:j], np.log(p[i:j]), own[i:j])) for i, j in _runs(to)]
    for i in range(0, len(out), 256):
        yield _batch(out[i : i + 256])


def _answer(batches: Iterator[pa.RecordBatch], two: list[float], three: list[float]) -> Iterator[pa.RecordBatch]:
    """To each slice the sums of what a bucket knows of its texts: of all n-grams, and of those that more than one document has."""
    rows = _gather(batches)
    out = [(bucket, TEXTS, src, body) for src, bucket, body in rows.get(TEXTS, [])]

    def reply(src, bucket, doc, every, held):
        order = np.argsort(doc, kind="stable")
        first = _starts(doc[order])
        if len(first):
            sums = [np.add.reduceat(x[order], first).astype(np.float32) for x in (every, held)]
            out.append((bucket, SUMS, src, _pack(doc[order][first], *sums)))

    if TRIPLES in rows:
        known, got, _ = _counted(rows[TRIPLES])
        below = np.zeros(len(known))
        for _, _, body in rows.get(BELOW, []):
            words, p = _unpack(body)
            at, seen = _find(known, np.cumsum(words))
            below[at[seen]] = p[seen]
        got.weights(below[got.g2 % got.n], two, three)
        for src, bucket, body in rows[TRIPLES]:
            words, *abc, doc, _, _ = _opened(body)
            lut = np.searchsorted(known, words).astype(np.int32)
            reply(src, bucket, doc, *got.gains(*[lut[x] for x in abc]))
    if SINGLES in rows:
        model = [_unpack(body) for _, _, body in rows.get(ONE, [])]
        known, p, own = (np.concatenate(x) for x in zip(*model, strict=True)) if model else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
        order = np.argsort(known)
        known, p, own = known[order], p[order], own[order]
        for src, bucket, body in rows[SINGLES]:
            words, c, doc, times, spell = _unpack(body)
            words, c, doc = np.cumsum(words), np.cumsum(c, dtype=np.int32), np.cumsum(doc, dtype=np.int32)
            at, seen = _find(known, words)
            seen = seen[c]
            every = np.zeros(len(c))
            every[seen] = times[seen] * p[at[c[seen]]] - spell[seen]
            held = every.copy()
            held[seen] = np.where(own[at[c[seen]]], 0.0, every[seen])
            reply(src, bucket, doc, every, held)
    for i in range(0, len(out), 256):
        yield _batch(out[i : i + 256])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each text over the buckets of a round."""
    rows = _gather(batches)
    replies = {}
    for src, _, body in rows.get(SUMS, []):
        replies.setdefault(src, []).append(body)
    for src, _, body in rows.get(TEXTS, []):
        key, flag, *base = _unpack(body)
        length, every = base or (np.zeros(len(key), np.int64), np.zeros(len(key)))
        every = every.astype(np.float64)
        held = every.copy()
        for reply in replies.pop(src, []):
            doc, x, y = _unpack(reply)
            every[doc] += x
            held[doc] += y
        asked = (flag & 2) == 2
        columns = [x[asked] for x in (key, np.full(len(key), 1 if base else 0), length, every, held)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[f.split()[0] for f in PARTIAL.split(", ")])


@dataclass(frozen=True)
class Plan:
    """The folder of the model and the numbers of buckets of middle words and of single words, and of groups of words."""

    folder: str
    buckets: int
    singles: int
    groups: int


@dataclass(frozen=True)
class Words:
    """A trained model of words: trusted rows, discounts of pairs and triples, and the stored probabilities of words."""

    rows: DataFrame
    plan: Plan
    two: list[float]
    three: list[float]


def _drop(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """What is shuffled goes when the query that shuffled it has ended: rounds would add up otherwise."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _stored(df: DataFrame, at: str) -> DataFrame:
    """df written to the shared folder at once and read back."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def plan_of(rows: DataFrame, folder: str) -> Plan:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = ROUNDS * max(1, -(-size // (ROUNDS * BUCKET_BYTES)))
    # what is known of a text comes in a row of each bucket, so those of single words, which need less memory, are fewer
    singles = SINGLE_ROUNDS * max(min(buckets // SINGLE_ROUNDS, 6), -(-buckets // (8 * SINGLE_ROUNDS)))
    return Plan(folder, buckets, singles, max(min(buckets, 16), buckets // 32))


def train_words(rows: DataFrame, folder: str, plan: Plan | None = None) -> Words:
    """From (_key, text) of trusted rows to the discounts of all orders and the probabilities of single words.

    With lower orders interpolated, the log probability of a word is a sum of weights of the n-grams that are known: context, the
    log of the weight that an n-gram passes on as a context; ending, for one word the log probability itself and for more words
    what knowing the n-gram adds to the orders below. All that the weights of pairs and triples need of others lies in the bucket
    of the middle word, but for the probability of the last word alone, which is asked for and stored here."""
    spark = rows.sparkSession
    plan = plan or plan_of(rows, folder)
    texts = rows.select("_key", "text", F.lit(1).alias("flag"))
    each = plan.buckets // TRAIN_ROUNDS
    kept = []
    with _tidy(spark):
        for at in range(TRAIN_ROUNDS):
            sent = texts.mapInArrow(lean(lambda it, at=at: _send(it, plan, TRAIN_ROUNDS, at, spell_to=0 if at else plan.groups)), PACKED)
            counted = sent.repartitionById(each, F.col("bucket")).mapInArrow(lean(lambda it, at=at: _count(it, at * each, plan.groups)), PACKED)
            kept.append(_stored(counted, f"{folder}/n{at}"))
        counted = reduce(DataFrame.unionByName, kept)
        times = [_unpack(r.body) for r in counted.where(F.col("kind") == TIMES).select("body").collect()]
        two, three = (_discounts(sum((t[k] for t in times), np.zeros(5, np.int64))) for k in (0, 1))
        by_word = counted.where(F.col("kind") != TIMES).repartitionById(plan.groups, F.col("bucket"))
        times = [_unpack(r.body) for r in by_word.mapInArrow(lean(lambda it: _singles(it, plan, None)), PACKED).select("body").collect()]
        n = sum((t[0] for t in times), np.zeros(5, np.int64))
        total = sum(int(t[1][0]) for t in times)
        one = _discounts(n)
        back = float(np.dot(one, [n[0], n[1], n[2:].sum()])) / max(total, 1)
        _stored(by_word.mapInArrow(lean(lambda it: _singles(it, plan, (one, total, back))), PACKED), f"{folder}/one")
    for at in range(TRAIN_ROUNDS):
        _drop(spark, f"{folder}/n{at}")
    return Words(rows, plan, two, three)


def score(docs: DataFrame, folder: str, weights: Words) -> DataFrame:
    """(doc_id, lang, bytes, nats, held): mean negative log probability of a byte, null for empty texts; held: without what only one trusted document has."""
    rows = _rows(docs)
    flagged = lambda df, flag: df.select("_key", "text", F.lit(flag).alias("flag"))
    sums = _score(flagged(rows, 2).unionByName(flagged(weights.rows, 1)), weights)
    return rows.select("_key", "doc_id", "lang").join(sums, "_key").drop("_key")


def _score(texts: DataFrame, weights: Words) -> DataFrame:
    """(_key, bytes, nats, held) of the rows (_key, text, flag) whose flag has bit 2; those with bit 1 are the trusted ones."""
    spark, plan, two, three = texts.sparkSession, weights.plan, weights.two, weights.three
    served = spark.read.schema(PACKED).parquet(f"{plan.folder}/one")
    kept = []
    with _tidy(spark):
        for at, singles in [(at, False) for at in range(ROUNDS)] + [(at, True) for at in range(SINGLE_ROUNDS)]:
            rounds, kind, each = (SINGLE_ROUNDS, ONE, plan.singles // SINGLE_ROUNDS) if singles else (ROUNDS, BELOW, plan.buckets // ROUNDS)
            own = served.where((F.col("kind") == kind) & F.col("bucket").between(at * each, (at + 1) * each - 1))
            own = own.withColumn("bucket", F.col("bucket") - at * each)
            sent = texts.mapInArrow(lean(lambda it, at=at, singles=singles, rounds=rounds: _send(it, plan, rounds, at, singles)), PACKED)
            answers = own.unionByName(sent).repartitionById(each, F.col("bucket")).mapInArrow(lean(lambda it: _answer(it, two, three)), PACKED)
            kept.append(_stored(answers.repartition(shuffle_parts(spark), "src").mapInArrow(lean(_sums), PARTIAL), f"{plan.folder}/s{int(singles)}{at}"))
    sums = reduce(DataFrame.unionByName, kept).groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("rows", "bytes", "every", "held")])
    # equal rows have sent their sums each
    nats = {"bytes": (F.col("bytes") / F.col("rows")).cast("long")} | {k: F.when(F.col("bytes") > 0, -F.col(c) / F.col("bytes")) for k, c in (("nats", "every"), ("held", "held"))}
    return sums.select("_key", *[c.alias(k) for k, c in nats.items()])


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *more)
    return rows.withColumn("_key", F.xxhash64("doc_id", "text"))


def _band(bytes_) -> Column:
    return F.floor(F.log2(F.greatest(bytes_, F.lit(1)))).cast("int")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """From (lang, bytes, nats) of trusted documents to (every, lang, band, level): a row for each band of a language with ENOUGH of
    them, one with band null for each language, and one with every True for all of them together.

    The level is the lowest point of the grid that at least the given share of the documents do not exceed."""
    cells = scored.where("nats IS NOT NULL").groupBy("lang", _band(F.col("bytes")).alias("band"), F.ceil(F.col("nats") / GRID).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    cells = cut(cells)
    none = {"lang": F.lit(None).cast("string"), "band": F.lit(None).cast("int")}
    whole = cells.groupBy("lang", "cell").agg(F.sum("n").alias("n")).select("lang", none["band"].alias("band"), "cell", "n", F.lit(0).alias("level_of"))
    every = cells.groupBy("cell").agg(F.sum("n").alias("n")).select(*[x.alias(c) for c, x in none.items()], "cell", "n", F.lit(1).alias("level_of"))
    both = cells.select("lang", "band", "cell", "n", F.lit(2).alias("level_of")).union(whole).union(every)
    by = Window.partitionBy("level_of", "lang", "band")
    upto = F.sum("n").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(by)).where((F.col("level_of") < 2) | (F.col("_all") >= ENOUGH))
    found = ranked.where(F.col("_upto") >= F.col("_all") * quantile).groupBy("level_of", "lang", "band").agg((F.min("cell") * GRID).alias("level"))
    return found.select((F.col("level_of") == 1).alias("every"), "lang", "band", "level")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, folder: str | None = None) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept), one row per row of docs. Trusted are the documents labelled with quality 1."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "quality")
    trusted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1")
    trusted = cut(trusted.select("doc_id", F.lit(True).alias("_mine")))
    # a broadcast spares the shuffle of all texts; beyond so many ids a merge join
    docs = docs.select("doc_id", "lang", "text").join(trusted.hint("broadcast" if trusted.count() <= IDS else "merge"), "doc_id", "left")
    mine = docs.where("_mine")
    train(mine, folder)
    words = train_words(_rows(mine), folder, plan_of(docs, folder))
    rows = _rows(docs, F.coalesce("_mine", F.lit(False)).alias("_mine"))
    sums = _score(rows.select("_key", "text", F.when(F.col("_mine"), 3).otherwise(2).alias("flag")), words)
    # a trusted document is judged without what it alone has taught the model
    nats = F.when(F.col("_mine"), F.col("held")).otherwise(F.col("nats")).alias("nats")
    scored = cut(rows.drop("text").join(sums, "_key").select("doc_id", "lang", "_mine", "bytes", nats))
    for name in ("one", *[f"s0{at}" for at in range(ROUNDS)], *[f"s1{at}" for at in range(SINGLE_ROUNDS)]):
        _drop(spark, f"{folder}/{name}")
    level = cut(thresholds(scored.where("_mine"), quantile))
    # a few rows per language; the row for all languages stands in for those without one
    every = level.where("every").select(F.col("level").alias("_every"))
    of = lambda rows, *names: rows.select(*[F.col(n).alias(f"_{n}") for n in names])
    whole = of(level.where("NOT every AND band IS NULL"), "lang", "level").withColumnRenamed("_level", "_whole")
    banded = of(level.where("NOT every AND band IS NOT NULL"), "lang", "band", "level")
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    out = scored.join(whole, same, "left").drop("_lang")
    out = out.join(banded, same & (_band(F.col("bytes")) == F.col("_band")), "left").join(F.broadcast(every), F.lit(True), "left")
    threshold = F.coalesce("_level", "_whole", "_every")
    kept = F.coalesce(F.col("nats") <= threshold, F.lit(False))
    return out.select("doc_id", "lang", F.exp("nats").alias("perplexity"), F.exp(threshold).alias("threshold"), kept.alias("kept"))
