"""Operator 6: n-gram Jaccard join by prefix index with set-relation skipping.

The set of a text is its distinct shingles of k words. All texts with one set are collapsed to it first. The
document frequency of every shingle is then counted exactly over all sets, in buckets of the hash space. A set
whose shingles that occur elsewhere are too few to reach the threshold with any partner is out; the rest keep
only their shared shingles, rarest first, and index the prefix that any partner must meet.

Sets that meet in an index list, directly or through others, form a candidate group; a group is found by linking
each list's members to one of them, not by pairing. A group is joined in blocks of a bounded number of sets:

* index level: a block's lists are cut by set size, and inside by position, so entries of a size or at a
  position that cannot reach the overlap are skipped as a whole;
* answer level: once a set is linked with another, it takes over that one's answers: what is already connected
  needs no look, and the similarities computed for one bound those of the other (Jaccard distance is a metric),
  which settles most pairs without comparing them.

Groups with several blocks share a few leaders, to which all their sets are compared; only what that leaves in
different components is then compared, all of it, in the way that sends fewer rows: the group's blocks against each
other, or, where a group is long and held together by passages alone, the members of each index list, lists with the same
members once. So a chain of neighbours costs as much as its lists. No pair list of a group is ever built, and
results are exact up to collisions of 64-bit hashes.

Scale: two passes over the text; one shuffle of eight bytes per distinct shingle, with the copies of one task
dropped before; everything else is of the size of what may have a partner. Bucket numbers follow the number of
shingles, so a task's share is bounded.

Defined results: null, empty and blank texts have an empty set, no links, and are components of their own;
texts shorter than k words have their whole sequence as one shingle; rows with one doc_id each get a row; a null
doc_id is in no component's name unless there is no other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Spans, mix, sliced
from .common import cut, lean, shuffle_parts, small_batches, spread
from .graph import components

K = 4
#: Threshold as a fraction.
NUM, DEN = 85, 100
#: Sets in a block, and sets to which all blocks of a group are compared.
BLOCK = 96
LEADERS = 8
#: Shingles in a bucket.
BUCKET = 1_500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sets of a batch


def shingles(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one after the other and sorted inside each; and how many each has."""
    words = Spans(texts)
    doc, h = words.doc, words.hash
    count = np.bincount(doc, minlength=words.count)
    n = len(h)
    first = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    gram = np.zeros(len(first), np.uint64)
    for i in range(k):
        gram = mix(gram * _STEP + h[first + i])
    short = np.flatnonzero((count > 0) & (count < k))
    begins = np.cumsum(count) - count
    whole = np.zeros(len(short), np.uint64)
    for j, d in enumerate(short):
        x = np.zeros(1, np.uint64)
        for i in range(begins[d], begins[d] + count[d]):
            x = mix(x * _STEP + h[i : i + 1])
        whole[j] = mix(x + np.uint64(int(count[d])))[0]
    owner = np.concatenate([doc[first], short])
    gram = np.concatenate([gram, whole])
    if len(short):
        order = np.argsort(owner, kind="stable")
        owner, gram = owner[order], gram[order]
    sizes = np.bincount(owner, minlength=words.count)
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        gram[a:b].sort()
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[fresh], np.bincount(owner[fresh], minlength=words.count)


def nodes(gram: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, independent of order; 0 for an empty one."""
    ends = np.cumsum(sizes)
    out = []
    for seed in (1, 2):
        sums = np.zeros(len(gram) + 1, np.uint64)
        np.cumsum(mix(gram ^ mix(np.full(1, seed, np.uint64))), out=sums[1:])
        total = sums[ends] - sums[ends - sizes]
        out.append(np.where(sizes > 0, mix(total + sizes.astype(np.uint64)), np.uint64(0)).view(np.int64))
    return out[0], out[1]


SET = "doc_id long, digest long, n_shingles long, node long, check long"


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        gram, sizes = shingles(batch.column("text"), k)
        node, check = nodes(gram, sizes)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(sizes.astype(np.int64)), pa.array(node), pa.array(check)], names=["doc_id", "digest", "n_shingles", "node", "check"])


# ---------------------------------------------------------------- document frequencies


def _gathered(batches: Iterator[pa.RecordBatch], k: int, most: int = 800_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Sets not yet seen by this task, about so many shingles at a time: their nodes and sizes, and for each shingle its owner among them."""
    seen: set[int] = set()
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def out():
        node, sizes, gram = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return node, sizes, np.repeat(np.arange(len(node)), sizes), gram

    for batch in sliced(batches):
        gram, sizes = shingles(batch.column("text"), k)
        node, _ = nodes(gram, sizes)
        fresh = np.zeros(len(node), bool)
        for i, x in enumerate(node.tolist()):
            if sizes[i] and x not in seen:
                seen.add(x)
                fresh[i] = True
        gram = gram[np.repeat(fresh, sizes)]
        parts.append((node[fresh], sizes[fresh], gram))
        held += len(gram)
        if held >= most:
            yield out()
            parts, held = [], 0
    if held:
        yield out()


def _deal(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Per bucket of the hash space: the sets with shingles there (node, size, how many) and these shingles."""
    for node, sizes, owner, gram in _gathered(batches, k):
        bucket = ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket * len(node) + owner, kind="stable")
        bucket, owner, gram = bucket[order], owner[order], gram[order]
        edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])
        runs = np.diff(np.r_[edge, len(gram)]).astype(np.int32)
        run_bucket, run_owner = bucket[edge], owner[edge]
        at = np.flatnonzero(np.r_[True, run_bucket[1:] != run_bucket[:-1]])
        to = np.r_[at[1:], len(edge)]
        gram_at = np.r_[edge, len(gram)]
        out: list[list] = [[], [], [], [], []]
        for a, b in zip(at.tolist(), to.tolist(), strict=True):
            o = run_owner[a:b]
            for column, value in zip(out, (int(run_bucket[a]), node[o].tobytes(), sizes[o].astype(np.int32).tobytes(), runs[a:b].tobytes(), gram[gram_at[a] : gram_at[b]].tobytes()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "nodes", "sizes", "runs", "grams"])


DEALT = "bucket int, nodes binary, sizes binary, runs binary, grams binary"
SHARED = "place int, nodes binary, sizes binary, runs binary, grams binary, freqs binary"


def _count(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """Of all shingles of a bucket those in two sets or more, with their frequency, sent to the place of their set."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for nodes_, sizes, runs, grams in zip(*(batch.column(c).to_pylist() for c in ("nodes", "sizes", "runs", "grams")), strict=True):
            parts.append((np.frombuffer(nodes_, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(runs, np.int32), np.frombuffer(grams, np.uint64)))
    if not parts:
        return
    node, size, run, gram = (np.concatenate([p[i] for p in parts]) for i in range(4))
    del parts
    known, first, which = np.unique(node, return_index=True, return_inverse=True)
    size, owner = size[first], np.repeat(which, run)
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    once = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]  # another task may have sent the same set
    gram, owner = gram[once], owner[once]
    edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    freq = np.repeat(np.diff(np.r_[edge, len(gram)]), np.diff(np.r_[edge, len(gram)]))
    take = freq >= 2
    gram, owner, freq = gram[take], owner[take], freq[take]
    place = (mix(known.view(np.uint64)) % np.uint64(places)).astype(np.int64)[owner]
    order = np.argsort(place * len(known) + owner, kind="stable")
    gram, owner, freq, place = gram[order], owner[order], freq[order], place[order]
    for p in np.unique(place).tolist():
        a, b = np.searchsorted(place, p), np.searchsorted(place, p, side="right")
        o = owner[a:b]
        edge = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        runs = np.diff(np.r_[edge, len(o)]).astype(np.int32)
        values = [known[o[edge]].tobytes(), size[o[edge]].astype(np.int32).tobytes(), runs.tobytes(), gram[a:b].tobytes(), freq[a:b].astype(np.int32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], names=["place", "nodes", "sizes", "runs", "grams", "freqs"])


ALIVE = "node long, size int, grams binary"


def _alive(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The sets that may have a partner, with their shared shingles, rarest first (ties by hash)."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for nodes_, sizes, runs, grams, freqs in zip(*(batch.column(c).to_pylist() for c in ("nodes", "sizes", "runs", "grams", "freqs")), strict=True):
            run = np.frombuffer(runs, np.int32)
            parts.append((np.repeat(np.frombuffer(nodes_, np.int64), run), np.repeat(np.frombuffer(sizes, np.int32), run), np.frombuffer(grams, np.uint64), np.frombuffer(freqs, np.int32)))
    if not parts:
        return
    node, size, gram, freq = (np.concatenate([p[i] for p in parts]) for i in range(4))
    del parts
    known, which, have = np.unique(node, return_inverse=True, return_counts=True)
    take = (den * have[which].astype(np.int64)) >= num * size.astype(np.int64)
    node, size, gram, freq = node[take], size[take], gram[take], freq[take]
    order = np.lexsort((gram, freq, node))
    node, size, gram = node[order], size[order], gram[order]
    edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    ends = np.r_[edge[1:], len(node)]
    for i in range(0, len(edge), 500):
        a, b = edge[i : i + 500], ends[i : i + 500]
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(size[a], pa.int32()), pa.array([gram[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], names=["node", "size", "grams"])


# ---------------------------------------------------------------- bounds


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The smallest o with o / (a + b - o) >= num / den."""
    return -(-num * (a + b) // (num + den))


def prefix(n: int, num: int, den: int) -> int:
    """So many of a set's first elements meet the same of any partner."""
    return n - -(-num * n // den) + 1


def _postings(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes_, grams = [], []
        for node, size, held in zip(batch.column("node").to_pylist(), batch.column("size").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            gram = np.frombuffer(held, np.int64)
            gram = gram[: max(0, prefix(size, num, den) - (size - len(gram)))]
            nodes_.append(np.full(len(gram), node, np.int64))
            grams.append(gram)
        if nodes_:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(nodes_))], names=["gram", "node"])


# ---------------------------------------------------------------- joining a block


class Block:
    """Sets of a block, their index, and what is known of their similarities so far."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, int, int]], num: int, den: int):
        """rows: (node, size, shared shingles rarest first, side, label). Sets with one label are known to be
        connected; sides, where not 0, are only compared with the other side."""
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.num, self.den = num, den
        self.node, self.size = [r[0] for r in rows], [r[1] for r in rows]
        self.gram = [r[2].tolist() for r in rows]
        self.side, self.label = [r[3] for r in rows], [r[4] for r in rows]
        self.members = [set(g) for g in self.gram]
        self.lists: dict[int, dict[int, tuple[list[int], list[int]]]] = {}
        self.known: list[dict[int, float]] = [{} for _ in rows]
        self.compared = 0
        first: dict[int, int] = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(self.label)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def _index(self, i: int, upto: int) -> None:
        skipped = self.size[i] - len(self.gram[i])
        for j in range(max(0, upto - skipped)):
            by_size = self.lists.setdefault(self.gram[i][j], {})
            at, who = by_size.setdefault(self.size[i], ([], []))
            p = bisect_right(at, skipped + j)
            at.insert(p, skipped + j)
            who.insert(p, i)

    def _linked(self, i: int, j: int) -> bool:
        """From what i's and j's similar sets already know, or else by comparing them."""
        limit, slack = 1 - self.num / self.den, 1e-9
        a, b = self.known[i], self.known[j]
        for r in a.keys() & b.keys() if len(a) < 16 else [r for r in b if r in a]:
            if abs(a[r] - b[r]) > limit + slack:
                return False
            if a[r] + b[r] < limit - slack:
                return True
        self.compared += 1
        both = len(self.members[i] & self.members[j])
        either = self.size[i] + self.size[j] - both
        d = 1 - both / either
        root = self.root(j)
        if root == j:
            a[j] = d
        b.setdefault(j, 0.0)
        if self.root(i) == i:
            b[i] = d
            a.setdefault(i, 0.0)
        return self.den * both >= self.num * either

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of nodes that connect what the sets' links connect, and no more."""
        for i, size in enumerate(self.size):
            reach = prefix(size, self.num, self.den)
            skipped = size - len(self.gram[i])
            seen: set[int] = set()
            for j in range(max(0, reach - skipped)):
                here = skipped + j
                for other, (at, who) in self.lists.get(self.gram[i][j], {}).items():
                    if self.den * other < self.num * size:
                        continue  # no set of this size reaches the threshold
                    need = least_overlap(size, other, self.num, self.den)
                    if size - here < need:
                        continue  # nor at this place of this set
                    for x in who[: bisect_right(at, other - need)]:  # nor beyond that place of theirs
                        if x in seen:
                            continue
                        seen.add(x)
                        if self.side[i] and self.side[i] == self.side[x]:
                            continue
                        if (a := self.root(i)) != (b := self.root(x)) and self._linked(i, x):
                            self.parent[max(a, b)] = min(a, b)
                            yield self.node[i], self.node[x]
            self._index(i, reach)


LINK = "a long, b long"


def _join(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; each block is joined as soon as its rows end."""

    def done(rows):
        pairs = list(Block(rows, num, den).links()) if len(rows) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for key, node, size, held, side, label in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "size", "grams", "side", "label")), strict=True):
            if key != now:
                yield from done(rows)
                now, rows = key, []
            rows.append((node, size, np.frombuffer(held, np.uint64), side, label))
    yield from done(rows)


def _join_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: block string, node, size, grams, side, label."""
    parts = shuffle_parts(rows.sparkSession)
    dealt = rows.select("block", "node", "size", "grams", "side", "label").repartition(parts, "block").sortWithinPartitions("block", "node")
    return dealt.mapInArrow(lean(lambda it: _join(it, num, den)), LINK)


# ---------------------------------------------------------------- the operator


def alive_sets(docs: DataFrame, total: int, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, size, grams): every set that may have a partner, with its shared shingles, rarest first."""
    spark = docs.sparkSession
    buckets = max(shuffle_parts(spark), -(-total // BUCKET))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    dealt = texts.mapInArrow(lean(lambda it: _deal(it, k, buckets)), DEALT).repartitionById(buckets, F.col("bucket"))
    shared = dealt.mapInArrow(lean(lambda it: _count(it, buckets)), SHARED).repartitionById(buckets, F.col("place"))
    return shared.mapInArrow(lean(lambda it: _alive(it, num, den)), ALIVE)


def _lists(posts: DataFrame) -> DataFrame:
    """posts of the lists that hold several labels, each set of members once however many lists have it. posts: (list, node, root, label)."""
    sums = [F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(20,0)")).alias(f"_s{seed}") for seed in (11, 13)]
    named = posts.groupBy("list").agg(F.count("*").alias("_n"), F.min("label").alias("_a"), F.max("label").alias("_b"), *sums).where("_a <> _b")
    once = named.groupBy("_n", "_s11", "_s13").agg(F.min("list").alias("list")).select("list", "_n")
    return cut(posts.join(spread(once), "list"))


def _ways(members: DataFrame, posts: DataFrame) -> DataFrame:
    """(root, node, label): the sets of large groups under what they are joined by, which is their whole group or, where fewer rows are sent so, its lists."""
    large = members.select("node", F.col("root").alias("_root"), "label")
    listed = _lists(posts.join(spread(large), "node").select(F.col("gram").alias("list"), "node", F.col("_root").alias("root"), "label"))
    rows = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK)
    by_list = listed.groupBy("root").agg(F.sum(rows("_n") / F.col("_n")).alias("_by_list"))
    by_group = members.groupBy("root").agg(F.count("*").alias("_n")).select("root", rows("_n").alias("_by_group"))
    way = cut(by_group.join(by_list, "root", "left").select("root", (F.coalesce("_by_list", F.lit(0.0)) < F.col("_by_group")).alias("_listed")))
    whole = members.join(spread(way.where("NOT _listed").select("root")), "root").select(F.concat(F.lit("g"), F.col("root").cast("string")).alias("root"), "node", "label")
    parts = listed.join(spread(way.where("_listed").select("root")), "root").select(F.concat(F.lit("l"), F.col("list").cast("string")).alias("root"), "node", "label")
    return cut(whole.union(parts))


def links(alive: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): links between sets that connect exactly what all links of the join connect. alive must be stored."""
    posts = cut(alive.mapInArrow(lean(lambda it: _postings(it, num, den)), "gram long, node long"))
    lead = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")))
    lists = posts.groupBy("gram").agg(lead.getField("n").alias("lead"), F.count("*").alias("_n")).where("_n > 1").select("gram", "lead")
    meets = posts.join(spread(lists), "gram").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    group = components(meets)

    sized = group.groupBy("root").agg(F.count("*").alias("_n"))
    placed = group.join(spread(sized), "root").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("long"))
    at = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col("_blocks"))
    placed = cut(placed.select("node", "root", "_blocks", at.alias("_at")))
    sets = alive.join(placed, "node")

    name = lambda *c: F.concat_ws("/", *[x.cast("string") for x in c])
    own = sets.select(name(F.col("root"), F.col("_at")).alias("block"), "node", "size", "grams", F.lit(0).alias("side"), F.col("node").alias("label"))
    large = placed.where("_blocks > 1")
    # the leaders of a group are the sets with the lowest hashes: one for each of LEADERS shares of its blocks
    low = large.groupBy("root", "_blocks", "_at").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))).alias("low"))
    best = low.groupBy("root", "_blocks", F.pmod("_at", F.lit(LEADERS)).alias("_r")).agg(F.min(F.struct("low", "_at")).alias("m"))
    best = best.select("root", "_blocks", "m.low", "m._at")
    best = best.select(F.col("low.node").alias("node"), F.col("_at").alias("_home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_to"), "root")
    leaders = best.where("_to <> _home").join(alive, "node")
    leaders = leaders.select(name(F.col("root"), F.col("_to")).alias("block"), "node", "size", "grams", F.lit(0).alias("side"), F.col("node").alias("label"))
    near = cut(_join_blocks(own.union(leaders), num, den))
    if not large.limit(1).count():
        return near

    # what large groups have left: their sets in components so far
    so_far = components(near)
    label = so_far.select("node", F.col("root").alias("_label"))
    members = large.join(label, "node", "left").select("node", "root", F.coalesce("_label", "node").alias("label"))
    members = _ways(cut(members), posts)
    parts = cut(members.groupBy("root", "label").agg(F.count("*").alias("_m")))
    split = parts.groupBy("root").agg(F.count("*").alias("_labels"), F.sum(F.when(F.col("_m") < BLOCK, F.col("_m")).otherwise(0)).alias("_few")).where("_labels > 1")
    parts = cut(parts.join(spread(split), "root"))
    # a component of many sets has blocks of its own; those of few sets share blocks
    many = F.col("_m") >= BLOCK
    count = F.ceil(F.when(many, F.col("_m")).otherwise(F.col("_few")) / BLOCK).cast("long")
    parts = parts.select("root", "label", F.when(many, F.col("label").cast("string")).otherwise(F.lit("few")).alias("_kind"), count.alias("_count"))
    members = members.join(parts, ["root", "label"])
    own_blocks = F.when(F.col("_kind") == "few", F.xxhash64("label", F.lit(3))).otherwise(F.xxhash64("node", F.lit(3)))
    members = cut(members.select("node", "root", "label", "_kind", F.pmod(own_blocks, F.col("_count")).alias("_b")))
    blocks = cut(members.groupBy("root", "_kind", "_b").agg(F.count("*").alias("_n")))
    x = blocks.select("root", F.col("_kind").alias("k1"), F.col("_b").alias("b1"))
    y = blocks.select("root", F.col("_kind").alias("k2"), F.col("_b").alias("b2"))
    order = F.struct("k1", "b1") <= F.struct("k2", "b2")
    pairs = x.join(y, "root").where(order & ((F.col("k1") != F.col("k2")) | (F.col("k1") == "few")))
    pairs = pairs.withColumn("_pair", name(F.col("root"), F.col("k1"), F.col("b1"), F.col("k2"), F.col("b2")))
    one = pairs.select("root", "_pair", F.col("k1").alias("_kind"), F.col("b1").alias("_b"), F.when((F.col("k1") == F.col("k2")) & (F.col("b1") == F.col("b2")), 0).otherwise(1).alias("side"))
    two = pairs.where("k1 <> k2 OR b1 <> b2").select("root", "_pair", F.col("k2").alias("_kind"), F.col("b2").alias("_b"), F.lit(2).alias("side"))
    rows = members.join(one.union(two), ["root", "_kind", "_b"])
    rows = rows.select("node", "label", "side", F.col("_pair").alias("block")).join(alive, "node")
    return near.union(_join_blocks(rows, num, den))


def _digest(col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")))


def _grouped(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_shingles, node, check), one row per row of docs, and (node, check, _first, root) of the sets; root is null without links."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _digest().alias("digest"))
    sets = cut(rows.mapInArrow(lean(lambda it: _sets(it, k)), SET))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    alive = cut(alive_sets(docs, total, k, num, den))
    found = cut(components(links(alive, num, den)))

    full = sets.where("n_shingles > 0")
    named = full.groupBy("node", "check").agg(F.min("doc_id").alias("_first"))
    return sets, cut(named.join(found, "node", "left"))


def near_groups(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs."""
    sets, named = _grouped(docs, k, num, den)
    linked = named.where("root IS NOT NULL").groupBy("root").agg(F.min("_first").alias("_least"))
    named = named.join(spread(linked), "root", "left").select("node", "check", F.coalesce("_least", "_first").alias("_name"))
    out = sets.join(named, ["node", "check"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_name", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: that whose doc_id names it, of several texts with it that of the lowest digest.
    Rows that agree in doc_id and text are one document; texts without words are components of their own."""
    sets, named = _grouped(docs, k, num, den)
    own = F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    least = sets.where("n_shingles > 0").groupBy("node", "check").agg(F.min(own).alias("_own")).join(named, ["node", "check"])
    alone = F.when(F.col("root").isNull(), F.col("check"))
    stay = least.groupBy(F.coalesce("root", "node"), alone).agg(F.min("_own").alias("_own")).select("_own._id", "_own._digest")
    blank = sets.where("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    stay = stay.union(blank).distinct()
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (_digest() == stay["_digest"]), "left_semi")
