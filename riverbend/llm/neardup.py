"""Operator 10: near-duplicate vectors by lattice hashing.

Equal vectors are collapsed. Of each distinct vector the direction is projected to eight dimensions at random, `blocks`
times per table, and each projection is decoded to the nearest point of the lattice E8; the points of a table make up a
cell. Beside its own cell a vector probes the neighbouring cells nearest to it. Vectors that meet in a cell, one of them at home there, are compared by cosine in double
precision. A pair that meets in several cells counts in the first of them only, which both can tell from their codes.

Recall: how often two vectors at the threshold meet in a table depends on the cells alone and not on the vectors;
it is measured on simulated projections, and as many tables are taken as bring the recall of such pairs to RECALL at
least, TABLES at least. Closer pairs are found more surely. Tests measure it against brute force.

Scale: cells shrink and gain blocks as the vectors grow in number (layout), so that a vector meets about MEET unrelated
ones in a table at any size, and the tables grow as its fifth root or so. Cells hold ids until their members are counted, with map-side
combining; vectors whose cells hold nobody else drop out there. A cell's members are dealt to blocks of bounded size and
compared block against block in numpy, in tasks that return counts and a spanning forest, not pairs; a cell of any
size is compared in full.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are
their own component; equal vectors are linked; vectors of different length are not compared; repeated rows with one
vec_id count each; a null vec_id names a component only where there is no other; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix
from .common import cut, lean, shuffle_parts, spread
from .e8 import MINIMAL, nearest, steps
from .graph import components

THRESHOLD = 0.95
TABLES = 10
PROBES = 2
#: Widest cells of one block, and most blocks.
WIDTH, BLOCKS = 1.15, 5
#: Chance that two unrelated directions meet in a cell of width 1, and how many such meetings a vector should have in a table.
FAR, MEET = 1.2e-4, 10
RECALL = 0.995
BLOCK = 256
SEED = 8


def _rows_by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length that occurs; rows that are null or hold nulls are left out."""
    lists = column.to_pylist() if column.null_count or column.values.null_count else None
    if lists is not None:
        usable: dict[int, list[int]] = {}
        for i, v in enumerate(lists):
            if v and all(x is not None for x in v):
                usable.setdefault(len(v), []).append(i)
        for rows in usable.values():
            yield np.array(rows), np.array([lists[i] for i in rows], np.float64)
        return
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        if n:
            yield rows, flat[starts[rows][:, None] + np.arange(n)]


def _usable(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


NAMED = "vec_id long, node long, check long, unit array<double>"


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each usable vector's components, and its direction."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            batch = whole.slice(at, 2_000)
            node: list = [None] * batch.num_rows
            check: list = [None] * batch.num_rows
            unit: list = [None] * batch.num_rows
            for rows, x in _rows_by_length(batch.column("embedding")):
                good = _usable(x)
                rows, x = rows[good], x[good]
                bits = (x + 0.0).view(np.uint64)
                place = np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                a, b = (mix(mix(bits + place * np.uint64(k)).sum(axis=1) + np.uint64(k)).view(np.int64).tolist() for k in (1, 3))
                for i, p, q, u in zip(rows.tolist(), a, b, _unit(x), strict=True):
                    node[i], check[i], unit[i] = p, q, u
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(unit, pa.list_(pa.float64()))], names=["vec_id", "node", "check", "unit"])


CODED = "node long, copies long, own array<long>, probe array<long>, packed binary"


def decoded(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of points (n, blocks, 8): the own one (n, blocks, 8), and the probed ones (n, probes, blocks, 8), which differ from it in one block."""
    n, blocks, _ = x.shape
    point = nearest(x.reshape(-1, 8))
    which, gain = (v.reshape(n, blocks * probes) for v in steps(x.reshape(-1, 8), point, probes))
    point = point.reshape(n, blocks, 8)
    best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
    probed = np.repeat(point[:, None], probes, axis=1)
    rows, at = np.arange(n)[:, None], np.arange(probes)[None, :]
    probed[rows, at, best // probes] += MINIMAL[np.take_along_axis(which, best, axis=1)]
    return point, probed


@functools.cache
def meeting(width: float, blocks: int, threshold: float = THRESHOLD, probes: int = PROBES, pairs: int = 20_000) -> float:
    """How often two vectors at the threshold meet in one table: one at home in a cell that is the other's own or probed."""
    rng = np.random.default_rng(SEED)
    x = rng.uniform(0, 2, (pairs, blocks, 8))
    y = x + rng.standard_normal(x.shape) * (math.sqrt(2 * (1 - threshold)) / width)
    (a, to_a), (b, to_b) = decoded(x, probes), decoded(y, probes)
    equal = lambda p, q: (p == q).all(axis=(-2, -1))
    return float((equal(a, b) | equal(a[:, None], to_b).any(axis=1) | equal(b[:, None], to_a).any(axis=1)).mean())


def layout(n: int, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL) -> tuple[int, int, float]:
    """(tables, blocks, width) for so many vectors: the fewest tables, then the fewest blocks, with MEET unrelated meetings a table."""
    found = []
    for blocks in range(1, BLOCKS + 1):
        width = ((MEET / max(n, MEET)) ** (1 / blocks) / FAR) ** (1 / 8)
        width = round(min(width, WIDTH if blocks == 1 else 2 * WIDTH), 3)
        met = min(max(meeting(width, blocks, threshold, probes), 1e-4), 1 - 1e-9)
        found.append((max(TABLES, math.ceil(math.log(1 - recall) / math.log(1 - met))), blocks, width))
        if found[-1][0] == TABLES:
            break
    return min(found)


def codes(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, blocks: int = 1, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n, tables) and probed cells (n, tables, probes) of unit vectors (n, d), as 64-bit hashes."""
    n, d = unit.shape
    own, probe = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    place = np.arange(1, 8 * blocks + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for t in range(tables):
        rng = np.random.default_rng((seed, t, d))
        x = unit @ (rng.standard_normal((d, 8 * blocks)) / width) + rng.uniform(0, 2, 8 * blocks)
        salt = np.uint64(t * 1_000_003 + d)
        cell = lambda p: mix(mix(p.reshape(*p.shape[:-2], -1).astype(np.uint64) + place).sum(axis=-1) + salt).view(np.int64)
        point, probed = decoded(x.reshape(n, blocks, 8), probes)
        own[:, t], probe[:, t] = cell(point), cell(probed)
    return own, probe


def _code(batches: Iterator[pa.RecordBatch], tables: int, probes: int, width: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """The cells of each vector, and, packed, all that comparing it needs: its direction, its own cells and those it probes."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            batch = whole.slice(at, 2_000)
            for rows, x in _rows_by_length(batch.column("unit")):
                own, probe = codes(x, tables, probes, width, blocks)
                take = batch.take(pa.array(rows))
                probe = probe.reshape(len(probe), -1)
                lists = [pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.reshape(-1)) for v in (own, probe)]
                packed = np.concatenate([np.ascontiguousarray(x).view(np.int64), own, probe], axis=1)
                yield pa.RecordBatch.from_arrays([take.column("node"), take.column("copies"), *lists, pa.array([r.tobytes() for r in packed], pa.binary())], names=["node", "copies", "own", "probe", "packed"])


def _first_meeting(own: np.ndarray, probe: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
    """Whether cell is the first, by table, where the pairs (i, j) meet; in one table their common home comes first."""
    at = np.zeros(len(i), np.int64)
    open_ = np.ones(len(i), bool)
    for t in range(own.shape[1]):
        a, b = own[i, t], own[j, t]
        same = a == b
        j_visits = (probe[j, t] == a[:, None]).any(axis=1)
        i_visits = (probe[i, t] == b[:, None]).any(axis=1)
        found = same | j_visits | i_visits
        # where both visit each other the home with the lower code counts
        home = np.where(same, a, np.where(j_visits & i_visits, np.minimum(a, b), np.where(j_visits, a, b)))
        at = np.where(open_ & found, home, at)
        open_ &= ~found
        if not open_.any():
            break
    return (at == cell) & ~open_


FOUND = "a long, b long, links long"


def compare(node, copies, unit, own, probe, role, part, mode: str, cell: int, threshold: float) -> list[tuple]:
    """(node, linked node or None, links to count) of the members of a task. role: 0 at home, 1 visiting.

    mode: 'all' for a cell in one block, 'home' for two blocks of home members, 'visit' for home against visitors."""
    near = unit @ unit.T >= threshold
    allowed = ~(role[:, None] & role[None, :]).astype(bool)
    if mode == "home" and len(np.unique(part)) > 1:
        allowed &= part[:, None] != part[None, :]
    if mode == "visit":
        allowed &= role[:, None] != role[None, :]
    near &= allowed
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    if not len(i):
        return []
    counted = _first_meeting(own, probe, i, j, cell)
    i, j = i[counted], j[counted]
    links = np.zeros(len(node), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    out = [(int(node[k]), None, int(links[k])) for k in np.flatnonzero(links)]
    kept = np.zeros_like(near)
    kept[i, j] = kept[j, i] = True
    left = np.ones(len(node), bool)
    for k in np.flatnonzero(links):  # a spanning forest of what was counted here
        if not left[k]:
            continue
        left[k], stack = False, [k]
        while stack:
            at = stack.pop()
            fresh = np.flatnonzero(kept[at] & left)
            left[fresh] = False
            stack += fresh.tolist()
            out += [(int(node[at]), int(node[f]), 0) for f in fresh]
    return out


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task."""

    def done(rows):
        if len(rows) < 2:
            return
        _, node, copies, packed, role, part, mode, cell = zip(*rows, strict=True)
        held = np.frombuffer(b"".join(packed), np.int64).reshape(len(rows), -1)
        d = held.shape[1] - tables * (1 + probes)
        unit, own, probe = np.ascontiguousarray(held[:, :d]).view(np.float64), held[:, d : d + tables], held[:, d + tables :].reshape(len(rows), tables, probes)
        out = compare(*(np.array(x, np.int64) for x in (node, copies)), unit, own, probe, *(np.array(x, np.int64) for x in (role, part)), mode[0], cell[0], threshold)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "links"])

    now, rows = None, []
    names = ("task", "node", "copies", "packed", "role", "part", "mode", "cell")
    for whole in batches:
        for at in range(0, whole.num_rows, 1_000):
            batch = whole.slice(at, 1_000)
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if row[0] != now:
                    yield from done(rows)
                    now, rows = row[0], []
                rows.append(row)
    yield from done(rows)


def found_links(vectors: DataFrame, threshold: float, tables: int, probes: int) -> DataFrame:
    """From the coded vectors to (a, b, links): counts of a's links to other vectors, and pairs that connect what is linked."""
    keys = vectors.select("node", F.explode("own").alias("cell"), F.lit(0).alias("role")).union(vectors.select("node", F.explode("probe").alias("cell"), F.lit(1).alias("role")))
    held = keys.groupBy("cell").agg(F.sum(1 - F.col("role")).alias("_home"), F.sum("role").alias("_visit")).where("_home > 0 AND _home + _visit > 1")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("long")
    met = keys.join(spread(held), "cell").withColumn("_h", blocks("_home")).withColumn("_v", blocks("_visit"))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("role") == 0, F.col("_h")).otherwise(F.col("_v"))))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    task = lambda mode, x, y: F.struct(F.lit(mode).alias("mode"), F.concat_ws("/", F.col("cell").cast("string"), F.lit(mode), x.cast("string"), y.cast("string")).alias("task"))
    part = F.col("part")
    at_home = F.transform(upto("_h"), lambda j: task("home", F.least(part, j), F.greatest(part, j)))
    to_visit = F.when(F.col("_visit") > 0, F.transform(upto("_v"), lambda j: task("visit", part, j)))
    visits = F.transform(upto("_h"), lambda i: task("visit", i, part))
    whole = F.array(task("all", F.lit(0), F.lit(0)))
    several = F.when(F.col("role") == 0, F.concat(at_home, F.coalesce(to_visit, F.array().cast("array<struct<mode:string,task:string>>")))).otherwise(visits)
    tasks = F.when(F.col("_home") + F.col("_visit") <= BLOCK, whole).otherwise(several)
    rows = met.select("node", "cell", "role", "part", F.explode(tasks).alias("_t")).select("node", "cell", "role", "part", "_t.mode", "_t.task")
    dealt = rows.join(vectors.select("node", "copies", "packed"), "node").repartition(shuffle_parts(vectors.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(lean(lambda it: _compare(it, threshold, tables, probes)), FOUND)


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of table."""
    source = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    named = cut(source.mapInArrow(lean(_name), NAMED))
    rows = named.select("vec_id", "node", "check")
    alike = named.where("node IS NOT NULL").groupBy("node", "check").agg(F.count("*").alias("copies"), F.min("vec_id").alias("_first"), F.first("unit").alias("unit"))
    alike = cut(alike)
    tables, blocks, width = layout(alike.count(), threshold, probes, recall)
    vectors = cut(alike.select("node", "copies", "unit").mapInArrow(lean(lambda it: _code(it, tables, probes, width, blocks)), CODED))
    found = cut(found_links(vectors, threshold, tables, probes))
    links = found.groupBy("a").agg(F.sum("links").alias("_links")).select(F.col("a").alias("node"), "_links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    known = alike.drop("unit").join(links, "node", "left").join(roots, "node", "left")
    known = cut(known.select("node", "check", "copies", "_first", "root", F.coalesce("_links", F.lit(0)).alias("_links")))
    least = known.where("root IS NOT NULL").groupBy("root").agg(F.min("_first").alias("_least"))
    known = known.join(spread(least), "root", "left").select("node", "check", (F.col("copies") - 1 + F.col("_links")).alias("_n"), F.coalesce("_least", "_first").alias("_name"))
    out = rows.join(known, ["node", "check"], "left")
    name = F.coalesce("_name", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))
