"""Operator 1: mixing sources to target weights by systematic sampling.

Each document expects target / source size copies. Expected copies are summed over the documents of a
source in a fixed order, one random offset per source is added, and a document is emitted once for each
integer boundary that its own interval crosses. Sums are of integers (units of 2**-24 copies), so they
are exact, independent of how rows are dealt out, and reruns agree.

Documents are taken in order of size class, first digit of the MD5 of doc_id, size, MD5 and doc_id: neighbours then
have about the same size, so whichever of them is taken, the words come near the target.

Scale: one narrow table of sizes is computed once. The prefix sum has two levels: groups of
(source, size class, and in large classes MD5 digits and size) are summed with map-side aggregation, a window over these few
groups gives each its start, and a window within each group, which holds a bounded share of any hot
source, gives each document's own start. Groups are by prefixes of the one order of documents, so how finely
they are parted never changes a result. Nothing but one row per source is joined by broadcast, and only
after its size was checked.

Defined results: null text has no words (size 0); null source is a source of its own, the last; repeated
rows count each; empty input gives no rows; sources without words have target 0; extra columns are kept
by sample() and ignored by plan().
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

UNIT = 1 << 24
#: Above this many sources, their targets are joined by a shuffle.
BROADCAST_SOURCES = 2_000
#: Above this many pairs of source and size class, the digits that part them are joined by a shuffle.
BROADCAST_CLASSES = 100_000
PER_GROUP = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _source_key(col: Column) -> Column:
    """Never null, and in code point order of the source with null last."""
    return F.coalesce(F.concat(F.lit("0"), col.cast("string")), F.lit("1"))


def _size_class(size: Column) -> Column:
    """Sizes with as many digits and the same first three; increases with size."""
    digits = size.cast("string")
    return (F.length(digits) * 1000 + F.substring(F.rpad(digits, 3, "0"), 1, 3).cast("int")).cast("int")


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """From (_src, source_size), one row per source, to (_src, source_size, target).

    The i-th source in order of _src weighs weights[i % len(weights)]; all share the sum of the sizes.
    A target stops at cap times its source's size and the excess is reshared by weight. In order of
    cap / weight the capped sources come first, so two running sums find where capping ends."""
    order = Window.orderBy("_src")
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sources.select("_src", "source_size", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).alias("_w"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_src")
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    )
    first = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.withColumn("_first", first).select("_src", "source_size", F.least("_cap", F.coalesce(F.col("_first") * F.col("_w"), F.col("_cap"))).alias("target"))


def _keyed(docs: DataFrame, payload: Column) -> DataFrame:
    """(payload, doc_id, size, and the keys of the order in which copies are summed)."""
    rows = docs.select(payload.alias("_row"), F.col("doc_id").alias("_id"), _source_key(F.col("source")).alias("_src"), word_count(text_of()).alias("size"))
    return rows.withColumn("_class", _size_class(F.col("size"))).withColumn("_h", F.coalesce(F.md5(F.col("_id").cast("string")), F.lit("")))


def _with_copies(rows: DataFrame, narrow: DataFrame, weights: Sequence[float], cap: float, seed: str) -> DataFrame:
    """rows with source_size, target and copies; narrow has the same rows without payload."""
    digits = F.when(F.col("_n") > PER_GROUP, F.ceil(F.log(F.col("_n") / PER_GROUP) / math.log(16))).otherwise(0).cast("int")
    classes = narrow.groupBy("_src", "_class").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    classes = cut(classes.withColumn("_digits", digits))
    sources = cut(classes.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.sum("_n").alias("_rows")))
    n_sources, n_classes = sources.count(), classes.count()
    goal = targets(sources, weights, cap)
    unit = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_src"))), 1, 6), 16, 10).cast("long")
    goal = goal.withColumn("_unit", unit).withColumn("_offset", offset)
    goal = F.broadcast(goal) if n_sources <= BROADCAST_SOURCES else goal

    # a class of many documents is parted by as many hash digits as bring its parts down to about PER_GROUP
    split = classes.select("_src", "_class", "_digits")
    split = F.broadcast(split) if n_classes <= BROADCAST_CLASSES else split
    keys = ["_src", "_class", "_sub", "_part", "_more"]
    parts = {"_sub": "substring(_h, 1, least(_digits, 1))", "_part": "if(_digits > 1, size, -1)", "_more": "substring(_h, 1, if(_digits > 1, _digits, 0))"}
    parted = lambda df: df.join(split, ["_src", "_class"]).withColumns({k: F.expr(x) for k, x in parts.items()}).drop("_digits")
    groups = parted(narrow).groupBy(keys).agg(F.count("*").alias("_n")).join(goal.select("_src", "_unit"), "_src")
    ahead = Window.partitionBy("_src").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, F.coalesce(F.sum(F.col("_n") * F.col("_unit")).over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy(keys).orderBy(F.substring("_h", 1, 1), "size", "_h", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_offset") + F.col("_start") + F.sum("_unit").over(within)
    joined = parted(rows).join(goal, "_src").join(groups, keys)
    return joined.withColumn("copies", (F.shiftright(upto, 24) - F.shiftright(upto - F.col("_unit"), 24)).cast("long"))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document."""
    rows = cut(_keyed(docs, F.col("source")))
    out = _with_copies(rows, rows.drop("_row"), weights, cap, seed)
    return out.select(F.col("_id").alias("doc_id"), F.col("_row").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sample(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as many times as plan() takes it, with the columns of docs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    narrow = cut(_keyed(docs, F.lit(None).cast("int")).drop("_row"))
    out = _with_copies(_keyed(docs, whole), narrow, weights, cap, seed).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
