"""Joins of records with intervals.

Catalyst plans a join on bounds alone as a nested loop. Here every interval is cut into bins of a fixed width and the
join is an equi-join on (key, bin), with the bounds checked again; a record has one bin, so no pair comes twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS
from .resample import seconds


def interval_join(records: DataFrame, intervals: DataFrame, at: Column, low: Column, high: Column, width: int, keys: Sequence[str] = KEYS, how: str = "inner") -> DataFrame:
    """Records with the intervals that hold them, both ends included. at is a number of records; low and high are numbers of intervals."""
    r = records.withColumn("_at", at).withColumn("_bin", F.floor(F.col("_at") / width).cast("long"))
    i = intervals.withColumn("_low", low).withColumn("_high", high)
    i = i.where("_low <= _high").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / width).cast("long"), F.floor(F.col("_high") / width).cast("long"))))
    on = [r[k] == i[k] for k in keys] + [r["_bin"] == i["_bin"], r["_at"] >= i["_low"], r["_at"] <= i["_high"]]
    out = r.join(i, on, how)
    return out.drop(*[i[k] for k in keys]).drop("_bin", "_low", "_high", "_at")


def label_records(records: DataFrame, events: DataFrame, ignore: Sequence[int] = (), keys: Sequence[str] = KEYS, ts: str = "ts", width: int = 3600 * 6) -> DataFrame:
    """records with the column label: the type of the event that holds the record, 0 without one.

    events: keys, type_id, root_cause_start, root_cause_end, extended_effect_end (may be null), event_order; an event ends
    with its extended effect where it has one. Of several events the one latest in event_order counts."""
    kept = events.where(~F.col("type_id").isin(*ignore)) if ignore else events
    low, high = seconds(F.col("root_cause_start")), seconds(F.coalesce("extended_effect_end", "root_cause_end"))
    bin_of = lambda c: F.floor(c / width).cast("long")
    slim = kept.select(*keys, "type_id", "event_order", low.alias("_s"), high.alias("_e")).where("_s <= _e")
    slim = slim.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_s")), bin_of(F.col("_e")))))
    # the few events of a bin as one row, so each record meets one row and is read once
    per_bin = slim.groupBy(*keys, "_bin").agg(F.collect_list(F.struct("event_order", "type_id", "_s", "_e")).alias("_events"))
    held = records.withColumn("_at", seconds(F.col(ts))).withColumn("_bin", bin_of(F.col("_at"))).join(per_bin, [*keys, "_bin"], "left")
    hits = F.filter("_events", lambda x: (x["_s"] <= F.col("_at")) & (F.col("_at") <= x["_e"]))
    last = F.array_max(hits)["type_id"]
    return held.withColumn("label", F.coalesce(last, F.lit(0)).cast("int")).select(*[c for c in records.columns if c != "label"], "label")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, strict: bool = False, width: int = 64) -> DataFrame:
    """Pairs of ranges of a (r_start, r_end, ends excluded) and b (o_start, o_end) of a period that overlap.

    Ranges that only touch count too, with size 0, unless strict."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width).cast("long"), F.floor(F.col(e) / width).cast("long")))
    x, y = a.withColumn("_bin", bins("r_start", "r_end")), b.withColumn("_bin", bins("o_start", "o_end"))
    meets = (F.col("r_start") < F.col("o_end")) & (F.col("o_start") < F.col("r_end")) if strict else (F.col("r_start") <= F.col("o_end")) & (F.col("o_start") <= F.col("r_end"))
    # a pair belongs to the bin where the later of the two begins
    first = F.col("_bin") == F.floor(F.greatest("r_start", "o_start") / width).cast("long")
    return x.join(y, [*keys, "_bin"]).where(meets & first).drop("_bin")
