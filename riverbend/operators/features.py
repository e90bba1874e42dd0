"""Feature bundles: chains of column functions on one frame, compiled to window expressions.

A difference drops the records that have none, as the head of a period, unless its inputs are kept; later steps of its chain see
the records that are left. The records of a bundle are those that its first entry leaves. Each entry is filled once,
forwards then backwards, over these records.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, filled
from .clean import INACTIVE
from .windows import difference


def active_mean(columns: Sequence[Column]) -> Column:
    """Mean over the columns that are not inactive; inactive if all are."""
    known = [F.nullif(c, F.lit(INACTIVE)) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(k, F.lit(0.0)) for k in known])
    count = reduce(lambda a, b: a + b, [k.isNotNull().cast("int") for k in known])
    return F.when(count > 0, total / count).otherwise(F.lit(INACTIVE))


def plain_mean(columns: Sequence[Column]) -> Column:
    """Mean over the columns that are not null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.when(count > 0, total / count)


def _suffixes(names: Sequence[str], prefixes: Sequence[str]) -> dict[str, list[str]]:
    """Suffix to names, for groups of columns that differ in their prefix alone."""
    found: dict[str, list[str]] = {}
    for n in names:
        hit = next((p for p in prefixes if n.startswith(p)), None)
        if hit:
            found.setdefault(n[len(hit) :], []).append(n)
    return found


#: What a step makes: new name to column, and the names of which all must be known in a record for any to be.
Made = tuple[dict[str, Column], list[str]]


def identity(columns: Mapping[str, str], args: Sequence[str], keys: Sequence[str], thinned: bool) -> Made:
    return {n: F.col(f"`{c}`") for n, c in columns.items()}, []


def differenced(columns: Mapping[str, str], args: Sequence[str], keys: Sequence[str], thinned: bool) -> Made:
    """args: k, and keep or drop, whether the inputs stay. thinned: records without values are not there, and the record before is the last that is."""
    k = int(args[0])
    over = f"(PARTITION BY {', '.join(f'`{x}`' for x in keys)} ORDER BY idx)"
    last = lambda c: F.col(f"`{c}`") - F.expr(f"lag(`{c}`, {k}) IGNORE NULLS OVER {over}")
    made = {f"{k}_diff_{n}": last(c) if thinned else difference(F.col(f"`{c}`"), k, keys) for n, c in columns.items()}
    return _kept(columns, args) | made, list(made)


def _kept(columns: Mapping[str, str], args: Sequence[str]) -> dict[str, Column]:
    return {n: F.col(f"`{c}`") for n, c in columns.items()} if "keep" in args else {}


def averaged_executors(columns: Mapping[str, str], args: Sequence[str], keys: Sequence[str], thinned: bool) -> Made:
    groups = _suffixes(list(columns), [f"{i}_" for i in range(1, 6)])
    return _kept(columns, args) | {f"avg_{s}": active_mean([F.col(f"`{columns[n]}`") for n in names]) for s, names in groups.items()}, []


def averaged_nodes(columns: Mapping[str, str], args: Sequence[str], keys: Sequence[str], thinned: bool) -> Made:
    groups = _suffixes(list(columns), [f"node{i}_" for i in range(5, 9)])
    return _kept(columns, args) | {f"avg_node_{s}": plain_mean([F.col(f"`{columns[n]}`") for n in names]) for s, names in groups.items()}, []


#: Name in a chain to function (columns, args, keys, thinned) -> Made, columns from name to column of the frame; further ones may be added.
FUNCTIONS: dict[str, Callable] = {"identity": identity, "difference": differenced, "execavg": averaged_executors, "nodeavg": averaged_nodes}


def _chained(df: DataFrame, names: Sequence[str], chain: str, keys: Sequence[str], entry: int) -> tuple[DataFrame, dict[str, str], str | None]:
    """df with the results of a chain in columns of their own; from their names to these columns; and the column that tells which records it leaves."""
    columns, present = {n: n for n in names}, None
    for i, step in enumerate(chain.split(".")):
        name, *args = step.split("_")
        made, strict = FUNCTIONS[name](columns, args, keys, present is not None)
        at = {n: f"_{entry}_{i}_{n}" for n in made}
        df = df.withColumns({at[n]: c if present is None else F.when(F.col(present), c) for n, c in made.items()})
        if strict:
            left = f"_{entry}_{i}_left"
            df = df.withColumn(left, reduce(lambda a, b: a & b, [F.col(f"`{at[n]}`").isNotNull() for n in strict]))
            df = df.withColumns({at[n]: F.when(F.col(left), F.col(f"`{at[n]}`")) for n in strict})
            present = left if len(strict) == len(made) else present
        columns = at
    return df, columns, present


def _bundled(df: DataFrame, bundle: Mapping[tuple[str, ...], str], keys: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """The records that the first entry leaves, with all entries' results, and from their names to columns."""
    out, first = {}, None
    for e, (names, chain) in enumerate(bundle.items()):
        df, made, present = _chained(df, names, chain, keys, e)
        out |= made
        first = present if e == 0 else first
    return (df if first is None else df.where(F.col(first))), out


def _fill(columns: Mapping[str, str], keys: Sequence[str]) -> list[Column]:
    return [filled(F.col(f"`{c}`"), keys).alias(n) for n, c in columns.items()]


def apply_chain(df: DataFrame, names: Sequence[str], chain: str, keys: Sequence[str] = KEYS) -> tuple[DataFrame, list[str]]:
    """The steps of a chain such as execavg.difference_1, each on what the one before made: df with the results, and their names."""
    out, made = _bundled(df, {tuple(names): chain}, keys)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *_fill(made, keys)), list(made)


def build(df: DataFrame, bundle: Mapping[tuple[str, ...], str], keys: Sequence[str] = KEYS, label: str | None = "label") -> DataFrame:
    """keys, idx, the features of every entry (input columns to chain) of a bundle in order, and the label."""
    out, made = _bundled(df, bundle, keys)
    return out.select(*keys, "idx", *_fill(made, keys), *([label] if label and label in df.columns else []))


# Names of the metrics that the built-in bundle reads.
DELAYS = (
    "driver_StreamingMetrics_streaming_lastCompletedBatch_processingDelay_value",
    "driver_StreamingMetrics_streaming_lastCompletedBatch_schedulingDelay_value",
    "driver_StreamingMetrics_streaming_lastCompletedBatch_totalDelay_value",
)
DIFFERENCED = (
    "driver_StreamingMetrics_streaming_totalCompletedBatches_value",
    "driver_StreamingMetrics_streaming_totalProcessedRecords_value",
    "driver_StreamingMetrics_streaming_totalReceivedRecords_value",
    "driver_StreamingMetrics_streaming_lastReceivedBatch_records_value",
    "driver_BlockManager_memory_memUsed_MB_value",
    "driver_jvm_heap_used_value",
    "node5_CPU_ALL_Idle%",
    "node6_CPU_ALL_Idle%",
    "node7_CPU_ALL_Idle%",
    "node8_CPU_ALL_Idle%",
)
PER_EXECUTOR = (
    "executor_filesystem_hdfs_write_ops_value",
    "executor_cpuTime_count",
    "executor_runTime_count",
    "executor_shuffleRecordsRead_count",
    "executor_shuffleRecordsWritten_count",
    "jvm_heap_used_value",
)


def builtin_bundle() -> dict[tuple[str, ...], str]:
    """Three delays as they are, ten metrics differenced, six executor metrics averaged over active executors, then differenced."""
    executors = tuple(f"{i}_{m}" for m in PER_EXECUTOR for i in range(1, 6))
    return {DELAYS: "identity", DIFFERENCED: "difference_1_drop", executors: "execavg_drop.difference_1_drop"}


BUNDLES: dict[int, Callable[[], dict[tuple[str, ...], str]]] = {0: builtin_bundle}
