"""Readers and writers of traces, truth tables, metrics and explanations. All paths go through Spark's file systems."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.report import upsert

# Applications, trace types and anomaly types, in order of their numbers.
APPLICATIONS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
UNUSED_APPLICATIONS = (7, 8)
TRACE_TYPES = ("undisturbed", "bursty_input", "bursty_input_crash", "stalled_input", "cpu_contention", "process_failure")
ANOMALY_TYPES = ("bursty_input", "bursty_input_crash", "stalled_input", "cpu_contention", "driver_failure", "executor_failure", "unknown")


def trace_parts(name: Column) -> dict[str, Column]:
    """app_id and trace_type from a trace name app_type_rate_id."""
    parts = F.split(name, "_")
    kinds = F.array(*[F.lit(t) for t in TRACE_TYPES])
    return {"app_id": F.try_element_at(parts, F.lit(1)).try_cast("int"), "trace_type": F.try_element_at(kinds, F.try_element_at(parts, F.lit(2)).try_cast("int") + 1)}


def read_traces(spark: SparkSession, path: str, metrics: Sequence[str], rename: Callable[[str], str] | None = None) -> DataFrame:
    """(trace, app_id, trace_type, period_rank, ts, metrics in order of name) from CSV files with a header and epoch seconds in t.

    Only the columns named are read; the trace is the file's name."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv(\..*)?$", "").alias("trace")
    renamed = {m: (rename(m) if rename else m) for m in metrics}
    values = [F.col(f"`{m}`").try_cast("double").alias(renamed[m]) for m in sorted(metrics, key=renamed.get)]
    out = raw.select(name, F.timestamp_seconds(F.col("t").try_cast("double")).alias("ts"), *values)
    return out.withColumns(trace_parts(F.col("trace"))).withColumn("period_rank", F.lit(0)).select("trace", "app_id", "trace_type", "period_rank", "ts", *[renamed[m] for m in sorted(metrics, key=renamed.get)])


def select_traces(traces: DataFrame, app_id: int = 0, trace_types: Sequence[str] | None = None) -> DataFrame:
    """Traces of one application (0: all but the unused) and of some types. Filters on partition columns prune files."""
    out = traces.where(~F.col("app_id").isin(*UNUSED_APPLICATIONS)) if app_id == 0 else traces.where(F.col("app_id") == app_id)
    return out.where(F.col("trace_type").isin(*trace_types)) if trace_types else out


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(trace, type_id, anomaly_details, root_cause_start, root_cause_end, extended_effect_end, event_order) from the truth table.

    Columns go by the file's header. Events are numbered by file and line; the table is written by hand, so one task numbers it."""
    raw = spark.read.option("header", True).csv(path).withColumn("_at", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")))
    kinds = F.array(*[F.lit(t) for t in ANOMALY_TYPES])
    at = lambda c: F.timestamp_seconds(F.col(c).try_cast("double")).alias(c)
    out = raw.select(F.col("trace_name").alias("trace"), F.nullif(F.array_position(kinds, F.col("anomaly_type")), F.lit(0)).cast("int").alias("type_id"), "anomaly_details", at("root_cause_start"), at("root_cause_end"), at("extended_effect_end"), "_at")
    return out.withColumn("event_order", (F.row_number().over(Window.orderBy("_at")) - 1).cast("long")).drop("_at")


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def load_many(spark: SparkSession, folder: str, kinds: Mapping[str, str]) -> dict[str, DataFrame]:
    """Frames by name, each with its own format."""
    return {n: load(spark, f"{folder}/{n}", k) for n, k in kinds.items()}


def parsed_keys(values: Mapping[str, object]) -> dict:
    """Keys as integers or else numbers, if all of them parse."""
    for kind in (int, float):
        try:
            return {kind(k): v for k, v in values.items()}
        except ValueError:
            continue
    return dict(values)


def save(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_datasets(series: DataFrame, path: str) -> None:
    """Records under a folder per dataset, so that a reader of one set prunes the other."""
    save(series, path, partition_by=["dataset"])


def save_labels(series: DataFrame, path: str, keys: Sequence[str] = ("trace", "period_rank"), label: str = "label") -> None:
    save(series.select(*keys, "idx", label), path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert_table(new: DataFrame, path: str, keys: Sequence[str] = ("method", "granularity", "cls", "metric")) -> None:
    """Rows of the table at path replaced or added by key; the table is made where there is none.

    The merged table is written beside the old one, which steps aside before it and is deleted last: a whole table is there at
    any time, and a call that finds one set aside by a lost one takes it back."""
    spark = new.sparkSession
    beside, aside = f"{path.rstrip('/')}__merged", f"{path.rstrip('/')}__old"
    fs = spark._jvm.org.apache.hadoop.fs
    at, merged, old = fs.Path(path), fs.Path(beside), fs.Path(aside)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(old):
        if system.exists(at):
            system.delete(old, True)
        else:
            system.rename(old, at)
    if not exists(spark, path):
        save(new, path)
        return
    save(upsert(spark.read.parquet(path), new, keys), beside)
    if not (system.rename(at, old) and system.rename(merged, at)):
        raise OSError(f"{path} could not be replaced")
    system.delete(old, True)
    spark.catalog.refreshByPath(path)


def explanations_json(rules: DataFrame) -> DataFrame:
    """(instance, value): JSON texts with the important features and their ranges."""
    per_ft = rules.groupBy("instance", "ft").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    both = per_ft.groupBy("instance").agg(F.sort_array(F.collect_list(F.struct("ft", "ranges"))).alias("_e"))
    return both.select("instance", F.to_json(F.struct(F.col("_e.ft").alias("important_fts"), F.col("_e.ranges").alias("anomalous_ranges"))).alias("value"))


def save_model(spark: SparkSession, params: Mapping[str, object], path: str) -> None:
    """Parameters of a fitted model as a small table of names and JSON values."""
    save(spark.createDataFrame([(k, json.dumps(v)) for k, v in params.items()], "name string, value string"), path)


def load_model(spark: SparkSession, path: str) -> dict:
    return {r.name: json.loads(r.value) for r in spark.read.parquet(path).collect()}
