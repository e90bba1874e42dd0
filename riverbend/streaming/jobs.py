"""Ten streaming jobs over clicks (ts TIMESTAMP, user, url), and what runs them.

Each job is a function of a DataFrame, static or streaming, so that its result on a stream can be checked against a batch.
Windows are event-time windows aligned to the epoch; with a watermark their state expires.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SEPARATOR = " - - "


def parse_clicks(lines: DataFrame, column: str = "value", ts: str = "timestamp") -> DataFrame:
    """(ts, user, url) from text lines with fields between ' - - ': the first is the user, the third the url."""
    parts = F.split(column, SEPARATOR)
    return lines.select(F.col(ts).alias("ts"), F.try_element_at(parts, F.lit(1)).alias("user"), F.try_element_at(parts, F.lit(3)).alias("url"))


def parse_ranks(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url, rank) from text lines 'rank - - url'."""
    parts = F.split(column, SEPARATOR)
    return lines.select(F.try_element_at(parts, F.lit(2)).alias("url"), F.try_element_at(parts, F.lit(1)).try_cast("int").alias("rank"))


def socket_lines(spark: SparkSession, host: str, ports: Sequence[int]) -> DataFrame:
    """Lines of several socket senders as one stream, with the time they came."""
    streams = [spark.readStream.format("socket").option("host", host).option("port", p).option("includeTimestamp", True).load() for p in ports]
    out = streams[0]
    for s in streams[1:]:
        out = out.union(s)
    return out


@dataclass(frozen=True)
class Options:
    """Window and slide in seconds, least count to report, watermark (none: state never expires)."""

    window: int = 30
    slide: int | None = None
    more_than: int | None = None
    watermark: str | None = None
    extra: dict = field(default_factory=dict)

    def over(self, **changes) -> Options:
        return replace(self, **changes)


#: Defaults of a job's own settings, which key=value arguments override.
BATCH = 5


def from_arguments(base: Options, arguments: Sequence[str]) -> Options:
    """Options with key=value arguments applied; numbers where they parse."""
    made: dict = {}
    for a in arguments:
        key, _, value = a.partition("=")
        made[key] = int(value) if value.lstrip("-").isdigit() else value
    own = {k: v for k, v in made.items() if k in ("window", "slide", "more_than", "watermark")}
    return replace(base, **own, extra={k: v for k, v in made.items() if k not in own})


def _window(o: Options) -> Column:
    return F.window("ts", f"{o.window} seconds", f"{o.slide or o.window} seconds")


def _marked(df: DataFrame, o: Options) -> DataFrame:
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", o.watermark) if o.watermark and df.isStreaming else df


def _counted(df: DataFrame, o: Options, key: str) -> DataFrame:
    out = _marked(df, o).groupBy(_window(o).alias("w"), key).agg(F.count("*").alias("n"))
    out = out.where(F.col("n") > o.more_than) if o.more_than is not None else out
    return out.select(F.unix_timestamp("w.start").alias("w_start"), key, "n")


def clicks_per_user(df: DataFrame, o: Options = Options(window=BATCH)) -> DataFrame:
    """1: clicks per user in each batch interval."""
    return _counted(df, o, "user")


def popular_urls(df: DataFrame, o: Options = Options(more_than=1000)) -> DataFrame:
    """2: clicks per url since the start, above a limit."""
    out = df.groupBy("url").agg(F.count("*").alias("n"))
    return out.where(F.col("n") > o.more_than) if o.more_than is not None else out


def sliding_urls(df: DataFrame, o: Options = Options(window=30, slide=20, more_than=1000)) -> DataFrame:
    """3: clicks per url in a sliding window, above a limit."""
    return _counted(df, o, "url")


def distinct_users(df: DataFrame, o: Options = Options(window=30, slide=BATCH)) -> DataFrame:
    """4 and 9: users seen in each window."""
    return _marked(df, o).groupBy(_window(o).alias("w"), "user").agg(F.lit(1).alias("_one")).select(F.unix_timestamp("w.start").alias("w_start"), "user")


def rank_per_user(df: DataFrame, ranks: DataFrame, o: Options = Options(window=30, slide=BATCH), on: str = "url") -> DataFrame:
    """5 and 6: sum of the ranks of what each user visited, in each window; ranks is a static table.

    It is joined as Spark's size estimates say; a broadcast would not be safe for a table of unknown size."""
    joined = _marked(df, o).join(ranks, on)
    return joined.groupBy(_window(o).alias("w"), "user").agg(F.sum("rank").alias("rank")).select(F.unix_timestamp("w.start").alias("w_start"), "user", "rank")


def slow_pi(terms: int = 70) -> Callable[[Column], Column]:
    """A user function that burns time per record: Leibniz's series."""

    @F.pandas_udf("double")
    def pi(x: pd.Series) -> pd.Series:
        out = []
        for _ in range(len(x)):
            total = 0.0
            for k in range(terms):
                total += (-1) ** k / (2 * k + 1)
            out.append(4 * total)
        return pd.Series(out)

    return pi


def distinct_users_slow(df: DataFrame, o: Options = Options(window=30, slide=BATCH)) -> DataFrame:
    """7: as 4, with the slow function applied to every record."""
    return distinct_users(df.withColumn("_pi", slow_pi()(F.col("user").cast("string"))).where("_pi > 3").drop("_pi"), o)


def busy_users(df: DataFrame, o: Options = Options(window=10, more_than=300)) -> DataFrame:
    """8: clicks per user in jumping windows, above a limit."""
    return _counted(df, o, "user")


def jumping_urls(df: DataFrame, o: Options = Options(window=10, more_than=500)) -> DataFrame:
    """10: clicks per url in jumping windows, above a limit."""
    return _counted(df, o, "url")


#: The job of each number with its default options; 9 takes window=30 for the wider form in use.
JOBS: dict[int, tuple[Callable[..., DataFrame], Options]] = {
    1: (clicks_per_user, Options(window=BATCH)),
    2: (popular_urls, Options(more_than=1000)),
    3: (sliding_urls, Options(window=30, slide=20, more_than=1000)),
    4: (distinct_users, Options(window=30, slide=BATCH)),
    5: (rank_per_user, Options(window=30, slide=BATCH)),
    6: (rank_per_user, Options(window=30, slide=BATCH)),
    7: (distinct_users_slow, Options(window=30, slide=BATCH)),
    8: (busy_users, Options(window=10, more_than=300)),
    9: (distinct_users, Options(window=10, slide=10)),
    10: (jumping_urls, Options(window=10, more_than=500)),
}


# ---------------------------------------------------------------- running


def checkpoint_folder(spark: SparkSession) -> str:
    """A fresh folder for a query's state: in the shared folder, or a local one where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='riverbend-')}"
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything that is available now, run to the end and read back from files in the shared folder.

    A batch that is run again after a failure replaces its own files: all results so far with complete, else those of its number."""
    spark, folder = result.sparkSession, checkpoint_folder(result.sparkSession)
    at = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={0 if mode == 'complete' else number}")

    spark.createDataFrame([], result.schema).write.parquet(f"{at}/batch=-1")  # a stream without input runs no batch
    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(at).select(*result.columns)


def save(result: DataFrame, path: str, mode: str = "append", kind: str = "parquet", every: str | None = None) -> StreamingQuery:
    """Write a stream's results to files, batch by batch."""
    writer = result.writeStream.outputMode(mode).format(kind).option("path", path).option("checkpointLocation", checkpoint_folder(result.sparkSession))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def save_first_batch(result: DataFrame, path: str, mode: str = "update") -> StreamingQuery:
    """Write the results of the first batch only; later batches are computed but not kept."""

    def write(batch: DataFrame, number: int) -> None:
        if number == 0:
            batch.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint_folder(result.sparkSession)).trigger(availableNow=True).start()


# ---------------------------------------------------------------- online scaling


SCALED = "trace string, idx long, value double, scaled double"
_STATE = "n long, mean double, m2 double, low double, high double"


def _scaler(kind: str, head: int):
    def scale(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2, low, high = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"))
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, x in zip(rows.idx, rows.value, strict=True):
            if n >= head and n > 1:
                offset, spread = (mean, (m2 / (n - 1)) ** 0.5) if kind == "std" else (low, high - low)
                out.append((x - offset) / (spread or 1.0))
            else:
                out.append(None)
            n += 1
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
            low, high = min(low, x), max(high, x)
        state.update((n, mean, m2, low, high))
        yield pd.DataFrame({"trace": key[0], "idx": rows.idx, "value": rows.value, "scaled": pd.Series(out, index=rows.index, dtype="float64")})

    return scale


def scale_online(stream: DataFrame, kind: str = "std", head: int = 240) -> DataFrame:
    """(trace, idx, value, scaled): each record scaled by all records of its trace before it; null in the first `head`.

    The state of a trace is five numbers. Records of a trace must come in order from batch to batch."""
    return stream.select(F.col("trace").cast("string").alias("trace"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")).groupBy("trace").applyInPandasWithState(_scaler(kind, head), SCALED, _STATE, "append", "NoTimeout")
