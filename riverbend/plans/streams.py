"""The streaming jobs on the events table, as batches and as streams, with one DuckDB query for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from . import fixtures as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
H = 3600
#: The jobs' windows, hours for seconds, since events are minutes apart; limits fitting their number.
OPTIONS = {
    1: jobs.Options(window=5 * H),
    2: jobs.Options(more_than=1000),
    3: jobs.Options(window=30 * H, slide=20 * H, more_than=10),
    4: jobs.Options(window=30 * H, slide=5 * H),
    5: jobs.Options(window=30 * H, slide=5 * H),
    6: jobs.Options(window=30 * H, slide=10 * H),
    7: jobs.Options(window=30 * H, slide=15 * H),
    8: jobs.Options(window=10 * H, more_than=2),
    9: jobs.Options(window=10 * H, slide=10 * H),
    10: jobs.Options(window=10 * H, more_than=5),
}
NAMES = {1: "clicks_per_user_batch", 2: "running_url_having", 3: "sliding_url_having", 4: "distinct_users_sliding", 5: "stream_static_rank", 6: "stream_static_rank_saved", 7: "distinct_users_slow", 8: "jumping_user_having", 9: "distinct_users_jumping", 10: "jumping_url_having"}


def _clicks(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("url"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.round(F.col("c_acctbal") * 100).cast("long").alias("rank"))


def _run(number: int, clicks: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    job, _ = jobs.JOBS[number]
    if number in (5, 6):
        return job(clicks, _ranks(spark, sf_dir), OPTIONS[number], on="user")
    return job(clicks, OPTIONS[number])


def _batch(number: int):
    return lambda spark, sf_dir: _run(number, _clicks(fx.table(spark, sf_dir, "events")), spark, sf_dir)


def _stream(number: int):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = fx.table(spark, sf_dir, "events").schema
        events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, since a stream takes no single file
        return jobs.drain(_run(number, _clicks(events), spark, sf_dir))

    return f


def _sql(number: int) -> str:
    o = OPTIONS[number]
    clicks = "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, user_id AS \"user\", event_type AS url FROM events"
    if number == 2:
        return f"SELECT url, count(*) AS n FROM ({clicks}) GROUP BY url HAVING count(*) > {o.more_than}"
    slide = o.slide or o.window
    n = -(-o.window // slide)
    windows = f"SELECT *, ((s // {slide}) - k) * {slide} AS w_start FROM ({clicks}), (SELECT unnest(generate_series(0, {n - 1})) AS k)"
    held = f"({windows}) WHERE w_start + {o.window} > s"
    if number in (4, 7, 9):
        return f"SELECT DISTINCT w_start, \"user\" FROM {held}"
    if number in (5, 6):
        return f"SELECT w_start, \"user\", CAST(sum(rank) AS BIGINT) AS rank FROM (SELECT * FROM {held}) JOIN (SELECT c_custkey AS \"user\", CAST(round(c_acctbal * 100) AS BIGINT) AS rank FROM customer) USING (\"user\") GROUP BY 1, 2"
    key = "\"user\"" if number in (1, 8) else "url"
    having = f" HAVING count(*) > {o.more_than}" if o.more_than is not None else ""
    return f"SELECT w_start, {key}, count(*) AS n FROM {held} GROUP BY 1, 2{having}"


for _n, _name in NAMES.items():
    QUERIES[_name], ORACLE[_name] = _batch(_n), _sql(_n)
    if _n != 7:
        QUERIES[f"{_name}_stream"], ORACLE[f"{_name}_stream"] = _stream(_n), _sql(_n)


def online_scaler_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running scaler on a stream of H's f_cnt, after a head of 48 hours."""
    path = f"{jobs.checkpoint_folder(spark)}/h"
    h = fx.hourly(spark, sf_dir).select("trace", "idx", F.col("f_cnt").alias("value"))
    h.coalesce(1).write.parquet(path)
    out = jobs.drain(jobs.scale_online(spark.readStream.schema(h.schema).parquet(path), head=48), "append")
    return out.select("trace", "idx", F.round("scaled", 6).alias("scaled"))


QUERIES["online_scaler_stream"] = online_scaler_stream
ORACLE["online_scaler_stream"] = fx.sql(
    fx.H,
    body="SELECT trace, idx, CASE WHEN idx >= 48 THEN round((f_cnt - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) END AS scaled FROM (SELECT *, avg(f_cnt) OVER w AS m, stddev_samp(f_cnt) OVER w AS sd FROM h WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
)
