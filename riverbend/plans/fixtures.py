"""Series derived from the tables: H (hourly series per event type), U (records per user), L (line items per supplier),
GT (ground-truth intervals), LAB (labels), S (scores) and P (predictions), each in Spark and as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import filled, numbered, one_row
from ..functions.store import stored
from ..operators import models, rangejoin, scale, score, threshold, windows
from ..operators.resample import seconds

FEATURES = ("f_cnt", "f_sum", "f_users", "f_mean")
TRAIN = ("click", "view")
HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: trace, idx, sec, f_cnt, f_sum, f_users, f_mean on a dense grid of hours."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("trace"), F.floor(seconds(F.col("ts")) / HOUR).alias("h"), F.round(F.col("value") * 100).cast("long").alias("c"), "user_id")
    bins = events.groupBy("trace", "h").agg(F.count("*").alias("n"), F.sum("c").alias("cents"), F.count_distinct("user_id").alias("users"))
    limits = bins.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    grid = one_row(bins.select("trace").distinct(), limits).select("trace", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    joined = grid.join(bins, ["trace", "h"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    mean = F.col("cents") / 100.0 / F.col("n")
    return joined.select("trace", (F.col("h") - F.col("lo")).cast("long").alias("idx"), (F.col("h") * HOUR).cast("long").alias("sec"), zero("n").alias("f_cnt"), (zero("cents") / 100.0).alias("f_sum"), zero("users").alias("f_users"), filled(mean, ["trace"], "h").alias("f_mean"))


H = """
b AS (SELECT event_type AS trace, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(DISTINCT user_id) AS users
      FROM events GROUP BY 1, 2),
g AS (SELECT trace, lo, unnest(generate_series(lo, hi)) AS h FROM (SELECT DISTINCT trace FROM b), (SELECT min(h) AS lo, max(h) AS hi FROM b)),
j AS (SELECT g.trace, g.h, lo, coalesce(n, 0)::DOUBLE AS f_cnt, coalesce(cents, 0)::DOUBLE / 100.0 AS f_sum, coalesce(users, 0)::DOUBLE AS f_users, cents::DOUBLE / 100.0 / n AS m
      FROM g LEFT JOIN b ON b.trace = g.trace AND b.h = g.h),
h AS (SELECT trace, h - lo AS idx, h * 3600 AS sec, f_cnt, f_sum, f_users,
             coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY trace ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      first_value(m IGNORE NULLS) OVER (PARTITION BY trace ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f_mean
      FROM j)"""


def ground_truth(h: DataFrame) -> DataFrame:
    """GT: runs of hours above the 95th percentile of the trace: trace, r_start, r_end, type_id, event_order and times."""
    high = h.groupBy("trace").agg(F.percentile("f_sum", 0.95).alias("p95"))
    above = h.join(high, "trace").where("f_sum > p95")
    run = F.col("idx") - F.row_number().over(Window.partitionBy("trace").orderBy("idx"))
    found = above.withColumn("_run", run).groupBy("trace", "_run").agg(F.min("idx").alias("r_start"), (F.max("idx") + 1).alias("r_end"), F.min("sec").alias("_s"), F.max("sec").alias("_e"))
    ext = F.when(F.col("r_start") % 2 == 0, F.timestamp_seconds(F.col("_e") + 2 * HOUR))
    return found.select("trace", "r_start", "r_end", (F.col("r_start") % 6 + 1).cast("int").alias("type_id"), F.col("r_start").alias("event_order"), F.timestamp_seconds("_s").alias("root_cause_start"), F.timestamp_seconds("_e").alias("root_cause_end"), ext.alias("extended_effect_end"))


GT = """
q AS (SELECT trace, quantile_cont(f_sum, 0.95) AS p95 FROM h GROUP BY trace),
i AS (SELECT h.trace, idx, idx - row_number() OVER (PARTITION BY h.trace ORDER BY idx) AS run FROM h JOIN q ON q.trace = h.trace WHERE f_sum > p95),
gt AS (SELECT trace, min(idx) AS r_start, max(idx) + 1 AS r_end, 1 + min(idx) % 6 AS type_id,
              max(idx) + CASE WHEN min(idx) % 2 = 0 THEN 2 ELSE 0 END AS last
       FROM i GROUP BY trace, run)"""


def labelled(h: DataFrame) -> DataFrame:
    """LAB: h with label, by interval join with the ground truth."""
    records = h.withColumn("ts", F.timestamp_seconds("sec"))
    return rangejoin.label_records(records, ground_truth(h))


LAB = """
lab AS (SELECT h.*, CAST(coalesce((SELECT arg_max(type_id, r_start) FROM gt WHERE gt.trace = h.trace AND h.idx BETWEEN gt.r_start AND gt.last), 0) AS INTEGER) AS label FROM h)"""


def scored(h: DataFrame) -> DataFrame:
    """S: relative error of the naive forecast of the features scaled per trace: trace, idx, score."""
    scaled = scale.scale_trace(h, FEATURES)
    return score.relative_error(models.NaiveForecaster(FEATURES).fit(scaled).predict(scaled), FEATURES)


def _z(c: str) -> str:
    return f"({c} - avg({c}) OVER (PARTITION BY trace)) / CASE WHEN stddev_pop({c}) OVER (PARTITION BY trace) = 0 THEN 1 ELSE stddev_pop({c}) OVER (PARTITION BY trace) END AS {c}"


S = f"""
z AS (SELECT trace, idx, {", ".join(_z(c) for c in FEATURES)} FROM h),
d AS (SELECT *, {", ".join(f"{c} - lag({c}) OVER (PARTITION BY trace ORDER BY idx) AS d_{c}" for c in FEATURES)} FROM z),
s AS (SELECT trace, idx, sqrt({" + ".join(f"pow(d_{c}, 2)" for c in FEATURES)}) / sqrt(sum({" + ".join(f"pow({c}, 2)" for c in FEATURES)}) OVER ()) AS score
      FROM d WHERE d_f_cnt IS NOT NULL)"""


def predicted(h: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """P: S with pred, by the STD threshold of the undisturbed traces."""
    s = stored(scored(h)) if s is None else s
    return threshold.detect(s, threshold.threshold(s.where(F.col("trace").isin(*TRAIN)), "std", 2.0))


P = """
t AS (SELECT avg(score) + 2.0 * stddev_pop(score) AS threshold FROM s WHERE trace IN ('click', 'view')),
p AS (SELECT s.*, CAST(score >= threshold AS INTEGER) AS pred FROM s, t)"""


def truth(lab: DataFrame) -> DataFrame:
    """Real ranges per class."""
    return windows.class_ranges(lab)


REAL = """
ri AS (SELECT trace, label AS class, idx, idx - row_number() OVER (PARTITION BY trace, label ORDER BY idx) AS run FROM lab WHERE label > 0),
real AS (SELECT trace, class, min(idx) AS r_start, max(idx) + 1 AS r_end FROM ri GROUP BY trace, class, run)"""

PRED = """
pi AS (SELECT trace, idx, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS run FROM p WHERE pred = 1),
pr AS (SELECT trace, min(idx) AS r_start, max(idx) + 1 AS r_end FROM pi GROUP BY trace, run)"""


def user_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: trace (user), idx, ts, event_id, value."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), "ts", "event_id", "value")
    return numbered(events, by=("ts", "event_id"))


U = """
u AS (SELECT user_id AS trace, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"""


def gapped(u: DataFrame) -> DataFrame:
    """G: a counter and a value with gaps."""
    off = F.col("event_id") % 7
    hole = (off == 3) | (off == 4)
    return u.select("trace", "idx", "event_id", F.when(hole, -1.0).otherwise((F.col("idx") + 1).cast("double")).alias("cnt"), F.when(hole, -1.0).otherwise(F.col("value")).alias("value"))


G = """
gp AS (SELECT trace, idx, event_id, CASE WHEN event_id % 7 IN (3, 4) THEN -1.0::DOUBLE ELSE (idx + 1)::DOUBLE END AS cnt,
              CASE WHEN event_id % 7 IN (3, 4) THEN -1.0::DOUBLE ELSE value END AS value FROM u)"""


def wide(h: DataFrame) -> DataFrame:
    """W: a column of f_sum per event type, inactive (-1) in hours without events."""
    types = ["click", "error", "purchase", "signup", "view"]
    kept = h.withColumn("v", F.when(F.col("f_cnt") == 0, -1.0).otherwise(F.col("f_sum")))
    pivoted = kept.groupBy("idx").pivot("trace", types).agg(F.first("v"))
    return pivoted.select("idx", F.lit("all").alias("trace"), *[F.coalesce(F.col(t), F.lit(-1.0)).alias(f"{i}_sum") for i, t in enumerate(types, 1)])


W = "w AS (SELECT idx, 'all' AS trace, " + ", ".join(f"coalesce(max(CASE WHEN trace = '{t}' THEN CASE WHEN f_cnt = 0 THEN -1.0 ELSE f_sum END END), -1.0) AS \"{i}_sum\"" for i, t in enumerate(["click", "error", "purchase", "signup", "view"], 1)) + " FROM h GROUP BY idx)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: trace (supplier), idx and four features of line items."""
    cols = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    source = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trace"), *cols, "l_quantity", "l_discount", "l_tax")
    return numbered(source, by=cols)


L = """
l AS (SELECT l_suppkey AS trace, l_quantity, l_extendedprice, l_discount, l_tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx FROM lineitem)"""


def sql(*parts: str, body: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + body


