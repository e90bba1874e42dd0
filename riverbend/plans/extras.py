"""Queries of the smaller operators: sampling matches, names, semi-joins, disturbed samples, spans, and the chain of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import clean, edeval, evaluate, explain, models, nets, report, resample, scale, split, threshold
from ..sources import io
from ..streaming.jobs import checkpoint_folder
from . import fixtures as fx
from . import lifecycle
from .explaining import LAB
from .fixtures import FEATURES, sql
from .scoring import FULL
from .series import six

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_NAMES = [("2_2_200000_69",), ("10_0_1_1",), ("3_5_x_2",), ("bad",)]


@query("WITH n(trace) AS (VALUES " + ", ".join(f"('{a}')" for (a,) in _NAMES) + f") SELECT trace, TRY_CAST(split_part(trace, '_', 1) AS INTEGER) AS app_id, ([{', '.join(repr(t) for t in io.TRACE_TYPES)}])[TRY_CAST(split_part(trace, '_', 2) AS INTEGER) + 1] AS trace_type FROM n")
def trace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_NAMES, "trace string")
    return df.withColumns(io.trace_parts(F.col("trace")))


@query("SELECT event_type AS url, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1 HAVING count(*) > 10")
def known_users_having(spark, sf_dir):
    known = fx.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    kept = clean.known_only(fx.table(spark, sf_dir, "events"), known, "user_id")
    return clean.having(kept.groupBy(F.col("event_type").alias("url")).agg(F.count("*").alias("n")), 10)


@query(sql(fx.U, fx.G, body="SELECT trace, idx FROM (SELECT *, max(CASE WHEN cnt <> -1 THEN 1 END) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, max(CASE WHEN cnt <> -1 THEN 1 END) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM gp) WHERE cnt = -1 AND a = 1 AND b = 1"))
def interior_gaps(spark, sf_dir):
    g = fx.gapped(fx.user_records(spark, sf_dir))
    return g.withColumn("gap", clean.interior_gaps(g, "cnt")).where("gap").select("trace", "idx")


@query(sql(fx.U, "t AS (SELECT trace, n, CASE WHEN trace % 2 = 0 THEN n ELSE n * 2 END AS target FROM (SELECT trace, count(*) AS n FROM u GROUP BY trace))", body="SELECT u.trace, unnest(CASE WHEN u.trace % 2 = 0 THEN [idx] ELSE [idx * 2, idx * 2 + 1] END) AS idx, value FROM u JOIN t ON t.trace = u.trace"))
def match_sampling(spark, sf_dir):
    u = fx.user_records(spark, sf_dir)
    lengths = u.groupBy("trace").agg(F.count("*").alias("_n")).select("trace", F.when(F.col("trace") % 2 == 0, F.col("_n")).otherwise(F.col("_n") * 2).alias("target"))
    return resample.match_sampling(u, lengths, ["value"])


@query(sql(*LAB, fx.REAL, body="SELECT trace, r_start, CAST(v AS INTEGER) AS variant, r_start + v AS s_start, r_start + v + 2 AS s_end FROM real, (SELECT unnest(generate_series(0, 2)) AS v) WHERE r_end - r_start >= 4"))
def ed_disturbances(spark, sf_dir):
    real = fx.truth(fx.labelled(fx.hourly(spark, sf_dir))).where("r_end - r_start >= 4")
    return edeval.disturbed(real.withColumn("e_start", F.col("r_start")).withColumn("e_end", F.col("r_end")), 2, 3).select("trace", "r_start", "variant", "s_start", "s_end")


@query(sql(*FULL, body="SELECT s.trace, s.idx, round(s.score * 1000, 6) AS score, coalesce(class, 0) AS class FROM s LEFT JOIN real ON real.trace = s.trace AND s.idx >= r_start AND s.idx < r_end"))
def anomaly_spans(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    out = report.spans(fx.scored(h), fx.truth(fx.labelled(h)))
    return out.select("trace", "idx", F.round(F.col("score") * 1000, 6).alias("score"), "class")


@query(sql(*FULL, "o AS (SELECT trace, sum(pred) AS n FROM p GROUP BY trace)", body="SELECT trace, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, trace) AS k FROM o) WHERE k = 1"))
def most_detections(spark, sf_dir):
    return threshold.best(fx.predicted(fx.hourly(spark, sf_dir)).groupBy("trace").agg(F.sum("pred").alias("n")), "n", "trace")


@query()
def kernel_pca(spark, sf_dir):
    h = scale.scale_trace(fx.hourly(spark, sf_dir), FEATURES)
    return scale.kernel_pca(h.drop("sec"), FEATURES, 3)


@query()
def chain_of_steps(spark, sf_dir):
    """Metrics of the whole chain on H, from datasets to evaluation, with a linear forecaster."""
    h = fx.hourly(spark, sf_dir)
    raw = h.select("trace", F.col("trace").alias("trace_type"), F.timestamp_seconds("sec").alias("ts"), *FEATURES)
    s = lifecycle.Settings(raw_period=fx.HOUR, period=2 * fx.HOUR)
    data = stored(lifecycle.datasets(raw, fx.ground_truth(h), FEATURES, fx.TRAIN, s))
    scored = stored(lifecycle.scores(data, FEATURES, s, models.LinearForecaster(FEATURES, 2)))
    return evaluate.named(lifecycle.evaluation(stored(lifecycle.detections(data, scored, s)), s).withColumn("granularity", F.lit("global"))).select("granularity", "column", *six("value"))


# ---------------------------------------------------------------- sinks read back


_SETS = (fx.H, fx.GT, fx.LAB, "ds AS (SELECT *, CASE WHEN trace IN ('click', 'view') THEN 'train' ELSE 'test' END AS dataset FROM lab)")


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.split_by_type(fx.labelled(fx.hourly(spark, sf_dir)), fx.TRAIN, "trace")


@query(sql(*_SETS, body="SELECT trace, idx, f_cnt, f_sum, label FROM ds WHERE dataset = 'test'"))
def dataset_sink(spark, sf_dir):
    at = f"{checkpoint_folder(spark)}/datasets"
    io.save_datasets(_datasets(spark, sf_dir), at)
    return io.load(spark, at).where("dataset = 'test'").select("trace", "idx", "f_cnt", "f_sum", "label")


@query(sql(*_SETS, body="SELECT trace, idx, label FROM ds"))
def label_sink(spark, sf_dir):
    at = f"{checkpoint_folder(spark)}/labels"
    io.save_labels(_datasets(spark, sf_dir), at, ["trace"])
    return io.load(spark, at)


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON r_regionkey = n_regionkey")
def mixed_load(spark, sf_dir):
    at = checkpoint_folder(spark)
    io.save(fx.table(spark, sf_dir, "region").select("r_regionkey", "r_name"), f"{at}/region", "json")
    io.save(fx.table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), f"{at}/nation", "orc")
    held = io.load_many(spark, at, {"region": "json", "nation": "orc"})
    return held["region"].join(held["nation"], F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


# ---------------------------------------------------------------- samples


@query(sql(*LAB, body="SELECT trace, idx, CAST(label > 0 AS INTEGER) AS label FROM lab"))
def split_merge_by_label(spark, sf_dir):
    return clean.merged(*clean.by_label(fx.labelled(fx.hourly(spark, sf_dir)).select("trace", "idx", "label"))).select("trace", "idx", "label")


@query(sql(*_SETS, "k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('21:' || trace || '/' || idx)) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS n FROM ds)", body="SELECT dataset, trace, idx FROM k WHERE r < floor(0.3 * n)"))
def data_proportion(spark, sf_dir):
    return split.proportion(_datasets(spark, sf_dir), 0.3, F.concat_ws("/", "trace", "idx")).select("dataset", "trace", "idx")


@query(
    sql(
        *LAB,
        """
e AS (SELECT unnest(generate_series(0, 4)) AS repetition, trace, idx, CAST(label > 0 AS INTEGER) AS y FROM lab),
k AS (SELECT *, row_number() OVER (PARTITION BY y, repetition ORDER BY md5('0:' || repetition || '/' || trace || '/' || idx)) - 1 AS r, count(*) OVER (PARTITION BY y, repetition) AS n FROM e)""",
        body="SELECT CAST(repetition AS INTEGER) AS repetition, trace, idx, CASE WHEN r < floor((1 - 0.2) * n) THEN 'train' ELSE 'test' END AS dataset FROM k",
    )
)
def train_test_repeats(spark, sf_dir):
    lab = fx.labelled(fx.hourly(spark, sf_dir)).select("trace", "idx", (F.col("label") > 0).cast("int").alias("y"))
    return split.train_test(lab, 0.2, F.concat_ws("/", "trace", "idx"), 5, ["y"]).select("repetition", "trace", "idx", "dataset")


# ---------------------------------------------------------------- rows of metrics


_POINT = """
c1 AS (SELECT lab.trace, label, coalesce(pred, 0) AS pred FROM lab JOIN p ON p.trace = lab.trace AND p.idx = lab.idx),
g1 AS (SELECT sum(CASE WHEN label > 0 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(pred) AS pp, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS rp FROM c1),
g2 AS (SELECT CASE WHEN pp = 0 THEN 1.0 ELSE tp / pp END AS pr, CASE WHEN rp = 0 THEN 1.0 ELSE tp / rp END AS re FROM g1)"""


@query(sql(*FULL, _POINT, body="SELECT 'global' AS granularity, round(pr, 6) AS \"TEST_GLOBAL_PRECISION\", round(re, 6) AS \"TEST_GLOBAL_RECALL\", round(2 * pr * re / (pr + re), 6) AS \"TEST_GLOBAL_F\" FROM g2"))
def detection_row(spark, sf_dir):
    h = stored(fx.hourly(spark, sf_dir))
    records = fx.predicted(h).select("trace", "idx", "pred").join(fx.labelled(h).select("trace", "idx", "label"), ["trace", "idx"])
    names = ["TEST_GLOBAL_PRECISION", "TEST_GLOBAL_RECALL", "TEST_GLOBAL_F"]
    long = evaluate.named(evaluate.point_metrics(records).withColumn("granularity", F.lit("global")))
    return evaluate.metric_row(long, names).select("granularity", *six(*names))


_LENGTHS = "ln AS (SELECT class, count(*) AS n, avg(r_end - r_start) AS length, max(r_end - r_start)::DOUBLE AS longest FROM real GROUP BY class)"


@query(sql(*LAB, fx.REAL, _LENGTHS, body="SELECT round(sum(length * n) / sum(n), 6) AS length FROM ln"))
def weighted_global_mean(spark, sf_dir):
    return edeval.weighted_mean(_lengths(spark, sf_dir), "length", "n").select(*six("length"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("r_end") - F.col("r_start")
    return fx.truth(fx.labelled(fx.hourly(spark, sf_dir))).groupBy("class").agg(F.count("*").alias("n"), F.avg(size).alias("length"), F.max(size).cast("double").alias("longest"))


_CELLS = [f'round(max(CASE WHEN class = {c} THEN {v} END), 6) AS "{c}_{v.upper()}"' for c in range(1, 7) for v in ("length", "longest")]


@query(sql(*LAB, fx.REAL, _LENGTHS, body='SELECT round(sum(length * n) / sum(n), 6) AS "GLOBAL_LENGTH", round(sum(longest * n) / sum(n), 6) AS "GLOBAL_LONGEST", ' + ", ".join(_CELLS) + " FROM ln"))
def explanation_row(spark, sf_dir):
    out = edeval.explanation_row(_lengths(spark, sf_dir), ["length", "longest"], range(1, 7))
    return out.select(*six(*out.columns))


# ---------------------------------------------------------------- models on windows, explanations judged on held-out records


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(scale.scale_trace(fx.hourly(spark, sf_dir), FEATURES).drop("sec"))


def _train(h: DataFrame) -> DataFrame:
    return h.where(F.col("trace").isin(*fx.TRAIN))


@query()
def autoencoder_scores(spark, sf_dir):
    h = _scaled(spark, sf_dir)
    return nets.DenseAutoencoder(FEATURES, 6, (12,), 4, 25, 0.02).fit(_train(h)).scores(h).select("trace", "idx", *six("score"))


@query()
def recurrent_forecast(spark, sf_dir):
    h = _scaled(spark, sf_dir)
    made = nets.RecurrentForecaster(FEATURES, 5, 12, 25, 0.02).fit(_train(h)).predict(h)
    return models.errors(made, FEATURES).select(*six("mse", "mae"))


@query()
def bigan_scores(spark, sf_dir):
    h = _scaled(spark, sf_dir)
    return nets.BiGAN(FEATURES, 6, 12, 4, 25, 0.01).fit(_train(h)).scores(h).select("trace", "idx", *six("score"))


@query()
def ed1_accuracy(spark, sf_dir):
    lab = fx.labelled(fx.hourly(spark, sf_dir))
    wide = lab.select(F.col("trace").alias("instance"), "idx", (F.col("label") > 0).cast("int").alias("y"), *FEATURES)
    out = edeval.ed1_accuracy(wide, FEATURES, explain.macrobase, repetitions=2, half_open=True)
    return out.select("instance", *six("precision", "recall", "f1"))


# ---------------------------------------------------------------- where records are downsampled


_BINS = "(SELECT trace, k // 2 AS idx, avg(v) AS v FROM (SELECT trace, v, row_number() OVER (PARTITION BY trace ORDER BY idx) - 1 AS k FROM {0}) GROUP BY 1, 2)"
_DIFF = "(SELECT * FROM (SELECT trace, idx, v - lag(v) OVER (PARTITION BY trace ORDER BY idx) AS v FROM {0}) WHERE v IS NOT NULL)"
_Z = "(SELECT trace, idx, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END AS v FROM {0} WINDOW w AS (PARTITION BY trace))"
_ORDERS = {"first": (_BINS, _DIFF, _Z), "middle": (_DIFF, _BINS, _Z), "last": (_DIFF, _Z, _BINS)}


def _position(position: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, names = lifecycle.build_features(fx.hourly(spark, sf_dir), ["f_sum"], "difference_1_drop", "trace_scaling", 1, 2, position)
        return out.select("trace", "idx", F.round(names[0], 6).alias("v"))

    return f


for _at, _steps in _ORDERS.items():
    _source = "(SELECT trace, idx, f_sum AS v FROM h)"
    for _step in _steps:
        _source = _step.format(_source)
    QUERIES[f"downsample_{_at}"] = _position(_at)
    ORACLE[f"downsample_{_at}"] = sql(fx.H, body=f"SELECT trace, idx, round(v, 6) AS v FROM {_source}")
