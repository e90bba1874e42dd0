"""Queries of models, scores, thresholds and the evaluation of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import clean, evaluate, models, rangejoin, ranges, scale, score, threshold, windows
from ..operators.report import score_distribution as distribution
from . import fixtures as fx
from .fixtures import FEATURES, sql
from .series import r6, six

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BASE = (fx.H, fx.S)
FULL = (fx.H, fx.GT, fx.LAB, fx.S, fx.P, fx.REAL, fx.PRED)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query(sql(fx.H, body="SELECT round(sum(e2) / (count(*) * 2), 6) AS mse, round(sum(ea) / (count(*) * 2), 6) AS mae FROM (SELECT pow(f_sum - a, 2) + pow(f_cnt - b, 2) AS e2, abs(f_sum - a) + abs(f_cnt - b) AS ea FROM (SELECT *, lag(f_sum) OVER w AS a, lag(f_cnt) OVER w AS b FROM h WINDOW w AS (PARTITION BY trace ORDER BY idx)) WHERE a IS NOT NULL)"))
def naive_forecast_eval(spark, sf_dir):
    names = ["f_sum", "f_cnt"]
    h = stored(fx.hourly(spark, sf_dir))
    return models.errors(models.NaiveForecaster(names).fit(h).predict(h), names).select(*six("mse", "mae"))


@query()
def linear_forecast(spark, sf_dir):
    h = scale.scale_trace(fx.hourly(spark, sf_dir), FEATURES)
    model = models.LinearForecaster(FEATURES, 3).fit(h.where(F.col("trace").isin(*fx.TRAIN)))
    return score.relative_error(model.predict(h), FEATURES).select("trace", "idx", *six("score"))


@query()
def linear_reconstruction(spark, sf_dir):
    h = scale.scale_trace(fx.hourly(spark, sf_dir), FEATURES)
    model = models.LinearReconstructor(FEATURES, 2).fit(h.where(F.col("trace").isin(*fx.TRAIN)))
    return score.enclosing_window_mse(model.predict(h), FEATURES, 5).select("trace", "idx", *six("score"))


@query(sql(*BASE, body="SELECT trace, idx, round(score * 1000, 6) AS score FROM s"))
def score_relative_error(spark, sf_dir):
    return fx.scored(fx.hourly(spark, sf_dir)).select("trace", "idx", F.round(F.col("score") * 1000, 6).alias("score"))


_MSE = "m AS (SELECT trace, idx, pow(f_sum - f_mean, 2) AS e FROM h), w5 AS (SELECT trace, idx AS w_start, avg(e) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS score, count(*) OVER (PARTITION BY trace) AS n FROM m), w6 AS (SELECT * FROM w5 WHERE w_start + 5 <= n)"


def _reconstructed(spark, sf_dir) -> DataFrame:
    return fx.hourly(spark, sf_dir).withColumn("r_f_sum", F.col("f_mean"))


@query(sql(fx.H, _MSE, body="SELECT trace, w_start, round(score, 4) AS score FROM w6"))
def score_window_mse(spark, sf_dir):
    return score.window_mse(_reconstructed(spark, sf_dir), ["f_sum"], 5).select("trace", "w_start", F.round("score", 4).alias("score"))


@query(
    sql(
        fx.H,
        _MSE,
        "gr AS (SELECT trace, unnest(generate_series(0, max(w_start) + 4)) AS idx FROM w6 GROUP BY trace), jn AS (SELECT gr.trace, gr.idx, score FROM gr LEFT JOIN w6 ON w6.trace = gr.trace AND w_start = gr.idx)",
        body="SELECT trace, idx, round(sum(score) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / least(idx + 1, 5), 4) AS score FROM jn",
    )
)
def score_window_to_record(spark, sf_dir):
    return score.enclosing_window_mse(_reconstructed(spark, sf_dir), ["f_sum"], 5).select("trace", "idx", F.round("score", 4).alias("score"))


# ---------------------------------------------------------------- thresholds

_STAT = {
    "std": "SELECT avg(score) + {f} * stddev_pop(score) AS t FROM {src}",
    "mad": "SELECT max(m) + {f} * 1.4826 * median(abs(score - m)) AS t FROM {src}, (SELECT median(score) AS m FROM {src})",
    "iqr": "SELECT quantile_cont(score, 0.75) + {f} * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) AS t FROM {src}",
}


def _threshold_sql(kind: str, n: int) -> str:
    parts = [*BASE, "a AS (SELECT score FROM s WHERE trace IN ('click', 'view'))", f"t1 AS ({_STAT[kind].format(f='2.0', src='a')})"]
    if n == 2:
        parts += ["a2 AS (SELECT score FROM a, t1 WHERE score <= t)", f"t2 AS ({_STAT[kind].format(f='2.0', src='a2')})"]
    return sql(*parts, body=f"SELECT round(t * 1000, 6) AS threshold FROM t{n}")


def _threshold(kind: str, n: int):
    def f(spark, sf_dir):
        s = fx.scored(fx.hourly(spark, sf_dir)).where(F.col("trace").isin(*fx.TRAIN))
        return threshold.threshold(s, kind, 2.0, n).select(F.round(F.col("threshold") * 1000, 6).alias("threshold"))

    return f


for _kind in ("std", "mad", "iqr"):
    for _n in (1, 2):
        QUERIES[f"threshold_{_kind}_{_n}"] = _threshold(_kind, _n)
        ORACLE[f"threshold_{_kind}_{_n}"] = _threshold_sql(_kind, _n)


def _grid_sql() -> str:
    rows, parts = [], [*BASE, "a AS (SELECT score FROM s WHERE trace IN ('click', 'view'))"]
    for i, (m, f, n, r) in enumerate(threshold.grid()):
        parts.append(f"x{i} AS ({_STAT[m].format(f=f, src='a')})")
        last = f"x{i}"
        if n == 2:
            parts += [f"y{i} AS (SELECT score FROM a, x{i} WHERE score <= {r} * t)", f"z{i} AS ({_STAT[m].format(f=f, src=f'y{i}')})"]
            last = f"z{i}"
        rows.append(f"SELECT '{m}' AS method, {f}::DOUBLE AS factor, {n} AS iterations, {r}::DOUBLE AS removal, round(t * 1000, 6) AS threshold FROM {last}")
    return sql(*parts, body=" UNION ALL ".join(rows))


@query(_grid_sql())
def threshold_grid(spark, sf_dir):
    s = stored(fx.scored(stored(fx.hourly(spark, sf_dir))).where(F.col("trace").isin(*fx.TRAIN)))
    return threshold.threshold_grid(s).withColumn("threshold", F.round(F.col("threshold") * 1000, 6))


@query(sql(*BASE, fx.P, body="SELECT trace, idx, pred FROM p"))
def detector_predictions(spark, sf_dir):
    return fx.predicted(fx.hourly(spark, sf_dir)).select("trace", "idx", "pred")


@query(sql(*BASE, fx.P, body="SELECT h.trace, h.idx, coalesce(pred, 0) AS pred FROM h LEFT JOIN p ON p.trace = h.trace AND p.idx = h.idx"))
def prepend_negatives(spark, sf_dir):
    h = stored(fx.hourly(spark, sf_dir))
    return clean.prepend_negatives(h, fx.predicted(h))


# ---------------------------------------------------------------- evaluation


def _records(spark, sf_dir) -> DataFrame:
    """Labelled records with score and pred, from the first forecast on."""
    h = stored(fx.hourly(spark, sf_dir))
    return stored(fx.predicted(h).join(fx.labelled(h).select("trace", "idx", "label"), ["trace", "idx"]))


_REC = "rec AS (SELECT p.trace, p.idx, score, pred, label FROM p JOIN lab ON lab.trace = p.trace AND lab.idx = p.idx)"
_F1 = "CASE WHEN precision = 0 AND recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"


@query(
    sql(
        *FULL,
        _REC,
        """
pp AS (SELECT CASE WHEN sum(pred) = 0 THEN 1.0 ELSE sum(CASE WHEN label > 0 THEN pred ELSE 0 END)::DOUBLE / sum(pred) END AS precision FROM rec),
rr AS (SELECT 'global' AS cls, sum(pred)::DOUBLE / count(*) AS recall FROM rec WHERE label > 0 UNION ALL SELECT label::VARCHAR, sum(pred)::DOUBLE / count(*) FROM rec WHERE label > 0 GROUP BY label),
ra AS (SELECT * FROM rr UNION ALL SELECT 'avg', avg(recall) FROM rr WHERE cls <> 'global')""",
        body=f"SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f FROM ra, pp",
    )
)
def point_metrics(spark, sf_dir):
    return evaluate.point_metrics(_records(spark, sf_dir)).select("cls", *six("precision", "recall", "f"))


_N = 500
_CURVE = f"""
lim AS (SELECT min(score) AS lo, max(score) AS hi FROM rec),
th AS (SELECT t, CASE WHEN t = {_N} THEN 'inf'::DOUBLE WHEN t = {_N - 1} THEN hi ELSE lo + t * ((hi - lo) / {_N - 1}) END AS threshold FROM lim, (SELECT unnest(generate_series(0, {_N}))::INTEGER AS t)),
cnt AS (SELECT t, label, count(*) AS n, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS hits FROM rec, th GROUP BY t, label),
cp AS (SELECT t, CASE WHEN sum(hits) = 0 THEN 1.0 ELSE sum(CASE WHEN label > 0 THEN hits ELSE 0 END)::DOUBLE / sum(hits) END AS precision FROM cnt GROUP BY t),
cr AS (SELECT t, 'global' AS cls, sum(hits)::DOUBLE / sum(n) AS recall FROM cnt WHERE label > 0 GROUP BY t UNION ALL SELECT t, label::VARCHAR, hits::DOUBLE / n FROM cnt WHERE label > 0),
ca AS (SELECT * FROM cr UNION ALL SELECT t, 'avg', avg(recall) FROM cr WHERE cls <> 'global' GROUP BY t),
curve AS (SELECT ca.t, cls, precision, recall, {_F1} AS f FROM ca JOIN cp ON cp.t = ca.t)"""
_AREA = "SELECT cls, round(coalesce(sum(a), 0), 6) AS auc FROM (SELECT cls, (recall - lag(recall) OVER w) * (precision + lag(precision) OVER w) / 2 AS a FROM (SELECT * REPLACE (round(recall, 9) AS recall) FROM curve) WINDOW w AS (PARTITION BY cls ORDER BY recall, -t)) GROUP BY cls"


@query(sql(*FULL, _REC, _CURVE, body=f"SELECT t, cls, {r6('precision', 'recall', 'f')} FROM curve"))
def pr_curve_point(spark, sf_dir):
    return evaluate.point_curve(_records(spark, sf_dir), _N).select("t", "cls", *six("precision", "recall", "f"))


@query(sql(*FULL, _REC, _CURVE, body=_AREA))
def auprc_point(spark, sf_dir):
    return evaluate.areas(evaluate.point_curve(_records(spark, sf_dir), _N)).select("cls", *six("auc"))


@query(sql(*FULL, _REC, _CURVE, body="SELECT cls, t, round(f, 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f DESC, t) AS k FROM curve) WHERE k = 1"))
def best_threshold_per_class(spark, sf_dir):
    return evaluate.best_points(evaluate.point_curve(_records(spark, sf_dir), _N)).select("cls", "t", *six("f"))


_MEET = "a.r_start <= b.r_end AND b.r_start <= a.r_end"


@query(sql(*FULL, body=f"SELECT a.trace, a.class, a.r_start, a.r_end, b.r_start AS o_start, b.r_end AS o_end FROM real a JOIN pr b ON a.trace = b.trace AND {_MEET}"))
def range_overlaps(spark, sf_dir):
    h = stored(fx.hourly(spark, sf_dir))
    real, pred = fx.truth(fx.labelled(h)), evaluate.predicted_ranges(fx.predicted(h))
    return rangejoin.overlapping(real, ranges.as_others(pred)).select("trace", "class", "r_start", "r_end", "o_start", "o_end")


@query(sql(*FULL, body=f"SELECT a.trace, a.class, a.r_start, CASE WHEN EXISTS (SELECT 1 FROM pr b WHERE b.trace = a.trace AND {_MEET}) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM real a"))
def range_existence(spark, sf_dir):
    h = stored(fx.hourly(spark, sf_dir))
    out = ranges.range_recalls(fx.truth(fx.labelled(h)), evaluate.predicted_ranges(fx.predicted(h)), ranges.LEVELS["ad1"])
    return out.select("trace", "class", "r_start", "reward")


def _reward_sql(size: str, bias: str, card: str, alpha: float, of: str, against: str, extra: str) -> str:
    n, k, ab = "(a.r_end - a.r_start)", "(e - s)", "(s + e - 1)"
    flat = f"{k}::DOUBLE / n"
    whole = "(n * (n - 1) / 2.0)"
    biased = {"flat": flat, "front": f"CASE WHEN n = 1 THEN {flat} ELSE ({k} * (n - 1) - {ab} * {k} / 2.0) / {whole} END", "back": f"CASE WHEN n = 1 THEN {flat} ELSE ({ab} * {k} / 2.0) / {whole} END"}[bias]
    value = biased
    if size == "flat.normalized" and bias != "flat":
        best = f"CASE WHEN n = 1 THEN {flat} ELSE ({k} * (n - 1) - ({k} - 1) * {k} / 2.0) / {whole} END"
        value = f"CASE WHEN {best} = 0 THEN 0.0 ELSE {flat} * ({biased}) / ({best}) END"
    several = {"dup": "1.0", "no.dup": "0.0", "inv.poly": "1.0 / count(*)"}[card]
    return f"""
SELECT {extra} a.trace, a.r_start, a.r_end, coalesce(m.v, 0.0) AS reward FROM {of} a LEFT JOIN (
  SELECT trace, r_start, r_end, {alpha} + {1 - alpha} * (CASE WHEN count(*) = 1 THEN 1.0 ELSE {several} END) * sum({value}) AS v FROM (
    SELECT DISTINCT a.trace, a.r_start, a.r_end, {n} AS n, greatest(a.r_start, b.r_start) - a.r_start AS s, least(a.r_end, b.r_end) - a.r_start AS e, b.r_start AS b1, b.r_end AS b2{", b.class" if against == "real" else ""}
    FROM {of} a JOIN {against} b ON a.trace = b.trace AND {_MEET}) GROUP BY trace, r_start, r_end) m ON m.trace = a.trace AND m.r_start = a.r_start AND m.r_end = a.r_end"""


def _range_sql(p: dict) -> str:
    parts = [*FULL, f"rc AS ({_reward_sql(p['recall_size'], p['recall_bias'], p['recall_card'], p['alpha'], 'real', 'pr', 'a.class,')})", f"pc AS ({_reward_sql(p['precision_size'], p['precision_bias'], p['precision_card'], 0.0, 'pr', 'real', '')})"]
    parts.append("""
pp AS (SELECT coalesce(avg(reward), 1.0) AS precision FROM pc),
rr AS (SELECT 'global' AS cls, avg(reward) AS recall FROM rc UNION ALL SELECT class::VARCHAR, avg(reward) FROM rc GROUP BY class),
ra AS (SELECT * FROM rr UNION ALL SELECT 'avg', avg(recall) FROM rr WHERE cls <> 'global')""")
    return sql(*parts, body=f"SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f FROM ra, pp")


def _range_query(p: dict):
    def f(spark, sf_dir):
        h = stored(fx.hourly(spark, sf_dir))
        out = evaluate.range_metrics(stored(fx.truth(fx.labelled(h))), stored(evaluate.predicted_ranges(fx.predicted(h))), p)
        return out.select("cls", *six("precision", "recall", "f"))

    return f


CUSTOM = {"alpha": 0.3, "recall_size": "default", "recall_bias": "back", "recall_card": "inv.poly", "precision_size": "flat.normalized", "precision_bias": "front", "precision_card": "inv.poly"}
for _name, _p in {**ranges.LEVELS, "custom": CUSTOM}.items():
    QUERIES[f"range_metrics_{_name}"] = _range_query(_p)
    ORACLE[f"range_metrics_{_name}"] = _range_sql(_p)


_T = 500
_RANGE_CURVE = f"""
lim AS (SELECT min(score) AS lo, max(score) AS hi FROM rec),
th AS (SELECT t, CASE WHEN t = {_T} THEN 'inf'::DOUBLE WHEN t = {_T - 1} THEN hi ELSE lo + t * ((hi - lo) / {_T - 1}) END AS threshold FROM lim, (SELECT unnest(generate_series(0, {_T}))::INTEGER AS t)),
hit AS (SELECT t, trace, idx, idx - row_number() OVER (PARTITION BY t, trace ORDER BY idx) AS run FROM rec, th WHERE score >= threshold),
pt AS (SELECT t, trace, min(idx) AS r_start, max(idx) + 1 AS r_end FROM hit GROUP BY t, trace, run),
ri2 AS (SELECT trace, label AS class, idx, idx - row_number() OVER (PARTITION BY trace, label ORDER BY idx) AS run FROM rec WHERE label > 0),
re2 AS (SELECT trace, class, min(idx) AS r_start, max(idx) + 1 AS r_end FROM ri2 GROUP BY trace, class, run),
rt AS (SELECT t, re2.* FROM re2, th),
rec1 AS (SELECT a.t, a.class, a.trace, a.r_start, sum(greatest(least(a.r_end, b.r_end) - greatest(a.r_start, b.r_start), 0)::DOUBLE / (a.r_end - a.r_start)) AS reward
         FROM rt a JOIN pt b ON a.t = b.t AND a.trace = b.trace AND {_MEET} GROUP BY 1, 2, 3, 4),
rc AS (SELECT rt.t, rt.class, coalesce(reward, 0.0) AS reward FROM rt LEFT JOIN rec1 USING (t, class, trace, r_start)),
pc1 AS (SELECT a.t, a.trace, a.r_start, sum(greatest(least(a.r_end, b.r_end) - greatest(a.r_start, b.r_start), 0)::DOUBLE / (a.r_end - a.r_start)) AS reward
        FROM pt a JOIN re2 b ON a.trace = b.trace AND {_MEET} GROUP BY 1, 2, 3),
pc AS (SELECT pt.t, coalesce(reward, 0.0) AS reward FROM pt LEFT JOIN pc1 USING (t, trace, r_start)),
cp AS (SELECT t, avg(reward) AS precision FROM pc GROUP BY t),
cr AS (SELECT t, 'global' AS cls, avg(reward) AS recall FROM rc GROUP BY t UNION ALL SELECT t, class::VARCHAR, avg(reward) FROM rc GROUP BY t, class),
ca AS (SELECT * FROM cr UNION ALL SELECT t, 'avg', avg(recall) FROM cr WHERE cls <> 'global' GROUP BY t),
c0 AS (SELECT ca.t, cls, coalesce(precision, 1.0) AS precision, recall FROM ca LEFT JOIN cp ON cp.t = ca.t),
curve AS (SELECT *, {_F1} AS f FROM c0)"""


# means of rewards such as 5/128 end in a 5 at the seventh decimal, where the order of a sum decides a rounding to six
_NINE = ", ".join(f"round({c}, 9) AS {c}" for c in ("precision", "recall", "f"))


@query(sql(*FULL, _REC, _RANGE_CURVE, body=f"SELECT t, cls, {_NINE} FROM curve"))
def pr_curve_range(spark, sf_dir):
    return evaluate.range_curve(_records(spark, sf_dir), ranges.LEVELS["ad2"], _T).select("t", "cls", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


@query(sql(*FULL, _REC, _RANGE_CURVE, body=_AREA))
def auprc_range(spark, sf_dir):
    return evaluate.areas(evaluate.range_curve(_records(spark, sf_dir), ranges.LEVELS["ad2"], _T)).select("cls", *six("auc"))


_ROLL = [*FULL, f"rc AS ({_reward_sql('default', 'flat', 'dup', 0.0, 'real', 'pr', 'a.class,')})", f"pc AS ({_reward_sql('default', 'flat', 'dup', 0.0, 'pr', 'real', '')})"]
_APP = "CASE WHEN trace IN ('click', 'view') THEN 'use' ELSE 'other' END"
_GRAN = "CASE WHEN grouping(app) = 1 THEN 'global' WHEN grouping(trace) = 1 THEN 'app_' || app ELSE 'trace_' || trace END"


@query(
    sql(
        *_ROLL,
        f"""
ra1 AS (SELECT *, {_APP} AS app FROM rc), pa1 AS (SELECT *, {_APP} AS app FROM pc),
gp1 AS (SELECT {_GRAN} AS granularity, avg(reward) AS precision FROM pa1 GROUP BY GROUPING SETS ((), (app), (app, trace))),
gr1 AS (SELECT {_GRAN} AS granularity, 'global' AS cls, avg(reward) AS recall FROM ra1 GROUP BY GROUPING SETS ((), (app), (app, trace))
        UNION ALL SELECT {_GRAN}, class::VARCHAR, avg(reward) FROM ra1 GROUP BY GROUPING SETS ((class), (app, class), (app, trace, class))),
ga1 AS (SELECT * FROM gr1 UNION ALL SELECT granularity, 'avg', avg(recall) FROM gr1 WHERE cls <> 'global' GROUP BY granularity),
o0 AS (SELECT granularity, cls, coalesce(precision, 1.0) AS precision, recall FROM ga1 LEFT JOIN gp1 USING (granularity)),
o1 AS (SELECT *, {_F1} AS f FROM o0),
o2 AS (SELECT * FROM o1 UNION ALL SELECT 'app_avg', cls, avg(precision), avg(recall), avg(f) FROM o1 WHERE starts_with(granularity, 'app_') GROUP BY cls
       UNION ALL SELECT 'trace_avg', cls, avg(precision), avg(recall), avg(f) FROM o1 WHERE starts_with(granularity, 'trace_') GROUP BY cls)""",
        body=f"SELECT granularity, cls, {r6('precision', 'recall', 'f')} FROM o2",
    )
)
def granularity_rollup(spark, sf_dir):
    h = stored(fx.hourly(spark, sf_dir))
    app = F.when(F.col("trace").isin(*fx.TRAIN), "use").otherwise("other").alias("app")
    real, pred = stored(fx.truth(fx.labelled(h)).select("*", app)), stored(evaluate.predicted_ranges(fx.predicted(h)).select("*", app))
    return evaluate.rolled_up(real, pred, ranges.LEVELS["ad2"]).select("granularity", "cls", *six("precision", "recall", "f"))


@query(
    sql(
        *FULL,
        _REC,
        """
qq AS (SELECT min(score) AS lo, least(max(score), quantile_cont(score, 0.75) + 3.0 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25))) AS hi FROM rec),
cc AS (SELECT label, CAST(least(floor((least(score, hi) - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n, sum(CAST(score > hi AS INTEGER)) AS c FROM rec, qq GROUP BY 1, 2)""",
        body="SELECT label, bin, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 6) AS share, round(sum(c) OVER (PARTITION BY label)::DOUBLE / sum(n) OVER (PARTITION BY label), 6) AS capped FROM cc",
    )
)
def score_distribution(spark, sf_dir):
    return distribution(_records(spark, sf_dir)).select("label", "bin", "n", *six("share", "capped"))


@query(sql(fx.L, body="SELECT trace, count(*) AS n_ranges, CAST(sum(len) AS BIGINT) AS records FROM (SELECT trace, run, count(*) AS len FROM (SELECT trace, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS run FROM l WHERE l_quantity > 45) GROUP BY 1, 2) GROUP BY trace"))
def detected_ranges_at_volume(spark, sf_dir):
    found = windows.ranges(fx.lines(spark, sf_dir), F.col("l_quantity") > 45)
    return found.groupBy("trace").agg(F.count("*").alias("n_ranges"), F.sum(F.col("r_end") - F.col("r_start")).alias("records"))


def flagship(spark, sf_dir) -> DataFrame:
    """Detected ranges and their mean length per trace."""
    found = evaluate.predicted_ranges(fx.predicted(fx.hourly(spark, sf_dir)))
    return found.groupBy("trace").agg(F.count("*").alias("n_ranges"), F.sum(F.col("r_end") - F.col("r_start")).alias("records"))


QUERIES["flagship"] = flagship
ORACLE["flagship"] = sql(*FULL, body="SELECT trace, count(*) AS n_ranges, CAST(sum(r_end - r_start) AS BIGINT) AS records FROM pr GROUP BY trace")
