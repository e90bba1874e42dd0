"""Queries of resampling, cleaning, windows, features, scaling and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import clean, features, resample, scale, split, windows
from . import fixtures as fx
from .fixtures import FEATURES, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WHOLE = "PARTITION BY trace ORDER BY idx"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _resampled(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("trace"), "ts", "value", (F.col("event_id") % 3).cast("int").alias("label"))
        out = resample.resample_time(events, 6 * 3600, ["value"], kind, "label")
        return out.select("trace", "idx", F.unix_timestamp("ts").alias("sec"), F.round("value", 6).alias("value"), "label")

    return f


def _resampled_sql(agg: str) -> str:
    return f"""
WITH b AS (SELECT event_type AS trace, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS bin, {agg}(value) AS value, max(event_id % 3)::INTEGER AS label FROM events GROUP BY 1, 2),
g AS (SELECT trace, unnest(generate_series(lo, hi)) AS bin, lo FROM (SELECT trace, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY trace)),
j AS (SELECT g.trace, g.bin, lo, value, label FROM g LEFT JOIN b ON b.trace = g.trace AND b.bin = g.bin)
SELECT trace, bin - lo AS idx, bin * 21600 AS sec, round(coalesce(last_value(value IGNORE NULLS) OVER f, first_value(value IGNORE NULLS) OVER n), 6) AS value,
       coalesce(last_value(label IGNORE NULLS) OVER f, first_value(label IGNORE NULLS) OVER n) AS label
FROM j WINDOW f AS (PARTITION BY trace ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY trace ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
"""


for _kind, _agg in (("mean", "avg"), ("max", "max"), ("median", "median")):
    QUERIES[f"resample_{_kind}"] = _resampled(_kind)
    ORACLE[f"resample_{_kind}"] = _resampled_sql(_agg)


@query(sql(fx.H, body=f"SELECT trace, idx, sec, {r6(*FEATURES)} FROM h"))
def resample_fill(spark, sf_dir):
    return fx.hourly(spark, sf_dir).select("trace", "idx", "sec", *six(*FEATURES))


@query(sql(fx.U, body="SELECT trace, CAST(floor(idx * 1 / 4.0) AS BIGINT) AS idx, round(avg(value), 6) AS value FROM u GROUP BY 1, 2"))
def resample_by_rank(spark, sf_dir):
    return resample.resample_rank(fx.user_records(spark, sf_dir), 1, 4, ["value"]).select("trace", "idx", *six("value"))


@query(sql(fx.H, fx.GT, fx.LAB, body="SELECT trace, CAST(floor(idx / 4.0) AS BIGINT) AS idx, max(label) AS label FROM lab GROUP BY 1, 2"))
def label_resample(spark, sf_dir):
    return resample.resample_labels(fx.labelled(fx.hourly(spark, sf_dir)), 1, 4)


@query(sql(fx.H, fx.GT, fx.LAB, body="SELECT trace, idx, label FROM lab"))
def interval_label(spark, sf_dir):
    return fx.labelled(fx.hourly(spark, sf_dir)).select("trace", "idx", "label")


@query(sql(fx.H, fx.GT, body="SELECT trace, r_start, r_end, CAST(type_id AS INTEGER) AS type_id FROM gt"))
def ground_truth_events(spark, sf_dir):
    return fx.ground_truth(fx.hourly(spark, sf_dir)).select("trace", "r_start", "r_end", "type_id")


@query(
    sql(
        fx.U,
        fx.G,
        """
k AS (SELECT *, last_value(CASE WHEN cnt <> -1 THEN cnt END IGNORE NULLS) OVER a AS was_c, last_value(CASE WHEN cnt <> -1 THEN value END IGNORE NULLS) OVER a AS was_v,
             first_value(CASE WHEN cnt <> -1 THEN cnt END IGNORE NULLS) OVER z AS next_c
      FROM gp WINDOW a AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        body="SELECT trace, idx, CASE WHEN cnt = -1 AND was_c IS NOT NULL AND next_c >= was_c THEN was_c ELSE cnt END AS cnt, CASE WHEN cnt = -1 AND was_c IS NOT NULL AND next_c >= was_c THEN was_v ELSE value END AS value FROM k",
    )
)
def gap_fill_counter(spark, sf_dir):
    return clean.fill_counter_gaps(fx.gapped(fx.user_records(spark, sf_dir)), "cnt", ["cnt", "value"]).select("trace", "idx", "cnt", "value")


@query(
    sql(
        fx.U,
        fx.G,
        body="""SELECT trace, idx, coalesce(last_value(nullif(value, -1) IGNORE NULLS) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                                            first_value(nullif(value, -1) IGNORE NULLS) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS value FROM gp""",
    )
)
def gap_fill_os(spark, sf_dir):
    return clean.fill_inactive(fx.gapped(fx.user_records(spark, sf_dir)), ["value"]).select("trace", "idx", "value")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, -1) AS value FROM events")
def null_to_inactive(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return clean.null_to_inactive(events, ["value"])


@query(sql(fx.U, body="SELECT trace, idx, value FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM u) WHERE idx >= 3 AND idx < n - 2"))
def prune_head_tail(spark, sf_dir):
    return clean.prune(fx.user_records(spark, sf_dir), 3, 2).select("trace", "idx", "value")


@query(sql(fx.U, body="SELECT trace, idx, value FROM u WHERE idx >= 5"))
def trim_head(spark, sf_dir):
    return clean.trim_head(fx.user_records(spark, sf_dir), 5).select("trace", "idx", "value")


@query(sql(fx.H, body="SELECT trace, CASE WHEN trace IN ('click', 'view') THEN 'train' ELSE 'test' END AS dataset, count(*) AS n FROM h GROUP BY 1, 2"))
def train_test_split(spark, sf_dir):
    return clean.split_by_type(fx.hourly(spark, sf_dir), fx.TRAIN, "trace").groupBy("trace", "dataset").agg(F.count("*").alias("n"))


@query(sql(fx.H, fx.GT, fx.LAB, body="SELECT trace, idx, CASE WHEN label = 6 THEN 0 ELSE label END AS label FROM lab"))
def mask_unknown(spark, sf_dir):
    return clean.mask_label(fx.labelled(fx.hourly(spark, sf_dir)), 6).select("trace", "idx", "label")


def _lengths(u: DataFrame, factor: float) -> DataFrame:
    return u.groupBy("trace").agg(F.floor(F.count("*") * factor).cast("long").alias("target"))


_EVEN = "CASE WHEN x - floor(x) = 0.5 AND CAST(floor(x) AS BIGINT) % 2 = 0 THEN floor(x) ELSE round(x) END"


@query(
    sql(
        fx.U,
        f"""
n AS (SELECT trace, n, target, CAST({_EVEN} AS BIGINT) AS rep FROM (SELECT *, target::DOUBLE / n AS x FROM (SELECT trace, count(*) AS n, CAST(floor(count(*) * 2.6) AS BIGINT) AS target FROM u GROUP BY trace))),
o AS (SELECT trace, n, rep, unnest(generate_series(0, target - 1)) AS slot FROM n)""",
        body="SELECT o.trace, slot AS idx, value FROM o JOIN u ON u.trace = o.trace AND u.idx = least(CAST(floor(slot / rep) AS BIGINT), n - 1)",
    )
)
def upsample(spark, sf_dir):
    u = fx.user_records(spark, sf_dir)
    return resample.upsample(u, _lengths(u, 2.6), ["value"])


@query(
    sql(
        fx.U,
        f"""
n AS (SELECT trace, n, target, greatest(CAST({_EVEN} AS BIGINT), 1) AS w FROM (SELECT *, n::DOUBLE / target AS x FROM (SELECT trace, count(*) AS n, greatest(CAST(floor(count(*) * 0.3) AS BIGINT), 1) AS target FROM u GROUP BY trace))),
k AS (SELECT u.trace, idx, value, n, w, target, n // w AS whole FROM u JOIN n ON n.trace = u.trace),
x AS (SELECT trace, idx // w AS win, value FROM k WHERE idx < whole * w
      UNION ALL SELECT trace, whole AS win, value FROM k WHERE w * target >= n AND whole * w <> n AND idx >= n - w)""",
        body="SELECT trace, win AS idx, max(value) AS value FROM x GROUP BY 1, 2",
    )
)
def downsample(spark, sf_dir):
    u = fx.user_records(spark, sf_dir)
    lengths = u.groupBy("trace").agg(F.greatest(F.floor(F.count("*") * 0.3), F.lit(1)).cast("long").alias("target"))
    return resample.downsample(u, lengths, ["value"])


@query(sql(fx.H, body=f"SELECT trace, idx, round(d, 6) AS \"1_diff_f_sum\" FROM (SELECT *, f_sum - lag(f_sum) OVER ({WHOLE}) AS d FROM h) WHERE d IS NOT NULL"))
def difference_1(spark, sf_dir):
    out, names = features.apply_chain(fx.hourly(spark, sf_dir), ["f_sum"], "difference_1_drop")
    return out.select("trace", "idx", *six(*names))


@query(sql(fx.H, body=f"SELECT trace, idx, round(d, 6) AS \"2_diff_1_diff_f_sum\" FROM (SELECT *, (f_sum - lag(f_sum) OVER ({WHOLE})) - (lag(f_sum, 2) OVER ({WHOLE}) - lag(f_sum, 3) OVER ({WHOLE})) AS d FROM h) WHERE d IS NOT NULL"))
def difference_chain(spark, sf_dir):
    out, names = features.apply_chain(fx.hourly(spark, sf_dir), ["f_sum"], "difference_1_drop.difference_2_drop")
    return out.select("trace", "idx", *six(*names))


@query(sql(fx.H, body=f"SELECT trace, idx, round(f_sum, 6) AS f_sum, round(coalesce(d, first_value(d IGNORE NULLS) OVER ({WHOLE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS \"2_diff_f_sum\" FROM (SELECT *, f_sum - lag(f_sum, 2) OVER ({WHOLE}) AS d FROM h)"))
def difference_keep(spark, sf_dir):
    out, names = features.apply_chain(fx.hourly(spark, sf_dir), ["f_sum"], "difference_2_keep")
    return out.select("trace", "idx", *six(*names))


_ACTIVE = "CASE WHEN " + " + ".join(f'CAST("{i}_sum" <> -1 AS INTEGER)' for i in range(1, 6)) + " > 0 THEN (" + " + ".join(f'CASE WHEN "{i}_sum" <> -1 THEN "{i}_sum" ELSE 0 END' for i in range(1, 6)) + ") / (" + " + ".join(f'CAST("{i}_sum" <> -1 AS INTEGER)' for i in range(1, 6)) + ") ELSE -1 END"


@query(sql(fx.H, fx.W, body=f"SELECT idx, round({_ACTIVE}, 6) AS avg_sum FROM w"))
def group_avg_active(spark, sf_dir):
    out, names = features.apply_chain(fx.wide(fx.hourly(spark, sf_dir)), [f"{i}_sum" for i in range(1, 6)], "execavg_drop")
    return out.select("idx", *six(*names))


@query(sql(fx.H, fx.W, body='SELECT idx, round(("1_sum" + "2_sum" + "3_sum" + "4_sum") / 4, 6) AS avg_node_sum FROM w'))
def group_avg_nodes(spark, sf_dir):
    w = fx.wide(fx.hourly(spark, sf_dir)).withColumnsRenamed({f"{i}_sum": f"node{i + 4}_sum" for i in range(1, 5)})
    out, names = features.apply_chain(w, [f"node{i}_sum" for i in range(5, 9)], "nodeavg_drop")
    return out.select("idx", *six(*names))


@query(
    sql(
        fx.H,
        fx.W,
        f'a AS (SELECT idx, "1_sum" AS one, {_ACTIVE} AS av FROM w), d AS (SELECT idx, one, av - lag(av) OVER (ORDER BY idx) AS df FROM a)',
        body='SELECT idx, round(one, 6) AS "1_sum", round(coalesce(df, first_value(df IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS "1_diff_avg_sum" FROM d',
    )
)
def bundle_chain(spark, sf_dir):
    bundle = {("1_sum",): "identity", tuple(f"{i}_sum" for i in range(1, 6)): "execavg_drop.difference_1_drop"}
    return features.build(fx.wide(fx.hourly(spark, sf_dir)), bundle).select("idx", *six("1_sum", "1_diff_avg_sum"))


# ---------------------------------------------------------------- scaling

_OFF = {"std": ("avg({c}) {o}", "stddev_pop({c}) {o}"), "minmax": ("min({c}) {o}", "max({c}) {o} - min({c}) {o}"), "robust": ("quantile_cont({c}, 0.5) {o}", "quantile_cont({c}, 0.75) {o} - quantile_cont({c}, 0.25) {o}")}


def _scaled_sql(kind: str, over: str, value: str = "{c}", source: str = "h") -> str:
    off, by = _OFF[kind]
    items = []
    for c in ("f_sum", "f_cnt"):
        o, s = (x.format(c=value.format(c=c), o=over) for x in (off, by))
        items.append(f"round(({c} - ({o})) / CASE WHEN ({s}) = 0 THEN 1 ELSE ({s}) END, 6) AS {c}")
    return f"SELECT trace, idx, {', '.join(items)} FROM {source}"


def _scaled(how: str, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        h, names = fx.hourly(spark, sf_dir), ["f_sum", "f_cnt"]
        out = {
            "regular": lambda: scale.scale_regular(h, names, kind, F.col("trace").isin(*fx.TRAIN)),
            "trace": lambda: scale.scale_trace(h, names, kind),
            "head": lambda: scale.scale_head(h, names, kind),
            "head_online": lambda: scale.scale_head_online(h, names, kind),
        }[how]()
        return out.select("trace", "idx", *six(*names))

    return f


for _kind in ("std", "minmax", "robust"):
    _regular = "(SELECT {0} FROM h WHERE trace IN ('click', 'view'))"
    _o, _s = _OFF[_kind]
    _items = ", ".join(f"round(({c} - {_regular.format(_o.format(c=c, o=''))}) / coalesce(nullif({_regular.format(_s.format(c=c, o=''))}, 0), 1), 6) AS {c}" for c in ("f_sum", "f_cnt"))
    QUERIES[f"scale_{_kind}_regular"] = _scaled("regular", _kind)
    ORACLE[f"scale_{_kind}_regular"] = sql(fx.H, body=f"SELECT trace, idx, {_items} FROM h")
    QUERIES[f"scale_{_kind}_trace"] = _scaled("trace", _kind)
    ORACLE[f"scale_{_kind}_trace"] = sql(fx.H, body=_scaled_sql(_kind, "OVER (PARTITION BY trace)"))
    if _kind == "robust":
        QUERIES["scale_robust_head"] = _scaled("head", _kind)
        ORACLE["scale_robust_head"] = sql(fx.H, body=_scaled_sql(_kind, "OVER (PARTITION BY trace)", "CASE WHEN idx < 240 THEN {c} END"))
        continue
    QUERIES[f"scale_{_kind}_head"] = _scaled("head", _kind)
    ORACLE[f"scale_{_kind}_head"] = sql(fx.H, body=_scaled_sql(_kind, "OVER (PARTITION BY trace)", "CASE WHEN idx < 240 THEN {c} END"))
    _online = _OFF["std"] if _kind == "std" else _OFF["minmax"]
    _rows = f"OVER ({WHOLE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    _head, _tail = _scaled_sql(_kind, "OVER (PARTITION BY trace)", "CASE WHEN idx < 240 THEN {c} END"), _scaled_sql(_kind, _rows).replace("stddev_pop", "stddev_samp")
    QUERIES[f"scale_{_kind}_head_online"] = _scaled("head_online", _kind)
    ORACLE[f"scale_{_kind}_head_online"] = sql(fx.H, f"a AS ({_head})", f"b2 AS ({_tail})", body="SELECT a.trace, a.idx, CASE WHEN a.idx < 240 THEN a.f_sum ELSE b2.f_sum END AS f_sum, CASE WHEN a.idx < 240 THEN a.f_cnt ELSE b2.f_cnt END AS f_cnt FROM a JOIN b2 ON a.trace = b2.trace AND a.idx = b2.idx")


# ---------------------------------------------------------------- windows


@query(sql(fx.U, body="SELECT trace, idx AS w_start, round(m, 6) AS value FROM (SELECT *, avg(value) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m, count(*) OVER (PARTITION BY trace) AS n FROM u) WHERE idx % 2 = 0 AND idx + 10 <= n"))
def sliding_windows(spark, sf_dir):
    return windows.window_means(fx.user_records(spark, sf_dir), ["value"], 10, 2).select("trace", "w_start", *six("value"))


@query(
    sql(
        fx.U,
        body="SELECT trace, idx AS w_start, n_records, round(total, 6) AS total FROM (SELECT *, count(*) OVER w AS n_records, sum(value) OVER w AS total, count(*) OVER (PARTITION BY trace) AS n FROM u WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE (idx % 8 = 0 OR idx = n - 8) AND idx + 8 <= n",
    )
)
def jumping_windows_remainder(spark, sf_dir):
    out = windows.sliding_windows(fx.user_records(spark, sf_dir), ["value"], 8, 8, remainder=True)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
    return out.select("trace", "w_start", F.size("window").cast("long").alias("n_records"), F.round(total, 6).alias("total"))


@query(sql(fx.U, body="SELECT trace, idx, round(past, 6) AS past, target FROM (SELECT *, sum(value) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past, lead(value) OVER (PARTITION BY trace ORDER BY idx) AS target FROM u) WHERE idx >= 5 AND target IS NOT NULL"))
def sequence_pairs(spark, sf_dir):
    out = windows.sequence_pairs(fx.user_records(spark, sf_dir), ["value"], 5, 2)
    return out.select("trace", "idx", F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]), 6).alias("past"), F.col("target")[0].alias("target"))


@query(sql(fx.H, fx.GT, fx.LAB, "bi AS (SELECT trace, idx, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS run FROM lab WHERE label > 0)", body="SELECT trace, min(idx) AS r_start, max(idx) + 1 AS r_end FROM bi GROUP BY trace, run"))
def binary_ranges(spark, sf_dir):
    return windows.ranges(fx.labelled(fx.hourly(spark, sf_dir)), F.col("label") > 0)


@query(sql(fx.H, fx.GT, fx.LAB, fx.REAL, body="SELECT * FROM real"))
def multiclass_ranges(spark, sf_dir):
    return fx.truth(fx.labelled(fx.hourly(spark, sf_dir))).select("trace", "class", "r_start", "r_end")


@query(
    sql(
        fx.L,
        body="""SELECT trace, count(*) AS n, round(sum(m), 3) AS sum_mean, round(sum(sd), 3) AS sum_std FROM (
                SELECT trace, avg(l_quantity) OVER w AS m, stddev_samp(l_quantity) OVER w AS sd, count(*) OVER w AS c FROM l WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)) WHERE c = 40 GROUP BY trace""",
    )
)
def rolling_statistics(spark, sf_dir):
    l = fx.lines(spark, sf_dir)
    q = F.col("l_quantity")
    held = l.select("trace", windows.running(q, "mean", 40).alias("m"), windows.running(q, "std", 40).alias("sd")).where("m IS NOT NULL")
    return held.groupBy("trace").agg(F.count("*").alias("n"), F.round(F.sum("m"), 3).alias("sum_mean"), F.round(F.sum("sd"), 3).alias("sum_std"))


_PARTS = """
k AS (SELECT trace, idx, f_sum, f_cnt, n, greatest(n // 5, 1) AS w FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM h)),
x AS (SELECT trace, 0 AS ft, idx // w AS win, f_sum AS v FROM k WHERE idx < (n // w) * w UNION ALL SELECT trace, 0, n // w, f_sum FROM k WHERE (n // w) * w <> n AND idx >= n - w
      UNION ALL SELECT trace, 1, idx // w, f_cnt FROM k WHERE idx < (n // w) * w UNION ALL SELECT trace, 1, n // w, f_cnt FROM k WHERE (n // w) * w <> n AND idx >= n - w),
a AS (SELECT trace, ft, win, avg(v) AS m FROM x GROUP BY 1, 2, 3),
d AS (SELECT trace, ft, m - lag(m) OVER (PARTITION BY trace, ft ORDER BY win) AS d FROM a)"""


@query(sql(fx.H, _PARTS, body="SELECT trace, CAST(ft AS INTEGER) AS ft, min(d) > 0 OR max(d) < 0 AS monotone FROM d GROUP BY 1, 2"))
def monotone_fifths(spark, sf_dir):
    return windows.fifths(fx.hourly(spark, sf_dir), ["f_sum", "f_cnt"]).select("trace", "ft", "monotone")


# ---------------------------------------------------------------- splits


def _split_sql(source: str, part: str, key: str) -> str:
    return f"""
k AS (SELECT *, row_number() OVER ({part} ORDER BY md5('21:' || {key})) - 1 AS r, count(*) OVER ({part}) AS n FROM {source})"""


@query(sql(fx.U, _split_sql("u", "", "event_id::VARCHAR"), body="SELECT event_id, CASE WHEN r < floor((1 - 0.15 - 0.15) * n) THEN 'train' WHEN r < floor((1 - 0.15) * n) THEN 'val' ELSE 'test' END AS dataset FROM k"))
def hash_split_random(spark, sf_dir):
    return split.random_split(fx.user_records(spark, sf_dir), F.col("event_id")).select("event_id", "dataset")


@query(
    sql(
        fx.U,
        """
s1 AS (SELECT trace, idx, n, n // 3 AS q, n % 3 AS r FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM u)),
s2 AS (SELECT *, CAST(CASE WHEN idx < r * (q + 1) THEN idx // (q + 1) ELSE r + (idx - r * (q + 1)) // greatest(q, 1) END AS INTEGER) AS stratum FROM s1),
s3 AS (SELECT *, CASE WHEN stratum < r THEN (stratum + 1) * (q + 1) ELSE r * (q + 1) + (stratum - r + 1) * q END AS e FROM s2),
s4 AS (SELECT trace, stratum, idx AS w_start FROM s3 WHERE idx + 6 <= e),
k AS (SELECT *, row_number() OVER (PARTITION BY trace, stratum ORDER BY md5('21:' || trace || '/' || w_start)) - 1 AS rk, count(*) OVER (PARTITION BY trace, stratum) AS m FROM s4)""",
        body="SELECT trace, stratum, w_start, CASE WHEN rk < floor((1 - 0.15 - 0.15) * m) THEN 'train' WHEN rk < floor((1 - 0.15) * m) THEN 'val' ELSE 'test' END AS dataset FROM k",
    )
)
def hash_split_stratified(spark, sf_dir):
    return split.stratified_split(fx.user_records(spark, sf_dir), 6)


@query(
    sql(
        fx.U,
        """
c AS (SELECT trace, count(*) AS n FROM u GROUP BY trace), big AS (SELECT trace FROM c ORDER BY n DESC, trace LIMIT 1),
o AS (SELECT trace FROM c WHERE trace NOT IN (SELECT trace FROM big) ORDER BY md5('0:' || trace), trace LIMIT 9)""",
        body="SELECT trace, count(*) AS n FROM u WHERE trace IN (SELECT trace FROM big UNION SELECT trace FROM o) GROUP BY trace",
    )
)
def period_selection(spark, sf_dir):
    return split.select_periods(fx.user_records(spark, sf_dir), 10).groupBy("trace").agg(F.count("*").alias("n"))


@query(
    sql(
        fx.H,
        fx.GT,
        fx.LAB,
        """
e AS (SELECT unnest(generate_series(0, 4)) AS repetition, trace, idx, CAST(label > 0 AS INTEGER) AS y FROM lab),
k AS (SELECT *, row_number() OVER (PARTITION BY y, repetition ORDER BY md5('0:' || repetition || '/' || trace || '/' || idx)) - 1 AS r, count(*) OVER (PARTITION BY y, repetition) AS n FROM e)""",
        body="SELECT CAST(repetition AS INTEGER) AS repetition, y, trace, idx FROM k WHERE r < floor(0.8 * n)",
    )
)
def subsample_records(spark, sf_dir):
    lab = fx.labelled(fx.hourly(spark, sf_dir)).select("trace", "idx", (F.col("label") > 0).cast("int").alias("y"))
    return split.subsample(lab, 0.8, F.concat_ws("/", "trace", "idx"), 5, ["y"]).select("repetition", "y", "trace", "idx")


@query()
def pca_features(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(16)]
    flat = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    out, _ = scale.pca(flat, names, 5)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("pc")])


@query()
def factor_analysis(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(8)]
    flat = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return scale.factor_analysis(flat, names, 3)


