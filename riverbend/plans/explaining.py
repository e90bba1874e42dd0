"""Queries of explanation discovery, its evaluation, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import edeval, explain, nets, report, scale, windows
from . import fixtures as fx
from .fixtures import FEATURES, sql
from .series import r6, six

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LAB = (fx.H, fx.GT, fx.LAB)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instance per trace: its labelled records."""
    lab = fx.labelled(fx.hourly(spark, sf_dir))
    return stored(lab.select(F.col("trace").alias("instance"), "idx", (F.col("label") > 0).cast("int").alias("y"), *FEATURES))


LONG = "lg AS (" + " UNION ALL ".join(f"SELECT trace AS instance, idx, CAST(label > 0 AS INTEGER) AS y, {i} AS ft, {c} AS value FROM lab" for i, c in enumerate(FEATURES)) + ")"
SEG = """
va AS (SELECT instance, ft, value, sum(1 - y) AS n0, sum(y) AS n1 FROM lg GROUP BY 1, 2, 3),
vb AS (SELECT *, n0 + n1 AS n, CASE WHEN n1 = 0 THEN 'normal' WHEN n0 = 0 THEN 'anomalous' ELSE 'mixed' END AS kind FROM va),
vc AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS c, row_number() OVER w = 1 AS first, lead(value) OVER w IS NULL AS last FROM vb WINDOW w AS (PARTITION BY instance, ft ORDER BY value)),
vd AS (SELECT *, sum(c) OVER (PARTITION BY instance, ft ORDER BY value) AS seg,
              CASE WHEN first THEN '-inf'::DOUBLE WHEN last AND n = 1 THEN 'inf'::DOUBLE ELSE value END AS lo0, CASE WHEN last THEN 'inf'::DOUBLE WHEN first AND n = 1 THEN '-inf'::DOUBLE ELSE value END AS hi0 FROM vc),
sg AS (SELECT instance, ft, seg, kind, arg_min(lo0, value) AS lo, arg_max(hi0, value) AS hi, sum(n) AS n FROM vd GROUP BY 1, 2, 3, 4),
nn AS (SELECT instance, sum(1 - y) AS n0, sum(y) AS n1 FROM (SELECT DISTINCT instance, idx, y FROM lg) GROUP BY 1),
rw0 AS (SELECT sg.instance, ft, sum(-(n::DOUBLE / (n0 + n1)) * ln(n::DOUBLE / (n0 + n1))) + sum(CASE WHEN kind = 'mixed' THEN ln(n) ELSE 0 END) AS r, max(n0) AS n0, max(n1) AS n1, sum(CASE WHEN kind = 'mixed' THEN 0 ELSE 1 END) AS pure
        FROM sg JOIN nn ON nn.instance = sg.instance GROUP BY 1, 2),
rw AS (SELECT instance, ft, CASE WHEN pure = 0 THEN 0.0 ELSE (-(n0::DOUBLE / (n0 + n1)) * ln(n0::DOUBLE / (n0 + n1)) - (n1::DOUBLE / (n0 + n1)) * ln(n1::DOUBLE / (n0 + n1))) / r END AS reward FROM rw0)"""


@query(sql(*LAB, LONG, SEG, body="SELECT instance, CAST(ft AS INTEGER) AS ft, kind, count(*) AS segments, CAST(sum(n) AS BIGINT) AS records, round(sum(CASE WHEN isfinite(lo) THEN lo ELSE 0 END), 4) AS lows, round(sum(CASE WHEN isfinite(hi) THEN hi ELSE 0 END), 4) AS highs FROM sg GROUP BY 1, 2, 3"))
def feature_segments(spark, sf_dir):
    segs = explain.segments(explain.sample(_wide(spark, sf_dir), FEATURES, "instance"))
    finite = lambda c: F.round(F.sum(F.when(F.abs(F.col(c)) == explain.INF, 0.0).otherwise(F.col(c))), 4)
    return segs.groupBy("instance", "ft", "kind").agg(F.count("*").alias("segments"), F.sum("n").alias("records"), finite("lo").alias("lows"), finite("hi").alias("highs"))


@query(sql(*LAB, LONG, SEG, body="SELECT instance, CAST(ft AS INTEGER) AS ft, round(reward, 6) AS reward FROM rw"))
def feature_reward(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return explain.rewards(explain.segments(explain.sample(wide, FEATURES, "instance")), explain.class_counts(wide)).select("instance", "ft", *six("reward"))


@query(
    sql(
        *LAB,
        LONG,
        SEG,
        """
dr AS (SELECT *, row_number() OVER w AS k, reward - lead(reward) OVER w AS d FROM rw WINDOW w AS (PARTITION BY instance ORDER BY reward DESC, ft)),
lv AS (SELECT instance, arg_max(reward, (d, -k)) AS level FROM dr WHERE d IS NOT NULL GROUP BY instance)""",
        body="SELECT rw.instance, CAST(ft AS INTEGER) AS ft, round(CASE WHEN reward < level THEN 0.0 ELSE reward END, 6) AS reward FROM rw LEFT JOIN lv ON lv.instance = rw.instance",
    )
)
def reward_leap(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    scored = explain.rewards(explain.segments(explain.sample(wide, FEATURES, "instance")), explain.class_counts(wide))
    return explain.reward_leap(scored).select("instance", "ft", *six("reward"))


@query(
    sql(
        *LAB,
        LONG,
        """
nm AS (SELECT instance, ft, value, row_number() OVER (PARTITION BY instance, ft ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY instance, ft) AS n FROM lg WHERE y = 0),
sd AS (SELECT instance, ft, stddev_pop(value) AS s FROM nm GROUP BY 1, 2),
zz AS (SELECT instance, ft, (s - avg(s) OVER (PARTITION BY instance)) / CASE WHEN stddev_pop(s) OVER (PARTITION BY instance) = 0 THEN 1 ELSE stddev_pop(s) OVER (PARTITION BY instance) END AS z FROM sd),
kk AS (SELECT *, greatest(n // 5, 1) AS w FROM nm),
xx AS (SELECT instance, ft, i // w AS win, value FROM kk WHERE i < (n // w) * w UNION ALL SELECT instance, ft, n // w, value FROM kk WHERE (n // w) * w <> n AND i >= n - w),
aa AS (SELECT instance, ft, win, avg(value) AS m FROM xx GROUP BY 1, 2, 3),
dd AS (SELECT instance, ft, m - lag(m) OVER (PARTITION BY instance, ft ORDER BY win) AS d FROM aa)""",
        body="SELECT instance, CAST(ft AS INTEGER) AS ft FROM zz WHERE z >= 1.64 UNION SELECT instance, CAST(ft AS INTEGER) FROM dd GROUP BY instance, ft HAVING min(d) > 0 OR max(d) < 0",
    )
)
def fp_features(spark, sf_dir):
    from ..functions.frames import numbered

    normal = numbered(_wide(spark, sf_dir).where("y = 0"), ["instance"], ["idx"], "idx")
    return explain.false_positives(normal, FEATURES)


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1, len(FEATURES))]


@query(sql(*LAB, body=" UNION ALL ".join(f"SELECT trace AS instance, {i} AS ft1, {j} AS ft2, round(coalesce(corr({FEATURES[i]}, {FEATURES[j]}), 0), 6) AS corr FROM lab GROUP BY trace" for i, j in _PAIRS)))
def corr_pairs(spark, sf_dir):
    return explain.correlations(_wide(spark, sf_dir), FEATURES).select("instance", "ft1", "ft2", *six("corr"))


@query()
def feature_clusters(spark, sf_dir):
    return explain.clusters(_wide(spark, sf_dir), FEATURES)


@query()
def exstream_explain(spark, sf_dir):
    return explain.exstream(_wide(spark, sf_dir), FEATURES)


HIST = """
lm AS (SELECT instance, ft, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM lg WHERE y = 0 GROUP BY 1, 2),
bn AS (SELECT lg.*, lo, hi, CAST(least(greatest(floor((value - lo) / (hi - lo) * 10), 0), 9) AS INTEGER) AS bin FROM lg JOIN lm ON lm.instance = lg.instance AND lm.ft = lg.ft),
hc AS (SELECT instance, ft, bin, sum(y) AS a1, sum(1 - y) AS a0, max(lo) AS lo, max(hi) AS hi FROM bn GROUP BY 1, 2, 3),
nn AS (SELECT instance, sum(1 - y) AS n0, sum(y) AS n1 FROM (SELECT DISTINCT instance, idx, y FROM lg) GROUP BY 1),
rk AS (SELECT hc.*, n1, (a1::DOUBLE / CASE WHEN a1 + a0 = 0 THEN 1 ELSE a1 + a0 END) / (CASE WHEN n1 - a1 = 0 THEN 1 ELSE n1 - a1 END::DOUBLE / CASE WHEN n1 + n0 - a1 - a0 = 0 THEN 1 ELSE n1 + n0 - a1 - a0 END) AS ratio FROM hc JOIN nn ON nn.instance = hc.instance),
it AS (SELECT * FROM rk WHERE a1 >= greatest(n1 // 10, 1) AND ratio >= 1.5)"""


@query(sql(*LAB, LONG, HIST, body="SELECT instance, CAST(ft AS INTEGER) AS ft, bin, CAST(a1 AS BIGINT) AS a1, CAST(a0 AS BIGINT) AS a0, round(ratio, 6) AS ratio FROM it"))
def hist_items(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return explain.items(explain.sample(wide, FEATURES, "instance"), explain.class_counts(wide)).select("instance", "ft", "bin", "a1", "a0", *six("ratio"))


_SETS = """
tx AS (SELECT bn.instance, idx, y, bn.ft || '_' || bn.bin AS item FROM bn JOIN it ON it.instance = bn.instance AND it.ft = bn.ft AND it.bin = bn.bin),
s1 AS (SELECT instance, idx, y, item AS items, item AS last, 1 AS size FROM tx),
s2 AS (SELECT a.instance, a.idx, a.y, a.items || ',' || b.item AS items, b.item AS last, 2 AS size FROM s1 a JOIN tx b ON a.instance = b.instance AND a.idx = b.idx AND a.last < b.item),
s3 AS (SELECT a.instance, a.idx, a.y, a.items || ',' || b.item AS items, b.item AS last, 3 AS size FROM s2 a JOIN tx b ON a.instance = b.instance AND a.idx = b.idx AND a.last < b.item),
s4 AS (SELECT a.instance, a.idx, a.y, a.items || ',' || b.item AS items, b.item AS last, 4 AS size FROM s3 a JOIN tx b ON a.instance = b.instance AND a.idx = b.idx AND a.last < b.item),
al AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
ct AS (SELECT al.instance, items, size, sum(y) AS a1, sum(1 - y) AS a0, max(n1) AS n1, max(n0) AS n0 FROM al JOIN nn ON nn.instance = al.instance GROUP BY 1, 2, 3),
st AS (SELECT instance, items, size, a1::DOUBLE / n1 AS support, (a1::DOUBLE / CASE WHEN a1 + a0 = 0 THEN 1 ELSE a1 + a0 END) / (CASE WHEN n1 - a1 = 0 THEN 1 ELSE n1 - a1 END::DOUBLE / CASE WHEN n1 + n0 - a1 - a0 = 0 THEN 1 ELSE n1 + n0 - a1 - a0 END) AS ratio
       FROM ct WHERE a1::DOUBLE / n1 >= 0.2)"""


def _sets(wide: DataFrame) -> DataFrame:
    long, counts = explain.sample(wide, FEATURES, "instance"), explain.class_counts(wide)
    return explain.itemsets(explain.baskets(long, explain.items(long, counts)), counts, 0.2)


@query(sql(*LAB, LONG, HIST, _SETS, body=f"SELECT instance, items, CAST(size AS INTEGER) AS size, {r6('support', 'ratio')} FROM st"))
def itemset_risk(spark, sf_dir):
    return _sets(_wide(spark, sf_dir)).select("instance", F.concat_ws(",", "items").alias("items"), "size", *six("support", "ratio"))


@query(sql(*LAB, LONG, HIST, _SETS, body="SELECT instance, items, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ratio DESC, support DESC, size DESC, items) AS k FROM st) WHERE k = 1"))
def macrobase_explain(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    found = explain.macrobase(wide, FEATURES, support=0.2)
    edges = found.join(explain.items(explain.sample(wide, FEATURES, "instance"), explain.class_counts(wide)).select("instance", "ft", "lo", "hi", "bin"), ["instance", "ft", "lo", "hi"])
    return edges.groupBy("instance").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("_", "ft", "bin")))).alias("items"), F.round(F.max("ratio"), 6).alias("ratio"))


@query()
def lime_explain(spark, sf_dir):
    """Windows that end in an anomalous record, by the score of an autoencoder of the undisturbed traces."""
    h = stored(fx.labelled(scale.scale_trace(fx.hourly(spark, sf_dir), FEATURES)))
    model = nets.DenseAutoencoder(FEATURES, 4, (8,), 3, 20, 0.02).fit(h.where(F.col("trace").isin(*fx.TRAIN)))
    last = h.select("trace", (F.col("idx") - 3).alias("w_start"), (F.col("label") > 0).cast("int").alias("y"))
    held = windows.sliding_windows(h, FEATURES, 4).join(last, ["trace", "w_start"]).withColumnRenamed("trace", "instance")
    return explain.union_of(explain.lime_windows(held, FEATURES, model.score_windows, 4))


_RULES = """
ru(rule, ft, lo, hi) AS (VALUES ('busy', 0, 12.0, 'inf'::DOUBLE), ('busy', 1, 600.0, 800.0), ('busy', 1, 800.0, 'inf'::DOUBLE), ('mild', 3, 40.0, 60.0)),
jd AS (SELECT rule, instance, idx, y, lg.ft, bool_or(value >= lo AND value <= hi) AS ok FROM lg JOIN ru ON ru.ft = lg.ft GROUP BY 1, 2, 3, 4, 5),
pd AS (SELECT rule, instance, idx, y, CAST(bool_and(ok) AS INTEGER) AS pred FROM jd GROUP BY 1, 2, 3, 4)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    inf = float("inf")
    rules = spark.createDataFrame([("busy", 0, 12.0, inf), ("busy", 1, 600.0, 800.0), ("busy", 1, 800.0, inf), ("mild", 3, 40.0, 60.0)], "rule string, ft int, lo double, hi double")
    long = explain.sample(_wide(spark, sf_dir), FEATURES, "instance")
    named = long.select("instance").distinct().crossJoin(F.broadcast(rules))
    return explain.classify(named, long, keys=("instance", "idx", "y"))


@query(sql(*LAB, LONG, _RULES, body="SELECT * FROM pd"))
def rule_classify(spark, sf_dir):
    return _judged(spark, sf_dir).select("rule", "instance", "idx", "y", "pred")


@query(sql(*LAB, LONG, _RULES, body="SELECT rule, instance, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT rule, instance, CASE WHEN sum(pred) = 0 THEN 0.0 ELSE sum(y * pred)::DOUBLE / sum(pred) END AS p, CASE WHEN sum(y) = 0 THEN 0.0 ELSE sum(y * pred)::DOUBLE / sum(y) END AS r FROM pd GROUP BY 1, 2)"))
def rule_accuracy(spark, sf_dir):
    return edeval.accuracy(_judged(spark, sf_dir), ["rule", "instance"]).select("rule", "instance", *six("precision", "recall", "f1"))


_INST = """
ins0 AS (SELECT *, coalesce(lag(r_end) OVER (PARTITION BY trace ORDER BY r_start), 0) AS n_start FROM real),
ins AS (SELECT trace, class, n_start, r_start, r_end FROM ins0 WHERE r_start - n_start >= 2 AND r_end - r_start >= 2)"""


@query(sql(*LAB, fx.REAL, _INST, body="SELECT * FROM ins"))
def ed_instances(spark, sf_dir):
    return edeval.anomaly_instances(fx.truth(fx.labelled(fx.hourly(spark, sf_dir))))


def _expanded_sql(policy: str) -> str:
    before = {"before": "need", "both": "need // 2", "after": "0"}[policy]
    return sql(
        *LAB,
        fx.REAL,
        f"""
nd AS (SELECT *, greatest(12 - (r_end - r_start), 0) AS need, 720 AS n FROM real),
ba AS (SELECT *, {before} AS b, need - {before} AS a FROM nd),
se AS (SELECT *, greatest(r_start - b, 0) AS s, r_end + greatest(b - r_start, 0) AS e FROM ba),
ov AS (SELECT *, greatest(e + a - n, 0) AS o FROM se WHERE e <= n)""",
        body="SELECT trace, class, r_start, r_end, s - o AS e_start, least(e + a, n) AS e_end FROM ov WHERE s - o >= 0",
    )


def _expanded(policy: str):
    def f(spark, sf_dir):
        h = fx.hourly(spark, sf_dir)
        sizes = h.groupBy("trace").agg(F.count("*").alias("n"))
        return edeval.expanded_instances(fx.truth(fx.labelled(h)), sizes, 8, 5, policy)

    return f


for _p in ("before", "after", "both"):
    QUERIES[f"ed_expanded_{_p}"] = _expanded(_p)
    ORACLE[f"ed_expanded_{_p}"] = _expanded_sql(_p)


@query(sql(*LAB, fx.REAL, _INST, body="SELECT class, count(*) AS n, round(count(i) / count(*)::DOUBLE, 6) AS covered, round(sum(CASE WHEN i IS NOT NULL AND r_start % 3 <> 0 THEN 1 ELSE 0 END) / nullif(count(i), 0)::DOUBLE, 6) AS explained FROM (SELECT real.class, real.r_start, ins.r_start AS i FROM real LEFT JOIN ins ON ins.trace = real.trace AND ins.r_start = real.r_start) GROUP BY class"))
def ed_proportions(spark, sf_dir):
    real = fx.truth(fx.labelled(fx.hourly(spark, sf_dir)))
    instances = edeval.anomaly_instances(real)
    return edeval.proportions(real, instances, instances.where("r_start % 3 <> 0")).select("class", "n", *six("covered", "explained"))


_EX = [("a", i, f) for i, fs in enumerate([(1, 2), (1, 2), (2, 3, 4)]) for f in fs] + [("b", i, f) for i, fs in enumerate([(1,), (5, 6)]) for f in fs] + [("c", 0, 7)]
_EXV = "ex(class, instance, ft) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _EX) + ")"


def _explanations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_EX, "class string, instance int, ft int")


@query(sql(_EXV, body="SELECT class, avg(s) AS conciseness FROM (SELECT class, instance, count(DISTINCT ft) AS s FROM ex GROUP BY 1, 2) GROUP BY class"))
def ed_conciseness(spark, sf_dir):
    return edeval.conciseness(_explanations(spark))


@query(
    sql(
        _EXV,
        "c0 AS (SELECT class, ft, count(*) AS c FROM ex GROUP BY 1, 2), t0 AS (SELECT class, sum(c) AS t FROM c0 GROUP BY 1), m0 AS (SELECT class, count(DISTINCT instance) AS m FROM ex GROUP BY 1), v0 AS (SELECT c0.class, pow(2, sum(-(c::DOUBLE / t) * log2(c::DOUBLE / t))) AS v, max(t) AS t FROM c0 JOIN t0 ON t0.class = c0.class GROUP BY 1)",
        body="SELECT v0.class, CASE WHEN m > 1 THEN round(v / (t::DOUBLE / m), 6) END AS consistency FROM v0 JOIN m0 ON m0.class = v0.class",
    )
)
def ed_consistency(spark, sf_dir):
    return edeval.consistency(_explanations(spark)).select("class", *six("consistency"))


@query()
def ed2_accuracy(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    lab = fx.labelled(h)
    instances = edeval.anomaly_instances(fx.truth(lab))
    records = edeval.instance_records(instances, lab, FEATURES)
    wide = records.select("instance", "idx", "y", *FEATURES)
    classes = records.select("instance", "class").distinct()
    rules = explain.macrobase(wide, FEATURES).select("instance", "ft", "lo", "hi")
    return edeval.cross_accuracy(rules, explain.sample(wide, FEATURES, "instance"), classes, half_open=True)


# ---------------------------------------------------------------- reports

_METRICS = [(m, g, c, k, round(0.1 * (i + 1) + 0.07 * j + 0.013 * a + 0.005 * b, 4)) for i, m in enumerate(("ae", "rnn")) for j, g in enumerate(("global", "app1", "app2", "app_avg")) for a, c in enumerate(("1", "2", "7", "global")) for b, k in enumerate(("F1", "PRECISION", "RECALL"))]
_MV = "mt(method, granularity, cls, metric, value) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}::DOUBLE)" for a, b, c, d, e in _METRICS) + ")"


def _metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_METRICS, "method string, granularity string, cls string, metric string, value double")


@query(sql(_MV, body="SELECT method, round(median(value), 6) AS value FROM mt WHERE granularity = 'app1' AND metric = 'F1' GROUP BY method"))
def report_median(spark, sf_dir):
    return report.report(_metrics(spark), granularity="app1").select("method", *six("value"))


@query(sql(_MV, body="SELECT method, granularity, metric, round(avg(value), 6) AS value FROM mt WHERE cls NOT IN ('global', 'avg', '7') GROUP BY 1, 2, 3"))
def class_average(spark, sf_dir):
    return report.class_average(_metrics(spark)).select("method", "granularity", "metric", *six("value"))


@query(sql(_MV, body="SELECT method, granularity, max(CASE WHEN cls = '1' AND metric = 'F1' THEN value END) AS \"1_F1\", max(CASE WHEN cls = 'global' AND metric = 'RECALL' THEN value END) AS \"GLOBAL_RECALL\" FROM mt GROUP BY 1, 2"))
def report_wide(spark, sf_dir):
    return report.wide(_metrics(spark), ["1_F1", "GLOBAL_RECALL"])


@query(sql(_MV, body="SELECT method, granularity, cls, metric, CASE WHEN method = 'ae' AND metric = 'F1' THEN 0.5 ELSE value END AS value FROM mt UNION ALL SELECT 'bigan', 'global', 'global', 'F1', 0.9"))
def upsert_metrics(spark, sf_dir):
    old = _metrics(spark)
    fresh = old.where("method = 'ae' AND metric = 'F1'").withColumn("value", F.lit(0.5))
    added = spark.createDataFrame([("bigan", "global", "global", "F1", 0.9)], old.schema)
    return report.upsert(old, fresh.unionByName(added))


_RUNS = [("a", "a_2024.01.02.10.00.00", 1), ("a", "a_2024.03.01.09.00.00", 2), ("a", "a_2023.12.31.23.59.59", 3), ("b", "b_2024.01.01.00.00.00", 4)]


@query("WITH r(config, run, n) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _RUNS) + ") SELECT config, run, n FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY strptime(right(run, 19), '%Y.%m.%d.%H.%M.%S') DESC) AS k FROM r) WHERE k = 1")
def latest_run(spark, sf_dir):
    return report.latest(spark.createDataFrame(_RUNS, "config string, run string, n int"))


_CURVES = [(m, s, x, round(0.5 + 0.1 * i + 0.05 * s + 0.2 * x + 0.01 * r, 4)) for i, m in enumerate(("ae", "rnn")) for s in (0, 1, 2) for x in (0.0, 0.25, 0.5, 1.0) for r in (0, 1, 2)]


@query(
    "WITH r(model, seed, share, f1) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _CURVES) + """),
p AS (SELECT model, seed, share, median(f1) AS y FROM r GROUP BY 1, 2, 3),
s AS (SELECT *, lead(share) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY model, seed ORDER BY share)),
g AS (SELECT unnest([0.0, 0.1, 0.4, 0.75, 1.0])::DOUBLE AS x),
v AS (SELECT model, x, CASE WHEN x1 IS NULL THEN y ELSE y + (x - share) / (x1 - share) * (y1 - y) END AS v FROM s, g WHERE x >= share AND (x < x1 OR x1 IS NULL AND x = share))
SELECT model, x, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM v GROUP BY 1, 2"""
)
def learning_curve(spark, sf_dir):
    runs = spark.createDataFrame(_CURVES, "model string, seed int, share double, f1 double")
    return report.learning_curve(runs, [0.0, 0.1, 0.4, 0.75, 1.0]).select("model", "x", *six("mean", "std"))
