"""Hand-computed cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverbend.operators import clean, edeval, evaluate, explain, features, ranges, resample, scale, score, threshold, windows
from riverbend.plans import fixtures as fx


def frame(spark, rows, names="trace string, idx long, value double"):
    return spark.createDataFrame(rows, names)


def series(spark, values, trace="a"):
    return frame(spark, [(trace, i, float(v)) for i, v in enumerate(values)])


def column(df, name="value", by="idx"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize(("text", "target", "expected"), [("ABC", 11, "AAAABBBBCCC"), ("ABC", 10, "AAABBBCCCC"), ("ABCD", 10, "AABBCCDDDD")])
def test_upsample(spark, text, target, expected):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(text)], "trace string, idx long, value string")
    lengths = spark.createDataFrame([("a", target)], "trace string, target long")
    assert "".join(column(resample.upsample(df, lengths, ["value"]))) == expected


def test_downsample_with_remainder(spark):
    lengths = spark.createDataFrame([("a", 3)], "trace string, target long")
    # 7 to 3: pairs, and the last record is left out as three windows are there already
    assert column(resample.downsample(series(spark, [1, 5, 2, 3, 9, 4, 0]), lengths, ["value"])) == [5, 3, 9]
    # 8 to 3: triples, the last of them the last three records
    assert column(resample.downsample(series(spark, [1, 5, 2, 3, 9, 4, 0, 1]), lengths, ["value"])) == [5, 9, 4]


def test_match_sampling_goes_both_ways(spark):
    df = series(spark, [1, 2, 3, 4], "down").union(series(spark, [1, 2], "up"))
    lengths = spark.createDataFrame([("down", 2), ("up", 4)], "trace string, target long")
    out = resample.match_sampling(df, lengths, ["value"])
    assert column(out.where("trace = 'down'")) == [2, 4]
    assert column(out.where("trace = 'up'")) == [1, 1, 2, 2]


def test_ranges(spark):
    df = series(spark, [0, 1, 1, 0, 1])
    assert sorted((r.r_start, r.r_end) for r in windows.ranges(df, F.col("value") == 1).collect()) == [(1, 3), (4, 5)]
    labels = frame(spark, [("a", i, v) for i, v in enumerate([0, 2, 2, 1, 0, 1])], "trace string, idx long, label int")
    found = sorted((r["class"], r.r_start, r.r_end) for r in windows.class_ranges(labels).collect())
    assert found == [(1, 3, 4), (1, 5, 6), (2, 1, 3)]


def overlap(spark, real, pred, **how):
    r = spark.createDataFrame([("a", 1, *real)], "trace string, class int, r_start long, r_end long")
    p = spark.createDataFrame([("a", *x) for x in pred], "trace string, r_start long, r_end long")
    params = {"alpha": 0.0, "recall_size": "default", "recall_bias": "flat", "recall_card": "dup"} | how
    return ranges.range_recalls(r, p, params).first().reward


def test_overlap_rewards(spark):
    assert overlap(spark, (0, 5), [(5, 8)], alpha=1.0) == 1.0
    assert overlap(spark, (0, 5), [(5, 8)]) == 0.0
    assert overlap(spark, (0, 4), [(2, 6)]) == 0.5
    assert overlap(spark, (0, 4), [(2, 6)], recall_bias="front") == pytest.approx(1 / 6)
    assert overlap(spark, (0, 4), [(2, 6)], recall_bias="back") == pytest.approx(5 / 6)
    assert overlap(spark, (0, 4), [(2, 6)], recall_bias="front", recall_size="flat.normalized") == pytest.approx(0.1)
    two = [(0, 1), (3, 4)]
    assert overlap(spark, (0, 4), two) == 0.5
    assert overlap(spark, (0, 4), two, recall_card="no.dup") == 0.0
    assert overlap(spark, (0, 4), two, recall_card="inv.poly") == 0.25


def test_touching_ranges_are_apart_when_strict(spark):
    r = spark.createDataFrame([("a", 1, 0, 5)], "trace string, class int, r_start long, r_end long")
    p = spark.createDataFrame([("a", 5, 8)], "trace string, r_start long, r_end long")
    assert ranges.range_recalls(r, p, ranges.LEVELS["ad1"], strict=True).first().reward == 0.0


def test_rewards_against_sums_over_positions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        n = int(rng.integers(2, 12))
        a = int(rng.integers(0, n))
        rows.append((n, a, int(rng.integers(a + 1, n + 1))))
    df = spark.createDataFrame(rows, "n long, a long, b long")
    names = [(s, b) for s in ranges.SIZES for b in ranges.BIASES]
    out = df.select("n", "a", "b", *[ranges.size_reward(F.col("n"), F.col("a"), F.col("b"), s, b).alias(f"{s}|{b}") for s, b in names]).collect()
    for r in out:
        for s, b in names:
            weight = {"flat": np.ones(r.n), "front": np.arange(r.n)[::-1], "back": np.arange(r.n)}[b].astype(float)
            share = weight[r.a : r.b].sum() / weight.sum()
            if s == "flat.normalized":
                k = r.b - r.a
                best = np.sort(weight)[::-1][:k].sum() / weight.sum()
                share = k / r.n * share / best if best else 0.0
            assert r[f"{s}|{b}"] == pytest.approx(share), (r, s, b)


def test_thresholds(spark):
    s = lambda values: spark.createDataFrame([(float(v),) for v in values], "score double")
    assert threshold.threshold(s([1, 2, 3, 4]), "std", 2.0).first()[0] == pytest.approx(4.736068)
    assert threshold.threshold(s([1, 2, 3, 4, 100]), "mad", 2.0).first()[0] == pytest.approx(5.9652)
    assert threshold.threshold(s([1, 2, 3, 4]), "iqr", 1.5).first()[0] == pytest.approx(5.5)
    # the second iteration sees what does not exceed the first threshold
    assert threshold.threshold(s([1, 2, 3, 4, 100]), "iqr", 1.5, 2).first()[0] == pytest.approx(5.5)
    assert len(threshold.grid()) == 24
    assert len(threshold.grid(removals=(0.5, 1.0))) == 36


def test_grid_agrees_with_single_thresholds(spark):
    scores = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).exponential(size=200)], "score double")
    for r in threshold.threshold_grid(scores).collect():
        assert r.threshold == pytest.approx(threshold.threshold(scores, r.method, r.factor, r.iterations, r.removal).first()[0])


def test_window_to_record(spark):
    w = frame(spark, [("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "trace string, w_start long, score double")
    assert column(windows.window_to_record(w, 3), "score") == pytest.approx([1, 1.5, 2, 3, 7 / 3, 4 / 3])
    assert column(windows.window_to_record(w, 3, strict=True), "score") == pytest.approx([1, 1.5, 2, 3, 3.5, 4])
    few = frame(spark, [("a", 0, 2.0)], "trace string, w_start long, score double")
    assert column(windows.window_to_record(few, 3), "score") == pytest.approx([2, 1, 2 / 3])


def test_difference_drops_the_head_unless_an_entry_before_keeps_it(spark):
    out, names = features.apply_chain(series(spark, [1, 4, 9]), ["value"], "difference_1_drop")
    assert names == ["1_diff_value"] and column(out, names[0]) == [3, 5]
    kept = features.build(series(spark, [1, 4, 9]).withColumn("other", F.col("value")), {("other",): "identity", ("value",): "difference_1_drop"})
    assert column(kept, "1_diff_value") == [3, 3, 5]
    out, names = features.apply_chain(series(spark, [1, 4, 9, 16]), ["value"], "difference_1_drop.difference_1_drop")
    assert names == ["1_diff_1_diff_value"] and column(out, names[0]) == [2, 2]
    out, _ = features.apply_chain(series(spark, [1, 4, 9]), ["value"], "difference_1_keep")
    assert column(out, "value") == [1, 4, 9] and column(out, "1_diff_value") == [3, 3, 5]
    late = features.build(series(spark, [1, 4, 9]).withColumn("other", F.col("value")), {("value",): "difference_1_drop", ("other",): "identity"})
    assert column(late, "other") == [4, 9]


def test_a_record_without_value_is_not_there_for_later_steps(spark):
    gap = series(spark, [1, 4, 0, 9, 16, 36]).withColumn("value", F.nullif("value", F.lit(0.0)))
    out, names = features.apply_chain(gap, ["value"], "difference_1_drop.difference_1_drop")
    assert column(out, names[0]) == [4, 13]


def test_active_mean(spark):
    df = spark.createDataFrame([(2.0, -1.0, 4.0), (-1.0, -1.0, -1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(features.active_mean([F.col(c) for c in "abc"])).collect()] == [3.0, -1.0]


def test_builtin_bundle_has_nineteen_features(spark):
    bundle = features.builtin_bundle()
    names = sorted({n for key in bundle for n in key})
    rows = [("a", i, 0, *[float(i + j) for j in range(len(names))]) for i in range(4)]
    df = spark.createDataFrame(rows, ["trace", "idx", "label", *names])
    out = features.build(df, {k: v for k, v in bundle.items() if not any("%" in n for n in k)})
    assert len(out.columns) == 3 + 3 + 6


def test_online_scaling(spark):
    out = scale.scale_head_online(series(spark, [1, 2, 3, 4]), ["value"], size=1)
    assert column(out)[3] == pytest.approx(2.0)
    flat = scale.scale_head_online(series(spark, [5, 5, 5, 7]), ["value"], "minmax", size=2)
    assert column(flat)[3] == 2.0
    with pytest.raises(ValueError):
        scale.scale_head_online(series(spark, [1]), ["value"], "robust")


def test_head_scaling_with_training_weight(spark):
    df = series(spark, [1, 3, 5, 7], "t").union(series(spark, [10, 20, 30, 40], "x"))
    out = scale.scale_head(df, ["value"], size=2, regular_weight=0.5, train=F.col("trace") == "t")
    assert column(out.where("trace = 't'")) == pytest.approx((np.array([1, 3, 5, 7]) - 4) / np.std([1, 3, 5, 7]))
    offset, spread = 0.5 * 4 + 0.5 * 15, 0.5 * np.std([1, 3, 5, 7]) + 0.5 * 5
    assert column(out.where("trace = 'x'")) == pytest.approx((np.array([10, 20, 30, 40]) - offset) / spread)


def test_pca_and_factors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 2)) * [3, 1]
    x = np.column_stack([base, base @ [1.0, 1.0] + rng.normal(size=200) * 0.01])
    df = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(x)], "trace string, idx long, f0 double, f1 double, f2 double")
    out, shares = scale.pca(df, ["f0", "f1", "f2"], 0.999)
    got = np.array([[r.pc0, r.pc1] for r in out.orderBy("idx").collect()])
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(c @ vt[:2].T), abs=1e-6)
    assert shares[:2].sum() > 0.999
    fa = scale.factor_analysis(df, ["f0", "f1", "f2"], 1)
    assert len(fa.columns) == 3
    k = scale.kernel_pca(df, ["f0", "f1"], 2, sample=50)
    assert k.count() == 200 and "kpc1" in k.columns


def test_kernel_pca_is_fitted_on_all_records(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 2)) * 0.3
    x[:300] += 4  # a regime of its own
    df = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(x)], "trace string, idx long, f0 double, f1 double")
    got = np.array([[r.kpc0, r.kpc1] for r in scale.kernel_pca(df, ["f0", "f1"], 2, sample=400).orderBy("idx").collect()])
    assert got.mean(0) == pytest.approx([0, 0], abs=1e-6)
    assert got[:, 0] @ got[:, 1] == pytest.approx(0, abs=1e-4)
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    values, vectors = np.linalg.eigh(k - k.mean(0) - k.mean(1)[:, None] + k.mean())
    exact = vectors[:, -1] * np.sqrt(values[-1])
    assert abs(np.corrcoef(exact, got[:, 0])[0, 1]) > 0.99 and got[:, 0].std() == pytest.approx(exact.std(), rel=0.1)


def test_counter_gaps(spark):
    rows = [("a", i, c, v) for i, (c, v) in enumerate([(-1, -1), (3, 30), (-1, -1), (4, 40), (-1, -1), (2, 20), (-1, -1)])]
    df = spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in rows], "trace string, idx long, cnt double, v double")
    out = clean.fill_counter_gaps(df, "cnt", ["cnt", "v"])
    # filled between 3 and 4, not where the counter starts again, nor at either end
    assert column(out, "cnt") == [-1, 3, 3, 4, -1, 2, -1]
    assert column(out, "v") == [-1, 30, 30, 40, -1, 20, -1]
    assert column(clean.fill_inactive(df, ["v"]), "v") == [30, 30, 30, 40, 40, 20, 20]


def test_segments_and_reward(spark):
    rows = [("i", i, 0, 0, float(v)) for i, v in enumerate([1, 2, 3])] + [("i", i + 3, 1, 0, float(v)) for i, v in enumerate([3, 4, 5])]
    long = spark.createDataFrame(rows, "instance string, idx long, y int, ft int, value double")
    segs = {r.kind: (r.lo, r.hi, r.n) for r in explain.segments(long).collect()}
    assert segs == {"normal": (-math.inf, 2.0, 2), "mixed": (3.0, 3.0, 2), "anomalous": (4.0, math.inf, 2)}
    counts = spark.createDataFrame([("i", 3, 3)], "instance string, n0 long, n1 long")
    assert explain.rewards(explain.segments(long), counts).first().reward == pytest.approx(0.386853, abs=1e-6)


def test_only_mixed_values_earn_nothing(spark):
    long = spark.createDataFrame([("i", 0, 0, 0, 1.0), ("i", 1, 1, 0, 1.0)], "instance string, idx long, y int, ft int, value double")
    counts = spark.createDataFrame([("i", 1, 1)], "instance string, n0 long, n1 long")
    assert explain.rewards(explain.segments(long), counts).first().reward == 0.0


def test_complete_linkage():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.85, 0.9], [0.9, 0.85, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert list(explain.complete_linkage(d, 0.45)) == [1, 1, 2, 2]
    assert list(explain.complete_linkage(d, 0.05)) == [1, 2, 3, 4]


def test_consistency(spark):
    e = spark.createDataFrame([("a", i, f) for i in (0, 1) for f in (1, 2)], "class string, instance int, ft int")
    assert edeval.consistency(e).first().consistency == pytest.approx(1.0)
    assert edeval.conciseness(e).first().conciseness == 2.0


def test_f_beta_and_auc(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0)], "p double, r double")
    assert [r[0] for r in df.select(evaluate.f_beta(F.col("p"), F.col("r"))).collect()] == pytest.approx([0.0, 2 / 3])
    points = spark.createDataFrame([(0.0, 1.0, 2), (0.5, 1.0, 1), (1.0, 0.0, 0)], "x double, y double, t int")
    assert evaluate.auc(points, "x", "y", "t").first().auc == pytest.approx(0.75)


def test_perfect_prediction_scores_one(spark):
    df = frame(spark, [("a", i, int(0.2 < v < 0.7), 3 * int(0.2 < v < 0.7)) for i, v in enumerate(np.linspace(0, 1, 20))], "trace string, idx long, pred int, label int")
    for out in (evaluate.point_metrics(df), *(evaluate.range_metrics(windows.class_ranges(df), evaluate.predicted_ranges(df), ranges.LEVELS[k]) for k in ranges.LEVELS)):
        assert all((r.precision, r.recall, r.f) == pytest.approx((1, 1, 1)) for r in out.collect())


def test_no_prediction_has_precision_one(spark):
    df = frame(spark, [("a", i, 0, int(i > 3)) for i in range(8)], "trace string, idx long, pred int, label int")
    for out in (evaluate.point_metrics(df), evaluate.range_metrics(windows.class_ranges(df), evaluate.predicted_ranges(df), ranges.LEVELS["ad2"])):
        assert all((r.precision, r.recall, r.f) == (1, 0, 0) for r in out.collect())


def test_curve_has_falling_recall_and_ends_at_nothing(spark, sf_dir):
    rng = np.random.default_rng(5)
    df = frame(spark, [("a", i, float(s), int(s + rng.normal() * 0.3 > 0.8)) for i, s in enumerate(rng.random(200))], "trace string, idx long, score double, label int")
    for curve in (evaluate.point_curve(df, 20), evaluate.range_curve(df, ranges.LEVELS["ad2"], 20)):
        rows = curve.where("cls = 'global'").orderBy("t").collect()
        assert len(rows) == 21 and rows[0].recall == pytest.approx(1.0) and (rows[-1].precision, rows[-1].recall) == (1.0, 0.0)
        assert all(a.recall >= b.recall - 1e-9 for a, b in zip(rows, rows[1:], strict=False))


def test_expanded_instances(spark):
    real = spark.createDataFrame([("a", 1, 4, 6), ("a", 2, 0, 2), ("a", 3, 18, 20)], "trace string, class int, r_start long, r_end long")
    sizes = spark.createDataFrame([("a", 20)], "trace string, n long")
    got = lambda p: {r["class"]: (r.e_start, r.e_end) for r in edeval.expanded_instances(real, sizes, 3, 3, p).collect()}
    assert got("before") == {1: (1, 6), 2: (0, 5), 3: (15, 20)}
    assert got("after") == {1: (4, 9), 2: (0, 5), 3: (15, 20)}
    assert got("both") == {1: (3, 8), 2: (0, 5), 3: (15, 20)}
    assert got("none") == {}


def test_disturbed_windows_stay_inside(spark):
    inst = spark.createDataFrame([("a", 5, 4, 20)], "trace string, r_start long, e_start long, e_end long")
    for policy in ("all", "start", "center", "end"):
        rows = edeval.disturbed(inst, 6, 3, policy).collect()
        assert len(rows) == 3 and all(4 <= r.s_start and r.s_end <= 20 and r.s_end - r.s_start == 6 for r in rows)


def test_weighted_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 5), (float("nan"), 7), (4.0, 1)], "v double, n int")
    assert edeval.weighted_mean(df, "v", "n").first().v == pytest.approx(2.0)


def test_order_of_rows_does_not_matter(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    mixed = h.orderBy(F.xxhash64("sec", "trace")).repartition(7)
    a, b = (fx.predicted(x).orderBy("trace", "idx").collect() for x in (h, mixed))
    assert [(r.trace, r.idx, r.pred) for r in a] == [(r.trace, r.idx, r.pred) for r in b]
    assert [r.score for r in a] == pytest.approx([r.score for r in b])


def test_blend_and_cross_entropy(spark):
    v = spark.range(1).select(score.blended(F.lit(2.0), F.lit(4.0), 0.25).alias("b"), score.cross_entropy(F.lit(1.0), F.lit(0.5)).alias("c")).first()
    assert (v.b, v.c) == pytest.approx((3.5, math.log(2)))
