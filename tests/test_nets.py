"""Models on windows: gradients against finite differences, training, scores, and what calls them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverbend.operators import edeval, explain, nets, windows
from riverbend.sources import io

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def waves(spark):
    rows = [(t, i, float(np.sin(i / 3 + j)), float(np.cos(i / 5 + j))) for j, t in enumerate("xy") for i in range(80)]
    return spark.createDataFrame(rows, "trace string, idx long, a double, b double")


@pytest.mark.parametrize("model", [nets.DenseAutoencoder(FEATURES, 4, (5,), 2), nets.RecurrentForecaster(FEATURES, 3, 4)])
def test_gradient(model):
    rng = np.random.default_rng(1)
    x, params = rng.normal(size=(7, model.size, 2)), nets._start(model.shapes, rng)
    grad = model.gradient(params, x)[1]
    for i in range(0, len(params), 5):
        step = np.zeros(len(params))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((model.gradient(params + step, x)[0] - model.gradient(params - step, x)[0]) / 2e-5, rel=1e-4, abs=1e-7)


def test_gradient_of_discriminator():
    model, rng = nets.BiGAN(FEATURES, 3, 5, 2), np.random.default_rng(2)
    x, key, params = rng.normal(size=(6, 3, 2)), np.arange(6), nets._start(model.shapes, rng)
    grad, first = model.gradient(params, x, key)[1], sum(int(np.prod(s)) for net in model.nets[:2] for s in net)
    for i in range(first, len(params), 3):
        step = np.zeros(len(params))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((model.gradient(params + step, x, key)[0] - model.gradient(params - step, x, key)[0]) / 2e-5, rel=1e-4, abs=1e-7)


def test_training_covers_all_windows_and_any_partitioning(waves):
    first = nets.DenseAutoencoder(FEATURES, 4, (6,), 3, 8, 0.05).fit(waves)
    again = nets.DenseAutoencoder(FEATURES, 4, (6,), 3, 8, 0.05).fit(waves.repartition(3))
    assert first.losses[-1] < first.losses[0]
    np.testing.assert_allclose(first.params, again.params, rtol=1e-8)
    scores = first.scores(waves).toPandas()
    assert len(scores) == 160 and scores.score.notna().all() and (scores.score >= 0).all()


def test_forecasts_stand_at_the_record_after_their_window(waves):
    model = nets.RecurrentForecaster(FEATURES, 3, 6, 5, 0.05).fit(waves)
    made = {(r.trace, r.idx): r.y_a for r in model.predict(waves).collect()}
    assert len(made) == 160 and made["x", 2] is None
    xs = np.array([(r.a, r.b) for r in waves.where("trace = 'x'").orderBy("idx").collect()])
    assert made["x", 3] == pytest.approx(model.forecast(xs[None, :4])[0, 0])


@pytest.mark.parametrize("kind", ["mse", "mse.dis", "mse.ft"])
def test_adversarial_scores(waves, kind):
    model = nets.BiGAN(FEATURES, 4, 6, 2, 3, kind=kind).fit(waves)
    assert len(model.losses) == 3 and np.isfinite(model.params).all()
    assert np.isfinite(model.score_windows(np.ones((5, 4, 2)))).all()


def test_no_windows(spark, waves):
    model = nets.DenseAutoencoder(FEATURES, 4).fit(waves.limit(0))
    assert model.losses == [] and model.scores(waves.limit(0)).count() == 0


def test_lime_on_windows_depends_on_no_partitioning(waves):
    held = windows.sliding_windows(waves, FEATURES, 3).withColumn("y", (F.col("window")[2][1] > 0.9).cast("int")).withColumnRenamed("trace", "instance")  # far from what a draw brings
    run = lambda df: sorted(map(tuple, explain.lime_windows(df, FEATURES, lambda x: x[:, 2, 1] * 10, 3, 1, 200).collect()))
    assert run(held) == run(held.repartition(5))
    assert {r[2] for r in run(held)} == {1}


@pytest.mark.parametrize("size,step,remainder", [(4, 1, False), (5, 2, True), (3, 3, True), (3, 5, False), (100, 7, True)])
def test_windows_against_slices(waves, size, step, remainder):
    got = {(r.trace, r.w_start): [x[0] for x in r.window] for r in windows.sliding_windows(waves, FEATURES, size, step, remainder).collect()}
    xs = {t: [r.a for r in waves.where(F.col("trace") == t).orderBy("idx").collect()] for t in "xy"}
    starts = [s for s in range(0, 80, step) if s + size <= 80]
    starts = sorted({*starts, 80 - size}) if remainder and size <= 80 else starts
    assert got == {(t, s): xs[t][s : s + size] for t in "xy" for s in starts}


def test_ed1_accuracy_of_a_perfect_rule(spark):
    rows = [(f"i{k}", i, int(i >= 20), float(i >= 20), 0.0) for k in range(2) for i in range(40)]
    records = spark.createDataFrame(rows, "instance string, idx long, y int, a double, b double")
    rule = lambda df, features: df.select("instance").distinct().select("instance", F.lit(0).alias("ft"), F.lit(0.5).alias("lo"), F.lit(2.0).alias("hi"))
    got = {r.instance: (r.precision, r.recall, r.f1) for r in edeval.ed1_accuracy(records, FEATURES, rule).collect()}
    assert got == {"i0": (1.0, 1.0, 1.0), "i1": (1.0, 1.0, 1.0)}


def test_upsert_takes_back_a_table_set_aside(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda k, v: spark.createDataFrame([(k, "g", "c", "F1", v)], "method string, granularity string, cls string, metric string, value double")
    io.save(make("a", 0.1), f"{path}__old")  # as a call leaves it that was lost between its renames
    io.upsert_table(make("b", 0.2), path)
    assert sorted((r.method, r.value) for r in io.load(spark, path).collect()) == [("a", 0.1), ("b", 0.2)]


def test_truth_goes_by_its_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("anomaly_type,trace_name,anomaly_details,root_cause_start,root_cause_end,extended_effect_end\nstalled_input,1_3_1_1,x,10,20,\nunknown,1_0_1_2,y,30,40,50\n")
    got = io.read_truth(spark, str(tmp_path / "t.csv")).orderBy("event_order").collect()
    assert [(r.trace, r.type_id, r.event_order) for r in got] == [("1_3_1_1", 3, 0), ("1_0_1_2", 7, 1)]
