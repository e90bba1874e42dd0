"""Readers, writers, the registry, the chain of steps, and streams against batches."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riverbend import registry
from riverbend.operators import split
from riverbend.plans import catalog, fixtures as fx, lifecycle, streams
from riverbend.sources import io
from riverbend.streaming import jobs


def test_trace_and_truth_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    pd.DataFrame({"t": [10, 11], "b": [1, ""], "a": [2.5, 3]}).to_csv(tmp_path / "t/2_1_200000_69.csv", index=False)
    pd.DataFrame({"t": [10], "b": [1], "a": [2]}).to_csv(tmp_path / "t/7_0_1_1.csv", index=False)
    traces = io.read_traces(spark, str(tmp_path / "t"), ["b", "a"])
    assert traces.columns == ["trace", "app_id", "trace_type", "period_rank", "ts", "a", "b"]
    rows = io.select_traces(traces).orderBy("ts").collect()
    assert [(r.trace, r.app_id, r.trace_type, r.a, r.b) for r in rows] == [("2_1_200000_69", 2, "bursty_input", 2.5, 1.0), ("2_1_200000_69", 2, "bursty_input", 3.0, None)]
    assert io.select_traces(traces, 7).count() == 1 and io.select_traces(traces, 0, ["undisturbed"]).count() == 0
    (tmp_path / "truth.csv").write_text("trace_name,anomaly_type,anomaly_details,root_cause_start,root_cause_end,extended_effect_end\nx,cpu_contention,d,10,20,\nx,unknown,d,30,40,50\n")
    truth = io.read_truth(spark, str(tmp_path / "truth.csv")).orderBy("event_order").collect()
    assert [(r.type_id, r.extended_effect_end is None) for r in truth] == [(4, True), (7, False)]


def test_upsert_table(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    make = lambda v: spark.createDataFrame([("m", "g", "c", "F1", v)], "method string, granularity string, cls string, metric string, value double")
    io.upsert_table(make(0.1), path)
    io.upsert_table(make(0.2).union(make(0.2).withColumn("method", F.lit("n"))), path)
    assert sorted((r.method, r.value) for r in spark.read.parquet(path).collect()) == [("m", 0.2), ("n", 0.2)]


def test_models_and_explanations_are_stored(spark, tmp_path):
    io.save_model(spark, {"threshold": 1.5, "names": ["a"]}, f"{tmp_path}/m")
    assert io.load_model(spark, f"{tmp_path}/m") == {"threshold": 1.5, "names": ["a"]}
    rules = spark.createDataFrame([("i", 2, 0.0, 1.0), ("i", 2, 3.0, 4.0)], "instance string, ft int, lo double, hi double")
    assert io.explanations_json(rules).first().value == '{"important_fts":[2],"anomalous_ranges":[[{"lo":0.0,"hi":1.0},{"lo":3.0,"hi":4.0}]]}'
    assert io.parsed_keys({"1": "a"}) == {1: "a"} and io.parsed_keys({"1.5": "a"}) == {1.5: "a"} and io.parsed_keys({"x": 1}) == {"x": 1}


def test_datasets_are_partitioned(spark, sf_dir, tmp_path):
    h = fx.hourly(spark, sf_dir).withColumn("dataset", F.when(F.col("trace") == "view", "train").otherwise("test"))
    io.save_datasets(h, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").where("dataset = 'train'").count() == 720


def test_registry(spark):
    assert registry.find("thresholds", "mad") is not None
    with pytest.raises(ValueError):
        registry.find("thresholds", "none")
    registry.register("scorers", "own", lambda df: df)
    assert registry.find("scorers", "own")(1) == 1


def test_chain_of_steps(spark, sf_dir):
    lab = fx.labelled(fx.hourly(spark, sf_dir)).withColumn("ts", F.timestamp_seconds("sec"))
    raw = lab.select("trace", F.col("trace").alias("trace_type"), "ts", *fx.FEATURES)
    s = lifecycle.Settings(raw_period=3600, period=7200, prune_head=2, prune_tail=2)
    data = lifecycle.datasets(raw, fx.ground_truth(fx.hourly(spark, sf_dir)), fx.FEATURES, fx.TRAIN, s).cache()
    assert data.groupBy("trace").count().where("count <> 358").count() == 0
    detected = lifecycle.detections(data, lifecycle.scores(data, fx.FEATURES, s), s).cache()
    metrics = {r.cls: r for r in lifecycle.evaluation(detected, s).collect()}
    assert 0 <= metrics["global"].recall <= 1 and 0 <= metrics["global"].precision <= 1
    assert lifecycle.explanations(data, fx.FEATURES, lifecycle.Settings(explainer="macrobase")).columns[:2] == ["instance", "ft"]
    data.unpersist()


@pytest.mark.parametrize("number", [n for n in streams.NAMES if n != 7])
def test_stream_equals_batch(spark, sf_dir, number):
    name = streams.NAMES[number]
    a, b = (catalog.QUERIES[n](spark, sf_dir) for n in (name, f"{name}_stream"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == b.count()


def test_slow_function_changes_nothing(spark, sf_dir):
    a = catalog.QUERIES["distinct_users_slow"](spark, sf_dir)
    clicks = streams._clicks(fx.table(spark, sf_dir, "events"))
    b = jobs.distinct_users(clicks, streams.OPTIONS[7])
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_lines_and_arguments(spark):
    lines = spark.createDataFrame([("u1 - - x - - /a", None), ("broken", None)], "value string, timestamp timestamp")
    assert [(r.user, r.url) for r in jobs.parse_clicks(lines).collect()] == [("u1", "/a"), ("broken", None)]
    ranks = jobs.parse_ranks(spark.createDataFrame([("7 - - /a",)], "value string"))
    assert (ranks.first().url, ranks.first()["rank"]) == ("/a", 7)
    o = jobs.from_arguments(jobs.Options(window=5), ["window=9", "slide=3", "host=h"])
    assert (o.window, o.slide, o.extra) == (9, 3, {"host": "h"})


def test_first_batch_only(spark, sf_dir, tmp_path):
    schema = fx.table(spark, sf_dir, "events").schema
    clicks = streams._clicks(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    jobs.save_first_batch(jobs.popular_urls(clicks, jobs.Options()), f"{tmp_path}/first").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/first").count() == 5


def test_splits_cover_all_rows_once(spark, sf_dir):
    u = fx.user_records(spark, sf_dir)
    parts = split.random_split(u, F.col("event_id"))
    counts = {r.dataset: r["count"] for r in parts.groupBy("dataset").count().collect()}
    assert sum(counts.values()) == u.count() and counts["train"] == int(0.7 * u.count())
    again = split.random_split(u.repartition(5), F.col("event_id"))
    assert parts.select("event_id", "dataset").exceptAll(again.select("event_id", "dataset")).count() == 0
    assert split.proportion(parts, 0.5, F.col("event_id")).count() <= 0.5 * u.count() + 3


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).columns == ["trace", "n_ranges", "records"]
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
