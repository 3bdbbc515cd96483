from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from motorspark.operators import pricing, reports, trend


def test_value_counts_skip_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert sorted(map(tuple, reports.value_counts(df, "v").collect())) == [("a", 2), ("b", 1)]
    assert [r["v"] for r in reports.top_k(df, "v", 1, ["a"]).collect()] == ["b"]


def test_mode_ties_go_to_the_smaller_label(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("j", "z"), ("j", None)], "key string, v string")
    assert {r["key"]: r["m"] for r in reports.mode_by(df, "key", "v", "m").collect()} == {"k": "a", "j": "z"}


def test_count_report_reads_missing_as_false(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "v int")
    checks = [("big", F.col("v") > 2), ("not big", ~(F.col("v") > 2)), ("missing", F.col("v").isNull())]
    got = reports.count_report(df, checks, "check", "n", "pct").collect()
    assert [(r["check"], r["n"]) for r in got] == [("big", 1), ("not big", 1), ("missing", 1)]
    assert got[0]["pct"] == pytest.approx(100 / 3)


def test_empty_input_gives_missing_shares(spark):
    df = spark.createDataFrame([], "v int")
    assert reports.count_report(df, [("a", F.col("v") > 0)], "c", "n", "pct").collect()[0].asDict() == {"c": "a", "n": 0, "pct": None}


def test_skewness_is_bias_corrected(spark):
    values = [1.0, 2.0, 2.5, 10.0, 50.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.agg(reports.adjusted_skewness(F.col("v")).alias("s")).collect()[0]["s"]
    assert got == pytest.approx(2.0834699) and got == pytest.approx(pd.Series(values).skew())


def test_category_profile_lists_only_few_values(spark):
    df = spark.createDataFrame([(f"m{i}", "x" if i % 2 else None) for i in range(20)], "many string, few string")
    got = {r["column"]: (r["n_unique"], r["sample_values"]) for r in reports.category_profile(df).collect()}
    assert got == {"many": (20, None), "few": (1, "x")}


def test_violation_report_has_an_empty_example(spark):
    df = spark.createDataFrame([("b", True), ("a", True), ("c", False)], "vin string, bad boolean").withColumn("never", F.lit(False))
    got = reports.violation_report(df, {"r1": "bad", "r2": "never"}, "vin").collect()
    assert [(r["violations"], r["example_vin"]) for r in got] == [(2, "a"), (0, "")]


def test_describe_matches_pandas(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, None]
    got = reports.describe_numbers(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).collect()[0]
    want = pd.Series(values).describe()
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
        assert got[ours] == pytest.approx(want[theirs])


def test_histogram_keeps_every_value(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9, 10, 10)], "v double")
    got = pricing.histogram(df, F.col("v"), 5).orderBy("bin").collect()
    assert [r["listings"] for r in got] == [2, 0, 1, 0, 3]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert sum(r["listings"] for r in pricing.histogram(same, F.col("v"), 4).collect()) == 2


def test_box_whiskers_leave_outliers_out(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    box = pricing.box_stats(spark.createDataFrame([("a", v) for v in values], "k string, v double"), ["k"], "v").collect()[0]
    assert (box["whisker_low"], box["whisker_high"], box["listings"]) == (1.0, 5.0, 6)


def test_top_models_share_other(spark):
    rows = [(i, 2000, 1000.0, "kia", m) for i, m in enumerate(["a", "a", "b", "unknown", "unknown", "unknown"])]
    df = spark.createDataFrame(rows, "id int, year int, odometer double, manufacturer string, model string")
    got = pricing.price_features(df, 1999, ["kia"], 1).orderBy("id").collect()
    assert [r["model_grouped"] for r in got] == ["a", "a", "Other", "Other", "Other", "Other"]
    assert got[0]["vehicle_age"] == 0 and got[0]["miles_per_year"] == 1000.0 and got[0]["brand_segment"] == "Luxury"


def test_dense_counts_fill_zero_for_seen_periods_only(spark):
    df = spark.createDataFrame([("a", 2000), ("a", 2002), ("b", 2002), ("c", 2005)], "k string, y int")
    got = sorted(map(tuple, trend.dense_counts(df.where("k <> 'c'"), "k", "y").collect()))
    assert got == [("a", 2000, 1), ("a", 2002, 1), ("b", 2000, 0), ("b", 2002, 1)]


def test_spikes_ignore_constant_series(spark):
    rows = [("flat", y, 3) for y in range(10)] + [("jump", y, 20 if y == 9 else 1) for y in range(10)]
    got = trend.spikes(spark.createDataFrame(rows, "k string, y int, n int"), "k", "y").collect()
    assert [(r["k"], r["y"]) for r in got] == [("jump", 9)]


def test_breaks_need_an_earlier_level(spark):
    rows = [("new", y, 0 if y < 5 else 9) for y in range(10)] + [("twice", y, 3 if y < 5 else 6) for y in range(10)]
    got = trend.structural_breaks(spark.createDataFrame(rows, "k string, y int, n int"), "k", "y", (0, 4), (5, 9)).collect()
    assert [(r["k"], r["increase_ratio"]) for r in got] == [("twice", 2.0)]


def test_exposure_sums_missing_units_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 5.0), (None, 1.0)], "k string, u double")
    got = {r["k"]: (r["recalls"], r["units_affected"], r["rank_by_units"]) for r in trend.exposure(df, "k", "u").collect()}
    assert got == {"a": (2, 0.0, 2), "b": (1, 5.0, 1)}


def test_peak_takes_the_earlier_period(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,)], "y int")
    assert tuple(trend.peak(df, "y").collect()[0]) == (1, 2)


def test_pivot_fills_zero(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None)], "y int, c string")
    got = {r["y"]: (r["a"], r["b"]) for r in trend.pivot_counts(df, "y", "c", ["a", "b"]).collect()}
    assert got == {1: (2, 0), 2: (0, 1)}
