from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.operators import comparing, joins, linking
from motorspark.plans import specs as spec_plan
from motorspark.session import checkpointed


def test_spread_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else "x") for i in range(60)], "id int, k string")
    right = spark.createDataFrame([("hot", 5), ("y", 1)], "k string, n int")
    plain = sorted(map(str, joins.enrich(left, right, ["k"], {"n": 0}).select("id", "k", "n").collect()))
    spread = sorted(map(str, joins.enrich(left, right, ["k"], {"n": 0}, "id").select("id", "k", "n").collect()))
    assert plain == spread and len(spread) == 60


def test_only_hot_keys_are_offered_more_than_once(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(400)], "id int, k string")
    right = spark.createDataFrame([("hot", 5), *((f"k{i}", i) for i in range(0, 400, 2))], "k string, n int")
    hot = joins.hot_keys(left, ["k"])
    copies = {r["k"]: r["count"] for r in joins.offered(right, ["k"], hot).groupBy("k").count().collect()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert copies.pop("hot") >= parts // 2 and set(copies.values()) == {1}
    assert hot.count() < parts
    assert joins.spread_join(left, right, ["k"], "id").where("n is null").count() == 0


@pytest.mark.parametrize("most", [20_000, 1])
def test_rows_in_a_key_set_by_broadcast_and_by_parts(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST", most)
    rows = [(i, "hot" if i % 3 else None if i % 2 else "x", 1 if i % 5 else None) for i in range(90)]
    left = spark.createDataFrame([*rows, *rows[:7], (None, "hot", 1)], "id int, k string, y int")
    keys = spark.createDataFrame([("hot", 1), ("hot", 1), ("y", 1), (None, 1), ("x", None)], "k string, y int")
    found = joins.in_key_set(left, keys, ["k", "y"], "id").select("id", "k", "y")
    assert sorted(map(str, found.collect())) == sorted(map(str, left.where("k = 'hot' and y = 1").collect()))
    ids = [r["id"] for r in joins.match_ids(left, keys, ["k", "y"], "id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i, k, y in rows if k == "hot" and y == 1} | {None}


def test_a_few_known_words_do_not_gather_all_recalls_of_a_word_in_one_task(spark):
    text = "Ford is recalling certain 2010-2012 F-150 trucks"
    recalls = spark.range(200).select("id", F.lit("Ford").alias("g"), F.lit(text).alias("t"))
    parsed = linking.parsed_recalls(recalls, "id", "g", "t")
    words = checkpointed(spark.createDataFrame([("f150",), ("escape",)], "model_token string"))
    table = linking.link_table(parsed, words, "id", "g")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(model_token" not in plan
    assert table.count() == 600


def test_join_contract(spark):
    twice = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(joins.JoinContractError):
        joins.assert_unique(twice, ["k"])
    joins.assert_unique(twice.distinct(), ["k"])
    joins.assert_same_count(twice, twice)
    with pytest.raises(joins.JoinContractError):
        joins.assert_same_count(twice, twice.distinct())


def test_vocabulary_drops_short_year_and_ambiguous_words(spark):
    counts = spark.createDataFrame(
        [("civic", 20), ("rare", 19), ("3", 99), ("35", 99), ("350", 99), ("2015", 99), ("new", 99), ("x", 99), ("all", 99)],
        "model_token string, n int",
    )
    kept = {r["model_token"] for r in linking.usable_tokens(counts, stop_words=["all"]).collect()}
    assert kept == {"civic", "350"}


@pytest.fixture()
def recalls(spark):
    rows = [
        (1, "Ford", "Vehicle", "Ford is recalling certain 2010-2011 F-150 trucks. The Escape bolt of 2012 broke."),
        (2, "Ford", "Vehicle", "Ford is recalling certain 2011 Escape and F-150 cars"),
        (3, None, "Vehicle", "Truck Co is recalling certain 2011 Escape"),
        (4, "Ford", "Vehicle", "Old text without the word"),
        (5, "Ford", "Tire", "Ford is recalling certain 2011 Escape"),
        (6, "Kia", "Vehicle", "Kia is recalling 2011 Rio"),
    ]
    return spark.createDataFrame(rows, "recall_id int, mfr_group string, recall_type string, description string")


@pytest.fixture()
def cars(spark):
    rows = [(1, "Ford", 2011, "f150"), (2, "Ford", 2010, "f150"), (3, "Ford", 2012, "escape"), (4, "Kia", 2011, "soul"), (5, None, 2011, None)]
    return spark.createDataFrame(rows, "id int, mfr_group string, year int, model_token string")


def links(recalls, spark):
    words = spark.createDataFrame([("f150",), ("escape",), ("rio",)], "model_token string")
    parsed = linking.parsed_recalls(recalls.where("recall_type = 'Vehicle'"), "recall_id", "mfr_group", "description")
    years = linking.recall_years(parsed, "recall_id", "mfr_group")
    return years, linking.link_table(parsed, words, "recall_id", "mfr_group")


def test_links_come_from_the_announcing_sentence(spark, recalls):
    _, table = links(recalls, spark)
    got = sorted((r["recall_id"], r["year"], r["model_token"]) for r in table.collect())
    assert got == [(1, 2010, "f150"), (1, 2011, "f150"), (2, 2011, "escape"), (2, 2011, "f150"), (6, 2011, "rio")]


def test_features_never_change_the_number_of_listings(spark, recalls, cars):
    years, table = links(recalls, spark)
    by_year, by_model = linking.recall_counts(years, table, "recall_id", "mfr_group")
    rows = linking.recall_features(cars, by_year, by_model, "mfr_group").orderBy("id").collect()
    assert [(r["recall_count"], r["mfr_year_recall_count"], r["recalled_flag"]) for r in rows] == [
        (2, 2, 1), (1, 1, 1), (0, 0, 0), (0, 1, 0), (0, 0, 0),
    ]


def test_quality_classes_take_the_best_key(spark, recalls, cars):
    years, table = links(recalls, spark)
    rows = linking.join_quality(recalls, years, table, cars, "recall_id", "mfr_group", F.col("recall_type") == "Vehicle")
    assert [r["join_quality"] for r in rows.orderBy("recall_id").collect()] == [
        fixed.QUALITY_MODEL, fixed.QUALITY_MODEL, fixed.QUALITY_NONE, fixed.QUALITY_MAKER, fixed.QUALITY_OUT_OF_SCOPE, fixed.QUALITY_YEAR,
    ]


SPEC_SCHEMA = (
    "VIN string, manufacturer string, year int, drive string, fuel string, price double, API_Make string, API_Year double, "
    "API_Body string, API_Engine double, API_Drive string, API_Fuel string, Status string"
)


@pytest.fixture()
def compared(spark):
    rows = [
        ("both", "kia", 2010, "fwd", "gas", 1.0, "FORD", 2012.0, "Sedan", 2.0, "4x2", "Gasoline", "Success"),
        ("year", "alfa-romeo", 2010, "fwd", "gas", 2.0, "ALFA ROMEO", 2011.0, "Sedan", None, "AWD/All", "Gasoline", "Success"),
        ("gap", "unknown", 2010, "unknown", "other", 3.0, "KIA", 2010.0, None, 1.0, "RWD/x", "Electric", "Success"),
        ("ram", "ram", 2010, "rwd", "electric", 4.0, "DODGE", 2010.0, "Pickup", 1.0, None, "Diesel", "Success"),
        ("none", "kia", 2010, "fwd", "gas", 5.0, None, None, None, None, None, None, None),
        ("empty", "kia", 1900, "4wd", "hybrid", 6.0, None, 1950.0, None, None, None, None, "Failed"),
    ]
    return comparing.compare_sources(comparing.align(spark.createDataFrame(rows, SPEC_SCHEMA)), comparing.FIELDS, "decoded")


def test_comparison_report(compared):
    got = {r["field"]: (r["compared"], r["gaps_filled"], r["conflicts"]) for r in comparing.comparison_report(compared, comparing.FIELDS).collect()}
    assert got == {"Manufacturer": (3, 1, 1), "Model year": (4, 0, 2), "Drive type": (2, 1, 1), "Fuel type": (3, 1, 1)}


def test_year_is_corrected_even_when_flagged(compared):
    got = {r["VIN"]: (r["action"], r["year"], r["year_original"]) for r in comparing.decide(compared).collect()}
    assert got["both"] == ("Flag", 2012.0, 2010)
    assert got["year"] == ("Correct", 2011.0, 2010)
    assert got["gap"] == ("Keep", 2010.0, 2010)
    assert got["none"][0] == got["empty"][0] == "Drop"


def test_rules_read_missing_as_violation_only_where_meant(compared):
    got = {r["rule"]: (r["violations"], r["example_vin"]) for r in spec_plan.rule_report(compared, 2026).collect()}
    assert got["Electric vehicle with an engine displacement"] == (1, "ram")
    assert got["Combustion vehicle without an engine displacement"] == (1, "year")
    assert got["Model year out of range"] == (1, "empty")
    assert got["Pickup without a drivetrain"] == (1, "ram")
    assert got["Listed year more than 1 year off the decoded year"] == (1, "both")


def test_before_and_after_cover_all_rows(compared):
    rows = comparing.before_after(compared, "drive_listing", "drive_enriched", "price").collect()
    assert sum(r["listings_before"] for r in rows) == sum(r["listings_after"] or 0 for r in rows) == 6
    assert {r["drive"]: r["listings_before"] for r in rows} == {"fwd": 3, "rwd": 1, "4wd": 1, "unknown": 1}
    only_after = [r for r in rows if r["drive"] == "unknown"]
    assert only_after[0]["listings_after"] is None


def test_taxonomy_and_decisions_sum_to_the_sample(compared):
    kinds = {r["category"]: r["count"] for r in spec_plan.taxonomy(compared).collect()}
    assert kinds["VIN not decoded"] == 2 and kinds["Missing engine"] == 1 and kinds["Missing drivetrain"] == 1
    assert sum(r["listings"] for r in spec_plan.decisions(comparing.decide(compared)).collect()) == 6
