from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorspark.operators import cleaning
from motorspark.plans.listings import CleaningPlan

SCHEMA = "id long, price double, year int, odometer double, manufacturer string, model string, VIN string, posting_date string"
PLAN = CleaningPlan(unknown_columns=["manufacturer", "model"], dropped_columns=[])


def row(id, price=1000.0, year=2000, odometer=10.0, manufacturer="ford", model="a", VIN=None, date="2021-04-01"):
    return (id, price, year, odometer, manufacturer, model, VIN, date)


ROWS = [
    row(1, price=None, year=None, odometer=None),
    row(2, price=0.0),
    row(3, price=499.99),
    row(4, price=500.0, VIN="A"),
    row(5, price=200000.0, VIN="B"),
    row(6, price=200000.01),
    row(7, year=1989),
    row(8, year=1990, VIN="C"),
    row(9, year=2022, VIN="D"),
    row(10, year=2023),
    row(11, odometer=400000.0, VIN="E"),
    row(12, odometer=400001.0),
    row(13, odometer=None),
    row(14, VIN="S", date="2021-04-02"),
    row(15, VIN="S", date="2021-04-03", model="newest"),
    row(15, VIN="S", date="2021-04-01", model="older copy"),
    row(16, VIN="T", date="2021-04-03"),
    row(17, VIN="T", date="2021-04-03"),
    row(18, model="twin", date="2021-04-05"),
    row(19, model="twin", date="2021-04-06"),
    row(20, model=None, manufacturer=None, price=700.0),
    row(21, model=None, manufacturer=None, price=700.0),
    row(22, model="twin", price=1001.0),
]


@pytest.fixture()
def listings(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_row_counts_under_the_first_rule_it_breaks(listings):
    broken = {r["id"]: r["b"] for r in listings.select("id", cleaning.first_broken(PLAN.rules()).alias("b")).collect()}
    assert broken[1] == 0 and broken[3] == 1 and broken[6] == 1
    assert broken[7] == 2 and broken[10] == 2 and broken[12] == 3 and broken[13] == 3
    assert all(broken[i] is None for i in (4, 5, 8, 9, 11))


def test_clean_keeps_latest_per_vin_and_first_near_duplicate(listings):
    kept = {r["id"] for r in PLAN.clean(listings).collect()}
    assert kept == {4, 5, 8, 9, 11, 15, 17, 19, 21, 22}


def test_duplicate_id_keeps_the_latest_row(listings):
    models = {r["id"]: r["model"] for r in PLAN.clean(listings).collect()}
    assert models[15] == "newest" and models[21] == "unknown"


def test_audit_adds_up(listings):
    audit = PLAN.audit(listings).orderBy("step_no").collect()
    removed = [r["rows_removed"] for r in audit]
    assert removed == [2, 2, 2, 2, 1, 2, 2]
    rest = len(ROWS)
    for line in audit:
        rest -= line["rows_removed"]
        assert line["rows_remaining"] == rest
        assert line["pct_of_original"] == pytest.approx(line["rows_removed"] * 100 / len(ROWS))
    assert rest == PLAN.clean(listings).count()


@pytest.mark.parametrize("partitions", [1, 7])
def test_result_does_not_depend_on_partitioning(spark, listings, partitions):
    expected = sorted(PLAN.clean(listings).collect())
    moved = listings.repartition(partitions).orderBy(F.desc("id"))
    assert sorted(PLAN.clean(moved).collect()) == expected


def test_latest_by_keeps_rows_without_key(listings):
    kept = cleaning.latest_by(listings, "VIN", ["posting_date", "id"])
    assert kept.where("VIN is null").count() == listings.where("VIN is null").count()
    assert kept.where("VIN is not null").groupBy("VIN").count().where("count > 1").count() == 0


def test_hot_key_is_cut_before_the_shuffle(spark, listings):
    plan = PLAN.clean(listings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial") == 2
