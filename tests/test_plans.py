"""The four plans on small raw files, checked by what must add up in their tables."""

from __future__ import annotations

import csv
import random
from datetime import datetime, timedelta

import pytest

from motorspark.functions import fixed_values as fixed
from motorspark.plans import listings as listing_plan
from motorspark.plans import recalls as recall_plan
from motorspark.plans import specs as spec_plan
from motorspark.plans import telematics as telematics_plan
from motorspark.sources import readers

BRANDS = {"ford": ["f-150 xlt", "escape"], "kia": ["rio", "soul lx"], "bmw": ["x5", "328i"], "": ["custom"]}


def summary(spark, out, name):
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/tables/{name}").collect()


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder, rnd = tmp_path_factory.mktemp("raw"), random.Random(4)
    names = ["id", "url", "region", "region_url", "price", "year", "manufacturer", "model", "condition", "cylinders", "fuel",
             "odometer", "title_status", "transmission", "VIN", "drive", "size", "type", "paint_color", "image_url",
             "description", "county", "state", "lat", "long", "posting_date"]
    with open(folder / "vehicles.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, names)
        out.writeheader()
        for i in range(900):
            brand = rnd.choice(list(BRANDS))
            year = rnd.choice([1985, 2005, 2010, 2011, 2012, 2020])
            out.writerow({
                "id": i - (i % 50 == 49), "price": rnd.choice([0, 100] + [round(f * 2000 * 1.08 ** (year - 1984)) for f in (0.9, 1, 1.1)]), "year": year,
                "manufacturer": brand, "model": rnd.choice(BRANDS[brand]), "fuel": rnd.choice(["gas", "diesel", "NA"]),
                "odometer": rnd.choice(["", 10000, 55000, 120000, 900000]), "transmission": "automatic",
                "VIN": rnd.choice(["", f"1FTEW1E5{rnd.randrange(10**8):09d}", "BAD"]), "drive": rnd.choice(["fwd", "4wd", ""]),
                "type": rnd.choice(["sedan", "truck", "SUV"]), "description": "line\nline", "state": "ca",
                "posting_date": f"2021-04-{1 + i % 28:02d}T10:00:00-0700",
            })
    sentences = [
        ("Ford Motor Company", "Ford is recalling certain 2010-2012 F-150 and Escape vehicles. A fuel leak."),
        ("Kia America, Inc.", "Kia is recalling certain 2011 Rio vehicles. Brakes."),
        ("BMW of North America, LLC", "No sentence."),
        ("Forest River, Inc.", "Forest River is recalling certain 2012 trailers. Tires."),
        ("FOREST RIVER INC", "Forest River is recalling certain 2011 trailers. Tires."),
    ]
    themes = ["fuel leak may start a fire", "seat belt latch may release", "air bag inflator may rupture and burn"]
    columns = ["NHTSA ID", "Report Received Date", "Manufacturer", "Recall Type", "Component", "Potentially Affected ",
               "Subject", "Recall Description", "Consequence Summary", "Park Outside Advisory", "Do Not Drive Advisory"]
    with open(folder / "recalls.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for i in range(400):
            maker, text = sentences[i % 5]
            out.writerow([f"R{i}", f"{1 + i % 12:02d}/15/{2006 + i % 20}", maker, "Tire" if i % 17 == 0 else "Vehicle",
                          rnd.choice(["ENGINE", "BRAKES", ""]), rnd.choice([100, 2000, ""]), f"S{i}", text,
                          "" if i % 13 == 0 else themes[i % 3], "Yes" if i % 30 == 1 else "No", "No"])
    with open(folder / "telematics.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["tripID", "deviceID", "timeStamp", "speed", "gps_speed", "rpm", "x"])
        for device in (1, 2):
            at = datetime(2024, 1, 1, 22, 0, 0)
            for i in range(1500):
                at += timedelta(seconds=400 if i % 500 == 499 else 1)
                out.writerow([i // 700, device, at.strftime("%d-%m-%Y %H:%M:%S"), rnd.choice([0, 30, 60]), 40, 900, rnd.choice([0.1, 0.2])])
    return folder


@pytest.fixture(scope="module")
def cleaned(spark, raw, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("listings"))
    table = readers.read_listings(spark, str(raw / "vehicles.csv"))
    return table, listing_plan.run(table, out), out


def test_listing_audit_adds_up(spark, cleaned):
    table, clean, out = cleaned
    audit = summary(spark, out, "cleaning_audit")
    assert len(audit) == 7
    assert sum(r["rows_removed"] for r in audit) == table.count() - clean.count()
    rest = table.count()
    for line in sorted(audit, key=lambda r: r["step_no"]):
        rest -= line["rows_removed"]
        assert rest == line["rows_remaining"]
    assert {r["column"]: r["decision"] for r in summary(spark, out, "missingness")}["county"] == "drop column"


def test_price_tables(spark, cleaned):
    _, clean, out = cleaned
    segments = summary(spark, out, "price_by_segment")
    for name in fixed.SEGMENTS:
        assert sum(r["listings"] for r in segments if r["segment"] == name) == clean.count()
    groups = {r["feature_group"] for r in summary(spark, out, "price_model_importance")}
    assert {"Vehicle age", "Odometer", "Body type", "Vehicle model"} <= groups
    age = [r for r in summary(spark, out, "price_model_effects") if r["group"] == "Vehicle age"]
    assert age[0]["pct_effect"] < 0
    assert sum(r["listings"] for r in summary(spark, out, "histogram")) == clean.count()


def test_recall_plan(spark, raw, cleaned, tmp_path):
    recalls = readers.read_recalls(spark, str(raw / "recalls.csv"))
    clean = cleaned[1]
    out = str(tmp_path)
    recall_plan.run(recalls, clean, out, min_recalls=20, max_iter=5)
    listings = summary(spark, out, "join_coverage_listings")
    by_level = [r["listings"] for r in listings]
    assert by_level[0] >= by_level[2] >= by_level[3] > 0
    quality = summary(spark, out, "join_coverage_recalls")
    assert sum(r["recalls"] for r in quality) == 400
    assert {r["join_quality"] for r in quality} >= {fixed.QUALITY_MODEL, fixed.QUALITY_MAKER, fixed.QUALITY_NONE, fixed.QUALITY_OUT_OF_SCOPE}
    features = spark.read.parquet(f"{out}/usedcars_with_recalls")
    assert features.count() == clean.count()
    assert features.where("recalled_flag = 1").count() == by_level[3]
    assert {r["manufacturer"] for r in summary(spark, out, "join_unmatched_examples")} == {"Forest River, Inc.", "FOREST RIVER INC"}
    check = {r["group"]: r["share_scored_high"] for r in summary(spark, out, "recall_severity_validation")}
    assert 0 <= check["All recalls with text"] <= 100
    topics = summary(spark, out, "recall_topics_severity")
    texts = recalls.where("consequence is not null").count()
    assert 0 < sum(r["recalls"] for r in topics) <= texts
    exposure = summary(spark, out, "recall_exposure")
    assert [r["rank_by_recalls"] for r in exposure] == list(range(1, len(exposure) + 1))
    assert {r["mfr_display"] for r in exposure} == {"BMW", "FOREST RIVER INC", "Ford", "Kia"}


def test_spec_plan(spark, cleaned, tmp_path):
    sample, batches = spec_plan.sample_batches(cleaned[1], 60, 25)
    sample = spark.createDataFrame(sample.toPandas(), sample.schema)
    assert [r["size"] for r in batches.orderBy("batch").collect()] == [25, 25, 10]
    replies = sample.selectExpr(
        "VIN", "CASE WHEN id % 9 = 0 THEN NULL ELSE upper(manufacturer) END AS Make", "model AS Model",
        "CAST(year + CAST(id % 10 = 0 AS INT) AS STRING) AS ModelYear", "'Sedan' AS BodyClass", "'2.0' AS DisplacementL",
        "'FWD/x' AS DriveType", "'Gasoline' AS FuelTypePrimary", "'0' AS ErrorCode",
    )
    out = str(tmp_path)
    kept = spec_plan.run(sample, readers.spec_items(replies), out, 2026, cleaned[1])
    line = summary(spark, out, "vin_sample")[0]
    assert line["sample_size"] == 60 and line["decoded"] + line["failure_rate"] * 0.6 == pytest.approx(60)
    assert [r["check"] for r in summary(spark, out, "vin_totals")] == ["with a VIN", "with a valid VIN", "malformed VINs"]
    assert {r["place"] for r in summary(spark, out, "vin_conflict_samples")} <= set(range(1, 6))
    decisions = {r["action"]: r["listings"] for r in summary(spark, out, "vin_decisions")}
    assert sum(decisions.values()) == 60 and kept.count() == 60 - decisions.get("Drop", 0)
    drive = summary(spark, out, "vin_drive_before_after")
    assert sum(r["listings_before"] for r in drive) == sum(r["listings_after"] or 0 for r in drive) == 60


def test_telematics_plan(spark, raw, tmp_path):
    readings = readers.read_telematics(spark, str(raw / "telematics.csv"))
    out = str(tmp_path)
    trips = telematics_plan.run(readings, out)
    assert trips.count() == 6 and trips.where("harsh_brakes > 0").count() > 0
    steps = summary(spark, out, "telematics_sampling")
    # the silence before the last reading of a device starts a trip of one row
    assert sum(r["rows"] for r in steps) == 3000 - 8
    checks = {r["check"]: r["rows"] for r in summary(spark, out, "telematics_quality_report")}
    assert checks["Missing intervals (gap > 10 s inside a trip)"] == steps[-1]["rows"] == 0
    assert len(summary(spark, out, "telematics_signal_ranges")) == 4
    line = summary(spark, out, "telematics_totals")[0]
    assert (line["rows"], line["trips"]) == (3000, 6) and line["total_distance_km"] == pytest.approx(trips.agg({"distance_km": "sum"}).first()[0])
