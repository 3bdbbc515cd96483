from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.sources import readers, writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_by_name_with_missing_spellings(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        'tripID,extra,deviceID,timeStamp,speed,gps_speed,rpm,x\n1,a,2,05-01-2024 10:11:12,3,3.5,NA,0.1\n1,b,2,2024-01-05,n/a,,800,abc\n',
    )
    rows = readers.read_telematics(spark, path).orderBy("speed").collect()
    assert "extra" not in rows[0].asDict()
    assert rows[1]["ts"].strftime("%Y-%m-%d %H:%M:%S") == "2024-01-05 10:11:12" and rows[1]["rpm"] is None
    assert (rows[0]["ts"], rows[0]["speed"], rows[0]["gps_speed"], rows[0]["x"]) == (None, None, None, None)


def test_unread_columns_are_pruned(spark, tmp_path):
    header = "id,url,region,region_url,price,year,manufacturer,model,condition,cylinders,fuel,odometer,title_status,transmission,VIN,drive,size,type,paint_color,image_url,description,county,state,lat,long,posting_date"
    path = write(tmp_path / "v.csv", header + '\n1,u,r,ru,100,2010.0,ford,"f-150, x",,,gas,5,clean,automatic,,4wd,,truck,red,i,"two\nlines ""q""",,ca,1,2,2021-04-01T00:00:00-0700\n')
    df = readers.read_listings(spark, path)
    row = df.collect()[0]
    assert row["year"] == 2010 and row["model"] == "f-150, x" and row["VIN"] is None
    assert not set(fixed.UNREAD_COLUMNS) & set(df.columns) and len(df.columns) == 22
    scan = df.select("id", "price")._jdf.queryExecution().executedPlan().toString()
    assert "description" not in scan


def test_header_names_are_trimmed(spark, tmp_path):
    path = write(tmp_path / "r.csv", "a, b ,c \n1,2,3\n")
    assert readers.read_csv(spark, path).columns == ["a", "b", "c"]
    assert readers.csv_header(spark, path) == ["a", " b ", "c "]


def test_decoder_replies_are_flattened(spark, tmp_path):
    items = [
        {"VIN": "A", "Make": "FORD", "Model": "", "ModelYear": "2010", "BodyClass": "Pickup", "DisplacementL": "3.5", "DriveType": "", "FuelTypePrimary": "Gasoline", "ErrorCode": "0", "Other": "x"},
        {"VIN": "B", "Make": "", "ModelYear": "?", "DisplacementL": ""},
    ]
    write(tmp_path / "batch_000.json", json.dumps({"Count": 2, "Results": items}, indent=1))
    write(tmp_path / "batch_001.json", json.dumps({"Results": items[:1]}))
    rows = {r["VIN"]: r for r in readers.read_spec_batches(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["A", "B"]
    assert (rows["A"]["API_Year"], rows["A"]["API_Engine"], rows["A"]["API_Drive"], rows["A"]["Status"]) == (2010.0, 3.5, None, "Success")
    assert (rows["B"]["API_Year"], rows["B"]["API_Engine"], rows["B"]["Status"]) == (None, None, "Failed")


def test_broken_replies_and_unknown_fields(spark, tmp_path):
    write(tmp_path / "a.json", '{"Results": [{"VIN": "A", "Make": "KIA", "ModelYear": 2012, "Extra": {"x": [1, 2]}}]}')
    write(tmp_path / "b.json", '{"Results": [{"VIN": "B", "Ma')
    write(tmp_path / "c.json", '{"Message": "no results"}')
    rows = {r["VIN"]: r for r in readers.read_spec_batches(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A", None}
    assert (rows["A"]["API_Year"], rows["A"]["Status"], rows[None]["Status"]) == (2012.0, "Success", "Failed")
    replies = spark.read.text(str(tmp_path / "a.json"), wholetext=True)
    items = readers.reply_items(replies, "value", "$.Results", ["VIN"])
    assert items.select(F.try_variant_get("item", "$.Extra.x[1]", "int")).first()[0] == 2


def test_summary_is_one_file_with_header(spark, tmp_path):
    writers.write_summary(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), str(tmp_path), "s")
    files = list((tmp_path / "s").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "k,n"


def test_document_keeps_order_and_nulls(spark, tmp_path):
    parts = {
        "lines": spark.createDataFrame([(2, None), (1, "x")], "n int, s string"),
        "none": spark.createDataFrame([], "n int"),
    }
    writers.write_document(str(tmp_path), "d", parts)
    lines = [json.loads(line) for f in sorted((tmp_path / "d/lines").glob("*.json")) for line in f.read_text().splitlines()]
    assert lines == [{"n": 1, "s": "x"}, {"n": 2, "s": None}]
    assert not any(f.read_text() for f in (tmp_path / "d/none").glob("*.json"))
    rows = [(r["part"], json.loads(r["line"])) for r in writers.document(parts).collect()]
    assert sorted(rows, key=str) == [("lines", {"n": 1, "s": "x"}), ("lines", {"n": 2, "s": None})]


def test_long_summary_is_written_whole_and_in_order(spark, tmp_path):
    writers.write_summary(spark.range(20000, 0, -1).repartition(5), str(tmp_path), "long")
    files = sorted((tmp_path / "long").glob("*.csv"))
    assert [int(line) for f in files for line in f.read_text().splitlines()[1:]] == list(range(1, 20001))


def test_columns_as_lists(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 1, 4), ("b", 1, 9)], "k string, age int, n int")
    got = {r["k"]: (r["age"], r["n"]) for r in writers.as_lists(df, "age", ["age", "n"], "k").collect()}
    assert got == {"a": ([1, 2], [4, 5]), "b": ([1], [9])}
    assert writers.as_lists(df.where(F.col("k") == "a"), "age", ["n"]).collect()[0]["n"] == [4, 5]


def test_rows_with_line_breaks_are_whole_by_default(spark, tmp_path):
    header = "id,url,region,region_url,price,year,manufacturer,model,condition,cylinders,fuel,odometer,title_status,transmission,VIN,drive,size,type,paint_color,image_url,description,county,state,lat,long,posting_date"
    line = '{i},u,r,ru,100,2010.0,ford,f,,,gas,5,clean,automatic,,4wd,,truck,red,i,"two\nlines\n\nof ""text"", all",,ca,1,2,2021-04-0{i}T00:00:00-0700'
    path = write(tmp_path / "v.csv", "\n".join([header, *(line.format(i=i) for i in range(1, 6))]) + "\n")
    rows = readers.read_listings(spark, path).orderBy("posting_date").collect()
    assert len(rows) == 5
    assert [str(r["posting_date"])[:10] for r in rows] == [f"2021-04-0{i}" for i in range(1, 6)]
    assert {r["state"] for r in rows} == {"ca"}
    columns = "NHTSA ID,Report Received Date,Manufacturer,Recall Type,Component,Potentially Affected,Subject,Recall Description,Consequence Summary,Park Outside Advisory,Do Not Drive Advisory"
    path = write(tmp_path / "r.csv", columns + "\n" + "".join(f'R{i},01/15/2010,m,Vehicle,c,5,s,"a\nb",x,No,Yes\n' for i in range(4)))
    rows = readers.read_recalls(spark, path).collect()
    assert [(r["recall_id"], r["description"], r["do_not_drive"]) for r in rows] == [(f"R{i}", "a\nb", "Yes") for i in range(4)]
