"""Records with line breaks inside quotes, cut by split borders at any place, against the reader that takes whole files."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from motorspark.sources import readers
from motorspark.sources.records import records


@pytest.fixture
def small_splits(spark):
    def cut(size: str):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def random_value(rng: random.Random) -> str:
    if rng.random() < 0.5:
        return rng.choice(["", "7", "12.5", "plain text", "ä"])
    pieces = ["a", '"', '""', "\n", "\r\n", "\n\n", "\r", ",", "é", " ", "long words " * 12]
    return '"' + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))).replace('"', '""') + '"'


def random_csv(folder, name: str, end: str, rows: int, seed: int, last_end: bool = True) -> str:
    rng = random.Random(seed)
    lines = ["a, b,c d" + end]
    for i in range(rows):
        lines.append(f"{i},{random_value(rng)},{random_value(rng)}" + (end if last_end or i < rows - 1 else ""))
        lines += [end] * (rng.random() < 0.05)
    (folder / name).write_text("".join(lines), encoding="utf-8", newline="")
    return str(folder / name)


def same(spark, path: str) -> int:
    got = Counter(map(tuple, readers.read_csv(spark, path, multi_line=True).collect()))
    assert got == Counter(map(tuple, readers.read_csv(spark, path, multi_line=True, whole_files=True).collect()))
    return sum(got.values())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["48", "200", "128m"])
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, small_splits, end, size):
    small_splits(size)
    path = random_csv(tmp_path, "t.csv", end, 60, 5, last_end=size != "200")
    assert same(spark, path) == 60


def test_several_files_and_a_break_at_every_border(spark, tmp_path, small_splits):
    small_splits("100")
    folder = tmp_path / "t"
    folder.mkdir()
    # each record is 100 bytes long and holds the border of a split within its quotes
    body = "".join(f'{i:03d},"' + "x" * 42 + "\n" + "y" * 49 + '",\n' for i in range(20))
    (folder / "one.csv").write_text("a, b,c d" + "\n" + " " * 40 + "\n" + body)
    random_csv(folder, "two.csv", "\r\n", 30, 9)
    random_csv(folder, "three.csv", "\n", 30, 10)
    assert same(spark, str(folder)) == 81


def test_a_record_over_many_splits_and_an_open_quote(spark, tmp_path, small_splits):
    small_splits("64")
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"' + "many\nlines " * 100 + '"\n2,x\n3,"never\nclosed\n4,y\n')
    rows = readers.read_csv(spark, str(path), multi_line=True).orderBy("a").collect()
    assert [r["a"] for r in rows] == ["1", "2", "3"] and rows[0]["b"] == "many\nlines " * 100 and rows[2]["b"].startswith("never\nclosed\n4,y")
    assert records(spark, str(path), header=False).count() == 4


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "h.csv"), multi_line=True).columns == ["a", "b"]
    assert readers.read_csv(spark, str(tmp_path / "h.csv"), multi_line=True).count() == 0


def test_listings_and_recalls_are_read_by_many_tasks(spark, tmp_path, small_splits):
    header = "id,url,region,region_url,price,year,manufacturer,model,condition,cylinders,fuel,odometer,title_status,transmission,VIN,drive,size,type,paint_color,image_url,description,county,state,lat,long,posting_date"
    line = '{i},u,r,ru,100,2010,ford,"f-150, x",,,gas,5,clean,automatic,,4wd,,truck,red,i,"two\nlines ""q"" and\r\nmore",,ca,1,2,2021-04-01T00:00:00-0700\n'
    path = tmp_path / "v.csv"
    path.write_text(header + "\n" + "".join(line.replace("{i}", str(i)) for i in range(400)), newline="")
    small_splits("4k")
    listings = readers.read_listings(spark, str(path))
    assert listings.rdd.getNumPartitions() > 10
    rows = listings.collect()
    assert sorted(r["id"] for r in rows) == list(range(400)) and {(r["state"], r["posting_date"]) for r in rows} == {("ca", "2021-04-01T00:00:00-0700")}
    names = ["Report Received Date", "NHTSA ID", "Manufacturer", "Subject", "Component", "Potentially Affected", "Recall Type", "Recall Description", "Consequence Summary", "Park Outside Advisory", "Do Not Drive Advisory"]
    text = ",".join(names) + "\n" + "".join(f'01/05/2024,24V{i:03d},Ford,"a\nb",x,"1,0{i:02d}",Vehicle,"one\n\n""two""",c,No,No\n' for i in range(100))
    (tmp_path / "r.csv").write_text(text)
    recalls = readers.read_recalls(spark, str(tmp_path / "r.csv"))
    assert recalls.rdd.getNumPartitions() > 1
    got = recalls.collect()
    assert len(got) == 100 and {(r["year"], r["description"], r["subject"]) for r in got} == {(2024, 'one\n\n"two"', "a\nb")}
