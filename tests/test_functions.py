from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorspark.functions import text, values


def one(spark, column, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(column(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("FREIGHTLINER LLC", "freightliner"),
        ("Freightliner Corporation", "freightliner"),
        ("Foo (Bar) Co., Ltd.", "foo"),
        ("Inc", "inc"),
        ("General Motors, LLC", "general motors"),
        ("Coinc", "coinc"),
        (None, None),
    ],
)
def test_company_names(spark, name, want):
    assert one(spark, text.normalize_company, name) == want


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("certain 2013-2018 cars", [2013, 2014, 2015, 2016, 2017, 2018]),
        ("2018-2013", [2013, 2018]),
        ("1985-2020", [1985, 2020]),
        ("none", []),
        ("1979", []),
        ("2028", []),
        ("2005 and 2003, 2003 - 2004", [2003, 2004, 2005]),
        ("12005 x", []),
        ("", []),
    ],
)
def test_model_years(spark, sentence, want):
    assert one(spark, text.model_years, sentence) == want


@pytest.mark.parametrize(
    ("description", "want"),
    [
        ("Ford is Recalling 2020 Escape. More text.", "Ford is Recalling 2020 Escape"),
        ("Ford (F. Inc) is recalling 2020 cars", "Ford (F. Inc) is recalling 2020 cars"),
        ("A. B is recalling x.y. End", "A. B is recalling x.y"),
        ("nothing here. At all", ""),
        (None, ""),
    ],
)
def test_announcing_sentence(spark, description, want):
    assert one(spark, text.announcing_sentence, description) == want


def test_tokens_join_hyphens(spark):
    assert one(spark, text.name_tokens, "F-150 XLT, CR-V!") == ["f150", "xlt", "crv"]
    assert one(spark, text.first_token, "...") is None


@pytest.mark.parametrize(
    ("summary", "want"),
    [("A FIRE may start", 3), ("risk of a crash", 2), ("crash and fire", 3), ("label is wrong", 1), ("123 !", None), (None, None)],
)
def test_severity(spark, summary, want):
    assert one(spark, text.severity, summary) == want


def test_last_pattern_wins(spark):
    patterns = {"one": "^a", "two": "^ab"}
    assert one(spark, lambda c: text.classify_regex(c, patterns), "abc") == "two"
    assert one(spark, lambda c: text.classify_regex(c, patterns), "x") is None


def test_short_name(spark):
    assert one(spark, text.short_name, "Toyota Motor North America Inc.") == "Toyota Motor"
    assert one(spark, text.short_name, "Forest River, Inc.") == "Forest River"


def test_holds_reads_missing_as_false(spark):
    assert one(spark, lambda c: ~values.holds(c > 1), None, "int") is True


def test_nullify_spellings(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), (" ",), ("nap",)], "v string")
    assert [r["v"] for r in values.nullify(df, ["v"]).collect()] == [None, None, None, "nap"]


def test_cut_is_closed_on_the_right(spark):
    edges, labels = [1989, 1999, 2009], ["a", "b"]
    assert [one(spark, lambda c: values.cut(c, edges, labels), v, "int") for v in (1989, 1990, 1999, 2000, 2009, 2010)] == [
        None, "a", "a", "b", "b", None,
    ]


def test_last_bin_is_closed(spark):
    bins = [one(spark, lambda c: values.bin_number(c, F.lit(0.0), F.lit(10.0), 5), v, "double") for v in (0.0, 1.9, 2.0, 10.0, 10.1)]
    assert bins == [0, 0, 1, 4, None]


def test_band_is_labelled_by_its_middle(spark):
    assert one(spark, lambda c: values.band(c, 20000), 39999.0, "double") == 30000


def test_lenient_number(spark):
    assert one(spark, values.lenient_number, "2.5") == 2.5
    assert one(spark, values.lenient_number, "two") is None


def test_share_bucket(spark):
    got = [one(spark, lambda c: values.share_bucket(c, F.lit(100)), v, "int") for v in (100, 65, 64, 25, 12, 11)]
    assert got == [4, 4, 3, 2, 1, 0]


def test_longest_argument_takes_the_first(spark):
    assert one(spark, values.longest_argument, [0.1, 0.5, 0.5], "array<double>") == 1


def test_map_and_replace(spark):
    assert one(spark, lambda c: values.replace_values(c, {"ram": "dodge"}), "ram") == "dodge"
    assert one(spark, lambda c: values.replace_values(c, {"ram": "dodge"}), "kia") == "kia"
    assert one(spark, lambda c: values.map_values(c, {"a": "b"}), None) is None
