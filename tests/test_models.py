from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from motorspark.operators import regression, sampling, topics
from motorspark.plans.listings import price_model, segment_models
from motorspark.plans.recalls import topic_model

DESIGN = regression.Design("log_price", ["vehicle_age", "odometer_10k"], {"fuel": "gas", "brand_segment": "Standard"})


@pytest.fixture(scope="module")
def cars(spark):
    random = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "vehicle_age": random.integers(0, 25, n),
            "odometer_10k": random.uniform(0, 30, n),
            "fuel": random.choice(["gas", "gas", "gas", "diesel", "other"], n),
            "brand_segment": random.choice(["Standard", "Luxury"], n),
        }
    )
    log_price = 10 - 0.07 * pdf["vehicle_age"] - 0.03 * pdf["odometer_10k"] + 0.3 * (pdf["fuel"] == "diesel")
    pdf["price"] = np.exp(log_price + random.normal(0, 0.2, n))
    return pdf, spark.createDataFrame(pdf)


def test_fit_equals_ml_linear_regression(cars):
    _, df = cars
    fitted = price_model(df, DESIGN)
    found = regression.levels(df, DESIGN.categorical).collect()
    wide = regression.one_hot(df.where(sampling.in_train("id", 42)), DESIGN.categorical, found).withColumn("log_price", F.log("price"))
    names = [*DESIGN.numeric, *[r["feature"] for r in found]]
    model = LinearRegression(labelCol="log_price", solver="normal", standardization=False).fit(
        VectorAssembler(inputCols=names, outputCol="features").transform(wide)
    )
    assert fitted.model.intercept == pytest.approx(model.intercept, abs=1e-6)
    for name, value in zip(names, model.coefficients):
        assert fitted.model.coefficients[name] == pytest.approx(value, abs=1e-6)


def test_scores_and_importance_equal_refits(cars):
    pdf, df = cars
    fitted = price_model(df, DESIGN)
    train_ids = {r["id"] for r in df.where(sampling.in_train("id", 42)).select("id").collect()}
    x = pd.get_dummies(pdf[["vehicle_age", "odometer_10k", "fuel", "brand_segment"]], dtype=float).drop(columns=["fuel_gas", "brand_segment_Standard"])
    y, train = np.log(pdf["price"]), pdf["id"].isin(train_ids)

    def r2(columns):
        a = np.column_stack([np.ones(len(x)), x[columns]])
        beta = np.linalg.lstsq(a[train], y[train], rcond=None)[0]
        rest = y[~train] - a[~train] @ beta
        return 1 - (rest**2).sum() / ((y[~train] - y[~train].mean()) ** 2).sum()

    assert fitted.r2 == pytest.approx(r2(list(x.columns)), abs=1e-9)
    lines = {g: w for g, w, _ in regression.group_importance(fitted.train, fitted.test, DESIGN, {})}
    for group in ("vehicle_age", "fuel"):
        assert lines[group] == pytest.approx(r2([c for c in x.columns if not c.startswith(group)]), abs=1e-9)
    assert 0.75 < len(train_ids) / len(pdf) < 0.85


def test_a_collinear_feature_does_not_break_the_fit(cars):
    _, df = cars
    twice = df.withColumn("copy", F.col("vehicle_age") * 2.0)
    design = regression.Design("log_price", ["vehicle_age", "copy"])
    products = regression.collect_products(regression.product_sums(twice.withColumn("log_price", F.log("price")), design))[()]
    model = regression.fit(products, design)
    plain = regression.fit(products, regression.Design("log_price", ["vehicle_age"]), ["copy"])
    assert model.coefficients["vehicle_age"] + 2 * model.coefficients["copy"] == pytest.approx(plain.coefficients["vehicle_age"])


def test_segment_models(cars):
    _, df = cars
    for row in segment_models(df).collect():
        assert row["pct_per_year"] == pytest.approx(math.expm1(-0.07) * 100, abs=0.6)


def test_sample_and_split_ignore_partitioning(spark):
    df = spark.range(1000)
    first = sorted(r["id"] for r in sampling.sample_n(df, 50, 1, "id").collect())
    assert first == sorted(r["id"] for r in sampling.sample_n(df.repartition(13), 50, 1, "id").collect())
    assert first != sorted(r["id"] for r in sampling.sample_n(df, 50, 2, "id").collect())


def test_batches_are_numbered_in_order(spark):
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(120)], "VIN string")
    got = sampling.to_batches(df, "VIN", 50, "VIN").orderBy("batch").collect()
    assert [(r["batch"], r["size"]) for r in got] == [(0, 50), (1, 50), (2, 20)]
    assert got[1]["keys"].startswith("v050;v051")


TEXTS = ["Fire fire brake leak", "brake leak of the hose", "fire, brake!", None, "the of", "fire leak fire leak"]


def test_tfidf_equals_a_plain_computation(spark):
    stop = ["the", "of"]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    counts = topics.term_counts(df, "id", "t", stop)
    vocab = topics.vocabulary(counts, topics.document_count(df, "t"), 2, 5)
    got = {(r["id"], r["term"]): r["weight"] for r in topics.long_weights(topics.tfidf(counts, vocab, "id"), "id").collect()}

    bags = {}
    for i, t in enumerate(TEXTS):
        ws = [w for w in re.findall(r"[a-z]{2,}", (t or "").lower()) if w not in stop]
        bags[i] = Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
    df_of, total = Counter(), Counter()
    for bag in bags.values():
        df_of.update(bag.keys())
        total.update(bag)
    kept = sorted((t for t in total if df_of[t] >= 2), key=lambda t: (-total[t], t))[:5]
    n = sum(1 for t in TEXTS if re.search("[a-z]", (t or "").lower()))
    want = {}
    for i, bag in bags.items():
        w = {t: bag[t] * (math.log((1 + n) / (1 + df_of[t])) + 1) for t in kept if bag[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want |= {(i, t): v / norm for t, v in w.items()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value)


@pytest.fixture(scope="module")
def planted(spark):
    random = np.random.default_rng(0)
    themes = [["fuel", "leak", "ignition"], ["seat", "belt", "latch"], ["air", "bag", "inflator"]]
    rows = [(i, " ".join(random.choice(themes[i % 3], 12)), i % 3) for i in range(150)]
    rows += [(150, "zzz yyy", -1), (151, None, -1)]
    df = spark.createDataFrame(rows, "id int, t string, theme int")
    return df, topic_model(df, "id", "t", [], 3, 30, 20, 100)


def test_planted_topics_are_found(planted):
    df, (assigned, _) = planted
    pairs = assigned.join(df, "id").groupBy("theme", "topic").count().collect()
    assert len(pairs) == 4
    assert {(r["theme"], r["count"]) for r in pairs} == {(0, 50), (1, 50), (2, 50), (-1, 2)}
    assert [r["topic"] for r in pairs if r["theme"] == -1] == [-1]


def test_error_falls_and_factors_stay_non_negative(planted):
    _, (assigned, factors) = planted
    assert all(b <= a + 1e-9 for a, b in zip(factors.errors, factors.errors[1:]))
    assert (factors.topics >= 0).all()
    assert assigned.where("topic_weight < 0").count() == 0


def test_topic_terms_and_examples(spark, planted):
    df, (assigned, factors) = planted
    words = [set(r["top_words"].split(", ")[:3]) for r in topics.top_terms(spark, factors, 3).collect()]
    assert all(any(w <= {"fuel", "leak", "ignition", *[f"{a} {b}" for a in t for b in t]} or w & set(t) for t in (["fuel"], ["seat"], ["air"], ["belt"], ["bag"], ["latch"], ["inflator"], ["leak"], ["ignition"])) for w in words)
    examples = topics.topic_examples(assigned, df, "id", "t").collect()
    assert len(examples) == 6 and len({(r["topic"], r["t"]) for r in examples}) == 6


def test_weights_are_least_squares(spark):
    random = np.random.default_rng(2)
    topic_matrix, own = random.uniform(size=(3, 8)), random.uniform(size=(5, 3))
    rows = own @ topic_matrix
    found = topics.topic_weights(rows @ topic_matrix.T, topic_matrix @ topic_matrix.T, 3000)
    assert np.allclose(found, own, atol=1e-4)


def test_blocks_cover_every_row(monkeypatch):
    monkeypatch.setattr(topics, "MAX_ENTRIES", 3)
    batch = pd.DataFrame({"term_ids": [np.array([0, 1]), np.array([2]), np.array([0, 1, 2, 3]), np.array([1])]})
    batch["weights"] = [np.ones(len(t)) for t in batch["term_ids"]]
    parts = list(topics.blocks(batch))
    assert [(p.start, p.stop) for p, _ in parts] == [(0, 2), (2, 3), (3, 4)]
    right = np.arange(8.0).reshape(4, 2)
    assert np.concatenate([b.times(right) for _, b in parts]).tolist() == [[2, 4], [4, 5], [12, 16], [2, 3]]


def test_sparse_fit_equals_the_dense_one(spark):
    random = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "x": random.normal(5, 2, n), "z": random.normal(-100, 30, n), "g": random.choice(list("abcd"), n), "h": random.choice(["p", "q"], n)})
    pdf["y"] = 3 + 0.5 * pdf["x"] - 0.01 * pdf["z"] + pdf["g"].map({"a": 0, "b": 1, "c": -2, "d": 0.3}) + random.normal(0, 0.1, n)
    design = regression.Design("y", ["x", "z"], {"g": "a", "h": "p"})
    cells = regression.product_sums(spark.createDataFrame(pdf), design)
    dense = regression.fit(regression.collect_products(cells)[()], design)
    sparse = {r["feature"]: r["coefficient"] for r in regression.fit_table(cells, design).collect()}
    assert sparse.pop(regression.INTERCEPT) == pytest.approx(dense.intercept, abs=1e-8)
    assert sparse == pytest.approx(dense.coefficients, abs=1e-8)
    ones = {tuple(r) for r in regression.sparse_features(spark.createDataFrame(pdf), "id", design.categorical).collect()}
    assert ones == {(i, f"g_{g}") for i, g in zip(pdf["id"], pdf["g"]) if g != "a"} | {(i, "h_q") for i, h in zip(pdf["id"], pdf["h"]) if h == "q"}


def test_a_hundred_thousand_levels_never_reach_the_driver(spark):
    levels = 100_000
    rows = spark.range(3 * levels).select(
        (F.col("id") % levels).alias("g"), (F.col("id") % 7 + F.col("id") / levels).alias("x")
    )
    rows = rows.withColumn("y", F.lit(2.0) + 0.25 * F.col("x") + F.col("g") % 10)
    design = regression.Design("y", ["x"], {"g": "0"})
    cells = regression.product_sums(rows, design)
    with pytest.raises(ValueError, match="levels"):
        regression.listed_levels(rows, design.categorical)
    found = regression.fit_table(cells, design)
    wanted = F.when(F.col("feature") == "x", 0.25).when(F.col("feature") == regression.INTERCEPT, 2.0).otherwise(F.substring("feature", 3, 9).cast("int") % 10)
    worst = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("coefficient") - wanted)).alias("off")).first()
    assert worst["n"] == levels + 1 and worst["off"] < 1e-6


def test_exact_weights_are_the_best_non_negative_ones():
    random = np.random.default_rng(0)
    topic_matrix = np.abs(random.normal(size=(6, 30))) * (random.random((6, 30)) < 0.4)
    rows = random.normal(size=(300, 30)) + np.abs(random.normal(size=(300, 30)))
    cross, square = rows @ topic_matrix.T, topic_matrix @ topic_matrix.T
    found = topics.exact_weights(cross, square)
    assert (found >= 0).all() and np.abs(found - topics.topic_weights(cross, square, 5000)).max() < 1e-8
    # two equal topics and an empty one
    twice = np.vstack([topic_matrix, topic_matrix[:1], np.zeros((1, 30))])
    again = topics.exact_weights(rows @ twice.T, twice @ twice.T)
    assert (again >= 0).all() and np.abs(again @ twice - found @ topic_matrix).max() < 1e-8


def test_terms_counted_inside_rows_equal_the_pair_table(spark):
    texts = ["Fire in the engine engine", None, "", "fire risk fire risk", "engine stall on the road", "seat belt", "fire engine seat", "x y z", "engine fire engine"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    counts, documents = topics.term_counts(df, "id", "t", ["the"]), topics.document_count(df, "t")
    wanted = topics.vocabulary(counts, documents, 4, 6)
    counted = topics.bags(df, "id", "t", ["the"])
    assert counted.count() == len(texts)
    for buckets in (1, 7, 1 << 18):
        assert sorted(topics.frequent_terms(counted, documents, 4, 6, buckets).collect()) == sorted(wanted.collect())
    found = wanted.orderBy("term").collect()
    names = [r["term"] for r in found]
    rows = topics.weighted_rows(counted, "id", names, [r["idf"] for r in found]).collect()
    got = {(r["id"], names[i]): w for r in rows for i, w in zip(r["term_ids"], r["weights"])}
    assert got == pytest.approx({(r["id"], r["term"]): r["weight"] for r in topics.long_weights(topics.tfidf(counts, wanted, "id"), "id").collect()})
    plan = topics.frequent_terms(counted, documents, 4, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" not in plan


def test_cells_and_scored_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(float(i % 7), "abc"[i % 3], float(i % 5)) for i in range(60)], "x double, c string, y double")
    design = regression.Design("y", ["x"], {"c": "a"})
    cells = regression.product_sums(rows, design).mapInPandas(count, "i string, j string, value double")
    assert regression.fit_table(cells, design).count() == 4
    assert seen.value == regression.product_sums(rows, design).count()
    scored = rows.selectExpr("x + 1 AS price", "y AS predicted").mapInPandas(count, "price double, predicted double")
    seen.value = 0
    assert regression.error_by_band(scored, "price", "predicted", 4, 2).count() == 2
    assert seen.value == 60


def test_texts_and_not_their_terms_are_sent_to_be_counted(spark, monkeypatch):
    monkeypatch.setattr(topics, "MAX_TEXT", 9)
    monkeypatch.setattr(topics, "MAX_TERMS", 3)
    texts = ["Fire in the engine\u00e9engine", None, "", "x 1", "fire-risk, FIRE risk", "\u212a the end", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2)
    for pairs in (True, False):
        counted = topics.bags(df, "id", "t", ["the"], pairs)
        got = {(r["id"], t, n) for r in counted.collect() for t, n in zip(r["terms"], r["tfs"])}
        assert got == {(r["id"], r["term"], r["tf"]) for r in topics.term_counts(df, "id", "t", ["the"], pairs).collect()}
        assert counted.count() == len(texts)
    assert "zip_with" not in counted._jdf.queryExecution().optimizedPlan().toString()
    counted = topics.bags(df, "id", "t", ["the"])
    assert [(r["term"], r["total"], r["df"]) for r in topics.frequent_terms(counted, F.lit(4), 1, 2).collect()] == [("engine", 2, 1), ("fire", 3, 2)][::-1]


def test_the_sketch_leaves_out_what_is_rarer_than_the_wanted_terms(spark):
    """Rare words in more documents than the least number pass a sketch by documents alone."""
    often, rare = " ".join(f"{a}{b}often" for a in "abcde" for b in "abcde"), [f"{a}{b}{c}rare" for a in "klmnopqr" for b in "klmnopqr" for c in "kl"]
    df = spark.createDataFrame([(i, f"{often} {rare[i % len(rare)]}") for i in range(3 * len(rare))], "id long, t string").repartition(2)
    counted = topics.bags(df, "id", "t", [], pairs=False)
    assert int(topics._sketch(counted, 2, 25, 1 << 18).sum()) <= 25
    assert {r["term"] for r in topics.frequent_terms(counted, F.lit(1), 2, 25).collect()} == set(often.split())
