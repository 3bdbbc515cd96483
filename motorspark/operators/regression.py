"""Least squares from grouped sums.

All a linear fit needs is the matrix of summed products. Rows that share their categories are
first summed into one line, a plain aggregation with partial sums on the map side; the lines
are then spread into matrix cells. Fits on part of the features, and scores on a test part,
reuse blocks of the same matrix, so the rows are read once. The driver only sees
features-by-features cells, and at most ``MAX_CELLS`` of them.

With more features the cells stay a table: ``fit_table`` solves the same equations by conjugate
gradients, one join and one aggregate of the cells that are not zero per round, and its
coefficients are a table as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.values import map_values
from motorspark.operators.ordering import quantiles
from motorspark.session import checkpointed

INTERCEPT = "(intercept)"
#: Cells and levels that the driver may hold; beyond them the sparse forms do the same work in Spark.
MAX_CELLS, MAX_LEVELS = 4_000_000, 1000


@dataclass(frozen=True)
class Design:
    """Target, numeric features and categorical features with their baseline level."""

    target: str
    numeric: Sequence[str]
    categorical: Mapping[str, str] = field(default_factory=dict)

    def group_of(self, feature: str) -> str:
        for column in self.categorical:
            if feature.startswith(f"{column}_"):
                return column
        return feature


def levels(df: DataFrame, baselines: Mapping[str, str]) -> DataFrame:
    """Rows per 0/1 feature: every level but the baseline of each categorical column."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in baselines]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .where("level is not null")
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("ones"))
    )
    base = map_values(F.col("column"), dict(baselines))
    return counts.where(F.col("level") != base).select(
        F.concat_ws("_", "column", "level").alias("feature"), "column", "level", "ones"
    )


def listed_levels(df: DataFrame, baselines: Mapping[str, str], most: int = MAX_LEVELS) -> list[Row]:
    """``levels`` in order on the driver, where there are at most ``most``."""
    found = levels(df, baselines).orderBy("feature").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} levels: take sparse_features, one row per id and feature, instead of a column each")
    return found


def sparse_features(df: DataFrame, id_column: str, baselines: Mapping[str, str]) -> DataFrame:
    """The 0/1 features that are 1, as (id, feature): any number of levels, no list of them, no shuffle."""
    pairs = [
        F.when(F.col(c).cast("string") != base, F.concat_ws("_", F.lit(c), F.col(c).cast("string"))) for c, base in baselines.items()
    ]
    return df.select(id_column, F.explode(F.array_compact(F.array(*pairs))).alias("feature"))


def one_hot(df: DataFrame, baselines: Mapping[str, str], found: Iterable[Row]) -> DataFrame:
    """One 0/1 column per level found by ``levels``."""
    return df.withColumns(
        {r["feature"]: F.coalesce((F.col(r["column"]) == r["level"]).cast("double"), F.lit(0.0)) for r in found}
    )


def product_sums(df: DataFrame, design: Design, by: Sequence[str] = ()) -> DataFrame:
    """Summed products (``i``, ``j``, ``value``) of all features and the target, per group of ``by``."""
    measures = [F.lit(1.0), *[F.col(c).cast("double") for c in (*design.numeric, design.target)]]
    width = len(measures)
    sums = {
        (a, b): F.sum(measures[a] * measures[b]).alias(f"_s{a}_{b}") for a in range(width) for b in range(a, width)
    }
    lines = (
        df.dropna(subset=[*design.numeric, design.target])
        .groupBy(*by, *design.categorical)
        .agg(*sums.values())
    )
    cells = F.array(*[F.col(f"_s{min(a, b)}_{max(a, b)}") for a in range(width) for b in range(width)])
    names = [INTERCEPT, *design.numeric, design.target]
    features = [F.struct(F.lit(n).alias("name"), F.lit(i).alias("at")) for i, n in enumerate(names)]
    for column, baseline in design.categorical.items():
        level = F.col(column).cast("string")
        features.append(
            F.when(
                level != baseline, F.struct(F.concat_ws("_", F.lit(column), level).alias("name"), F.lit(0).alias("at"))
            )
        )
    lines = lines.select(*by, cells.alias("_cells"), F.array_compact(F.array(*features)).alias("_features"))
    left = lines.select(*by, "_cells", "_features", F.explode("_features").alias("_i"))
    both = left.select(*by, "_cells", "_i", F.explode("_features").alias("_j"))
    value = F.get(F.col("_cells"), F.col("_i.at") * width + F.col("_j.at"))
    return (
        both.select(*by, F.col("_i.name").alias("i"), F.col("_j.name").alias("j"), value.alias("value"))
        .groupBy(*by, "i", "j")
        .agg(F.sum("value").alias("value"))
    )


@dataclass(frozen=True)
class Products:
    """Summed products on the driver: ``names`` and the square matrix over them."""

    names: list[str]
    matrix: np.ndarray

    def block(self, rows: Sequence[str], columns: Sequence[str]) -> np.ndarray:
        place = {n: i for i, n in enumerate(self.names)}
        out = np.zeros((len(rows), len(columns)))
        for a, r in enumerate(rows):
            for b, c in enumerate(columns):
                if r in place and c in place:
                    out[a, b] = self.matrix[place[r], place[c]]
        return out


def collect_products(cells: DataFrame, by: Sequence[str] = ()) -> dict[tuple, Products]:
    groups: dict[tuple, list[Row]] = {}
    found = cells.limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells: fit with fit_table, which keeps them in Spark")
    for row in found:
        groups.setdefault(tuple(row[c] for c in by), []).append(row)
    out = {}
    for key, rows in groups.items():
        names = sorted({r["i"] for r in rows})
        place = {n: i for i, n in enumerate(names)}
        matrix = np.zeros((len(names), len(names)))
        for r in rows:
            matrix[place[r["i"]], place[r["j"]]] = r["value"]
        out[key] = Products(names, matrix)
    return out


@dataclass(frozen=True)
class Model:
    design: Design
    intercept: float
    coefficients: dict[str, float]
    train_rows: int

    def predicted(self) -> Column:
        """The fitted value as a column expression."""
        value = F.lit(self.intercept)
        for name in self.design.numeric:
            value = value + F.lit(self.coefficients.get(name, 0.0)) * F.col(name)
        for column in self.design.categorical:
            own = {f[len(column) + 1 :]: b for f, b in self.coefficients.items() if f.startswith(f"{column}_")}
            if own:
                value = value + map_values(F.col(column).cast("string"), own, F.lit(0.0))
        return value


def fit(products: Products, design: Design, without: Iterable[str] = ()) -> Model:
    """Least squares with intercept; features of the ``without`` groups are left out."""
    left_out = set(without)
    features = [
        n for n in products.names
        if n not in (INTERCEPT, design.target) and design.group_of(n) not in left_out
    ]
    rows = products.block([INTERCEPT], [INTERCEPT])[0, 0]
    sums = products.block(features, [INTERCEPT])[:, 0]
    total = products.block([design.target], [INTERCEPT])[0, 0]
    spread = products.block(features, features) - np.outer(sums, sums) / rows
    slope = products.block(features, [design.target])[:, 0] - sums * total / rows
    coefficients = np.linalg.pinv(spread, hermitian=True) @ slope
    intercept = (total - sums @ coefficients) / rows
    return Model(design, float(intercept), dict(zip(features, map(float, coefficients))), int(rows))


def fit_table(cells: DataFrame, design: Design, tol: float = 1e-12, rounds: int = 1000) -> DataFrame:
    """Least squares as (feature, coefficient), the intercept included, by conjugate gradients on summed products.

    ``cells`` are the ``product_sums`` of the design. Each feature is scaled by its own square sum. A round multiplies the
    cells by the direction, one line per feature, and stops once the scaled gradient is ``tol`` times the first one. The
    driver sees sums only. Of features that say the same the coefficients are the smallest that fit.
    """
    cells = checkpointed(cells)
    inner = cells.where((F.col("i") != design.target) & (F.col("j") != design.target))
    known = inner.where((F.col("i") == F.col("j")) & (F.col("value") > 0)).select(F.col("i").alias("feature"), F.col("value").alias("scale"))
    right = cells.where((F.col("j") == design.target) & (F.col("i") != design.target)).select(F.col("i").alias("feature"), F.col("value").alias("r"))
    state = checkpointed(known.join(right, "feature").withColumns({"x": F.lit(0.0), "p": F.col("r") / F.col("scale")}))
    size = first = state.agg(F.sum(F.col("r") * F.col("r") / F.col("scale"))).first()[0] or 0.0
    for _ in range(rounds):
        if size <= tol * tol * first:
            break
        moved = inner.join(state.select(F.col("feature").alias("j"), "p"), "j").groupBy(F.col("i").alias("feature"))
        both = checkpointed(state.join(moved.agg(F.sum(F.col("value") * F.col("p")).alias("ap")), "feature"))
        curve = both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        if curve <= 0:
            break
        step = size / curve
        stepped = both.select("feature", "scale", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "p")
        before, size = size, stepped.agg(F.sum(F.col("r") * F.col("r") / F.col("scale"))).first()[0]
        state = stepped.withColumn("p", F.col("r") / F.col("scale") + size / before * F.col("p"))
    return state.select("feature", F.col("x").alias("coefficient"))


def r_squared(products: Products, model: Model) -> float:
    """Share of explained variance on the rows behind ``products``."""
    names = [INTERCEPT, *model.coefficients]
    beta = np.array([model.intercept, *model.coefficients.values()])
    target = model.design.target
    cross = products.block(names, [target])[:, 0]
    squares = products.block([target], [target])[0, 0]
    residual = squares - 2 * beta @ cross + beta @ products.block(names, names) @ beta
    rows = products.block([INTERCEPT], [INTERCEPT])[0, 0]
    total = products.block([target], [INTERCEPT])[0, 0]
    return float(1 - residual / (squares - total * total / rows))


def effects(model: Model, numeric_labels: Mapping[str, tuple[str, str]], group_names: Mapping[str, str]) -> list[tuple]:
    """(group, label, percentage effect, coefficient) of a fit on a logarithm."""
    lines = []
    for name, value in model.coefficients.items():
        column = model.design.group_of(name)
        if column in model.design.categorical:
            baseline = model.design.categorical[column]
            group, label = group_names.get(column, column), f"{name[len(column) + 1:]} (vs {baseline})"
        else:
            group, label = numeric_labels.get(name, (name, "+1"))
        lines.append((group, label, float(np.expm1(value) * 100), value))
    return lines


def group_importance(train: Products, test: Products, design: Design, names: Mapping[str, str]) -> list[tuple]:
    """(group, test R2 without the group, drop), from blocks of the two matrices."""
    full = r_squared(test, fit(train, design))
    lines = []
    for group in [*design.numeric, *design.categorical]:
        without = r_squared(test, fit(train, design, [group]))
        lines.append((names.get(group, group), without, full - without))
    return sorted(lines, key=lambda line: -line[2])


PRICE_DESIGN = Design("log_price", ["vehicle_age", "odometer_10k"], fixed.BASELINES)
NUMERIC_LABELS = {"vehicle_age": ("Vehicle age", "+1 year"), "odometer_10k": ("Odometer", "+10,000 miles")}


def median_error_pct(scored: DataFrame, actual: str, predicted: str, alias: str) -> DataFrame:
    """Median of |predicted - actual| / actual in per cent."""
    error = F.abs(F.col(predicted) - F.col(actual)) / F.col(actual) * 100
    return quantiles(scored.select(error.alias("_e")), [], "_e", {alias: 0.5})


def error_by_band(
    scored: DataFrame, actual: str, predicted: str, cut: float = 2000, factor: float = 2,
    labels: tuple[str, str] = ("Asking price under $2,000", "Asking price $2,000 and above"),
) -> DataFrame:
    """Rows, median prediction, and share predicted at more than ``factor`` times the price, by band."""
    banded = checkpointed(
        scored.select(
            F.when(F.col(actual) < cut, labels[0]).otherwise(labels[1]).alias("listings"),
            F.col(predicted).alias("_p"),
            (F.col(predicted) > factor * F.col(actual)).cast("int").alias("_far"),
        )
    )
    medians = quantiles(banded, ["listings"], "_p", {"median_predicted": 0.5}, "test_rows")
    shares = banded.groupBy("listings").agg((F.avg("_far") * 100).alias("predicted_more_than_double"))
    return medians.join(shares, "listings")
