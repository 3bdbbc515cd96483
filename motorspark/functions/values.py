"""Value expressions: missing values, maps, bins and lenient parsing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed


def holds(condition: Column) -> Column:
    """The condition with missing read as false, so that it can be negated and counted."""
    return F.coalesce(condition, F.lit(False))


def null_unless(df: DataFrame, valid: dict[str, Column]) -> DataFrame:
    """Values that break their column's condition become missing."""
    return df.withColumns({c: F.when(ok, F.col(c)) for c, ok in valid.items()})


def nullify(
    df: DataFrame, columns: Iterable[str], tokens: Iterable[str] = fixed.MISSING_TOKENS, trimmed: bool = True
) -> DataFrame:
    """Spellings of a missing value become missing; with ``trimmed`` also between blanks."""
    spelled = list(tokens)
    plain = (lambda c: F.trim(F.col(c))) if trimmed else F.col
    return df.withColumns({c: F.when(~plain(c).isin(spelled), F.col(c)) for c in columns})


def fill_unknown(df: DataFrame, columns: Iterable[str], value: str = "unknown") -> DataFrame:
    return df.fillna(value, subset=list(columns))


def map_values(column: Column, mapping: dict, default: Column | None = None) -> Column:
    """Constant-map lookup."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, default)


def replace_values(column: Column, aliases: dict) -> Column:
    return map_values(column, aliases, column)


def band(column: Column, width: float) -> Column:
    """Middle of the equal-width band a value falls in."""
    return F.floor(column / width) * width + width / 2


def cut(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with labels; values outside every bin become missing."""
    bins = [
        F.when((column > low) & (column <= high), F.lit(label))
        for low, high, label in zip(edges, edges[1:], labels)
    ]
    return F.coalesce(*bins)


def bin_number(column: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right, outside is missing."""
    place = F.least(F.floor((column - low) / (high - low) * bins), F.lit(bins - 1).cast("long"))
    return F.when((column >= low) & (column <= high), place)


def lenient_number(column: Column) -> Column:
    return column.try_cast("double")


def percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / whole


def share_bucket(value: Column, largest: Column, steps: Sequence[float] = (0.65, 0.45, 0.25, 0.12)) -> Column:
    """Colour step of a heat-map cell: the highest step whose share of the maximum is reached."""
    share = F.try_divide(value, largest)
    level = F.lit(0)
    for i, step in enumerate(reversed(steps), start=1):
        level = F.when(share >= step, i).otherwise(level)
    return level


def longest_argument(weights: Column) -> Column:
    """0-based place of the largest entry; the first one wins a tie."""
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")
