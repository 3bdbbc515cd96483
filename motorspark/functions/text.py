"""Text expressions: names, tokens, announcing sentences and model years."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed


def normalize_company(name: Column, suffixes: Iterable[str] = fixed.LEGAL_SUFFIXES) -> Column:
    """Lower-cased name without bracketed text, punctuation and trailing legal suffixes."""
    plain = F.regexp_replace(F.lower(name), r"\(.*?\)", " ")
    plain = F.regexp_replace(plain, r"[^a-z0-9 ]", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.regexp_replace(plain, rf"( ({'|'.join(suffixes)}))+$", "")


def letters_only(text: Column) -> Column:
    """Lower-cased letters with single blanks; missing text becomes empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def short_name(name: Column) -> Column:
    """Display form: everything from the legal suffix on is cut, and the region is dropped."""
    cut = F.regexp_replace(name, r",? (Inc\.|LLC|North America).*$", "")
    return F.replace(cut, F.lit(" North America"), F.lit(""))


def name_tokens(text: Column) -> Column:
    """Runs of letters and digits; a hyphen joins its neighbours ('F-150' is 'f150')."""
    joined = F.replace(F.lower(text), F.lit("-"), F.lit(""))
    return F.regexp_extract_all(joined, F.lit("[a-z0-9]+"), F.lit(0))


def first_token(text: Column) -> Column:
    return F.get(name_tokens(text), F.lit(0))


def announcing_sentence(text: Column, marker: str = "recalling") -> Column:
    """Text up to the first full stop after the marker word; empty without the marker."""
    start = F.locate(marker, F.lower(text))
    end = F.call_function("locate", F.lit(". "), text, start)
    return (
        F.when(text.isNull() | (start == 0), F.lit(""))
        .when(end == 0, text)
        .otherwise(F.substring(text, F.lit(1), end - 1))
    )


def model_years(
    text: Column,
    years: tuple[int, int] = fixed.MODEL_YEAR_RANGE,
    max_span: int = fixed.MAX_YEAR_SPAN,
) -> Column:
    """Sorted distinct years in the text; a range such as 2013-2018 stands for all its years."""
    one = r"(?:19|20)\d{2}"
    pair = rf"\b({one})\s*-\s*({one})\b"
    starts = F.regexp_extract_all(text, F.lit(pair), F.lit(1))
    ends = F.regexp_extract_all(text, F.lit(pair), F.lit(2))
    spans = F.zip_with(starts, ends, lambda a, b: F.array(a.cast("int"), b.cast("int")))
    spans = F.filter(spans, lambda s: (s[1] - s[0]).between(0, max_span))
    expanded = F.flatten(F.transform(spans, lambda s: F.sequence(s[0], s[1])))
    single = F.transform(
        F.regexp_extract_all(text, F.lit(rf"\b{one}\b"), F.lit(0)), lambda y: y.cast("int")
    )
    found = F.array_union(expanded, single)
    return F.array_sort(F.filter(found, lambda y: y.between(*years)))


def classify_regex(text: Column, patterns: dict[str, str]) -> Column:
    """Label of the last pattern that matches; missing when none does."""
    return F.coalesce(
        *[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in reversed(patterns.items())]
    )


def classify_contains(text: Column, terms: list[tuple[str, list[str]]]) -> Column:
    """Label of the first entry with a term inside the upper-cased text; missing when none has."""
    upper = F.upper(text)
    branches = []
    for label, words in terms:
        found = F.lit(False)
        for word in words:
            found = found | upper.contains(word)
        branches.append(F.when(found, F.lit(label)))
    return F.coalesce(*branches)


def severity(
    text: Column,
    high: Iterable[str] = fixed.HIGH_SEVERITY_TERMS,
    medium: Iterable[str] = fixed.MEDIUM_SEVERITY_TERMS,
) -> Column:
    """3, 2 or 1 by keyword in the lower-cased text; missing when the text has no letters."""
    lowered = F.lower(text)
    return (
        F.when(~F.coalesce(lowered.rlike("[a-z]"), F.lit(False)), F.lit(None).cast("int"))
        .when(lowered.rlike("|".join(high)), 3)
        .when(lowered.rlike("|".join(medium)), 2)
        .otherwise(1)
    )
