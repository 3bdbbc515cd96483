"""Decoded specifications: sample, compare with the listing, check and decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.values import holds
from motorspark.operators import comparing, joins, reports, sampling
from motorspark.session import checkpointed
from motorspark.sources.writers import write_document, write_summaries, write_table

COVERAGE = {
    "Engine displacement": "API_Engine", "Body class": "API_Body", "Drivetrain": "API_Drive", "Fuel type": "API_Fuel",
}
OUTPUT_COLUMNS = [
    "id", "VIN", "price", "year", "year_original", "manufacturer", "model", "fuel", "drive", "type",
    "API_Make", "API_Model", "API_Year", "API_Body", "API_Engine", "API_Drive", "API_Fuel",
    "drive_enriched", "Status", "action",
]


def valid_vins(listings: DataFrame, pattern: str = fixed.VALID_VIN) -> DataFrame:
    """Trimmed, upper-cased VINs that have the legal form."""
    return listings.withColumn("VIN", F.upper(F.trim("VIN"))).where(F.col("VIN").rlike(pattern))


def vin_totals(listings: DataFrame, pattern: str = fixed.VALID_VIN) -> DataFrame:
    vin = F.upper(F.trim("VIN"))
    return reports.count_report(
        listings,
        [
            ("with a VIN", vin.isNotNull()),
            ("with a valid VIN", vin.rlike(pattern)),
            ("malformed VINs", vin.isNotNull() & ~vin.rlike(pattern)),
        ],
        "check", "listings", "pct_of_listings",
    )


def sample_batches(listings: DataFrame, n: int = 1000, size: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The sampled listings and the request batches of their VINs."""
    sample = sampling.sample_n(valid_vins(listings), n, seed, "id")
    return sample, sampling.to_batches(sample, "VIN", size, "id")


def compared(listings: DataFrame, specs: DataFrame, fuels: dict[str, str] = fixed.FUEL_NAMES) -> DataFrame:
    """Listings with their specification, in one vocabulary, with comparison flags."""
    joined = joins.enrich(listings, specs, ["VIN"])
    return comparing.compare_sources(comparing.align(joined, fuels), comparing.FIELDS, "decoded")


def coverage(enriched: DataFrame) -> DataFrame:
    checks = [(label, F.col(c).isNotNull()) for label, c in COVERAGE.items()]
    return reports.count_report(enriched, checks, "field", "populated", "coverage_pct")


def taxonomy(flagged: DataFrame) -> DataFrame:
    checks = comparing.taxonomy_checks()
    counts = reports.count_report(flagged, [(c, cond) for _, c, cond in checks], "category", "count", "pct_of_sample")
    kinds = F.create_map(*[F.lit(x) for kind, category, _ in checks for x in (category, kind)])
    return counts.withColumn("error_type", kinds[F.col("category")])


def rule_report(flagged: DataFrame, current_year: Column | int, **rules) -> DataFrame:
    masked, names = comparing.rule_masks(flagged, comparing.spec_rules(current_year, **rules))
    return reports.violation_report(masked, names, "VIN")


def decisions(decided: DataFrame) -> DataFrame:
    return reports.with_share(reports.value_counts(decided, "action", "listings"), "listings", "pct_of_sample")


def sample_totals(flagged: DataFrame) -> DataFrame:
    """One line: size of the sample, decoded VINs, and the share that could not be decoded."""
    failed = ~holds(F.col("Status") == "Success")
    return flagged.agg(
        F.count(F.lit(1)).alias("sample_size"), F.count_if(~failed).alias("decoded"), (F.avg(failed.cast("int")) * 100).alias("failure_rate")
    )


#: The reports keep the order of their checks; conflicts go by field and place.
ORDERS = {
    "vin_coverage": [],
    "vin_quality_audit": [],
    "vin_drive_before_after": ["-listings_before", "drive"],
    "vin_validation_rules": [],
    "vin_error_taxonomy": [],
    "vin_decisions": ["-listings", "action"],
    "vin_conflict_samples": ["field", "place"],
    "vin_sample": [],
    "vin_totals": [],
}


def run(
    sample: DataFrame, specs: DataFrame, out: str, current_year: Column | int | None = None, listings: DataFrame | None = None
) -> DataFrame:
    """Writes the specs, the enriched listings and every report; returns the enriched listings.

    With all ``listings`` the share with a VIN and the malformed VINs are reported as well.
    """
    year = F.year(F.current_date()) if current_year is None else current_year
    joins.assert_unique(specs, ["VIN"])
    flagged = checkpointed(compared(sample, specs))
    joins.assert_same_count(sample, flagged)
    decided = comparing.decide(flagged)
    tables = {
        "vin_coverage": coverage(flagged),
        "vin_quality_audit": comparing.comparison_report(flagged, comparing.FIELDS),
        "vin_drive_before_after": comparing.before_after(flagged, "drive_listing", "drive_enriched", "price"),
        "vin_validation_rules": rule_report(flagged, year),
        "vin_error_taxonomy": taxonomy(flagged),
        "vin_decisions": decisions(decided),
        "vin_conflict_samples": comparing.conflict_samples(flagged, comparing.FIELDS, "VIN"),
        "vin_sample": sample_totals(flagged),
    }
    if listings is not None:
        tables["vin_totals"] = vin_totals(listings)
    write_table(specs, out, "vin_specs")
    kept = decided.where(F.col("action") != "Drop").select(*[c for c in OUTPUT_COLUMNS if c in decided.columns])
    write_table(kept, out, "listings_vin_enriched")
    write_summaries(tables, f"{out}/tables", ORDERS)
    write_document(f"{out}/documents", "vin", tables, ORDERS)
    return kept
