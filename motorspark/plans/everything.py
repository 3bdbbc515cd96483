"""The four plans in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from motorspark.plans import listings, recalls, specs, telematics


def run(raw_listings: DataFrame, raw_recalls: DataFrame, decoded: DataFrame, readings: DataFrame, out: str, sample_size: int = 1000) -> dict[str, DataFrame]:
    """Runs listings, recalls, specifications and telematics into folders of ``out``; returns their main tables."""
    clean = listings.run(raw_listings, f"{out}/listings")
    tables = recalls.run(raw_recalls, clean, f"{out}/recalls")
    sample, _ = specs.sample_batches(clean, sample_size)
    return {
        "clean": clean,
        "recalls": tables["recall_exposure"],
        "specs": specs.run(sample, decoded, f"{out}/specs"),
        "trips": telematics.run(readings, f"{out}/telematics"),
    }
