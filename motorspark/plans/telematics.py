"""Telematics: readings to quality reports, trips and device rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.values import holds
from motorspark.operators import reports, timeline, trend
from motorspark.operators.ordering import quantiles
from motorspark.operators.timeline import Series
from motorspark.session import checkpointed
from motorspark.sources.writers import write_document, write_summaries, write_table

#: The tie-break is a digest: 52 low bits leave 4,096 chunks for readings without a time.
SERIES = Series("deviceID", "ts", "row_id", untimed_bits=52)


def sampling_steps(trip_break: float = fixed.TRIP_BREAK_SECONDS) -> list[tuple[str, Column]]:
    delta = F.col("time_delta")
    return [
        ("Duplicate timestamp (0 s)", delta == 0),
        ("1 s (nominal rate)", delta == 1),
        ("2 s", delta == 2),
        ("3 - 10 s", delta.between(3, 10)),
        (f"11 - {trip_break} s", delta > 10),
    ]


def sampling_report(steps: DataFrame, intervals: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows per interval between neighbours of a trip, as a share of all such steps."""
    return reports.count_report(steps, intervals, "interval", "rows", "pct", F.col("time_delta").isNotNull())


def quality_report(
    signals: DataFrame,
    series: Series,
    gap: float = fixed.GAP_SECONDS,
    min_run: int = 10,
    mismatch: float = 20,
    gps_limit: float = 200,
) -> DataFrame:
    """Rows per data-quality check and their share of all rows."""
    frozen_name = f"Accelerometer frozen for {min_run}+ rows while moving"
    checks = [
        ("Missing accelerometer values", F.col("x").isNull()),
        ("Unparsed timestamps", F.col(series.ts).isNull()),
        ("Duplicate timestamps inside a trip", F.col("time_delta") == 0),
        (f"Missing intervals (gap > {gap} s inside a trip)", F.col("time_delta") > gap),
        ("RPM = 0 while speed > 10 km/h (sensor dropout)", (F.col("rpm") == 0) & (F.col("speed") > 10)),
        (f"OBD speed vs GPS speed differ by > {mismatch} km/h", F.abs(F.col("speed") - F.col("gps_speed")) > mismatch),
        (f"GPS speed above {gps_limit} km/h (not plausible)", F.col("gps_speed") > gps_limit),
    ]
    counted = reports.count_report(signals, checks, "check", "rows", "pct_of_rows")
    frozen = timeline.frozen_count(signals, series, min_run).select(
        F.lit(frozen_name).alias("check"), "rows", (F.col("rows") * 100.0 / F.col("of_rows")).alias("pct_of_rows")
    )
    return counted.unionByName(frozen)


def trips_with_gaps(numbered: DataFrame, gap: float = fixed.GAP_SECONDS) -> DataFrame:
    """Trips with at least one gap, and all trips."""
    per_trip = numbered.groupBy("trip").agg(F.max(holds(F.col("time_delta") > gap).cast("int")).alias("_gap"))
    return per_trip.agg(F.sum("_gap").alias("trips_with_gaps"), F.count(F.lit(1)).alias("trips"))


def telematics_totals(readings: DataFrame, trips: DataFrame, devices: DataFrame, key: str, original_trip: str) -> DataFrame:
    """One line: readings, their trip ids and devices; trips, kilometres and median minutes of a trip; devices compared."""
    counts = readings.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(original_trip).alias("original_trip_ids"), F.count_distinct(key).alias("devices")
    )
    driven = trips.agg(F.struct(F.count(F.lit(1)).alias("trips"), F.sum("distance_km").alias("km"))).scalar()
    median = quantiles(trips, [], "duration_min", {"median_trip_min": 0.5}).scalar()
    return counts.select(
        "rows", "original_trip_ids", "devices", driven["trips"].alias("trips"), F.coalesce(driven["km"], F.lit(0.0)).alias("total_distance_km"),
        median.alias("median_trip_min"), devices.agg(F.count(F.lit(1))).scalar().alias("devices_compared"),
    )


#: Order of the published tables, "-" for descending; the others go by their first column.
ORDERS = {
    "telematics_signal_ranges": [],
    "telematics_sampling": [],
    "telematics_quality_report": [],
    "telematics_device_summary": ["-harsh_events_per_100km"],
    "telematics_example_trip": ["place"],
    "telematics_totals": [],
}


def run(readings: DataFrame, out: str, series: Series = SERIES, original_trip: str = "tripID") -> DataFrame:
    """Writes the trip table and every telematics summary; returns the trip table."""
    spark = readings.sparkSession
    signals = checkpointed(timeline.driving_signals(readings, series))
    trips = checkpointed(timeline.rounded(timeline.trip_features(signals, series)))
    devices = timeline.device_summary(trips, series.key)
    write_table(trips, out, "telematics_trip_features")
    numbered = timeline.number_trips(signals, series)
    tables = {
        "telematics_signal_ranges": timeline.rounded(reports.signal_ranges(readings, fixed.SIGNAL_LABELS)),
        "telematics_sampling": sampling_report(signals, sampling_steps()),
        "telematics_quality_report": quality_report(signals, series),
        "telematics_device_summary": devices,
        "telematics_example_trip": timeline.example_trip(numbered, series).select("trip", "place", "minutes", "speed", "rpm"),
        "telematics_trips_with_gaps": trips_with_gaps(numbered),
        "telematics_totals": telematics_totals(readings, trips, devices, series.key, original_trip),
        "telematics_period": trend.time_span(readings, series.ts, original_trip),
    }
    write_summaries(tables, f"{out}/tables", ORDERS)
    write_document(f"{out}/documents", "telematics", tables, ORDERS)
    return trips
