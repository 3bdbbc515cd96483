"""Ordered work on long series: gaps, trips, runs and rolling rows.

A series (a device) may hold a third of all rows, so no window covers a whole series. It is cut into time chunks, which one
exchange deals to the tasks. Two things cross a chunk border:

* rows before the border that lie in the same trip serve ``lag`` and rolling frames. A trip ends after a silence longer than a
  given gap, so only rows within that gap (times the rows of a frame) can matter: these are copied into the chunks they
  reach as marked overlap rows where they are read, without a look at other rows;
* running totals up to a chunk come from per-chunk sums, a table of one line per chunk, taken from the same exchange.

Rows without a time come last, in the order of the tie-break, a whole number whose high bits cut them into chunks. Rows without
a series key come after all series; each is a trip of its own, as nothing tells which row it follows. Nothing runs before the
result is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.values import holds

CHUNK = "_chunk"
OVERLAP = "_overlap"
_UNTIMED_BASE = 1 << 62
#: Ranges that the series are dealt to when they are numbered.
RANGES = 1024


@dataclass(frozen=True)
class Series:
    """Series key, time column, whole-number tie-break, chunk length in seconds, and tie-break bits inside an untimed chunk."""

    key: str
    ts: str
    tie: str
    chunk_seconds: int = 86400
    untimed_bits: int = 20

    @property
    def order(self) -> list[Column]:
        return [F.col(self.ts).asc_nulls_last(), F.col(self.tie).asc()]

    @property
    def reverse_order(self) -> list[Column]:
        return [F.col(self.ts).desc_nulls_first(), F.col(self.tie).desc()]

    @property
    def window(self):
        return Window.partitionBy(self.key, CHUNK).orderBy(*self.order)

    @property
    def chunks(self):
        return Window.partitionBy(self.key).orderBy(CHUNK)


def with_chunks(df: DataFrame, series: Series, reach: float) -> DataFrame:
    """Rows with their chunk, and copies of them, marked as overlap, in the later chunks that start within ``reach`` seconds."""
    micros, length = F.unix_micros(series.ts), series.chunk_seconds * 1000000
    own = F.floor(micros / length)
    last = F.when(F.col(series.key).isNotNull(), F.floor((micros + int(reach * 1000000)) / length))
    untimed = F.lit(_UNTIMED_BASE) + F.shiftright(F.col(series.tie).cast("long"), series.untimed_bits)
    chunks = F.coalesce(F.sequence(own, F.coalesce(last, own)), F.array(untimed))
    return df.select("*", F.posexplode(chunks).alias(OVERLAP, CHUNK)).withColumn(OVERLAP, F.col(OVERLAP) > 0)


def held(small: DataFrame) -> DataFrame:
    """A table of one line per chunk or trip, used several times: Spark holds it from its first use on, in memory or on disk."""
    return small.persist(StorageLevel.MEMORY_AND_DISK)


def _offsets(sums: DataFrame, series: Series, within: list[str], across: list[str]) -> DataFrame:
    """Sum of every earlier chunk per (series, chunk); ``across`` columns also add all smaller series.

    ``sums`` has one line per (series, chunk).
    """
    before = series.chunks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(series.key).alias("_key"),
        F.col(CHUNK).alias("_in"),
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_off_{name}") for name in [*within, *across]],
    )
    for name in across:
        per_series = sums.groupBy(F.col(series.key).alias("_key")).agg(F.sum(name).alias("_weight"))
        offsets = offsets.join(_before_series(per_series), F.col("_key").eqNullSafe(F.col("_own"))).withColumn(
            f"_off_{name}", F.col(f"_off_{name}") + F.col("_earlier")
        ).drop("_own", "_earlier")
    return offsets


def _before_series(per_series: DataFrame) -> DataFrame:
    """(_own, _earlier): the weight of all series with a smaller key, a missing key last. Keys may be of any type that sorts.

    Series are dealt to ranges between the keys with the smallest hashes, which depend on the data alone; inside a range they are
    added up in order, and the ranges, at most ``RANGES`` lines, before it.
    """
    # the weight is part of the order so that all uses of the table ask for the same columns, and Spark makes it once
    chosen = per_series.orderBy(F.col("_key").isNull(), F.xxhash64("_key"), "_key", "_weight").limit(RANGES - 2)
    bounds = chosen.agg(F.sort_array(F.collect_list("_key"))).scalar()
    place = F.when(F.col("_key").isNull(), F.lit(RANGES)).otherwise(F.size(F.filter("_bounds", lambda k: k <= F.col("_key"))))
    dealt = per_series.withColumn("_bounds", bounds).withColumn("_range", place).drop("_bounds")
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.groupBy("_range").agg(F.sum("_weight").alias("_w")).select(
        F.col("_range").alias("_at"), F.coalesce(F.sum("_w").over(lower), F.lit(0)).alias("_below")
    )
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(below), F.col("_range").eqNullSafe(F.col("_at"))).select(
        F.col("_key").alias("_own"), (F.col("_below") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))).alias("_earlier")
    )


def _join_chunks(df: DataFrame, per_chunk: DataFrame, series: Series) -> DataFrame:
    same = F.col(series.key).eqNullSafe(F.col("_key")) & (F.col(CHUNK).eqNullSafe(F.col("_in")))
    return df.join(per_chunk, same).drop("_key", "_in")


def running_totals(df: DataFrame, series: Series, within: dict[str, str], across: dict[str, str]) -> DataFrame:
    """Running count of each flag column, named by the map's value.

    The sum runs inside a chunk; the sum of all earlier chunks is joined in per chunk. Counts in
    ``within`` start anew in every series, counts in ``across`` go on from the smaller series.
    """
    named = {**within, **across}
    flags = {name: F.col(flag).cast("long") for flag, name in named.items()}
    sums = df.groupBy(series.key, CHUNK).agg(*[F.sum(flag).alias(name) for name, flag in flags.items()])
    inside = series.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({f"_run_{name}": F.sum(flag).over(inside) for name, flag in flags.items()})
    joined = _join_chunks(local, _offsets(sums, series, list(within.values()), list(across.values())), series)
    return joined.withColumns({name: F.col(f"_off_{name}") + F.col(f"_run_{name}") for name in flags}).drop(
        *[f"{tag}{name}" for name in flags for tag in ("_off_", "_run_")]
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col(OVERLAP)).drop(OVERLAP)


def trip_starts(df: DataFrame, series: Series, gap: float = fixed.TRIP_BREAK_SECONDS, rows: int = 1) -> DataFrame:
    """Chunked rows with overlap, seconds since the previous row of a trip, and the trip-start flag."""
    before = F.lag(F.unix_micros(series.ts)).over(series.window)
    delta = F.when(F.col(series.key).isNotNull(), (F.unix_micros(series.ts) - before) / 1e6)
    return (
        with_chunks(df, series, gap * rows)
        .withColumn("_delta", delta)
        .withColumn("_start", F.col("_delta").isNull() | (F.col("_delta") > gap))
        .withColumn("time_delta", F.when(~F.col("_start"), F.col("_delta")))
        .drop("_delta")
    )


def number_trips(df: DataFrame, series: Series) -> DataFrame:
    """Adds ``trip``, numbered from 1 in the order (series, time), and ``position`` in the series."""
    marked = df.withColumn("_one", F.lit(1))
    return running_totals(marked, series, {"_one": "position"}, {"_start": "trip"}).drop("_one")


def sessionize(df: DataFrame, series: Series, gap: float = fixed.TRIP_BREAK_SECONDS) -> DataFrame:
    """Adds ``time_delta`` and ``trip``: a new trip starts after a silence longer than ``gap`` seconds."""
    return number_trips(own_rows(trip_starts(df, series, gap)), series).drop("_start", CHUNK)


def driving_signals(
    df: DataFrame,
    series: Series,
    gap: float = fixed.TRIP_BREAK_SECONDS,
    step: tuple[float, float] = (1, 1),
    harsh: float = fixed.HARSH_MS2,
    rows: int = fixed.ROLLING_ROWS,
    speed: str = "speed",
    rpm: str = "rpm",
    x: str = "x",
) -> DataFrame:
    """Acceleration, rolling mean and deviation, harsh and idle flags, distance and repeat flag.

    All windows share one exchange and one sort on (series, chunk, time). A rolling frame is
    whole when the row ``rows - 1`` places back is in the same trip. Keeps the chunk and the
    trip-start flag for ``number_trips`` and ``frozen_runs``.
    """
    window = series.window
    frame = window.rowsBetween(-(rows - 1), Window.currentRow)
    inside = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.col("_full") & (F.col("_known") == rows)
    started = trip_starts(df, series, gap, max(rows - 1, 1)).withColumn(
        "_here", F.sum(F.col("_start").cast("long")).over(inside)
    )
    framed = started.withColumns(
        {
            "_before": F.lag(speed).over(window),
            "_same": holds(~F.col("_start") & (F.col(x) == F.lag(x).over(window))),
            "_full": holds(F.lag("_here", rows - 1).over(window) == F.col("_here")),
            "_known": F.count(speed).over(frame),
            "_mean": F.avg(speed).over(frame),
            "_std": F.stddev_samp(speed).over(frame),
        }
    )
    change = F.when(~F.col("_start"), F.col(speed) - F.col("_before"))
    signals = (
        own_rows(framed)
        .withColumn("accel_ms2", F.when(F.col("time_delta").between(*step), change / 3.6))
        .withColumn("speed_mean", F.when(whole, F.col("_mean")))
        .withColumn("speed_std", F.when(whole, F.col("_std")))
        .withColumn("harsh_brake", holds(F.col("accel_ms2") < -harsh))
        .withColumn("harsh_accel", holds(F.col("accel_ms2") > harsh))
        .withColumn("idle", holds((F.col(speed) == 0) & (F.col(rpm) > 0)))
        .withColumn("km", F.col(speed) * F.coalesce("time_delta", F.lit(0.0)) / 3600)
    )
    return signals.drop("_here", "_before", "_full", "_known", "_mean", "_std")


def _with_runs(signals: DataFrame, series: Series) -> DataFrame:
    """``_run``: 0 for rows that go on with the run of the chunk before, then 1, 2, ..."""
    inside = series.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return signals.withColumn("_run", F.sum((~F.col("_same")).cast("long")).over(inside))


def _border_runs(runs: DataFrame, series: Series) -> DataFrame:
    """Whole size of the first and the last run of every chunk, from at most two parts per chunk.

    ``runs`` has one line per (series, chunk, run) with ``size``.
    """
    ends = (
        runs.groupBy(series.key, CHUNK).agg(
            F.max("_run").alias("_last"),
            F.coalesce(F.sum(F.when(F.col("_run") == 0, F.col("size"))), F.lit(0)).alias("_first_size"),
            F.max_by("size", "_run").alias("_last_size"),
            F.sum("rows").alias("_rows"),
            F.sum("long_moving").alias("_long_moving"),
            F.sum(F.when(F.col("_run") == 0, F.col("long_moving"))).alias("_first_long"),
            F.max_by("long_moving", "_run").alias("_last_long"),
            F.sum(F.when(F.col("_run") == 0, F.col("moving"))).alias("_first_moving"),
            F.max_by("moving", "_run").alias("_last_moving"),
        )
    )
    before = series.chunks.rowsBetween(Window.unboundedPreceding, -1)
    first = F.struct(F.lit(0).alias("side"), F.col("_offset").alias("run"), F.col("_first_size").alias("size"))
    last = F.struct(F.lit(1).alias("side"), (F.col("_offset") + F.col("_last")).alias("run"), F.col("_last_size").alias("size"))
    carried = [c for c in ends.columns if c not in (series.key, CHUNK)]
    return (
        ends.withColumn("_offset", F.coalesce(F.sum("_last").over(before), F.lit(0)))
        .select(
            F.col(series.key).alias("_key"),
            F.col(CHUNK).alias("_in"),
            *carried,
            F.inline(F.when(F.col("_last") == 0, F.array(first)).otherwise(F.array(first, last))),
        )
        .withColumn("_whole", F.sum("size").over(Window.partitionBy("_key", "run")))
        .groupBy("_key", "_in")
        .agg(
            *[F.max(c).alias(c) for c in carried],
            F.max(F.when(F.col("side") == 0, F.col("_whole"))).alias("_first_whole"),
            F.max(F.when(F.col("side") == 1, F.col("_whole"))).alias("_last_whole"),
        )
    )


def _run_sizes(with_runs: DataFrame, series: Series, min_run: int, speed: str) -> DataFrame:
    moving = F.count_if(F.col("_same") & (F.col(speed) > 0))
    return (
        with_runs.groupBy(series.key, CHUNK, "_run")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("_same").alias("size"), moving.alias("moving"))
        .withColumn("long_moving", F.when(F.col("size") >= min_run, F.col("moving")).otherwise(0))
    )


def frozen_runs(signals: DataFrame, series: Series, min_run: int = 10, speed: str = "speed") -> DataFrame:
    """Adds ``repeats``, the repeats in the row's run of equal values, and ``frozen``.

    Runs are counted inside a chunk; only the first and the last run of a chunk can go on in
    another one.
    """
    local = _with_runs(signals, series)
    borders = _border_runs(_run_sizes(local, series, min_run, speed), series).select(
        "_key", "_in", "_last", "_first_whole", "_last_whole"
    )
    in_run = Window.partitionBy(series.key, CHUNK, "_run")
    sized = local.withColumn("_size", F.sum(F.col("_same").cast("long")).over(in_run))
    repeats = (
        F.when(F.col("_run") == 0, F.col("_first_whole"))
        .when(F.col("_run") == F.col("_last"), F.col("_last_whole"))
        .otherwise(F.col("_size"))
    )
    return (
        _join_chunks(sized, borders, series)
        .withColumn("repeats", repeats)
        .withColumn("frozen", holds(F.col("_same") & (F.col("repeats") >= min_run) & (F.col(speed) > 0)))
        .drop("_run", "_size", "_last", "_first_whole", "_last_whole")
    )


def frozen_count(signals: DataFrame, series: Series, min_run: int = 10, speed: str = "speed") -> DataFrame:
    """One line: rows of ``frozen_runs`` that are frozen, and all rows, from run sizes alone."""
    borders = _border_runs(_run_sizes(_with_runs(signals, series), series, min_run, speed), series)
    one_run = F.col("_last") == 0
    inner = F.col("_long_moving") - F.coalesce("_first_long", F.lit(0)) - F.when(one_run, 0).otherwise(F.col("_last_long"))
    first = F.when(F.col("_first_whole") >= min_run, F.coalesce("_first_moving", F.lit(0))).otherwise(0)
    last = F.when(~one_run & (F.col("_last_whole") >= min_run), F.col("_last_moving")).otherwise(0)
    return borders.agg(
        F.coalesce(F.sum(inner + first + last), F.lit(0)).alias("rows"), F.sum("_rows").alias("of_rows")
    )


def trip_features(
    signals: DataFrame, series: Series, min_minutes: float = 2, min_km: float = 0.5, speed: str = "speed"
) -> DataFrame:
    """One line per trip; short recordings are left out before the rate per 100 km.

    Rows are reduced to one part per (series, chunk, trip) where they lie; only the parts are
    numbered and added up.
    """
    inside = series.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = held(
        signals.withColumn("_part", F.sum(F.col("_start").cast("long")).over(inside))
        .groupBy(series.key, CHUNK, "_part")
        .agg(
            F.min(series.ts).alias("start"),
            F.max(series.ts).alias("_end"),
            F.count(F.lit(1)).alias("rows"),
            F.sum("km").alias("_km"),
            F.sum(speed).alias("_speed"),
            F.count(speed).alias("_speeds"),
            F.max(speed).alias("max_speed"),
            F.sum("speed_std").alias("_std"),
            F.count("speed_std").alias("_stds"),
            F.count_if("harsh_brake").alias("harsh_brakes"),
            F.count_if("harsh_accel").alias("harsh_accels"),
            F.count_if("idle").alias("_idle"),
        )
    )
    sums = parts.groupBy(series.key, CHUNK).agg(F.max("_part").alias("trip"))
    offsets = _offsets(sums, series, [], ["trip"])
    seconds = (F.unix_micros(F.max("_end")) - F.unix_micros(F.min("start"))) / 1e6
    trips = (
        _join_chunks(parts, offsets, series)
        .withColumn("trip", F.col("_off_trip") + F.col("_part"))
        .groupBy("trip", series.key)
        .agg(
            F.min("start").alias("start"),
            (seconds / 60).alias("duration_min"),
            F.sum("rows").alias("rows"),
            F.coalesce(F.sum("_km"), F.lit(0.0)).alias("distance_km"),
            F.try_divide(F.sum("_speed"), F.sum("_speeds")).alias("mean_speed"),
            F.max("max_speed").alias("max_speed"),
            F.try_divide(F.sum("_std"), F.sum("_stds")).alias("speed_std_mean"),
            F.sum("harsh_brakes").alias("harsh_brakes"),
            F.sum("harsh_accels").alias("harsh_accels"),
            (F.sum("_idle") / F.sum("rows")).alias("idle_share"),
        )
    )
    kept = trips.where((F.col("duration_min") >= min_minutes) & (F.col("distance_km") >= min_km))
    events = F.col("harsh_brakes") + F.col("harsh_accels")
    return kept.withColumn("harsh_events_per_100km", F.try_divide(events, F.col("distance_km")) * 100)


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every double column rounded half to even, as the published tables are."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.bround(c, digits) for c in doubles})


def device_summary(trips: DataFrame, key: str, min_km: float = 100) -> DataFrame:
    """Trips, distance, harsh events and idle share per device with enough kilometres."""
    return (
        trips.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.sum("distance_km").alias("distance_km"),
            F.sum(F.col("harsh_brakes") + F.col("harsh_accels")).alias("harsh_events"),
            F.avg("idle_share").alias("idle_share"),
        )
        .withColumn("harsh_events_per_100km", F.try_divide("harsh_events", "distance_km") * 100)
        .where(F.col("distance_km") >= min_km)
    )


def example_trip(numbered: DataFrame, series: Series, target_rows: int = 1800, every: int = 5) -> DataFrame:
    """Every n-th row of the trip whose length is nearest the target, with minutes from its start."""
    trips = numbered.groupBy("trip").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.min(series.ts).alias("started")
    )
    nearest = F.min_by(F.struct("trip", "first", "started"), F.struct(F.abs(F.col("n") - target_rows), F.col("trip")))
    chosen = trips.agg(nearest.alias("t")).select(
        F.col("t.trip").alias("_trip"), F.col("t.first").alias("_first"), F.col("t.started").alias("_started")
    )
    rows = numbered.join(F.broadcast(chosen), F.col("trip") == F.col("_trip"))
    minutes = (F.unix_micros(series.ts) - F.unix_micros("_started")) / 6e7
    return (
        rows.withColumn("place", F.col("position") - F.col("_first"))
        .where(F.col("place") % every == 0)
        .withColumn("minutes", minutes)
        .drop("_trip", "_first", "_started")
    )
