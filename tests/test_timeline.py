from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from motorspark.operators import timeline
from motorspark.operators.timeline import Series
from motorspark.plans import telematics

SCHEMA = "row_id long, deviceID long, ts timestamp, speed double, gps_speed double, rpm double, x double"
START = datetime(2024, 1, 1, 23, 59, 0)


def frame(spark, steps, speed=None, x=None, device=1):
    """Readings ``steps`` seconds apart."""
    ts, rows = START, []
    for i, step in enumerate(steps):
        ts = ts + timedelta(seconds=step) if step is not None else ts
        rows.append(
            (device * 1000 + i, device, ts if step is not None else None, (speed or [10.0] * len(steps))[i], 10.0, 900.0,
             (x or [float(i) for i in range(len(steps))])[i])
        )
    return spark.createDataFrame(rows, SCHEMA)


def series(chunk=86400):
    return Series("deviceID", "ts", "row_id", chunk)


def test_gap_of_exactly_the_limit_stays_in_the_trip(spark):
    trips = timeline.sessionize(frame(spark, [0, 120, 121, 1]), series()).orderBy("row_id").collect()
    assert [r["trip"] for r in trips] == [1, 1, 2, 2]
    assert [r["time_delta"] for r in trips] == [None, 120.0, None, 1.0]


def test_untimed_rows_come_last_and_start_their_own_trip(spark):
    both = frame(spark, [0, 1, None, None]).unionByName(frame(spark, [0, 1], device=2))
    trips = {r["row_id"]: r["trip"] for r in timeline.sessionize(both, series()).collect()}
    assert trips[1000] == trips[1001] == 1
    assert sorted([trips[1002], trips[1003]]) == [2, 3]
    assert trips[2000] == trips[2001] == 4


@pytest.mark.parametrize("chunk", [3, 86400])
def test_run_needs_ten_repeats_and_first_row_is_not_flagged(spark, chunk):
    for members, frozen in ((10, 0), (11, 10)):
        x = [0.5] * members + [1.0]
        signals = timeline.driving_signals(frame(spark, [0] + [1] * members, x=x), series(chunk))
        flagged = timeline.frozen_runs(signals, series(chunk)).where("frozen").orderBy("row_id").collect()
        assert [r["row_id"] for r in flagged] == [1000 + i for i in range(1, 1 + frozen)]
        assert timeline.frozen_count(signals, series(chunk)).collect()[0]["rows"] == frozen


@pytest.mark.parametrize("chunk", [4, 86400])
def test_runs_end_at_missing_values_and_trip_breaks(spark, chunk):
    x = [1.0] * 6 + [None] + [1.0] * 6
    signals = timeline.driving_signals(frame(spark, [0] + [1] * 12, x=x), series(chunk))
    runs = timeline.frozen_runs(signals, series(chunk), 5).orderBy("row_id").collect()
    assert [r["repeats"] for r in runs] == [5] * 6 + [0] + [5] * 6
    broken = timeline.driving_signals(frame(spark, [0, 1, 1, 500, 1, 1], x=[1.0] * 6), series(chunk))
    assert [r["repeats"] for r in timeline.frozen_runs(broken, series(chunk), 2).orderBy("row_id").collect()] == [2] * 6


@pytest.mark.parametrize("chunk", [4, 86400])
def test_rolling_needs_ten_known_rows_of_the_same_trip(spark, chunk):
    speed = [float(i) for i in range(12)]
    rows = timeline.driving_signals(frame(spark, [0] + [1] * 11, speed), series(chunk)).orderBy("row_id").collect()
    assert [r["speed_mean"] is None for r in rows] == [True] * 9 + [False] * 3
    assert rows[9]["speed_mean"] == pytest.approx(4.5)
    assert rows[9]["speed_std"] == pytest.approx(np.std(speed[:10], ddof=1))
    speed[5] = None
    rows = timeline.driving_signals(frame(spark, [0] + [1] * 11, speed), series(chunk)).orderBy("row_id").collect()
    assert all(r["speed_mean"] is None for r in rows)


def test_acceleration_only_over_one_second_steps(spark):
    speed = [0.0, 20.0, 0.0, 50.0]
    rows = timeline.driving_signals(frame(spark, [0, 1, 1, 2], speed), series()).orderBy("row_id").collect()
    assert [r["harsh_accel"] for r in rows] == [False, True, False, False]
    assert [r["harsh_brake"] for r in rows] == [False, False, True, False]
    assert rows[3]["accel_ms2"] is None
    assert [r["idle"] for r in rows] == [True, False, True, False]
    assert rows[3]["km"] == pytest.approx(50 * 2 / 3600)


@pytest.mark.parametrize("chunk", [40, 3600, 10**7])
def test_any_chunk_length_gives_the_series_wide_result(spark, chunk):
    """Against a plain whole-series computation, with a hot device and sparse and dense chunks."""
    random = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame(
        {
            "row_id": np.arange(n),
            "deviceID": random.choice([1, 1, 1, 2, 3], n),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(random.choice([0, 1, 1, 1, 1, 5, 130, 900], n)), unit="s"),
            "speed": random.integers(0, 4, n) * 10.0,
            "gps_speed": 1.0,
            "rpm": 800.0,
            "x": random.integers(0, 2, n).astype(float),
        }
    )
    want = pdf.sort_values(["deviceID", "ts", "row_id"]).reset_index(drop=True)
    delta = want.groupby("deviceID")["ts"].diff().dt.total_seconds()
    starts = delta.isna() | (delta > 120)
    want["trip"] = starts.cumsum()
    same = want.groupby("trip")["x"].diff() == 0
    want["repeats"] = same.groupby((~same).cumsum()).transform("sum")
    want["mean"] = want.groupby("trip")["speed"].transform(lambda s: s.rolling(4, min_periods=4).mean())
    s = series(chunk)
    signals = timeline.driving_signals(spark.createDataFrame(pdf, SCHEMA), s, rows=4)
    got = (
        timeline.number_trips(timeline.frozen_runs(signals, s, 2), s)
        .orderBy("deviceID", "ts", "row_id").select("row_id", "trip", "repeats", "speed_mean").toPandas()
    )
    assert got["row_id"].tolist() == want["row_id"].tolist()
    assert got["trip"].tolist() == want["trip"].tolist()
    assert got["repeats"].tolist() == want["repeats"].tolist()
    assert np.allclose(got["speed_mean"].fillna(-1), want["mean"].fillna(-1))
    frozen = same & (want["repeats"] >= 2) & (want["speed"] > 0)
    assert timeline.frozen_count(signals, s, 2).collect()[0]["rows"] == frozen.sum()
    trips = timeline.trip_features(signals, s, 0, 0).orderBy("trip").toPandas()
    sizes = want.groupby("trip").size()
    assert trips["rows"].tolist() == sizes.tolist() and trips["trip"].tolist() == sizes.index.tolist()
    top = want.groupby("trip")["speed"].max()
    assert trips["max_speed"].tolist() == top.tolist()


def test_short_trips_are_left_out_before_the_rate(spark):
    speed = [60.0] * 200
    long = frame(spark, [0] + [1] * 199, speed)
    short = frame(spark, [0, 1], [60.0, 0.0], device=2)
    signals = timeline.driving_signals(long.unionByName(short), series())
    trips = timeline.trip_features(signals, series()).collect()
    assert [t["deviceID"] for t in trips] == [1]
    assert trips[0]["distance_km"] == pytest.approx(60 * 199 / 3600)
    assert timeline.device_summary(timeline.rounded(timeline.trip_features(signals, series())), "deviceID", 1).count() == 1
    assert timeline.device_summary(timeline.trip_features(signals, series()), "deviceID").count() == 0


def test_sampling_steps_sum_to_rows_less_trips(spark):
    df = frame(spark, [0, 0, 1, 2, 3, 10, 11, 120, 121, 1])
    steps = timeline.own_rows(timeline.trip_starts(df, series()))
    rows = telematics.sampling_report(steps, telematics.sampling_steps()).collect()
    assert [r["rows"] for r in rows] == [1, 2, 1, 2, 2]
    assert sum(r["rows"] for r in rows) == 10 - 2


@pytest.mark.parametrize("chunk", [40, 10**7])
def test_text_ids_and_readings_without_a_device(spark, chunk):
    """Readings without a device are trips of their own after all devices, in the order of time, and none is lost."""
    random = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame(
        {
            "row_id": np.arange(n),
            "deviceID": random.choice(["dev-3", "dev-10", "a", None], n),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(random.choice([0, 1, 1, 5, 130], n)), unit="s"),
            "speed": 10.0, "gps_speed": 1.0, "rpm": 800.0, "x": random.integers(0, 2, n).astype(float),
        }
    )
    pdf.loc[random.choice(n, 20, replace=False), "ts"] = pd.NaT
    want = pdf.sort_values(["deviceID", "ts", "row_id"], na_position="last").reset_index(drop=True)
    delta = want.groupby("deviceID")["ts"].diff().dt.total_seconds()
    want["trip"] = (delta.isna() | (delta > 120)).cumsum()
    df = spark.createDataFrame(
        [(r.row_id, r.deviceID, None if pd.isna(r.ts) else r.ts.to_pydatetime(), r.speed, r.gps_speed, r.rpm, r.x) for r in pdf.itertuples()],
        SCHEMA.replace("deviceID long", "deviceID string"),
    )
    signals = timeline.driving_signals(df, series(chunk))
    got = timeline.number_trips(timeline.frozen_runs(signals, series(chunk)), series(chunk)).select("row_id", "trip", "ts").toPandas()
    assert len(got) == n
    timed = want[want["ts"].notna()].set_index("row_id")["trip"].to_dict()
    found = got.set_index("row_id")["trip"].to_dict()
    assert {k: found[k] for k in timed} == timed
    assert sorted(found.values()) == sorted(want["trip"])
    trips = timeline.trip_features(signals, series(chunk), 0, 0).toPandas()
    assert trips["rows"].sum() <= n and (trips["deviceID"].isna()).any()
    assert timeline.device_summary(timeline.trip_features(signals, series(chunk), 0, 0), "deviceID", 0).where("deviceID is null").count() == 0
