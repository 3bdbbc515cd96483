"""Declared schemas of the raw files."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


LISTINGS = _struct(
    id=_L, url=_S, region=_S, region_url=_S, price=_D, year=_D, manufacturer=_S, model=_S, condition=_S,
    cylinders=_S, fuel=_S, odometer=_D, title_status=_S, transmission=_S, VIN=_S, drive=_S, size=_S, type=_S,
    paint_color=_S, image_url=_S, description=_S, county=_S, state=_S, lat=_D, long=_D, posting_date=_S,
)

TELEMATICS = _struct(tripID=_L, deviceID=_L, timeStamp=_S, speed=_D, gps_speed=_D, rpm=_D, x=_D)
