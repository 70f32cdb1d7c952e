"""Sunrise / sunset as column maths (no UDF, no per-row solver).

Low-precision "sunrise equation" (public astronomy; NOAA-style mean anomaly,
equation of centre, ecliptic longitude, declination, hour angle with the
standard -0.833 degree refraction + solar-disc altitude). Accurate to about a
minute at mid latitudes. Polar day / night (|cos w| > 1) gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import col, from_utc

# Fixed astronomical constants (degrees / days) of the sunrise equation.
M0, M1 = 357.5291, 0.98560028
C1, C2, C3 = 1.9148, 0.0200, 0.0003
PERIHELION = 282.9372
TRANSIT_M, TRANSIT_L = 0.0053, 0.0069
OBLIQUITY = 23.44
ALTITUDE = -0.833
EPOCH = "2000-01-01 00:00:00"
EPOCH_SECONDS = 946684800


def _sin_deg(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos_deg(x: Column) -> Column:
    return F.cos(F.radians(x))


def sun_events_utc(lon: str | Column, lat: str | Column, local_date: str | Column) -> tuple[Column, Column]:
    """(sunrise, sunset) as UTC ``TIMESTAMP_NTZ`` for a place and local calendar date."""
    lon, lat = col(lon).cast("double"), col(lat).cast("double")
    d = F.datediff(col(local_date).cast("date"), F.lit("2000-01-01").cast("date")).cast("double")
    n = d - lon / 360.0
    m = M0 + M1 * n
    c = C1 * _sin_deg(m) + C2 * _sin_deg(2 * m) + C3 * _sin_deg(3 * m)
    lam = m + c + PERIHELION
    transit = n + TRANSIT_M * _sin_deg(m) - TRANSIT_L * _sin_deg(2 * lam)
    sin_dec = _sin_deg(lam) * _sin_deg(F.lit(OBLIQUITY))
    cos_dec = F.sqrt(1 - sin_dec * sin_dec)
    cos_w = (_sin_deg(F.lit(ALTITUDE)) - _sin_deg(lat) * sin_dec) / (_cos_deg(lat) * cos_dec)
    w = F.when(F.abs(cos_w) <= 1, F.degrees(F.acos(cos_w)))
    epoch = F.lit(EPOCH).cast("timestamp_ntz")

    def at(days: Column) -> Column:
        secs = F.floor((days + 0.5) * 86400.0 + 0.5)
        return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))

    return at(transit - w / 360.0), at(transit + w / 360.0)


def with_sun_events_utc(
    df: DataFrame, lon: str, lat: str, local_date: str | Column, rise: str = "sunrise_utc", sset: str = "sunset_utc", seconds: bool = False
) -> DataFrame:
    """Add (sunrise, sunset) UTC columns, computing each intermediate once.

    ``seconds`` gives them as whole seconds since 1970 instead of timestamps.

    Same maths as ``sun_events_utc``, but as successive projections: Spark
    does not inline a non-trivial alias that is used more than once, so every
    trigonometric term is evaluated once per row and the generated code stays
    small.
    """
    p = "__sun_"
    d = F.datediff(col(local_date).cast("date"), F.lit("2000-01-01").cast("date")).cast("double")
    out = df.withColumn(f"{p}n", d - F.col(lon).cast("double") / 360.0)
    out = out.withColumn(f"{p}m", M0 + M1 * F.col(f"{p}n"))
    m = F.col(f"{p}m")
    c = C1 * _sin_deg(m) + C2 * _sin_deg(2 * m) + C3 * _sin_deg(3 * m)
    out = out.withColumn(f"{p}lam", m + c + PERIHELION)
    lam = F.col(f"{p}lam")
    out = out.withColumns(
        {
            f"{p}transit": F.col(f"{p}n") + TRANSIT_M * _sin_deg(m) - TRANSIT_L * _sin_deg(2 * lam),
            f"{p}sd": _sin_deg(lam) * _sin_deg(F.lit(OBLIQUITY)),
        }
    )
    sd = F.col(f"{p}sd")
    la = F.col(lat).cast("double")
    out = out.withColumn(f"{p}cw", (_sin_deg(F.lit(ALTITUDE)) - _sin_deg(la) * sd) / (_cos_deg(la) * F.sqrt(1 - sd * sd)))
    cw = F.col(f"{p}cw")
    out = out.withColumn(f"{p}w", F.when(F.abs(cw) <= 1, F.degrees(F.acos(cw))))
    epoch = F.lit(EPOCH).cast("timestamp_ntz")

    def at(days: Column) -> Column:
        secs = F.floor((days + 0.5) * 86400.0 + 0.5)
        if seconds:
            return secs + EPOCH_SECONDS
        return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))

    t, w = F.col(f"{p}transit"), F.col(f"{p}w")
    out = out.withColumns({rise: at(t - w / 360.0), sset: at(t + w / 360.0)})
    return out.drop(*[f"{p}{k}" for k in ("n", "m", "lam", "transit", "sd", "cw", "w")])


def sun_events_local(lon, lat, local_date, tz: str) -> tuple[Column, Column]:
    """(sunrise, sunset) as local ``TIMESTAMP_NTZ`` in ``tz``."""
    rise, sset = sun_events_utc(lon, lat, local_date)
    return from_utc(rise, tz), from_utc(sset, tz)
