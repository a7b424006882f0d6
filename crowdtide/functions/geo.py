"""Distance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * V.EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def box_half_widths(lat: Column, radius_km: float = V.RADIUS_KM) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that cover the radius."""
    return F.lit(radius_km / V.KM_PER_DEGREE), F.lit(radius_km) / (F.lit(V.KM_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.2)))


def match_confidence(distance_km: Column, delta_min: Column, window_min: Column, radius_km: float = V.RADIUS_KM) -> Column:
    near = F.greatest(F.lit(0.0), F.lit(1.0) - distance_km / F.lit(radius_km))
    soon = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(delta_min) / F.greatest(window_min, F.lit(1)))
    return F.bround(near * (F.lit(0.5) + F.lit(0.5) * soon), 3)


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)
