"""Geographic column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2.0
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """Point on the unit sphere; straight-line distance there grows with haversine distance."""
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def quadrant(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column) -> Column:
    """Quadrant around a centre; points on an axis count as north or east."""
    return (
        F.when((lat >= centre_lat) & (lon >= centre_lon), "NE")
        .when(lat >= centre_lat, "NW")
        .when(lon >= centre_lon, "SE")
        .when((lat < centre_lat) & (lon < centre_lon), "SW")
    )
