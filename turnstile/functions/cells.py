"""Hexagon cells over latitude and longitude.

The grid lies on a Lambert cylindrical equal-area projection, so all cells of a
resolution have one area. Sizes follow the H3 averages, but the ids are this
grid's own: ``r{resolution}:{q}:{r}``. With the ``h3`` package installed,
``h3_cell`` gives real H3 ids through an Arrow UDF.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius, mean cell area at resolution 8, and the
# place shown when a cell is unknown.
EARTH_KM = 6371.0088
AREA_KM2_AT_8 = 0.737
DEFAULT_CENTRE = (42.3601, -71.0589)


def cell_side_km(resolution: int) -> float:
    area = AREA_KM2_AT_8 * 7.0 ** (8 - resolution)
    return math.sqrt(2.0 * area / (3.0 * math.sqrt(3.0)))


def hex_cell(lat: Column, lon: Column, resolution: int = 8, ref_lat: float = 42.36) -> Column:
    """Cell id of a point; null if either coordinate is null."""
    side = cell_side_km(resolution)
    stretch = math.cos(math.radians(ref_lat))
    x = F.lit(EARTH_KM * stretch) * (lon * F.lit(math.pi / 180.0))
    y = F.lit(EARTH_KM / stretch) * F.sin(lat * F.lit(math.pi / 180.0))
    q = x * F.lit(math.sqrt(3.0)) / F.lit(3.0 * side) - y / F.lit(3.0 * side)
    r = y * F.lit(2.0) / F.lit(3.0 * side)
    cq, cr, cs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(-q - r + 0.5)
    dq, dr, ds = F.abs(cq - q), F.abs(cr - r), F.abs(cs + q + r)
    # The axis rounded worst is set from the other two, which must sum to 0.
    fq = F.when((dq > dr) & (dq > ds), -cr - cs).otherwise(cq)
    fr = F.when((dr >= dq) & (dr > ds), -cq - cs).otherwise(cr)
    return F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.concat(F.lit(f"r{resolution}:"), fq.cast("long").cast("string"), F.lit(":"), fr.cast("long").cast("string")),
    )


def cell_centre(cell: Column, ref_lat: float = 42.36) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre; the default place if unreadable."""
    pattern = r"^r([0-9]+):(-?[0-9]+):(-?[0-9]+)$"
    resolution = F.regexp_extract(cell, pattern, 1).try_cast("double")
    q = F.regexp_extract(cell, pattern, 2).try_cast("double")
    r = F.regexp_extract(cell, pattern, 3).try_cast("double")
    stretch = math.cos(math.radians(ref_lat))
    area = F.lit(AREA_KM2_AT_8) * F.pow(F.lit(7.0), F.lit(8.0) - resolution)
    side = F.sqrt(F.lit(2.0) * area / F.lit(3.0 * math.sqrt(3.0)))
    y = r * F.lit(3.0) * side / F.lit(2.0)
    x = (q + y / (F.lit(3.0) * side)) * F.lit(3.0) * side / F.lit(math.sqrt(3.0))
    sine = y * F.lit(stretch / EARTH_KM)
    lat = F.when(F.abs(sine) <= 1.0, F.asin(sine) * F.lit(180.0 / math.pi))
    lon = x / F.lit(EARTH_KM * stretch) * F.lit(180.0 / math.pi)
    known = lat.isNotNull() & lon.isNotNull()
    return (
        F.when(known, lat).otherwise(F.lit(DEFAULT_CENTRE[0])),
        F.when(known, lon).otherwise(F.lit(DEFAULT_CENTRE[1])),
    )


@lru_cache(maxsize=None)
def _h3_udf(resolution: int):
    import h3
    import pandas as pd

    to_cell = getattr(h3, "latlng_to_cell", None) or h3.geo_to_h3

    @F.pandas_udf("string")
    def cells(lat: pd.Series, lon: pd.Series) -> pd.Series:
        known = lat.notna() & lon.notna()
        return pd.Series([to_cell(a, o, resolution) if ok else None for a, o, ok in zip(lat, lon, known)])

    return cells


def h3_cell(lat: Column, lon: Column, resolution: int = 8) -> Column:
    """Real H3 ids by the optional ``h3`` package on the executors.

    Unsupported: a row-by-row call of that package, which no test here can run.
    The default cells are column expressions.
    """
    return _h3_udf(resolution)(lat, lon)


def spatial_cell(lat: Column, lon: Column, resolution: int = 8, backend: str = "hex") -> Column:
    if backend == "hex":
        return hex_cell(lat, lon, resolution)
    if backend == "h3":
        return h3_cell(lat, lon, resolution)
    raise ValueError(f"unknown cell backend: {backend}")
