"""Coordinates: parsing, distance, scores, and points in polygons. Catalyst expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlens.functions.text import COORD_NULLS, let

_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"
EARTH_KM = 6371.0


def number(c: Column) -> Column:
    """The finite number a text states, or null."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def given(lat: Column, lon: Column) -> Column:
    """Both say something."""
    return ~F.lower(F.trim(F.coalesce(lat.cast("string"), F.lit("")))).isin(COORD_NULLS) & ~F.lower(F.trim(F.coalesce(lon.cast("string"), F.lit("")))).isin(COORD_NULLS)


def real_coordinate(lat: Column, lon: Column) -> Column:
    """Both given, and not the null island."""
    return given(lat, lon) & ~F.coalesce((number(lat) == 0) & (number(lon) == 0), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, to three decimals."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return let(a, lambda x: F.round(2 * EARTH_KM * F.atan2(F.sqrt(x), F.sqrt(F.greatest(F.lit(0.0), 1 - x))), 3))


def coordinate_score(km: Column) -> Column:
    return F.when(km.isNull(), None).when(km < 1, 1.0).when(km < 10, 0.9).when(km < 50, 0.3).when(km < 100, 0.1).otherwise(0.0)


def inside_cell(lon: Column, lat: Column, base: Column, rays: Column) -> Column:
    """Ray casting to the east: `base` counts edges that every ray of the cell crosses, `rays` are those some may cross.

    A point on a border belongs to the area east and north of it; holes are edges too.
    """

    def crossed(e: Column) -> Column:
        # the edge's upper end comes first, so that both areas of a border work out the same crossing
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return (base + F.size(F.filter(rays, crossed))) % 2 == 1


def near_edge(lon: Column, lat: Column, edges: Column, degrees: float) -> Column:
    """Whether a point is no farther than `degrees` from one of some edges, struct(x1, y1, x2, y2)."""

    def foot(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.coalesce(((lon - e["x1"]) * dx + (lat - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))

    def near(e: Column) -> Column:
        off = let(foot(e), lambda t: F.struct((e["x1"] + t * (e["x2"] - e["x1"]) - lon).alias("x"), (e["y1"] + t * (e["y2"] - e["y1"]) - lat).alias("y")))
        return let(off, lambda o: o["x"] * o["x"] + o["y"] * o["y"] <= degrees * degrees)

    return F.exists(edges, near)


def flipped(c: Column) -> Column:
    """A coordinate's text with the other sign."""
    return F.when(c.contains("-"), F.replace(c, F.lit("-"), F.lit(""))).otherwise(F.concat(F.lit("-"), c))
