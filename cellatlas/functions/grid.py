"""Grid cells, tile mathematics and rectangles as Column expressions."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells per degree.
CELLS = 100


class Bounds(NamedTuple):
    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float


WORLD = Bounds(-90.0, 90.0, -180.0, 180.0)


def cell(degrees: Column) -> Column:
    """The index of the 0.01 degree cell that holds a latitude or longitude."""
    return F.floor(degrees * F.lit(float(CELLS))).cast("int")


def cell_of(degrees: float) -> int:
    return math.floor(degrees * CELLS)


def in_cells(lat_cell: Column, lon_cell: Column, b: Bounds) -> Column:
    """Whether a cell is among those that the bounds touch; a range predicate that reaches the scan."""
    return lat_cell.between(cell_of(b.min_lat), cell_of(b.max_lat)) & lon_cell.between(cell_of(b.min_lon), cell_of(b.max_lon))


def contains(lat: Column, lon: Column, b: Bounds) -> Column:
    """Inside the bounds, edges included."""
    return lat.between(b.min_lat, b.max_lat) & lon.between(b.min_lon, b.max_lon)


def strictly_inside(lat: Column, lon: Column, b: Bounds) -> Column:
    """Inside the bounds, edges excluded."""
    return (lat > b.min_lat) & (lat < b.max_lat) & (lon > b.min_lon) & (lon < b.max_lon)


def overlaps(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, b: Bounds) -> Column:
    """Two rectangles share a point; touching edges count."""
    return (min_lat <= b.max_lat) & (max_lat >= b.min_lat) & (min_lon <= b.max_lon) & (max_lon >= b.min_lon)


def covers(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, b: Bounds) -> Column:
    """The rectangle holds the whole of the bounds; equal edges count."""
    return (min_lat <= b.min_lat) & (max_lat >= b.max_lat) & (min_lon <= b.min_lon) & (max_lon >= b.max_lon)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(2**zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * float(2**zoom)).cast("int")


def corner_lon(x: Column, zoom: Column) -> Column:
    """Longitude of the western edge of a tile column."""
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def corner_lat(y: Column, zoom: Column) -> Column:
    """Latitude of the northern edge of a tile row."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))


def tile_bounds(x: int, y: int, zoom: int) -> Bounds:
    def lat(row: int) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / 2**zoom))))

    return Bounds(lat(y + 1), lat(y), x / 2**zoom * 360 - 180, (x + 1) / 2**zoom * 360 - 180)


def clip_share(inside: Column, outside: Column) -> Column:
    """For one axis of a segment from a point inside the unit interval to one outside: the share at which it leaves."""
    edge = F.when(outside > 1.0, F.lit(1.0)).when(outside < 0.0, F.lit(0.0))
    return F.when(edge.isNotNull() & (outside != inside), (edge - inside) / (outside - inside)).otherwise(F.lit(1.0))
