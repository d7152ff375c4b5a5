"""Column kernels for points and axis-aligned boxes; degrees are WGS 84 longitude and latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
EARTH_RADIUS = 6_371_000.0
LON_METRES, LAT_METRES = 111_320.0, 110_540.0
MERCATOR_RADIUS = 6_378_137.0


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geographic(lon, lat) -> Column:
    return col(lon).between(-180, 180) & col(lat).between(-90, 90)


def centroid_distance(lon1, lat1, lon2, lat2) -> Column:
    """Metres where both ends are longitudes and latitudes, plane distance otherwise."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    plane = F.sqrt(F.pow(lon2 - lon1, 2) + F.pow(lat2 - lat1, 2))
    return F.when(geographic(lon1, lat1) & geographic(lon2, lat2), haversine(lon1, lat1, lon2, lat2)).otherwise(plane)


class Box:
    """The corner columns of a box: ``Box("p_")`` has p_x1, p_y1, p_x2, p_y2."""

    def __init__(self, prefix: str = "") -> None:
        self.prefix = prefix  # columns are made on use: a module may hold a box before there is a session

    x1 = property(lambda self: F.col(f"{self.prefix}x1"))
    y1 = property(lambda self: F.col(f"{self.prefix}y1"))
    x2 = property(lambda self: F.col(f"{self.prefix}x2"))
    y2 = property(lambda self: F.col(f"{self.prefix}y2"))

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2


def intersects(a: Box, b: Box) -> Column:
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def contains(a: Box, b: Box) -> Column:
    return (a.x1 <= b.x1) & (b.x2 <= a.x2) & (a.y1 <= b.y1) & (b.y2 <= a.y2)


def overlap(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union in [0, 1]; 0 where the union is empty."""
    inter = overlap(a, b)
    union = a.area + b.area - inter
    return F.when(union > 0, F.least(F.lit(1.0), inter / union)).otherwise(0.0)


def gap(a: Box, b: Box) -> Column:
    """Metres between two boxes, 0 where they touch."""
    zero = F.lit(0.0)
    gx = F.greatest(zero, F.greatest(a.x1 - b.x2, b.x1 - a.x2)) * LON_METRES * F.cos(F.radians(a.cy))
    gy = F.greatest(zero, F.greatest(a.y1 - b.y2, b.y1 - a.y2)) * LAT_METRES
    return F.sqrt(gx * gx + gy * gy)


def metric_area(degrees2, lat) -> Column:
    """Square metres of an area in square degrees, the unified records' formula."""
    return F.round(col(degrees2) * LON_METRES * F.cos(F.radians(col(lat))) * LAT_METRES, 2)


def metric_area_series(degrees2, lat) -> Column:
    """Square metres by the series for the length of a degree, the analyses' formula."""
    phi = F.radians(col(lat))
    return col(degrees2) * (111132.92 - 559.82 * F.cos(2 * phi)) * (111412.84 * F.cos(phi))


def buffer_degrees(metres, lat) -> Column:
    """Radius in degrees of a buffer at a latitude."""
    return col(metres) / (LON_METRES * F.greatest(F.lit(0.2), F.cos(F.radians(col(lat)))))


def web_mercator(lon, lat) -> tuple[Column, Column]:
    x = MERCATOR_RADIUS * F.radians(col(lon))
    return x, MERCATOR_RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2))


def from_web_mercator(x, y) -> tuple[Column, Column]:
    return F.degrees(col(x) / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(col(y) / MERCATOR_RADIUS)) - math.pi / 2)


def grid_cell(lon, lat) -> Column:
    """Name of the cell of a hundredth of a degree."""
    return F.format_string("CLUST_%.2f_%.2f", F.round(col(lat), 2), F.round(col(lon), 2))


def relationship(a: Box, b: Box) -> Column:
    return F.when(contains(a, b) | contains(b, a), "CONTAINMENT").when(intersects(a, b), "OVERLAP").otherwise("PROXIMITY")
