"""Coordinate systems: names, web mercator and the transverse mercator zones."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid and the zone grid.
A, FLATTENING, SCALE, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_NAMES = {"WGS84": "EPSG:4326", "WGS 84": "EPSG:4326", "CRS84": "EPSG:4326", "OGC:CRS84": "EPSG:4326", "URN:OGC:DEF:CRS:OGC:1.3:CRS84": "EPSG:4326"}


def normalize(name: str | None) -> str:
    """``EPSG:n`` of a known system; ``missing`` or ``invalid`` otherwise."""
    text = (name or "").strip().upper()
    if not text:
        return "missing"
    if text in _NAMES:
        return _NAMES[text]
    m = re.fullmatch(r"(?:EPSG:+|URN:OGC:DEF:CRS:EPSG::)?(\d+)", text)
    code = int(m[1]) if m else 0
    known = code in (4326, 3857) or 32601 <= code <= 32660 or 32701 <= code <= 32760
    return f"EPSG:{code}" if known else "invalid"


def normalized(name: Column) -> Column:
    """:func:`normalize` of a column."""
    text = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    code = F.regexp_extract(text, r"^(?:EPSG:+|URN:OGC:DEF:CRS:EPSG::)?(\d+)$", 1).try_cast("int")
    known = code.isin(4326, 3857) | code.between(32601, 32660) | code.between(32701, 32760)
    out = F.when(text == "", "missing")
    for k, v in _NAMES.items():
        out = out.when(text == k, v)
    return out.when(known, F.concat(F.lit("EPSG:"), code.cast("string"))).otherwise("invalid")


def srid(name: str) -> int | None:
    n = normalize(name)
    return int(n[5:]) if n.startswith("EPSG:") else None


_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the third order.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_zone(lon, lat, code: int):
    lon, lat = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    centre = np.radians((code % 100) * 6 - 183)
    k = 2 * np.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(lat)) - k * np.arctanh(k * np.sin(lat)))
    xi, eta = np.arctan2(t, np.cos(lon - centre)), np.arctanh(np.sin(lon - centre) / np.sqrt(1 + t * t))
    e, n = eta.copy(), xi.copy()
    for j, a in enumerate(_ALPHA, 1):
        e += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        n += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return EASTING + SCALE * _RADIUS * e, (NORTHING if code >= 32700 else 0.0) + SCALE * _RADIUS * n


def from_zone(x, y, code: int):
    xi = (np.asarray(y, float) - (NORTHING if code >= 32700 else 0.0)) / (SCALE * _RADIUS)
    eta = (np.asarray(x, float) - EASTING) / (SCALE * _RADIUS)
    a, b = xi.copy(), eta.copy()
    for j, c in enumerate(_BETA, 1):
        a -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        b -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return np.degrees(np.radians((code % 100) * 6 - 183) + np.arctan2(np.sinh(b), np.cos(a))), np.degrees(lat)


def transform(x, y, source: str, target: str = "EPSG:4326"):
    """Coordinates in x, y order from one known system to another."""
    a, b = srid(source), srid(target)
    if a is None or b is None:
        raise ValueError(f"cannot transform {source} to {target}")
    x, y = np.asarray(x, float), np.asarray(y, float)
    if a == 3857:
        x, y = np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - np.pi / 2)
    elif a != 4326:
        x, y = from_zone(x, y, a)
    if b == 3857:
        return A * np.radians(x), A * np.log(np.tan(np.pi / 4 + np.radians(y) / 2))
    return to_zone(x, y, b) if b != 4326 else (x, y)
