"""Polygon kernels in numpy, and WKT, WKB and GeoJSON forms.

A polygon is a list of rings, the shell first; a ring is an (n, 2) array whose last point repeats the first.  Areas of
intersections come from signed triangles, so that concave shells and holes need no clipping of their own.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Polygon = list[np.ndarray]


def from_wkt(text: str) -> tuple[str, list]:
    """(kind, coordinates) of POINT, LINESTRING, POLYGON and MULTIPOLYGON."""
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*(POINT|LINESTRING|POLYGON|MULTIPOLYGON)\s*(EMPTY|\(.*\))\s*", text, re.I | re.S)
    if not m:
        raise ValueError(f"not a geometry: {text[:40]}")
    kind, body = m[1].upper(), m[2]
    if body.upper() == "EMPTY":
        return kind, []
    pairs = re.sub(r"([-+.\deE]+)\s+([-+.\deE]+)(?:\s+[-+.\deE]+)*", r"[\1,\2]", body)
    out = json.loads(pairs.replace("(", "[").replace(")", "]"))
    return kind, out[0] if kind == "POINT" else out


def to_wkt(kind: str, coordinates: list) -> str:
    def show(x) -> str:
        return f"{float(x[0])!r} {float(x[1])!r}" if not isinstance(x[0], (list, tuple, np.ndarray)) else "(" + ", ".join(map(show, x)) + ")"

    if not len(coordinates):
        return f"{kind} EMPTY"
    return f"{kind} ({show(coordinates)})" if kind == "POINT" else f"{kind} {show(coordinates)}"


_KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 6: "MULTIPOLYGON"}


def from_wkb(data: bytes) -> tuple[str, list]:
    def read(at: int) -> tuple[str, list, int]:
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5 + 4 * bool(code & 0x20000000)  # an SRID follows
        width = 2 + bool(code & 0x80000000) + (code & 0xFFFF) // 1000 % 2
        kind = _KINDS[(code & 0xFFFF) % 1000]

        def points(n: int, at: int) -> tuple[list, int]:
            a = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2]
            return a.tolist(), at + 8 * n * width

        if kind == "POINT":
            p, at = points(1, at)
            return kind, p[0], at
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if kind == "LINESTRING":
            p, at = points(n, at)
            return kind, p, at
        out = []
        for _ in range(n):
            if kind == "POLYGON":
                k = struct.unpack_from(order + "I", data, at)[0]
                ring, at = points(k, at + 4)
                out.append(ring)
            else:
                _, part, at = read(at)
                out.append(part)
        return kind, out, at

    kind, out, _ = read(0)
    return kind, out


def to_wkb(kind: str, coordinates: list) -> bytes:
    code = next(k for k, v in _KINDS.items() if v == kind)
    head = struct.pack("<BI", 1, code)
    flat = lambda ps: np.asarray(ps, "<f8").tobytes()
    if kind == "POINT":
        return head + flat(coordinates)
    if kind == "LINESTRING":
        return head + struct.pack("<I", len(coordinates)) + flat(coordinates)
    if kind == "POLYGON":
        return head + struct.pack("<I", len(coordinates)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in coordinates)
    return head + struct.pack("<I", len(coordinates)) + b"".join(to_wkb("POLYGON", p) for p in coordinates)


def geojson(kind: str, coordinates: list) -> dict:
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon"}
    return {"type": names[kind], "coordinates": coordinates}


def from_geojson(shape: dict) -> tuple[str, list]:
    return shape["type"].upper(), shape["coordinates"]


# ------------------------------------------------------------------ measures


def rings(polygon: list) -> Polygon:
    return [np.asarray(r, float)[:, :2] for r in polygon]


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def area(polygon: Polygon) -> float:
    return max(0.0, abs(signed_area(polygon[0])) - sum(abs(signed_area(r)) for r in polygon[1:])) if polygon else 0.0


def centroid(polygon: Polygon) -> tuple[float, float]:
    """Of the area; of the points where there is none."""
    total, cx, cy = 0.0, 0.0, 0.0
    for k, r in enumerate(polygon):
        p = r - polygon[0][0]
        cross = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
        a = cross.sum() / 2
        sign = (1 if a >= 0 else -1) * (1 if k == 0 else -1)
        total += sign * a
        cx += sign * ((p[:-1, 0] + p[1:, 0]) * cross).sum() / 6
        cy += sign * ((p[:-1, 1] + p[1:, 1]) * cross).sum() / 6
    if total == 0:
        x, y = polygon[0][:-1].mean(axis=0)
        return float(x), float(y)
    return float(polygon[0][0][0] + cx / total), float(polygon[0][0][1] + cy / total)


def bounds(polygon: Polygon) -> tuple[float, float, float, float]:
    p = np.concatenate(polygon)
    return (*map(float, p.min(axis=0)), *map(float, p.max(axis=0)))


def inside(x: float, y: float, polygon: Polygon) -> bool:
    """Even-odd rule over all rings."""
    hit = False
    for r in polygon:
        (x1, y1), (x2, y2) = r[:-1].T, r[1:].T
        cross = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        hit ^= bool((cross & (x < at)).sum() % 2)
    return hit


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which segments of ``a`` properly cross which of ``b``."""
    p, r = a[:-1, None], (a[1:] - a[:-1])[:, None]
    q, s = b[None, :-1], (b[1:] - b[:-1])[None]
    turn = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    d1, d2 = turn(r, q - p), turn(r, q + s - p)
    d3, d4 = turn(s, p - q), turn(s, p + r - q)
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def reason(polygon: Polygon | None) -> str:
    """Valid, or why not."""
    if polygon is None:
        return "Null geometry"
    if not polygon or not len(polygon[0]):
        return "Empty geometry"
    for r in polygon:
        if len(r) < 4:
            return "Too few points"
        if not np.array_equal(r[0], r[-1]):
            return "Ring not closed"
        if _crossings(r, r).any():
            return "Self-intersection"
        inner = r[:-1]
        if len(np.unique(inner, axis=0)) < len(inner) and len(np.unique(inner, axis=0)) < 3:
            return "Repeated points"
    return "Zero area" if area(polygon) == 0 else "Valid Geometry"


def _clip(triangle: list[tuple[float, float]], by: list[tuple[float, float]]) -> float:
    """Area that two counter-clockwise triangles share; numbers of Python, as arrays of three points cost more than they save."""
    out = triangle
    for k in range(3):
        (ax, ay), (bx, by_) = by[k], by[(k + 1) % 3]
        dx, dy = bx - ax, by_ - ay
        side = [dx * (y - ay) - dy * (x - ax) for x, y in out]
        kept = []
        (px, py), sp = out[-1], side[-1]
        for (qx, qy), sq in zip(out, side):
            if sp * sq < 0:
                at = sp / (sp - sq)
                kept.append((px + (qx - px) * at, py + (qy - py) * at))
            if sq >= 0:
                kept.append((qx, qy))
            px, py, sp = qx, qy, sq
        if len(kept) < 3:
            return 0.0
        out = kept
    twice = 0.0
    for (px, py), (qx, qy) in zip(out, [*out[1:], out[0]]):
        twice += px * qy - qx * py
    return abs(twice) / 2


def _fan(polygon: Polygon, origin: np.ndarray) -> list[tuple[int, list[tuple[float, float]]]]:
    """Signed counter-clockwise triangles that add up to the polygon."""
    out, o = [], tuple(origin.tolist())
    for k, r in enumerate(polygon):
        sign = (1 if signed_area(r) >= 0 else -1) * (1 if k == 0 else -1)
        points = [*map(tuple, r.tolist())]
        for p, q in zip(points, points[1:]):
            t = [o, p, q]
            a = (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
            if a:
                out.append((sign, t) if a > 0 else (-sign, t[::-1]))
    return out


def intersection_area(a: Polygon, b: Polygon) -> float:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = bounds(a), bounds(b)
    if ax1 > bx2 or bx1 > ax2 or ay1 > by2 or by1 > ay2:
        return 0.0
    fan_a, fan_b = _fan(a, a[0][0]), _fan(b, b[0][0])
    return max(0.0, sum(s * t * _clip(x, y) for s, x in fan_a for t, y in fan_b))


def iou(a: Polygon, b: Polygon) -> float:
    inter = intersection_area(a, b)
    union = area(a) + area(b) - inter
    return min(1.0, inter / union) if union > 0 else 0.0


def intersects(a: Polygon, b: Polygon) -> bool:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = bounds(a), bounds(b)
    if ax1 > bx2 or bx1 > ax2 or ay1 > by2 or by1 > ay2:
        return False
    return any(_crossings(r, s).any() for r in a for s in b) or inside(*a[0][0], b) or inside(*b[0][0], a) or intersection_area(a, b) > 0


def contains(a: Polygon, b: Polygon, tolerance: float = 1e-9) -> bool:
    whole = area(b)
    return whole > 0 and intersection_area(a, b) >= whole * (1 - tolerance)


def buffer_point(x: float, y: float, radius: float, quarter: int = 16) -> Polygon:
    """The polygon of 4 * ``quarter`` sides around a point."""
    turn = np.linspace(0, -2 * np.pi, 4 * quarter + 1)
    ring = np.stack([x + radius * np.cos(turn), y + radius * np.sin(turn)], axis=1)
    ring[-1] = ring[0]
    return [ring]


def mended(polygon: Polygon) -> Polygon:
    """Without repeated points and with closed rings; a bow-tie of four points becomes its larger triangle."""
    out = []
    for r in polygon:
        r = r[np.r_[True, (np.diff(r, axis=0) != 0).any(axis=1)]]
        if not np.array_equal(r[0], r[-1]):
            r = np.r_[r, r[:1]]
        if len(r) == 5 and _crossings(r, r).any():
            a, b, c, d = r[:-1]
            first = _crossings(np.array([a, b]), np.array([c, d])).any()
            p, q, s, t = (a, b, c, d) if first else (b, c, d, a)
            u, v = q - p, t - s
            k = ((s[0] - p[0]) * v[1] - (s[1] - p[1]) * v[0]) / (u[0] * v[1] - u[1] * v[0])
            x = p + k * u
            tris = [np.array([x, q, s, x]), np.array([x, t, p, x])]
            r = max(tris, key=lambda z: abs(signed_area(z)))
        out.append(r)
    return out


# ------------------------------------------------------------------ column functions


@F.pandas_udf(T.DoubleType())
def st_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two WKT polygons; put a box test before it."""
    return pd.Series([None if x is None or y is None else iou(rings(from_wkt(x)[1]), rings(from_wkt(y)[1])) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def st_area(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else area(rings(from_wkt(x)[1])) for x in a], dtype="float64")


@F.pandas_udf(T.StringType())
def st_reason(a: pd.Series) -> pd.Series:
    return pd.Series([reason(None if x is None else rings(from_wkt(x)[1])) for x in a])
