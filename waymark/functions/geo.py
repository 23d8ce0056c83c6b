"""Spherical geometry and map tiles as column expressions. Coordinates are degrees, lengths metres.

Scalar expressions stay inside whole-stage code; the ones over vertex arrays are meant for a projection of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
WINDOW_M = 20.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t))


def haversine_atan2_m(lon1, lat1, lon2, lat2) -> Column:
    """The same distance by the other inverse, which keeps its digits for points opposite each other."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing, clockwise from north, in [0, 360)."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lon, lat, bearing, metres) -> tuple[Column, Column]:
    """The point reached from (lon, lat) after so many metres on an initial bearing."""
    lon, lat, bearing, metres = map(_c, (lon, lat, bearing, metres))
    d, b, p = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    step = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(F.radians(lon) + step), F.degrees(q)


def on_edge(lon, lat, ax, ay, bx, by) -> tuple[Column, Column, Column]:
    """(t, x, y) of the nearest point of an edge, in the plane scaled by the cosine of its middle latitude."""
    cos = F.cos(F.radians((ay + by) / 2))
    dx, dy = (bx - ax) * cos, by - ay
    square = dx * dx + dy * dy
    t = F.when(square < 1e-20, 0.0).otherwise(F.least(F.greatest(((lon - ax) * cos * dx + (lat - ay) * dy) / square, F.lit(0.0)), F.lit(1.0)))
    return t, ax + t * (bx - ax), ay + t * (by - ay)


def edges_of(geometry: Column) -> Column:
    """array of (ax, ay, bx, by, len) of a vertex array; empty for fewer than two."""
    n = F.size(geometry)
    pair = lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by"), haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]).alias("len"))
    return F.when(n >= 2, F.zip_with(F.slice(geometry, F.lit(1), n - 1), F.slice(geometry, F.lit(2), n - 1), pair)).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double,len:double>>"))


def polyline_length_m(geometry: Column) -> Column:
    return F.aggregate(edges_of(geometry), F.lit(0.0), lambda s, e: s + e["len"])


def interpolate_on(edges: Column, last: Column, offset: Column) -> Column:
    """struct(lon, lat) so many metres along an array of edges; `last` for beyond the end."""
    start = F.struct(_c(offset).cast("double").alias("rem"), last["lon"].alias("lon"), last["lat"].alias("lat"), F.lit(False).alias("done"))

    def step(s, e):
        here = ~s["done"] & ((s["rem"] <= e["len"]) | (e["len"] < 1e-12))
        t = F.when(e["len"] > 0, F.least(F.greatest(s["rem"] / e["len"], F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.struct(
            F.when(s["done"] | here, s["rem"]).otherwise(s["rem"] - e["len"]).alias("rem"),
            F.when(here, e["ax"] + t * (e["bx"] - e["ax"])).otherwise(s["lon"]).alias("lon"),
            F.when(here, e["ay"] + t * (e["by"] - e["ay"])).otherwise(s["lat"]).alias("lat"),
            (s["done"] | here).alias("done"),
        )

    return F.aggregate(edges, start, step, lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))


def interpolate(geometry: Column, offset: Column) -> Column:
    """struct(lon, lat) so many metres along; the last vertex beyond the end."""
    return interpolate_on(edges_of(geometry), F.element_at(geometry, -1), offset)


def with_bearing(df: DataFrame, geometry: str, offset: Column, forward: Column, name: str, window: float = WINDOW_M) -> DataFrame:
    """Adds the bearing over a window ahead of an offset, or behind it and looking back. A window of no length takes the whole
    line. Every array is walked in a projection of its own, once, and the generator at the end keeps filters from undoing that."""
    g = F.col(geometry)
    out = df.withColumn("_fw", forward).withColumn("_edges", edges_of(g)).withColumn("_total", F.aggregate("_edges", F.lit(0.0), lambda s, e: s + e["len"]))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.col("_total"))
    out = out.withColumn("_at", _c(offset).cast("double"))
    out = out.withColumn("_p", interpolate_on(F.col("_edges"), F.element_at(g, -1), clamp(F.col("_at"))))
    out = out.withColumn("_q", interpolate_on(F.col("_edges"), F.element_at(g, -1), clamp(F.when(F.col("_fw"), F.col("_at") + window).otherwise(F.col("_at") - window))))
    flat = F.hypot(F.col("_p.lon") - F.col("_q.lon"), F.col("_p.lat") - F.col("_q.lat")) < 1e-12
    first, last = F.element_at(g, 1), F.element_at(g, -1)
    out = out.withColumn("_a", F.when(flat, F.when(F.col("_fw"), first).otherwise(last)).otherwise(F.col("_p"))).withColumn("_b", F.when(flat, F.when(F.col("_fw"), last).otherwise(first)).otherwise(F.col("_q")))
    value = F.when(F.size(g) < 2, 0.0).otherwise(bearing_deg(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat")))
    return out.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def tile_x(lon: Column, z: int) -> Column:
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * float(1 << z)), F.lit(0)), F.lit((1 << z) - 1)).cast("long")


def tile_y(lat: Column, z: int) -> Column:
    y = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * float(1 << z))
    return F.least(F.greatest(y, F.lit(0)), F.lit((1 << z) - 1)).cast("long")


def tile_west(x: Column, z: int) -> Column:
    return x / float(1 << z) * 360.0 - 180.0


def tile_north(y: Column, z: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / float(1 << z)))))


def tile_neighbours(x: Column, y: Column, z: int) -> Column:
    """array of (x, y): the tile and those around it that exist."""
    top = (1 << z) - 1
    grid = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dy: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dx: F.struct((x + dx).alias("x"), (y + dy).alias("y")))))
    return F.filter(grid, lambda t: t["x"].between(0, top) & t["y"].between(0, top))


def hilbert_id(z: int, x: Column, y: Column) -> Column:
    """Number of a tile along the Hilbert curves of all zooms: those of smaller zooms first."""
    before = sum(1 << (2 * k) for k in range(z))
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s, level):
        side = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        rx = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0)
        ry = F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        d = s["d"] + side * side * (3 * rx).bitwiseXOR(ry)
        turn = ry == 0
        flip = lambda v: F.when(turn & (rx == 1), side - 1 - v.bitwiseAND(side - 1)).otherwise(v.bitwiseAND(side - 1))
        fx, fy = flip(s["x"]), flip(s["y"])
        return F.struct(d.alias("d"), F.when(turn, fy).otherwise(fx).alias("x"), F.when(turn, fx).otherwise(fy).alias("y"))

    levels = F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)) if z > 0 else F.array().cast("array<int>")
    return F.aggregate(levels, start, step, lambda s: s["d"] + before)


def circle_polygon(lon, lat, metres, steps: int = 64) -> Column:
    """Closed ring of points at one distance."""

    def at(i):
        x, y = destination(lon, lat, i * (360.0 / steps), metres)
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def cone_polygon(lon, lat, lb, ub, metres, steps: int = 48, least_sweep: float = 2.0) -> Column:
    """Centre, arc from one bearing to the other, centre; a narrow cone is opened to `least_sweep` degrees."""
    sweep = F.pmod(_c(ub) - _c(lb), F.lit(360.0))
    middle, half = _c(lb) + sweep / 2, F.greatest(sweep, F.lit(least_sweep)) / 2

    def at(i):
        x, y = destination(lon, lat, middle - half + 2 * half * i / steps, metres)
        return F.struct(x.alias("lon"), y.alias("lat"))

    centre = F.array(F.struct(_c(lon).alias("lon"), _c(lat).alias("lat")))
    return F.concat(centre, F.transform(F.sequence(F.lit(0), F.lit(steps)), at), centre)
