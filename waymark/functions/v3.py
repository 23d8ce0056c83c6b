"""The compact binary format, version 3: strings to typed rows and back, as column expressions over hex digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
SECTOR_DEG, BUCKET_M, UNIT = 360.0 / 32, 15_000.0 / 256, 16_777_216.0
ORIENTATION = ("NoOrientation", "FirstTowardSecond", "SecondTowardFirst", "Both")
SIDE = ("OnRoadOrUnknown", "Right", "Left", "Both")
LRP = "struct<lon:double,lat:double,frc:int,fow:int,lfrcnp:int,bearing_lb:double,bearing_ub:double,dnp_lb:double,dnp_ub:double,pos_offset_raw:int,neg_offset_raw:int>"


def with_bytes(df: DataFrame, binary: str, name: str = "bytes") -> DataFrame:
    """Adds the bytes of a binary as array<int>, null for null; all readers below take that column. The generator keeps it a
    column of its own, so that expressions over it stay small."""
    h = F.hex(binary)
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(binary) - 1), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    value = F.when(F.octet_length(binary) > 0, codes).otherwise(F.when(F.col(binary).isNotNull(), F.array().cast("array<int>")))
    return df.withColumn("_h", F.array(F.struct(value.alias("v")))).select("*", F.explode("_h").alias("_x")).select(*[c for c in df.columns if c != name], F.col("_x.v").alias(name))


def apart(df: DataFrame, *names: str) -> DataFrame:
    """Keeps computed columns from being computed again inside what is built on them."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_x")).select(*rest, *[F.col(f"_x.{c}").alias(c) for c in names])


def worked_out(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def byte(b: Column, i) -> Column:
    """Byte i (from 0); null beyond the end."""
    return F.get(b, F.lit(i) if isinstance(i, int) else i)


def absolute(b: Column, i) -> Column:
    """Signed 24 bits to degrees."""
    u = byte(b, i) * 65536 + byte(b, i + 1) * 256 + byte(b, i + 2)
    n = F.when(u >= 1 << 23, u - (1 << 24)).otherwise(u)
    return (n - F.signum(n) * 0.5) * 360.0 / UNIT


def relative(b: Column, i, before: Column) -> Column:
    """Signed 16 bits of 1e-5 degrees, added to the previous coordinate."""
    u = byte(b, i) * 256 + byte(b, i + 1)
    return before + F.when(u >= 1 << 15, u - (1 << 16)).otherwise(u) / 100_000.0


def point(lon, lat, attr, path, dnp, first=False, sector=None, pos=None, neg=None) -> Column:
    """One location reference point from its attribute bytes."""
    s = (path if sector is None else sector).bitwiseAND(F.lit(31))
    null = F.lit(None).cast("int")
    return F.struct(
        lon.alias("lon"), lat.alias("lat"), F.shiftright(attr, 3).bitwiseAND(F.lit(7)).alias("frc"), attr.bitwiseAND(F.lit(7)).alias("fow"),
        (null if path is None or dnp is None else F.shiftright(path, 5).bitwiseAND(F.lit(7))).alias("lfrcnp"),
        (s * SECTOR_DEG).alias("bearing_lb"), ((s + 1) * SECTOR_DEG).alias("bearing_ub"),
        (F.lit(None).cast("double") if dnp is None else dnp * BUCKET_M).alias("dnp_lb"), (F.lit(None).cast("double") if dnp is None else (dnp + 1) * BUCKET_M).alias("dnp_ub"),
        (null if pos is None else pos).alias("pos_offset_raw"), (null if neg is None else neg).alias("neg_offset_raw"),
    )


def location_type(b: Column) -> Column:
    """From the status byte and, where two types share it, the length."""
    n, s = F.size(b), byte(b, 0)
    area = F.shiftright(s.bitwiseAND(F.lit(0x40)), 5) + F.shiftright(s.bitwiseAND(F.lit(0x10)), 4)
    spot, attr = s.bitwiseAND(F.lit(0x20)) != 0, s.bitwiseAND(F.lit(0x08)) != 0
    return (
        F.when((n < 7) | (s.bitwiseAND(F.lit(7)) != 3), None)
        .when((area == 0) & ~spot & attr, "Line").when((area == 0) & ~spot, "Circle")
        .when((area == 0) & spot & ~attr, "GeoCoordinate").when((area == 0) & spot & (n >= 22), "PoiWithAccessPoint").when((area == 0) & spot, "PointAlongLine")
        .when((area == 1) & ~spot, "Polygon").when((area == 2) & ~spot & (n >= 15), "Grid").when((area == 2) & ~spot, "Rectangle")
        .when((area == 3) & ~spot & attr, "ClosedLine")
    )


def error_code(b: Column) -> Column:
    """Why a binary can't be read; null where it can."""
    return worked_out(location_type(b), lambda kind: _error_of(b, kind))


def _error_of(b: Column, kind: Column) -> Column:
    n, s = F.size(b), byte(b, 0)
    last4 = byte(b, F.floor(n / 7).cast("int") * 7 + F.lit(1))
    asked = F.shiftright(last4.bitwiseAND(F.lit(0x40)), 6) + F.shiftright(last4.bitwiseAND(F.lit(0x20)), 5)
    return (
        F.when(b.isNull(), "Base64").when(n < 7, "TooShort").when(s.bitwiseAND(F.lit(7)) != 3, "InvalidHeader").when(kind.isNull(), "InvalidHeader")
        .when((kind == "Line") & (n < 16), "TooShort").when((kind == "Line") & ((n - 16) % 7 > 2), "TrailingBytes").when((kind == "Line") & (asked > (n - 16) % 7), "TooShort")
        .when((kind == "PointAlongLine") & (n < 16), "TooShort").when((kind == "PointAlongLine") & (n > 17), "TrailingBytes").when((kind == "PoiWithAccessPoint") & (n > 23), "TrailingBytes")
        .when((kind == "ClosedLine") & (n < 12), "TooShort").when((kind == "ClosedLine") & ((n - 12) % 7 != 0), "TrailingBytes")
        .when((kind == "GeoCoordinate") & (n != 7), "TooShort").when((kind == "Circle") & (n < 10), "TooShort")
        .when(kind.isin("Rectangle", "Grid") & (n < 13), "TooShort")
        .when((kind == "Polygon") & (n < 19), "TooShort").when((kind == "Polygon") & ((n - 1) % 6 != 0), "TrailingBytes")
    )


def middle_points(b: Column, first: Column, count: Column) -> Column:
    """The first point and `count` more of seven bytes each from byte 10, every one relative to the one before."""

    def step(done, k):
        at, last = 10 + 7 * k, F.element_at(done, -1)
        return F.concat(done, F.array(point(relative(b, at, last["lon"]), relative(b, at + 2, last["lat"]), byte(b, at + 4), byte(b, at + 5), byte(b, at + 6))))

    return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), F.array(first).cast(f"array<{LRP}>"), lambda a, k: step(a, k).cast(f"array<{LRP}>"))).otherwise(F.array(first).cast(f"array<{LRP}>"))


def lrps(b: Column) -> Column:
    """array of points of the types that have them, else null. Rows with an error_code give null."""
    n = F.size(b)
    first = point(absolute(b, 1), absolute(b, 4), byte(b, 7), byte(b, 8), byte(b, 9))
    count = F.floor(n / 7).cast("int") - 2
    at = 10 + 7 * count
    flags = byte(b, at + 5)
    has_pos, has_neg = flags.bitwiseAND(F.lit(0x40)) != 0, flags.bitwiseAND(F.lit(0x20)) != 0

    def whole(body: Column) -> Column:
        last = F.element_at(body, -1)
        end = point(relative(b, at, last["lon"]), relative(b, at + 2, last["lat"]), byte(b, at + 4), None, None, sector=flags, neg=F.when(has_neg, byte(b, at + 6 + has_pos.cast("int"))))
        head = F.transform(body, lambda p, i: p.withField("pos_offset_raw", F.when((i == 0) & has_pos, byte(b, at + 6))))
        return F.concat(head.cast(f"array<{LRP}>"), F.array(end).cast(f"array<{LRP}>"))

    line = worked_out(middle_points(b, first, count), whole)
    spot_pos = F.when(n.isin(17, 23), byte(b, n - 1))
    spot = F.array(
        point(absolute(b, 1), absolute(b, 4), byte(b, 7), byte(b, 8), byte(b, 9), pos=spot_pos).cast(LRP),
        point(relative(b, 10, absolute(b, 1)), relative(b, 12, absolute(b, 4)), byte(b, 14), None, None, sector=byte(b, 15)).cast(LRP),
    )
    inner = F.floor((n - 12) / 7).cast("int")
    ring = F.concat(middle_points(b, first, inner), F.array(point(absolute(b, 1), absolute(b, 4), byte(b, 10 + 7 * inner), None, None, sector=byte(b, 11 + 7 * inner))).cast(f"array<{LRP}>"))
    read = lambda x: F.when(x["error"].isNotNull(), None).when(x["kind"] == "Line", line).when(x["kind"].isin("PointAlongLine", "PoiWithAccessPoint"), spot).when(x["kind"] == "ClosedLine", ring)
    return worked_out(F.struct(location_type(b).alias("kind"), error_code(b).alias("error")), read)


def coordinates(b: Column) -> Column:
    """array of (lon, lat) of the shapes: point, centre, corners, vertices; null for types with location reference points."""
    kind = location_type(b)
    at = lambda i: F.struct(absolute(b, i).alias("lon"), absolute(b, i + 3).alias("lat"))
    ring = F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / 6).cast("int") - 1), lambda k: at(1 + 6 * k))
    return F.when(error_code(b).isNotNull(), None).when(kind.isin("GeoCoordinate", "Circle"), F.array(at(1))).when(kind.isin("Rectangle", "Grid"), F.array(at(1), at(7))).when(kind == "Polygon", ring)


def radius_m(b: Column) -> Column:
    return F.when(location_type(b) == "Circle", byte(b, 7) * 65536 + byte(b, 8) * 256 + byte(b, 9))


def grid_size(b: Column) -> tuple[Column, Column]:
    grid = location_type(b) == "Grid"
    return F.when(grid, byte(b, 13) + 1), F.when(grid, byte(b, 14) + 1)


def named(names: tuple[str, ...], code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), code + 1)


def orientation(b: Column) -> Column:
    return F.when(location_type(b).isin("PointAlongLine", "PoiWithAccessPoint"), named(ORIENTATION, F.shiftright(byte(b, 7), 6)))


def side_of_road(b: Column) -> Column:
    return F.when(location_type(b).isin("PointAlongLine", "PoiWithAccessPoint"), named(SIDE, F.shiftright(byte(b, 14), 6)))


# writing


def bytes_of(n: Column, count: int) -> Column:
    """The lowest `count` bytes of an integer."""
    return F.unhex(F.lpad(F.right(F.hex(n.cast("long")), F.lit(2 * count)), 2 * count, "0"))


def absolute_bytes(deg: Column) -> Column:
    i = F.round(F.signum(deg) * 0.5 + deg * (UNIT / 360.0))
    return bytes_of(F.least(F.greatest(i, F.lit(-8_388_608.0)), F.lit(8_388_607.0)), 3)


def relative_bytes(deg: Column, before: Column) -> Column:
    return bytes_of(F.least(F.greatest(F.round((deg - before) * 100_000.0), F.lit(-32_768.0)), F.lit(32_767.0)), 2)


def sector(deg: Column) -> Column:
    return F.least(F.greatest(F.floor(deg / SECTOR_DEG), F.lit(0)), F.lit(31)).cast("int")


def bucket(metres: Column) -> Column:
    return F.least(F.greatest(F.floor(metres / BUCKET_M), F.lit(0)), F.lit(255)).cast("int")


def offset_byte(offset: Column, leg: Column) -> Column:
    """The 256th of the leg that an offset falls into; null where it isn't within the leg."""
    return F.when((leg > 0) & (offset >= 0) & (offset < leg), F.least(F.floor(offset / leg * 256), F.lit(255)).cast("int"))


def encode_line(points: Column, pos_offset: Column | None = None, neg_offset: Column | None = None) -> Column:
    """Binary of a line from its array of points; null for fewer than two, a missing attribute or an offset beyond its leg."""
    n = F.size(points)
    p = lambda k: F.element_at(points, k)
    first, last, before = p(1), p(-1), p(-2)
    attr = lambda x: bytes_of(x["frc"].bitwiseAND(F.lit(7)) * 8 + x["fow"].bitwiseAND(F.lit(7)), 1)
    way = lambda x: F.concat(attr(x), bytes_of(x["lfrcnp"].bitwiseAND(F.lit(7)) * 32 + sector(x["bearing_lb"]), 1), bytes_of(bucket(x["dnp_lb"]), 1))
    step = lambda x, y: F.concat(relative_bytes(x["lon"], y["lon"]), relative_bytes(x["lat"], y["lat"]))
    middle = F.when(n > 2, F.aggregate(F.sequence(F.lit(2), n - 1), F.lit(b""), lambda a, k: F.concat(a, step(p(k), p(k - 1)), way(p(k))))).otherwise(F.lit(b""))
    none = F.lit(None).cast("double")
    pos, neg = (none if x is None else x for x in (pos_offset, neg_offset))
    tail = F.concat(
        F.when(pos.isNull(), F.lit(b"")).otherwise(bytes_of(offset_byte(pos, first["dnp_lb"]), 1)), F.when(neg.isNull(), F.lit(b"")).otherwise(bytes_of(offset_byte(neg, before["dnp_lb"]), 1))
    )
    flags = pos.isNotNull().cast("int") * 64 + neg.isNotNull().cast("int") * 32 + sector(last["bearing_lb"])
    return F.when(n >= 2, F.concat(F.lit(b"\x0b"), absolute_bytes(first["lon"]), absolute_bytes(first["lat"]), way(first), middle, step(last, before), attr(last), bytes_of(flags, 1), tail))


def encode_point_along_line(points: Column, orientation_code: Column, side_code: Column, pos_offset: Column | None = None) -> Column:
    first, last = F.element_at(points, 1), F.element_at(points, 2)
    attr = lambda x, high: bytes_of(high * 64 + x["frc"].bitwiseAND(F.lit(7)) * 8 + x["fow"].bitwiseAND(F.lit(7)), 1)
    tail = F.lit(b"") if pos_offset is None else F.when(pos_offset.isNull(), F.lit(b"")).otherwise(bytes_of(offset_byte(pos_offset, first["dnp_lb"]), 1))
    return F.when(
        F.size(points) == 2,
        F.concat(
            F.lit(b"\x2b"), absolute_bytes(first["lon"]), absolute_bytes(first["lat"]), attr(first, orientation_code),
            bytes_of(first["lfrcnp"].bitwiseAND(F.lit(7)) * 32 + sector(first["bearing_lb"]), 1), bytes_of(bucket(first["dnp_lb"]), 1),
            relative_bytes(last["lon"], first["lon"]), relative_bytes(last["lat"], first["lat"]), attr(last, side_code), bytes_of(sector(last["bearing_lb"]), 1), tail,
        ),
    )
