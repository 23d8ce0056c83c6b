"""Queries over the formats: references made from the walks are written as strings, told apart, read back and checked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tpeg, v3
from waymark.plans import fixtures as fx
from waymark.plans.fixture_sql import WALKS
from waymark.plans.network_queries import net
from waymark.plans.registry import query

R6 = lambda c: F.round(c, 6)

#: Published example strings of the two formats.
VECTORS = {
    "V1": "C/+zGCZJgyuvBAAh/x8rHw==",
    "V2": "C/7VOCaEbSu/BP+5AMUrbJEQ",
    "V3": "C/4bnSaa4yu5Af91ACAruQT+r/+9Kwc=",
    "V4": "CwV1BCHeEDv1BQEj/3s7WiY=",
    "V5": "CwV/ECHkoiORC//N/bIjjRYD+fy+I44FAAv+0yOOAwAL/2cbcn3flfluGwM=",
    "V6": "CwV+1CJROzbLCf8gARozDg==",
    "V7": "CwV0fiHP2iupDwRE/tYrqgr/6v50KyIf",
    "P1": "0829011000252404121724D5C800090504060321000A050406825F00FFF300030009050406030B00300F77",
    "P2": "08510110004D4C083CE62242730009050401023E000A0504018567000148F9A1000905040102FC007002038EFF1900090504010257000A05040198480006E7F7D400090504010258000A0504018F3100834655",
    "P3": "CCsBEAInJgHY7yKlnwAJBQQBAnwACgUEAYYXAACs/TMACQUEAQL8AAAAQIMc",
}


# detection


def looks_base64(s: Column) -> Column:
    return (s.rlike("^[A-Za-z0-9_-]*$") & (F.length(s) % 4 == 0)) | s.rlike("[+/=]")


def detect(df: DataFrame, ref: str) -> DataFrame:
    """Adds format: 'v3', 'tpeg' or null; base64 first if it looks like it, then hex, then base64 after all."""
    s = F.col(ref)
    d = df.withColumn("_b64", F.try_to_binary(s, F.lit("base64"))).withColumn("_hex", F.try_to_binary(s, F.lit("hex")))
    d = v3.with_bytes(v3.with_bytes(d, "_b64", "_b"), "_hex", "_h16")
    b, h = F.col("_b"), F.col("_h16")
    is_v3 = b.isNotNull() & v3.error_code(b).isNull()
    is_tpeg = lambda x: F.coalesce((F.size(x) >= 7) & (F.get(x, F.lit(0)) == 8) & (F.size(x) == F.get(x, F.lit(1)) + 2) & F.get(x, F.lit(4)).isin(0, 2), F.lit(False))
    kind = F.when(looks_base64(s) & is_v3, "v3").when(looks_base64(s) & is_tpeg(b), "tpeg").when(is_tpeg(h), "tpeg").when(is_v3, "v3")
    return d.withColumn("format", kind).drop("_b64", "_hex", "_b", "_h16")


def vectors(spark) -> DataFrame:
    return spark.createDataFrame(sorted(VECTORS.items()), "vec_id string, ref string")


@query("s1_detect_format", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{'v3' if k[0] == 'V' else 'tpeg'}')" for k in VECTORS) + ") AS t(vec_id, format)")
def s1_detect_format(spark, sf):
    return detect(vectors(spark), "ref").select("vec_id", "format")


@query("s2_base64_heuristic", "SELECT doc_id, count(*) AS n_words, count(*) FILTER ((regexp_full_match(s, '[A-Za-z0-9_-]*') AND length(s) % 4 = 0) OR regexp_matches(s, '[+/=]')) AS n_look FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS s FROM documents) GROUP BY doc_id")
def s2_base64_heuristic(spark, sf):
    """How many of a text's words would be tried as base64."""
    w = fx.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("s"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count(F.when(looks_base64(F.col("s")), 1)).alias("n_look"))


# lines from walks: each walk's ends as two points

LINES = """
ends AS (SELECT w.ref_id, min(w.step) AS a, max(w.step) AS b FROM walks w GROUP BY ALL),
lines AS (SELECT e.ref_id, f.x0 AS lon0, f.y0 AS lat0, f.frc AS frc0, f.fow AS fow0, l.x1 AS lon1, l.y1 AS lat1, l.frc AS frc1, l.fow AS fow1,
  CAST(e.ref_id%8 AS INTEGER) AS lfrcnp, CAST(e.ref_id%32 AS INTEGER) AS sector0, CAST(e.ref_id//32%32 AS INTEGER) AS sector1, CAST(e.ref_id%256 AS INTEGER) AS dnp
  FROM ends e JOIN walks wa ON wa.ref_id=e.ref_id AND wa.step=e.a JOIN walks wb ON wb.ref_id=e.ref_id AND wb.step=e.b JOIN segments f ON f.segment_id=wa.segment_id JOIN segments l ON l.segment_id=wb.segment_id),
ints AS (SELECT *, CAST(round(sign(lon0)*0.5+lon0*(16777216.0/360.0)) AS BIGINT) AS ix, CAST(round(sign(lat0)*0.5+lat0*(16777216.0/360.0)) AS BIGINT) AS iy,
  CAST(round((lon1-lon0)*100000.0) AS BIGINT) AS dx, CAST(round((lat1-lat0)*100000.0) AS BIGINT) AS dy FROM lines),
bytes AS (SELECT *, '0B' || printf('%06X', ix & 16777215) || printf('%06X', iy & 16777215) || printf('%02X', frc0*8+fow0) || printf('%02X', lfrcnp*32+sector0) || printf('%02X', dnp) || printf('%04X', dx & 65535) || printf('%04X', dy & 65535) || printf('%02X', frc1*8+fow1) || printf('%02X', sector1) AS hex FROM ints)
"""


def lines(spark, sf) -> DataFrame:
    """ref_id, points: the first and the last vertex of each walk."""
    w = fx.walks(spark, sf).join(fx.segments(spark, sf).select("segment_id", "geometry", "frc", "fow"), "segment_id")
    ends = w.groupBy("ref_id").agg(F.min_by(F.struct("geometry", "frc", "fow"), "step").alias("f"), F.max_by(F.struct("geometry", "frc", "fow"), "step").alias("l"))
    r = F.col("ref_id")
    s0, s1, d = (r % 32).cast("double") * v3.SECTOR_DEG, (F.expr("ref_id div 32") % 32).cast("double") * v3.SECTOR_DEG, (r % 256).cast("double") * v3.BUCKET_M
    a, b = F.element_at("f.geometry", 1), F.element_at("l.geometry", -1)
    null = F.lit(None)
    lrp = lambda p, side, lf, s, dn: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), F.col(f"{side}.frc").alias("frc"), F.col(f"{side}.fow").alias("fow"), lf.cast("int").alias("lfrcnp"), s.alias("bearing_lb"), (s + v3.SECTOR_DEG).alias("bearing_ub"), dn.cast("double").alias("dnp_lb"), (dn + v3.BUCKET_M).cast("double").alias("dnp_ub"), null.cast("int").alias("pos_offset_raw"), null.cast("int").alias("neg_offset_raw"))
    return v3.apart(ends.select("ref_id", F.array(lrp(a, "f", r % 8, s0, d), lrp(b, "l", null, s1, null)).alias("points")), "points")


@query("c17_encode_line", net("SELECT ref_id, to_base64(unhex(hex)) AS ref FROM bytes", WALKS, LINES))
def c17_encode_line(spark, sf):
    return lines(spark, sf).select("ref_id", F.base64(v3.encode_line(F.col("points"))).alias("ref"))


def read_lines(spark, sf) -> DataFrame:
    return v3.with_bytes(c17_encode_line(spark, sf).select("ref_id", F.unbase64("ref").alias("raw")), "raw", "b").select("ref_id", "b")


BYTE = lambda k: f"CAST(('0x' || substr(hex, {2 * k + 1}, 2)) AS INTEGER)"


@query(
    "c2_decode_line",
    net(
        f"""SELECT ref_id, lrp_idx, round(lon, 6) AS lon, round(lat, 6) AS lat, frc, fow, lfrcnp, bearing_lb, dnp_lb FROM (
        SELECT ref_id, CAST(0 AS INTEGER) AS lrp_idx, (ix-sign(ix)*0.5)*360.0/16777216.0 AS lon, (iy-sign(iy)*0.5)*360.0/16777216.0 AS lat, {BYTE(7)}>>3&7 AS frc, {BYTE(7)}&7 AS fow, {BYTE(8)}>>5&7 AS lfrcnp, CAST(({BYTE(8)}&31)*11.25 AS DOUBLE) AS bearing_lb, CAST({BYTE(9)}*58.59375 AS DOUBLE) AS dnp_lb FROM bytes
        UNION ALL SELECT ref_id, 1, (ix-sign(ix)*0.5)*360.0/16777216.0+dx/100000.0, (iy-sign(iy)*0.5)*360.0/16777216.0+dy/100000.0, {BYTE(14)}>>3&7, {BYTE(14)}&7, NULL, CAST(({BYTE(15)}&31)*11.25 AS DOUBLE), NULL FROM bytes)""",
        WALKS,
        LINES,
    ),
)
def c2_decode_line(spark, sf):
    b = read_lines(spark, sf)
    p = b.select("ref_id", F.posexplode(v3.lrps(F.col("b"))).alias("lrp_idx", "p"))
    return p.select("ref_id", "lrp_idx", R6(F.col("p.lon")).alias("lon"), R6(F.col("p.lat")).alias("lat"), "p.frc", "p.fow", "p.lfrcnp", "p.bearing_lb", "p.dnp_lb")


@query("c1_location_type", net("SELECT ref_id, 'Line' AS location_type, CAST(NULL AS VARCHAR) AS error_code FROM bytes", WALKS, LINES))
def c1_location_type(spark, sf):
    b = read_lines(spark, sf)
    return b.select("ref_id", v3.location_type(F.col("b")).alias("location_type"), v3.error_code(F.col("b")).alias("error_code"))


EVENT_HEX = "lpad(to_hex(event_id*2654435761 % 16777216), 6, '0')"


@query(
    "c8_coordinates",
    "SELECT event_id, round((i - sign(i)*0.5)*360.0/16777216.0, 6) AS lon, CAST(CASE WHEN r >= 32768 THEN r-65536 ELSE r END AS DOUBLE)/100000.0 AS step FROM (SELECT event_id, CASE WHEN u >= 8388608 THEN u-16777216 ELSE u END AS i, u % 65536 AS r FROM (SELECT event_id, event_id*2654435761 % 16777216 AS u FROM events))",
)
def c8_coordinates(spark, sf):
    u = (F.col("event_id") * 2_654_435_761) % 16_777_216
    b = v3.with_bytes(fx.table(spark, sf, "events").select("event_id", v3.bytes_of(u, 3).alias("raw")), "raw", "b")
    return b.select("event_id", R6(v3.absolute(F.col("b"), 0)).alias("lon"), v3.relative(F.col("b"), 1, F.lit(0.0)).alias("step"))


@query("c21_quantise", "SELECT event_id, CAST(least(greatest(floor(d/11.25),0),31) AS INTEGER) AS sector, CAST(least(greatest(floor(m/58.59375),0),255) AS INTEGER) AS bucket, CAST(CASE WHEN o < m THEN least(floor(o/m*256),255) END AS INTEGER) AS offset_byte FROM (SELECT event_id, CAST(event_id*7.3 AS DOUBLE) % 360 AS d, event_id%20000+1.0::DOUBLE AS m, (event_id*13%25000)::DOUBLE AS o FROM events)")
def c21_quantise(spark, sf):
    d, m, o = (F.col("event_id") * 7.3) % 360.0, F.col("event_id") % 20_000 + 1.0, (F.col("event_id") * 13 % 25_000).cast("double")
    return fx.table(spark, sf, "events").select("event_id", v3.sector(d).alias("sector"), v3.bucket(m).alias("bucket"), v3.offset_byte(o, m).alias("offset_byte"))


@query("c3_point_along_line")
def c3_point_along_line(spark, sf):
    """Points along lines written and read back: attributes, side and orientation survive."""
    p = lines(spark, sf)
    r = F.col("ref_id")
    b = p.select("ref_id", v3.encode_point_along_line(F.col("points"), (r % 4).cast("int"), (F.expr("ref_id div 4") % 4).cast("int")).alias("raw"))
    b, x = v3.with_bytes(b, "raw", "b"), F.col("b")
    return b.select("ref_id", F.base64("raw").alias("ref"), v3.location_type(x).alias("location_type"), v3.orientation(x).alias("orientation"), v3.side_of_road(x).alias("side_of_road"), F.size(v3.lrps(x)).alias("n_lrps"))


SHAPES = {"GeoCoordinate": "23", "Circle": "03", "Rectangle": "43", "Grid": "43", "Polygon": "13", "ClosedLine": "5B", "PoiWithAccessPoint": "2B"}


@query("c7_shapes")
def c7_shapes(spark, sf):
    """Shapes and closed lines from bytes that are made of the events: type, number of corners and points, radius, grid."""
    size = {"GeoCoordinate": 6, "Circle": 9, "Rectangle": 12, "Grid": 14, "Polygon": 18, "ClosedLine": 18, "PoiWithAccessPoint": 21}
    h = F.upper(F.md5(F.col("event_id").cast("string").cast("binary")))
    long = F.concat(h, h)
    kinds = F.array(*[F.struct(F.lit(k).alias("made_as"), F.concat(F.lit(SHAPES[k]), F.substring(long, 1, 2 * n)).alias("hex")) for k, n in size.items()])
    b = fx.table(spark, sf, "events").select("event_id", F.explode(kinds).alias("k")).select("event_id", "k.made_as", F.unhex("k.hex").alias("raw"))
    b, x = v3.with_bytes(b, "raw", "b"), F.col("b")
    cols, rows = v3.grid_size(x)
    return b.select("event_id", "made_as", v3.location_type(x).alias("location_type"), v3.error_code(x).alias("error_code"), F.size(v3.coordinates(x)).alias("n_corners"), F.size(v3.lrps(x)).alias("n_lrps"), v3.radius_m(x).alias("radius_m"), cols.alias("n_cols"), rows.alias("n_rows"))


# the variable-length format

POINT = "struct<lon:double,lat:double,frc:int,fow:int,lfrcnp:int,bearing_lb:double,bearing_ub:double,dnp_lb:double,dnp_ub:double>"
READ = f"ref_id long, location_type string, error_code string, pos_offset double, neg_offset double, points array<{POINT}>"


def decode_tpeg(refs: DataFrame) -> DataFrame:
    """ref_id, ref (hex or base64) to typed rows; a message that can't be read gives its error_code."""
    names = [f.split(":")[0] for f in POINT[7:-1].split(",")]
    kind = pa.list_(pa.struct([(n, pa.int32() if n in ("frc", "fow", "lfrcnp") else pa.float64()) for n in names]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    d = tpeg.decode_text(text or "")
                    out.append((d["location_type"], None, d["pos_offset"], d["neg_offset"], [{n: p.get(n) for n in names} for p in d["lrps"]]))
                except tpeg.Malformed as e:
                    out.append((None, str(e), None, None, None))
            t, e, p, n, l = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.string()), pa.array(e, pa.string()), pa.array(p, pa.float64()), pa.array(n, pa.float64()), pa.array(l, kind)], ["ref_id", "location_type", "error_code", "pos_offset", "neg_offset", "points"])

    return refs.select("ref_id", "ref").mapInArrow(rows, READ)


def encode_tpeg(refs: DataFrame) -> DataFrame:
    """ref_id, points to ref_id, ref (upper-case hex), error_code."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs_, errors = [], []
            for points in batch.column(1).to_pylist():
                try:
                    refs_.append(tpeg.encode("Line", points or []).hex().upper())
                    errors.append(None)
                except tpeg.Malformed as e:
                    refs_.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(refs_, pa.string()), pa.array(errors, pa.string())], ["ref_id", "ref", "error_code"])

    return refs.select("ref_id", "points").mapInArrow(rows, "ref_id long, ref string, error_code string")


@query(
    "c22_encode_tpeg",
    net(
        """SELECT ref_id, '08' || printf('%02X', 5+n) || '011000' || printf('%02X', n+1) || printf('%02X', n) || body AS ref FROM (SELECT *, length(body)//2 AS n FROM (SELECT ref_id,
        printf('%06X', ix & 16777215) || printf('%06X', iy & 16777215) || '00' || '090504' || printf('%02X', frc0) || printf('%02X', fow0) || printf('%02X', sector0*8) || '00' || '0A' || CASE WHEN v < 128 THEN '04' WHEN v < 16384 THEN '05' ELSE '06' END || '04' || printf('%02X', lfrcnp)
        || CASE WHEN v < 128 THEN printf('%02X', v) ELSE printf('%02X', (v>>7)|128) || printf('%02X', v&127) END || '00' || printf('%04X', dx & 65535) || printf('%04X', dy & 65535) || '00090504' || printf('%02X', frc1) || printf('%02X', fow1) || printf('%02X', sector1*8) || '0000' AS body
        FROM (SELECT *, CAST(round(dnp*58.59375) AS BIGINT) AS v FROM ints)))""",
        WALKS,
        LINES,
    ),
)
def c22_encode_tpeg(spark, sf):
    return encode_tpeg(lines(spark, sf)).select("ref_id", "ref")


@query("c12_decode_tpeg", net("SELECT ref_id, round((ix-sign(ix)*0.5)*360.0/16777216.0, 6) AS lon, round((iy-sign(iy)*0.5)*360.0/16777216.0, 6) AS lat, frc0 AS frc, fow0 AS fow, lfrcnp, round(dnp*58.59375)::DOUBLE AS dnp, round(sector0*11.25)::DOUBLE AS bearing_lb, round(sector0*11.25+1.40625)::DOUBLE AS bearing_ub FROM ints", WALKS, LINES))
def c12_decode_tpeg(spark, sf):
    p = F.element_at("points", 1)
    return decode_tpeg(c22_encode_tpeg(spark, sf)).select("ref_id", R6(p["lon"]).alias("lon"), R6(p["lat"]).alias("lat"), p["frc"].alias("frc"), p["fow"].alias("fow"), p["lfrcnp"].alias("lfrcnp"), p["dnp_lb"].alias("dnp"), p["bearing_lb"].alias("bearing_lb"), p["bearing_ub"].alias("bearing_ub"))


@query("c28_reference_summary", "SELECT * FROM (VALUES ('V1', 'Line', 2, FALSE, FALSE), ('V2', 'Line', 2, TRUE, TRUE), ('V3', 'Line', 3, FALSE, FALSE), ('V4', 'Line', 2, TRUE, FALSE), ('V5', 'Line', 6, FALSE, FALSE), ('V6', 'Line', 2, FALSE, FALSE), ('V7', 'Line', 3, FALSE, TRUE)) AS t(vec_id, location_type, n_lrps, has_pos, has_neg)")
def c28_reference_summary(spark, sf):
    """What the published strings hold, without decoding them on a map."""
    b = v3.with_bytes(vectors(spark).where("vec_id like 'V%'").select("vec_id", F.unbase64("ref").alias("raw")), "raw", "b")
    p = v3.apart(b.select("vec_id", v3.location_type(F.col("b")).alias("location_type"), v3.lrps(F.col("b")).alias("p")), "p")
    return p.select("vec_id", "location_type", F.size("p").alias("n_lrps"), F.element_at("p", 1)["pos_offset_raw"].isNotNull().alias("has_pos"), F.element_at("p", -1)["neg_offset_raw"].isNotNull().alias("has_neg"))


@query("s21_waypoint_text", "SELECT doc_id, TRY_CAST(split_part(w, ',', 1) AS DOUBLE) AS lon, TRY_CAST(split_part(w, ',', 2) AS DOUBLE) AS lat FROM (SELECT doc_id, (doc_id % 360 - 180)::VARCHAR || ',' || (doc_id % 180 - 90)::VARCHAR AS w FROM documents)")
def s21_waypoint_text(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat_ws(",", F.col("doc_id") % 360 - 180, F.col("doc_id") % 180 - 90).alias("text"))
    line = d.select("doc_id", F.explode(F.split("text", "\n")).alias("w")).where(F.trim("w") != "")
    part = lambda k: F.split_part("w", F.lit(","), F.lit(k)).try_cast("double")
    return line.select("doc_id", part(1).alias("lon"), part(2).alias("lat"))


#: Names of road classes and forms of way.
FRC_NAMES = ("Main road", "First class road", "Second class road", "Third class road", "Fourth class road", "Fifth class road", "Sixth class road", "Other class road")
FOW_NAMES = ("Undefined", "Motorway", "Multiple carriageway", "Single carriageway", "Roundabout", "Traffic square", "Slip road", "Other")


@query("l1_labels", net("SELECT segment_id, CASE frc " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FRC_NAMES)) + " END AS frc_name, CASE fow " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FOW_NAMES)) + " END AS fow_name FROM segments"))
def l1_labels(spark, sf):
    return fx.segments(spark, sf).select("segment_id", v3.named(FRC_NAMES, F.col("frc")).alias("frc_name"), v3.named(FOW_NAMES, F.col("fow")).alias("fow_name"))
