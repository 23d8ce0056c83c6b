"""The two formats: published vectors, errors, round trips."""

import base64

import pytest
from pyspark.sql import functions as F

from waymark.functions import tpeg, v3
from waymark.plans.codec_queries import VECTORS, decode_tpeg, detect

#: What the published v3 strings hold: lon, lat, frc, fow, lfrcnp, sector, dnp.
V1 = [(-0.422448, 53.841301, 5, 3, 5, 15, 4), (-0.422118, 53.839051, 5, 3, None, 31, None)]
V7 = [(7.671150, 47.548002, 5, 3, 5, 9, 15), (7.682070, 47.545022, 5, 3, 5, 10, 10), (7.681850, 47.541062, 5, 3, None, 2, None)]


def parsed(spark, *blobs):
    b = F.col("b")
    df = v3.with_bytes(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(blobs)], "i int, raw binary"), "raw", "b")
    cols, rows = v3.grid_size(b)
    df = df.select("i", v3.location_type(b).alias("kind"), v3.error_code(b).alias("error"), v3.lrps(b).alias("lrps"), v3.coordinates(b).alias("xy"), v3.radius_m(b).alias("r"), cols.alias("cols"), rows.alias("rows"), v3.orientation(b).alias("orientation"), v3.side_of_road(b).alias("side"))
    return v3.apart(df, "lrps").withColumn("again", F.base64(v3.encode_line(F.col("lrps")))).orderBy("i").collect()


@pytest.mark.parametrize(("name", "expected", "offsets"), [("V1", V1, (None, None)), ("V7", V7, (None, 31))])
def test_v3_vectors(spark, name, expected, offsets):
    (r,) = parsed(spark, base64.b64decode(VECTORS[name]))
    assert r["kind"] == "Line" and r["error"] is None
    got = [(round(p["lon"], 6), round(p["lat"], 6), p["frc"], p["fow"], p["lfrcnp"], int(p["bearing_lb"] / 11.25), None if p["dnp_lb"] is None else int(p["dnp_lb"] / v3.BUCKET_M)) for p in r["lrps"]]
    assert got == [pytest.approx(e, abs=2e-6) for e in expected]
    assert (r["lrps"][0]["pos_offset_raw"], r["lrps"][-1]["neg_offset_raw"]) == offsets


def test_v3_reencode(spark):
    for r, name in zip(parsed(spark, *[base64.b64decode(VECTORS[n]) for n in ("V1", "V3", "V6")]), ("V1", "V3", "V6"), strict=True):
        assert r["again"] == VECTORS[name]
    (r,) = parsed(spark, base64.b64decode(VECTORS["V2"]))
    assert (r["lrps"][0]["pos_offset_raw"], r["lrps"][1]["neg_offset_raw"]) == (145, 16)


def test_v3_shapes_and_errors(spark):
    spot = bytearray(17)
    spot[0], spot[7], spot[8], spot[9], spot[14], spot[15], spot[16] = 0x2B, 0x53, 0x45, 4, 0x53, 15, 128
    blobs = [spot, bytes([0x2B]) + bytes(15), b"\x0b" * 15, b"\x0c" + bytes(10), b"\x23" + bytes(6), b"\x03" + bytes(8) + b"\x64", b"\x43" + bytes(12), b"\x43" + bytes(12) + b"\x02\x03", b"\x13" + bytes(18), b"\x5b" + bytes(11), b"\x0b" + bytes(14) + b"\x40", b"\x2b" + bytes(22)]
    r = parsed(spark, *blobs)
    assert (r[0]["kind"], r[0]["orientation"], r[0]["side"], r[0]["lrps"][0]["pos_offset_raw"], r[0]["lrps"][0]["frc"]) == ("PointAlongLine", "FirstTowardSecond", "Right", 128, 2)
    assert r[1]["kind"] == "PointAlongLine" and len(r[1]["lrps"]) == 2
    assert [x["error"] for x in r[2:4]] == ["TooShort", "InvalidHeader"]
    assert (r[4]["kind"], len(r[4]["xy"])) == ("GeoCoordinate", 1) and r[5]["r"] == 100
    assert (r[6]["kind"], r[7]["kind"], r[7]["cols"], r[7]["rows"]) == ("Rectangle", "Grid", 3, 4)
    assert len(r[8]["xy"]) == 3 and (r[9]["kind"], len(r[9]["lrps"])) == ("ClosedLine", 2)
    assert r[10]["error"] == "TooShort" and r[11]["kind"] == "PoiWithAccessPoint"


def test_detection(spark):
    df = spark.createDataFrame([(k, v) for k, v in VECTORS.items()] + [("none", "zz"), ("null", None)], "k string, s string")
    got = {r["k"]: r["format"] for r in detect(df, "s").collect()}
    assert got == {k: "v3" if k[0] == "V" else "tpeg" for k in VECTORS} | {"none": None, "null": None}


def test_variable_length_vectors(spark):
    for name in ("P1", "P2", "P3"):
        d = tpeg.decode_text(VECTORS[name])
        raw = tpeg.encode(d["location_type"], d["lrps"], d["pos_offset"], d["neg_offset"], d["side"] or 0, d["orientation"] or 0)
        assert VECTORS[name] in (raw.hex().upper(), base64.b64encode(raw).decode())
    p1, p2 = VECTORS["P1"], VECTORS["P2"]
    assert [p["dnp_lb"] for p in tpeg.decode_text(p2)["lrps"][:-1]] == [743, 3144, 1969]
    bad = {1: p1[:2] + "2A" + p1[4:], 2: p1[:8] + "0A" + p1[10:], 3: "07" + p1[2:], 4: "0", 5: None}
    df = spark.createDataFrame(list(bad.items()), "ref_id long, ref string")
    assert {r["ref_id"]: r["error_code"] for r in decode_tpeg(df).collect()} == {1: "LengthMismatch", 2: "InvalidLocationType", 3: "InvalidHeader", 4: "Base64", 5: "TooShort"}
    assert [tpeg.varint(n).hex() for n in (127, 351, 1093567633)] == ["7f", "825f", "8489ba8911"]
