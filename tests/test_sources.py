"""Archives and tiles built by hand, and the stream of points."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.plans import fixtures as fx
from waymark.sources import tiles


def tile(segs, nodes, vertices, turns=(), cross=(), magic=b"OLRL", version=3):
    """segs: (start, end, first vertex, n, cm, attrs, id); nodes: (lon, lat, id, boundary); cross: (from id, via, to id)."""
    pool = b""

    def put(s):
        nonlocal pool
        at = len(pool)
        pool += s.encode()
        return at, len(s.encode())

    s = b"".join(struct.pack("<3IHIBxIB7x", a, b, v, n, cm, attrs, *put(i)) for a, b, v, n, cm, attrs, i in segs)
    g = b"".join(struct.pack("<2i", round(x * 1e7), round(y * 1e7)) for x, y in vertices)
    n = b"".join(struct.pack("<2iIB11xB3x", round(x * 1e7), round(y * 1e7), *put(i), b) for x, y, i, b in nodes)
    t = b"".join(struct.pack("<4I", *x, 0) for x in turns)
    c = b"".join(struct.pack("<IBIIBxx", *put(f), v, *put(to)) for f, v, to in cross)
    head = magic + bytes([version, 0, 0, 0]) + struct.pack("<6I", len(segs), len(nodes), len(turns), len(vertices), len(cross), len(pool)) + bytes(8)
    return head + s + g + n + t + c + pool


LINE = [(0.0, 0.0), (0.001, 0.0), (0.001, 0.0), (0.002, 0.0)]
FIRST = tile([(0, 1, 0, 2, 10000, 3 | 3 << 3, "seg-0"), (1, 2, 2, 2, 10000, 2 | 3 << 3 | 1 << 6, "seg-1")], [(0, 0, "n-0", 0), (0.001, 0, "n-1", 0), (0.002, 0, "shared", 1)], LINE, [(0, 1, 1)], [("seg-1", 2, "seg-9")])
SECOND = tile([(0, 1, 0, 2, 10000, 3, "seg-9")], [(0.002, 0, "shared", 0), (0.003, 0, "n-9", 0)], [(0.002, 0.0), (0.003, 0.0)])


def varint(n):
    out = []
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def directory(entries):
    ids = [e[0] for e in entries]
    columns = [[b - a for a, b in zip([0, *ids], ids, strict=False)], [e[3] for e in entries], [e[2] for e in entries], [e[1] + 1 for e in entries]]
    return gzip.compress(varint(len(entries)) + b"".join(varint(v) for c in columns for v in c))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    blobs = [gzip.compress(FIRST), gzip.compress(SECOND)]
    leaf = directory([(6, len(blobs[0]), len(blobs[1]), 1)])
    root = directory([(5, 0, len(blobs[0]), 1), (6, 0, len(leaf), 0)])
    head = b"PMTiles\x03" + struct.pack("<7Q", 127, len(root), 0, 0, 127 + len(root), len(leaf), 127 + len(root) + len(leaf))
    head = head.ljust(98, b"\0") + b"\x02\x00\x02"
    path = tmp_path_factory.mktemp("archive") / "roads.tiles"
    path.write_bytes(head.ljust(127, b"\0") + root + leaf + b"".join(blobs))
    return str(path)


def test_archive(spark, archive):
    got = {r["tile_id"]: r for r in tiles.read_archive(spark, archive).collect()}
    assert bytes(got[5]["data"]) == FIRST and bytes(got[6]["data"]) == SECOND
    assert [r["tile_id"] for r in tiles.read_archive(spark, archive, [6]).collect()] == [6]
    assert tiles.read_archive(spark, archive, []).count() == 0
    z, x, y = got[5]["z"], got[5]["x"], got[5]["y"]
    spot = spark.range(1).select((geo.tile_west(F.lit(x + 0.5), z)).alias("lon"), geo.tile_north(F.lit(y + 0.5), z).alias("lat"))
    found, status = tiles.load_near(spark, archive, spot, z)
    said = {r["tile_id"]: r["status"] for r in status.collect()}
    assert said[5] == "loaded" and {r["tile_id"] for r in found.collect()} == {t for t, s in said.items() if s == "loaded"} and "empty" in said.values()
    for r in got.values():
        assert spark.range(1).select(geo.hilbert_id(r["z"], F.lit(r["x"]), F.lit(r["y"])).alias("d")).first()["d"] == r["tile_id"]


def test_network(spark, archive):
    n = tiles.network(tiles.parse_tiles(tiles.read_archive(spark, archive)).cache())
    assert n["nodes"].count() == 4 and n["segments"].count() == 3
    assert n["nodes"].where("stable_id = 'shared'").first()["is_boundary"]
    s = {r["stable_id"]: r for r in n["segments"].collect()}
    assert (s["seg-1"]["direction"], s["seg-1"]["frc"], s["seg-0"]["length_m"], len(s["seg-9"]["geometry"])) == ("Forward", 2, 100.0, 2)
    assert n["restrictions"].count() == 2 and n["pending"].count() == 0
    one = tiles.network(tiles.parse_tiles(tiles.read_archive(spark, archive, [5])).cache())
    assert one["restrictions"].count() == 1 and one["pending"].count() == 1


def test_bad_tiles(spark):
    bad = {1: FIRST[:30], 2: tile([], [], [], magic=b"XXXX"), 3: tile([], [], [], version=2), 4: tile([(0, 7, 0, 2, 1, 0, "s")], [(0, 0, "n", 0)], LINE), 5: tile([(0, 0, 3, 2, 1, 0, "s")], [(0, 0, "n", 0)], LINE), 6: tile([(0, 0, 0, 1, 1, 0, "s")], [(0, 0, "n", 0)], LINE), 7: b"", 8: None}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in bad.items()], "tile_id long, data binary")
    got = {r["tile_id"]: r["error_code"] for r in tiles.parse_tiles(df).collect()}
    assert got == {1: "TooShort", 2: "BadMagic", 3: "UnsupportedVersion", 4: "NodeIndexOob", 5: "GeomOutOfRange", 6: "GeomTooShort"}


def test_stream(spark, tmp_path):
    from waymark.operators.candidates import select_candidates
    from waymark.streaming.matching import match_stream

    sf = "/root/testdata/sf0.001"
    points, segments = fx.points(spark, sf).where("lrp_id < 100"), fx.segments(spark, sf)
    points.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = match_stream(stream, segments, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.select("lrp_id", "rank", "segment_id").collect())) == sorted(map(tuple, select_candidates(points, segments).select("lrp_id", "rank", "segment_id").collect()))
