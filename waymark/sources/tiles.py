"""Tile archives and road tiles as DataFrames.

An archive is a single file of header, directories and tile blobs addressed along the Hilbert curve. Its reader lists the wanted
entries once and reads byte ranges in the executors; anything pyarrow can open will do. A tile holds segments, vertices, nodes,
turn restrictions and restrictions across tiles, whose ends it names by stable ids.
"""

from __future__ import annotations

import bisect
import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.functions import geo

#: Fixed values of the two formats.
ARCHIVE_MAGIC, ARCHIVE_VERSION = b"PMTiles", 3
TILE_MAGIC, TILE_VERSION = b"OLRL", 3
TILES_PER_TASK = 256


class BadTile(ValueError):
    """Carries the error code of an archive or tile that can't be read."""


# archive


def varint(b: bytes, at: int) -> tuple[int, int]:
    """(value, next place) of seven bits a byte, least significant first."""
    out = shift = 0
    while True:
        out |= (b[at] & 0x7F) << shift
        shift += 7
        at += 1
        if not b[at - 1] & 0x80:
            return out, at


def directory(b: bytes) -> list[tuple[int, int, int, int]]:
    """(tile_id, offset, length, run) of every entry; a run of 0 points to a leaf directory."""
    n, at = varint(b, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(b, at)
            column.append(v)
        columns.append(column)
    deltas, runs, lengths, offsets = columns
    out, tile, end = [], 0, 0
    for d, run, length, offset in zip(deltas, runs, lengths, offsets, strict=True):
        tile += d
        start = offset - 1 if offset else end
        end = start + length
        out.append((tile, start, length, run))
    return out


def tile_of(tile_id: int) -> tuple[int, int, int]:
    """(z, x, y) of a place along the curves."""
    z = 0
    while tile_id >= 1 << (2 * z):
        tile_id -= 1 << (2 * z)
        z += 1
    x = y = 0
    for k in range(z):
        s = 1 << k
        rx = 1 & (tile_id // 2)
        ry = 1 & (tile_id ^ rx)
        if ry == 0:
            if rx == 1:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, tile_id = x + s * rx, y + s * ry, tile_id // 4
    return z, x, y


class Archive:
    def __init__(self, path: str):
        from pyarrow import fs

        self.system, self.name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = self.system.open_input_file(self.name)
        head = self.range(0, 127)
        if head[:7] != ARCHIVE_MAGIC:
            raise BadTile("BadMagic")
        if head[7] != ARCHIVE_VERSION:
            raise BadTile("UnsupportedVersion")
        self.root, self.root_length, _, _, self.leaves, _, self.data = struct.unpack_from("<7Q", head, 8)
        self.inner, self.compression, self.min_zoom = head[97], head[98], head[100]
        if self.inner not in (0, 1, 2):
            raise BadTile("UnsupportedDirectoryCompression")

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(tile_id, offset, length) of every tile, or of those wanted; the tiles of a run share one blob. Leaf directories that hold
        none of the wanted tiles aren't read."""
        order = sorted(wanted) if wanted is not None else None
        stack = [(self.root, self.root_length, 1 << 62)]
        while stack:
            at, n, end = stack.pop()
            raw = self.range(at, n)
            found = directory(gzip.decompress(raw) if self.inner == 2 or self.inner == 0 and raw[:2] == b"\x1f\x8b" else raw)
            for (tile, offset, length, run), after in zip(found, [*[e[0] for e in found[1:]], end], strict=True):
                if run == 0:
                    if order is None or bisect.bisect_left(order, tile) < bisect.bisect_left(order, after):
                        stack.append((self.leaves + offset, length, after))
                for k in range(run):
                    if wanted is None or tile + k in wanted:
                        yield tile + k, offset, length

    def tile(self, offset: int, length: int) -> bytes:
        raw = self.range(self.data + offset, length)
        if self.compression not in (0, 1, 2):
            raise BadTile("UnsupportedTileCompression")
        return gzip.decompress(raw) if self.compression == 2 else raw


class Span(InputPartition):
    def __init__(self, entries: list[tuple[int, int, int]]):
        self.entries = entries


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        asked = options.get("tile_ids")
        self.wanted = None if asked is None else {int(x) for x in asked.split(",") if x}

    def partitions(self) -> list[InputPartition]:
        found = sorted(Archive(self.path).entries(self.wanted)) if self.wanted is None or self.wanted else []
        return [Span(found[i : i + TILES_PER_TASK]) for i in range(0, len(found), TILES_PER_TASK)] or [Span([])]

    def read(self, partition: Span) -> Iterator[tuple]:
        archive = Archive(self.path)
        for tile, offset, length in partition.entries:
            yield (tile, *tile_of(tile), archive.tile(offset, length))


class TileArchive(DataSource):
    """spark.read.format("tile_archive").option("tile_ids", "1,2").load(path): tile_id, z, x, y, data."""

    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        return "tile_id long, z int, x int, y int, data binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def tiles_near(points: DataFrame, z: int) -> DataFrame:
    """tile_id of the tiles around points (lon, lat): what a load for them asks for."""
    near = geo.tile_neighbours(geo.tile_x(F.col("lon"), z), geo.tile_y(F.col("lat"), z), z)
    t = points.select(F.explode(near).alias("t")).select("t.x", "t.y").distinct()
    return t.select(geo.hilbert_id(z, F.col("x"), F.col("y")).alias("tile_id"))


def load_near(spark: SparkSession, path: str, points: DataFrame, z: int) -> tuple[DataFrame, DataFrame]:
    """The archive's tiles around points, each once, and the status of every tile asked for: loaded, or empty."""
    asked = tiles_near(points, z)
    found = read_archive(spark, path).join(asked, "tile_id", "left_semi")
    status = asked.join(found.select("tile_id", F.lit("loaded").alias("status")), "tile_id", "left").select("tile_id", F.coalesce("status", F.lit("empty")).alias("status"))
    return found, status


def read_archive(spark: SparkSession, path: str, tile_ids: list[int] | None = None) -> DataFrame:
    spark.dataSource.register(TileArchive)
    reader = spark.read.format("tile_archive")
    return (reader.option("tile_ids", ",".join(map(str, tile_ids))) if tile_ids is not None else reader).load(path)


# tiles

ROW = "kind string, tile_id long, local_index int, stable_id string, from_id string, via_id string, to_id string, lon double, lat double, is_boundary boolean, geometry array<struct<lon:double,lat:double>>, length_m double, frc int, fow int, direction string, error_code string"
NAMES = [f.split()[0] for f in ROW.split(", ")]


def tile_rows(b: bytes) -> Iterator[dict]:
    """Nodes, segments, restrictions (by the stable ids of the tile) and cross restrictions of one tile; an empty tile has none."""
    if not b:
        return
    if len(b) < 40:
        raise BadTile("TooShort")
    if b[:4] != TILE_MAGIC:
        raise BadTile("BadMagic")
    if b[4] != TILE_VERSION:
        raise BadTile("UnsupportedVersion")
    counts = dict(zip(("seg", "node", "turn", "vertex", "cross", "pool"), struct.unpack_from("<6I", b, 8), strict=True))
    at, sizes = {}, {"seg": 32, "vertex": 8, "node": 28, "turn": 16, "cross": 16, "pool": 1}
    end = 40
    for k, size in sizes.items():
        at[k], end = end, end + size * counts[k]
    if end > len(b):
        raise BadTile("TooShort")
    pool = b[at["pool"] : end]

    def text(offset: int, n: int) -> str:
        if offset + n > len(pool):
            raise BadTile("PoolOutOfRange")
        try:
            return pool[offset : offset + n].decode("utf-8")
        except UnicodeDecodeError as e:
            raise BadTile("InvalidUtf8") from e

    vertices = [{"lon": x / 1e7, "lat": y / 1e7} for x, y in struct.iter_unpack("<2i", b[at["vertex"] : at["vertex"] + 8 * counts["vertex"]])]
    nodes, segs = [], []
    for i in range(counts["node"]):
        o = at["node"] + 28 * i
        lon, lat, offset = struct.unpack_from("<2iI", b, o)
        nodes.append(text(offset, b[o + 12]))
        yield {"kind": "node", "local_index": i, "stable_id": nodes[-1], "lon": lon / 1e7, "lat": lat / 1e7, "is_boundary": bool(b[o + 24] & 1)}

    def pick(names: list[str], i: int, code: str) -> str:
        if i >= len(names):
            raise BadTile(code)
        return names[i]

    for i in range(counts["seg"]):
        o = at["seg"] + 32 * i
        start, finish, first, n, cm = struct.unpack_from("<3IHI", b, o)
        start, finish = pick(nodes, start, "NodeIndexOob"), pick(nodes, finish, "NodeIndexOob")
        if first + n > len(vertices):
            raise BadTile("GeomOutOfRange")
        if n < 2:
            raise BadTile("GeomTooShort")
        a = b[o + 18]
        segs.append(text(struct.unpack_from("<I", b, o + 20)[0], b[o + 24]))
        yield {"kind": "segment", "local_index": i, "stable_id": segs[-1], "from_id": start, "to_id": finish, "geometry": vertices[first : first + n], "length_m": cm / 100.0, "frc": a & 7, "fow": a >> 3 & 7, "direction": {1: "Forward", 2: "Backward"}.get(a >> 6, "Both")}
    for i in range(counts["turn"]):
        f, v, t = struct.unpack_from("<3I", b, at["turn"] + 16 * i)
        yield {"kind": "turn", "local_index": i, "from_id": pick(segs, f, "SegIndexOob"), "via_id": pick(nodes, v, "NodeIndexOob"), "to_id": pick(segs, t, "SegIndexOob")}
    for i in range(counts["cross"]):
        o = at["cross"] + 16 * i
        f, fn, v, t, tn = struct.unpack_from("<IBIIB", b, o)
        yield {"kind": "cross", "local_index": i, "from_id": text(f, fn), "via_id": pick(nodes, v, "NodeIndexOob"), "to_id": text(t, tn)}


def parse_tiles(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id, data. Tagged rows of everything in them; a tile that can't be read gives one row of kind 'error'."""
    point = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
    kinds = dict(zip(NAMES, [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.float64(), pa.float64(), pa.bool_(), point, pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string()], strict=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = [r | {"tile_id": tile} for r in tile_rows(data.as_py() or b"")]
                except BadTile as e:
                    found = [{"kind": "error", "tile_id": tile, "error_code": str(e)}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], kinds[n]) for n in NAMES], NAMES)

    return tiles.select("tile_id", "data").mapInArrow(rows, ROW)


def network(parsed: DataFrame) -> dict[str, DataFrame]:
    """nodes, segments, restrictions, pending, coverage from parse_tiles() rows (settle them first: they are read five times).

    Of a stable id that several tiles have, the first by tile and place counts. Numbers are hashes of stable ids, so no tile has to
    wait for another. Restrictions across tiles hold once both segments are there and touch the node; others stay pending.
    """
    first = Window.partitionBy("stable_id").orderBy("tile_id", "local_index")
    only = lambda kind: parsed.where(F.col("kind") == kind)
    unique = lambda kind: only(kind).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    number = lambda c: F.xxhash64(c)
    nodes = unique("node").select(number("stable_id").alias("node_id"), "stable_id", "lon", "lat", "is_boundary", "tile_id", "local_index")
    segments = unique("segment").select(number("stable_id").alias("segment_id"), "stable_id", number("from_id").alias("start_node"), number("to_id").alias("end_node"), "geometry", "length_m", "frc", "fow", "direction", "tile_id", "local_index")
    named = lambda kind: only(kind).select(number("from_id").alias("from_seg"), number("via_id").alias("via_node"), number("to_id").alias("to_seg")).distinct()
    ends = lambda c: segments.select(F.col("segment_id").alias(c), F.explode(F.array("start_node", "end_node")).alias("via_node")).distinct()
    cross = named("cross")
    held = cross.join(ends("from_seg"), ["from_seg", "via_node"], "left_semi").join(ends("to_seg"), ["to_seg", "via_node"], "left_semi").select("from_seg", "via_node", "to_seg")
    coverage = parsed.groupBy("tile_id").agg(F.max("error_code").alias("error_code"), F.count(F.when(F.col("kind") == "segment", 1)).alias("n_segments"))
    return {"nodes": nodes, "segments": segments, "restrictions": named("turn").unionByName(held).distinct(), "pending": cross.join(held, ["from_seg", "via_node", "to_seg"], "left_anti"), "coverage": coverage}
