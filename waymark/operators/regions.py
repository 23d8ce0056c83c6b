"""Brings references and the roads they need into one task: blocks of the map, split by the number of references in them.

A block's size follows the extent of the references in it (classes of powers of two), so a long one doesn't drag the whole map
into a small block. What a task holds is bounded by the roads of a block and its margin and by MOST_REFS references; blocks with
more are dealt out to several tasks. Roads come packed by tile, a row for hundreds of them, and stay columns until a search asks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waymark.operators.kernel import Net
from waymark.plans.tables import settled

BLOCK_DEG, TILE_DEG, MOST_REFS = 0.05, 0.02, 4_000
KEY = ("k", "bx", "by", "part")


def with_blocks(refs: DataFrame) -> DataFrame:
    """refs: ref_id, payload, lon0, lat0, lon1, lat1, reach_m. Adds the block and the padded box; what has them comes back as it is."""
    if "part" in refs.columns:
        return refs
    pad = F.col("reach_m") / 111_000.0
    wide = pad / F.greatest(F.cos(F.radians(F.greatest(F.abs("lat0"), F.abs("lat1")))), F.lit(0.01))
    r = refs.select("ref_id", "payload", (F.col("lon0") - wide).alias("x0"), (F.col("lon1") + wide).alias("x1"), (F.col("lat0") - pad).alias("y0"), (F.col("lat1") + pad).alias("y1"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(BLOCK_DEG))
    r = r.withColumn("k", F.ceil(F.log2(extent / BLOCK_DEG)).cast("int")).withColumn("size", BLOCK_DEG * F.pow(F.lit(2.0), F.col("k")))
    r = r.withColumn("bx", F.floor((F.col("x0") + F.col("x1")) / 2 / F.col("size"))).withColumn("by", F.floor((F.col("y0") + F.col("y1")) / 2 / F.col("size")))
    r = settled(r)  # what it rests on is worked out once, not for the counts and again for the rows
    counts = r.groupBy("k", "bx", "by").agg(F.ceil(F.count("*") / MOST_REFS).alias("parts"))
    return r.join(counts, ["k", "bx", "by"]).withColumn("part", F.pmod(F.xxhash64("ref_id"), F.col("parts"))).drop("parts")


def packed(segments: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Roads by the tile in which their box begins, with the box they take up and the turns forbidden from them. A tile's size follows
    the extent of its roads, so a long one doesn't widen the tile of short ones."""
    edge = lambda f, axis: f(F.transform("geometry", lambda v: v[axis]))
    no = restrictions.groupBy(F.col("from_seg").alias("segment_id")).agg(F.to_json(F.collect_list(F.array("via_node", "to_seg"))).alias("no"))
    flags = [c for c in ("no_start", "no_end") if c in segments.columns]
    road = F.struct("segment_id", "start_node", "end_node", "length_m", "frc", "fow", "direction", F.flatten(F.transform("geometry", lambda v: F.array(v["lon"], v["lat"]))).alias("line"), "no", *flags)
    s = segments.join(no, "segment_id", "left").select(edge(F.array_min, "lon").alias("x0"), edge(F.array_max, "lon").alias("x1"), edge(F.array_min, "lat").alias("y0"), edge(F.array_max, "lat").alias("y1"), road.alias("road")).where("x0 is not null")
    s = s.withColumn("level", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(TILE_DEG)) / TILE_DEG)).cast("int"))
    cell = lambda c: F.floor(F.col(c) / (TILE_DEG * F.pow(F.lit(2.0), F.col("level"))))
    s = s.select(F.xxhash64("level", cell("x0"), cell("y0")).alias("tile"), "*")
    return s.groupBy("tile").agg(F.min("x0").alias("sx0"), F.max("x1").alias("sx1"), F.min("y0").alias("sy0"), F.max("y1").alias("sy1"), F.collect_list("road").alias("roads"))


def roads_of(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """The tiles of roads, from packed() and written, whose box touches the box of a block's references."""
    box = blocks.groupBy(*KEY, "size").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    cells = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / F.col("size")), F.floor(F.col(b) / F.col("size")))))
    wanted = cells(cells(box, "x0", "x1", "cx"), "y0", "y1", "cy").select(*KEY, "cx", "cy", "x0", "x1", "y0", "y1")
    classes = [r["k"] for r in blocks.select("k").distinct().collect()]  # powers of two: a few dozen at most
    sizes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(BLOCK_DEG * 2.0**k).alias("size")) for k in sorted(classes)]) if classes else F.array().cast("array<struct<k:int,size:double>>")
    s = tiles.select("tile", "sx0", "sx1", "sy0", "sy1", F.explode(sizes).alias("c")).select("*", "c.*")
    s = cells(cells(s, "sx0", "sx1", "cx"), "sy0", "sy1", "cy").drop("size", "c")
    touch = (F.col("sx0") <= F.col("x1")) & (F.col("sx1") >= F.col("x0")) & (F.col("sy0") <= F.col("y1")) & (F.col("sy1") >= F.col("y0"))
    pairs = wanted.join(s, ["k", "cx", "cy"]).where(touch).select(*KEY, "tile").distinct()
    # few rows, but each brings the roads of a tile: dealt out by number, not by what they weigh before that
    return pairs.repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism, *KEY).join(tiles.select("tile", "roads"), "tile")


PLAIN = ("segment_id", "start_node", "end_node", "length_m", "frc", "fow", "direction")


def net_of(tiles: pa.Table) -> tuple[Net, dict[str, np.ndarray]]:
    """The network, and the columns PLAIN, offsets and line it is made from."""
    roads = pc.list_flatten(tiles["roads"].combine_chunks())
    names = [f.name for f in roads.type]
    of = {n: pc.struct_field(roads, n) for n in names}
    ids, start, end, length, frc, fow, direction = plain = [of[n].to_numpy(zero_copy_only=False) for n in PLAIN]
    said = np.flatnonzero(of["no"].is_valid().to_numpy(zero_copy_only=False))
    banned = [(int(ids[i]), via, to) for i in said for via, to in json.loads(of["no"][int(i)].as_py())]
    lost = {n for gone, node in (("no_start", start), ("no_end", end)) if gone in of for n in node[of[gone].is_valid().to_numpy(zero_copy_only=False)].tolist()}
    shapes = of["line"].offsets.to_numpy(), of["line"].values.to_numpy(zero_copy_only=False)
    return Net.of(ids, start, end, length, frc, fow, direction, *shapes, banned, lost), dict(zip((*PLAIN, "offsets", "line"), (*plain, *shapes), strict=True))


def on_network(refs: DataFrame, segments: DataFrame, restrictions: DataFrame, each: Callable[[Net, dict], Iterator[tuple]], schema: str, missing: DataFrame | None = None, tiles: DataFrame | None = None, first: Callable[[dict, list], None] | None = None) -> DataFrame:
    """Rows of each(net, payload) for every reference, ref_id first. refs as for with_blocks() or with their blocks, payload as JSON
    text; missing: node, those whose own tile isn't there; tiles: the written packed() of the same roads without missing nodes, to
    share it; first(columns, payloads) may add to all payloads of a task from the columns of its roads."""
    if missing is not None:
        gone = missing.select("node").distinct()
        for end in ("start", "end"):
            segments = segments.join(gone.select(F.col("node").alias(f"{end}_node"), F.lit(True).alias(f"no_{end}")), f"{end}_node", "left")
    blocks = with_blocks(refs)
    if tiles is None or missing is not None:
        tiles = settled(packed(segments, restrictions))
    roads = roads_of(blocks, tiles).withColumnsRenamed({k: f"road_{k}" for k in KEY})
    rows = to_arrow_schema(StructType.fromDDL(f"ref_id long, {schema}"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (net, columns), out = net_of(right), []
        payloads = [json.loads(p) for p in left["payload"].to_pylist()]
        if first is not None and payloads:
            first(columns, payloads)
        for ref_id, payload in zip(left["ref_id"].to_pylist(), payloads, strict=True):
            out += [(ref_id, *row) for row in each(net, payload)]
        columns = zip(*out, strict=True) if out else [()] * len(rows)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, rows, strict=True)], schema=rows)

    return blocks.select("ref_id", "payload", *KEY).groupBy(*KEY).cogroup(roads.groupBy(*[f"road_{k}" for k in KEY])).applyInArrow(run, f"ref_id long, {schema}")
