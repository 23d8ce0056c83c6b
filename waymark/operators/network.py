"""Tables derived from a road network: edges, arcs, topology, cells, node validity, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo

CELL = 500.0  # cells a degree


def edges(segments: DataFrame) -> DataFrame:
    """segment_id, edge_idx, ax, ay, bx, by, len, before: a row for each pair of vertices, with the metres before it."""
    e = segments.select("segment_id", F.posexplode(geo.edges_of(F.col("geometry"))).alias("edge_idx", "e")).select("segment_id", "edge_idx", "e.*")
    return e


def grid_cells(segments: DataFrame) -> DataFrame:
    """segment_id, cx, cy: every cell that the bounding box touches."""
    lo = lambda axis: F.floor(F.array_min(F.transform("geometry", lambda v: v[axis])) * CELL)
    hi = lambda axis: F.floor(F.array_max(F.transform("geometry", lambda v: v[axis])) * CELL)
    box = segments.select("segment_id", lo("lon").alias("x0"), hi("lon").alias("x1"), lo("lat").alias("y0"), hi("lat").alias("y1"))
    return box.select("segment_id", F.explode(F.sequence("x0", "x1")).alias("cx"), "y0", "y1").select("segment_id", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))


def arcs(segments: DataFrame) -> DataFrame:
    """One row for each direction a segment may be driven: segment_id, traversal, tail, head, length_m, frc, fow."""
    fw = F.when(F.col("direction") != "Backward", F.struct(F.lit("Forward").alias("traversal"), F.col("start_node").alias("tail"), F.col("end_node").alias("head")))
    bw = F.when(F.col("direction") != "Forward", F.struct(F.lit("Backward").alias("traversal"), F.col("end_node").alias("tail"), F.col("start_node").alias("head")))
    return segments.select("segment_id", F.explode(F.array(fw, bw)).alias("d"), "length_m", "frc", "fow").where("d is not null").select("segment_id", "d.*", "length_m", "frc", "fow")


def topology(segments: DataFrame) -> DataFrame:
    """node, other, segment_id, whatever the direction; a loop once."""
    ends = F.array(F.struct(F.col("start_node").alias("node"), F.col("end_node").alias("other")), F.when(F.col("start_node") != F.col("end_node"), F.struct(F.col("end_node").alias("node"), F.col("start_node").alias("other"))))
    return segments.select("segment_id", F.explode(ends).alias("e")).where("e is not null").select("e.node", "e.other", "segment_id")


def node_validity(segments: DataFrame) -> DataFrame:
    """node, n_neighbours, is_valid: neither a mere corridor between two others nor one without a way to turn."""
    pairs = topology(segments).groupBy("node", "other").agg(F.count("*").alias("n"))
    found = pairs.groupBy("node").agg(F.count("*").alias("n_neighbours"), F.max("n").alias("most"))
    return found.select("node", "n_neighbours", ((F.col("n_neighbours") != 2) | (F.col("most") > 1)).alias("is_valid"))


def bearings_away(segments: DataFrame) -> DataFrame:
    """segment_id, node, bearing: what one faces at either end, looking into the segment."""
    ends = F.array(F.struct(F.col("start_node").alias("node"), F.lit(True).alias("fw")), F.when(F.col("end_node") != F.col("start_node"), F.struct(F.col("end_node").alias("node"), F.lit(False).alias("fw"))))
    e = segments.where(F.size("geometry") >= 2).select("segment_id", "geometry", F.explode(ends).alias("e")).where("e is not null").select("segment_id", "geometry", "e.*")
    e = geo.with_bearing(e, "geometry", F.when(F.col("fw"), 0.0).otherwise(geo.polyline_length_m(F.col("geometry"))), F.col("fw"), "bearing")
    return e.select("segment_id", "node", "bearing")


def deviation(b_in: Column, b_out: Column) -> Column:
    """0 straight on, 180 back."""
    d = F.abs(b_in - b_out) % 360.0
    return 180.0 - F.when(d > 180, 360.0 - d).otherwise(d)


def turns(segments: DataFrame, restrictions: DataFrame) -> DataFrame:
    """from_seg, via_node, to_seg, to_traversal, to_head, to_len, to_frc, restricted, deviation_deg: every way on from a segment at
    one of its nodes into an arc, turning back excluded."""
    touch = topology(segments).select(F.col("node").alias("via_node"), F.col("segment_id").alias("from_seg")).distinct()
    out = arcs(segments).select(F.col("tail").alias("via_node"), F.col("segment_id").alias("to_seg"), F.col("traversal").alias("to_traversal"), F.col("head").alias("to_head"), F.col("length_m").alias("to_len"), F.col("frc").alias("to_frc"))
    t = touch.join(out, "via_node").where("from_seg != to_seg")
    away = bearings_away(segments)
    side = lambda seg, b: away.select(F.col("node").alias("via_node"), F.col("segment_id").alias(seg), F.col("bearing").alias(b))
    t = t.join(side("from_seg", "b_in"), ["via_node", "from_seg"], "left").join(side("to_seg", "b_out"), ["via_node", "to_seg"], "left")
    t = t.join(restrictions.select("from_seg", "via_node", "to_seg").distinct().withColumn("restricted", F.lit(True)), ["from_seg", "via_node", "to_seg"], "left")
    return t.select("from_seg", "via_node", "to_seg", "to_traversal", "to_head", "to_len", "to_frc", F.coalesce("restricted", F.lit(False)).alias("restricted"), deviation(F.col("b_in"), F.col("b_out")).alias("deviation_deg"))


def successors(turn_table: DataFrame, lfrcnp: int, max_deviation: float) -> DataFrame:
    sharp = F.coalesce(F.col("deviation_deg") > max_deviation, F.lit(False)) if max_deviation < 180 else F.lit(False)
    return turn_table.where((F.col("to_frc") <= lfrcnp) & ~F.col("restricted") & ~sharp)


def successors_skipped(turn_table: DataFrame, lfrcnp: int, max_deviation: float) -> DataFrame:
    """The rest, with the first test that fails."""
    sharp = F.coalesce(F.col("deviation_deg") > max_deviation, F.lit(False)) if max_deviation < 180 else F.lit(False)
    reason = F.when(F.col("to_frc") > lfrcnp, "FrcBelowLfrcnp").when(F.col("restricted"), "TurnRestricted").when(sharp, "SharpTurn")
    return turn_table.withColumn("reason", reason).where("reason is not null")


def prefetch_tiles(points: DataFrame, legs: DataFrame, z: int, radius_m: float) -> DataFrame:
    """ref_id, x, y: tiles around each point (ref_id, lon, lat), and those of each leg's box (ref_id, lon1, lat1, lon2, lat2) with
    a margin of the radius and 0.3 of the leg, 3000 m at most."""
    near = points.select("ref_id", F.explode(geo.tile_neighbours(geo.tile_x(F.col("lon"), z), geo.tile_y(F.col("lat"), z), z)).alias("t")).select("ref_id", "t.x", "t.y")
    crow = geo.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    pad = (radius_m + F.least(0.3 * crow, F.lit(3000.0))) / 111_000.0
    box = legs.withColumn("p", pad).select(
        "ref_id", geo.tile_x(F.least("lon1", "lon2") - F.col("p"), z).alias("x0"), geo.tile_x(F.greatest("lon1", "lon2") + F.col("p"), z).alias("x1"),
        geo.tile_y(F.greatest("lat1", "lat2") + F.col("p"), z).alias("y0"), geo.tile_y(F.least("lat1", "lat2") - F.col("p"), z).alias("y1"),
    )
    corridor = box.select("ref_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("ref_id", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    return near.unionByName(corridor).distinct()
