"""Candidate selection: which segments a location reference point may lie on, scored, gated and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, intervals
from waymark.operators.network import CELL, grid_cells
from waymark.plans.params import DEFAULT, DecodeParams


def near(points: DataFrame, segments: DataFrame, radius_m: float, key: str = "lrp_id") -> DataFrame:
    """Spatial range join: key, segment_id, arc, px, py, distance_m, seg_length for segments within the radius of a point.

    Both sides are cut into cells, so the join is an equi-join that Spark hashes or sorts as it likes; what meets is projected
    edge by edge in scalar code, the first of equally near edges counts. Segments lie in every cell that their box touches, so a
    point asks for the cells of its own radius only; a degree east is shorter the further north.
    """
    high = radius_m / 111_000.0
    wide = high / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + high, F.lit(90.0)))), F.lit(0.01))
    at = lambda c, by: F.floor((F.col(c) + by) * CELL)
    p = points.select(key, "lon", "lat", wide.alias("wide"), F.explode(F.sequence(at("lon", -wide), at("lon", wide))).alias("cx")).select("*", F.explode(F.sequence(at("lat", -high), at("lat", high))).alias("cy"))
    e = p.join(grid_cells(segments), ["cx", "cy"]).select(key, "lon", "lat", "wide", "segment_id").join(measured(segments), "segment_id")
    beside = lambda c, a, b, by: F.col(c).between(F.least(a, b) - by, F.greatest(a, b) + by)
    e = e.where(beside("lon", "ax", "bx", F.col("wide")) & beside("lat", "ay", "by", high))
    t, x, y = geo.on_edge(*[F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by")])
    e = e.withColumn("t", t).withColumn("px", x).withColumn("py", y).withColumn("d", geo.haversine_m(F.col("lon"), F.col("lat"), F.col("px"), F.col("py")))
    # the generator keeps the filter from working everything out again inside itself
    e = e.select(key, "segment_id", F.explode(F.array(F.struct("d", "edge_idx", "t", "px", "py", "len", "before", "total"))).alias("b")).where(F.col("b.d") <= radius_m)
    # what meets in several cells comes several times and counts once, as the least of it; only edges within the radius are dealt out
    best = e.groupBy(key, "segment_id").agg(F.min("b").alias("b"))
    return best.select(key, "segment_id", (F.col("b.before") + F.col("b.t") * F.col("b.len")).alias("arc"), F.col("b.px").alias("px"), F.col("b.py").alias("py"), F.col("b.d").alias("distance_m"), F.col("b.total").alias("seg_length"))


def measured(segments: DataFrame) -> DataFrame:
    """Edges with the metres before them and of the whole segment, added up from its start."""
    s = segments.select("segment_id", geo.edges_of(F.col("geometry")).alias("e"))
    steps = F.aggregate("e", F.array(F.lit(0.0)), lambda a, e: F.concat(a, F.array(F.element_at(a, -1) + e["len"])))
    s = s.select("segment_id", "e", steps.alias("s")).select("segment_id", "s", F.posexplode("e").alias("edge_idx", "e"))
    return s.select("segment_id", "edge_idx", "e.*", F.get("s", F.col("edge_idx")).alias("before"), F.element_at("s", -1).alias("total"))


def directed(found: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each direction the segment may be driven; arcs count from where the traversal enters."""
    ways = F.explode(F.when(F.col("direction") == "Both", F.array(F.lit("Forward"), F.lit("Backward"))).otherwise(F.array("direction"))).alias("traversal")
    d = found.join(segments.select("segment_id", "geometry", F.col("frc").alias("seg_frc"), F.col("fow").alias("seg_fow"), "direction", "start_node", "end_node"), "segment_id").select("*", ways).drop("direction")
    back = F.col("traversal") == "Backward"
    length = F.greatest("seg_length", F.lit(0.001))
    return d.withColumn("seg_length", length).withColumn("arc", F.when(back, F.greatest(F.col("seg_length") - F.col("arc"), F.lit(0.0))).otherwise(F.col("arc"))).withColumn("geometry", F.when(back, F.reverse("geometry")).otherwise(F.col("geometry")))


def snaps(arc: Column, length: Column, threshold: float) -> Column:
    """array of (snap_order, snap_type, snap_arc): inside if far from both ends, else the near ends; never empty."""
    snap = lambda k, name, at: F.struct(F.lit(k).alias("snap_order"), F.lit(name).alias("snap_type"), at.alias("snap_arc"))
    zero = F.lit(0.0)
    inside = (arc > 1e-6) & (arc < length - 1e-6) & (arc > threshold) & (length - arc > threshold)
    found = F.filter(F.array(F.when(inside, snap(0, "Interior", arc)), F.when(arc <= threshold, snap(1, "Entry", zero)), F.when(length - arc <= threshold, snap(2, "Exit", length))), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.when(arc <= length / 2, snap(1, "Entry", zero)).otherwise(snap(2, "Exit", length))))


def table_cell(table: tuple, row: Column, column: Column) -> Column:
    lit = F.array(*[F.lit(float(v)) for r in table for v in r])
    return F.get(lit, F.least(row, F.lit(7)) * 8 + F.least(column, F.lit(7)))


def evaluated(points: DataFrame, segments: DataFrame, params: DecodeParams = DEFAULT) -> DataFrame:
    """Every snap of every directed candidate with its six scores and verdict. points: lrp_id, lon, lat, frc, fow, bearing_lb,
    bearing_ub, is_last."""
    d = directed(near(points, segments, params.candidate_search_radius_m), segments).join(points, "lrp_id")
    d = d.select("*", F.explode(snaps(F.col("arc"), F.col("seg_length"), params.snap_to_endpoint_threshold_m)).alias("s")).select("*", "s.*").drop("s")
    g = F.col("geometry")
    first, last = F.element_at(g, 1), F.element_at(g, -1)
    spot = lambda f, inner: F.when(F.col("snap_type") == "Entry", first[f]).when(F.col("snap_type") == "Exit", last[f]).otherwise(F.col(inner))
    d = d.withColumn("snap_lon", spot("lon", "px")).withColumn("snap_lat", spot("lat", "py"))
    # the first cell in which a walk over the search window meets the road
    window = params.candidate_search_radius_m / 111_000.0 + 1 / CELL
    met = lambda axis: F.greatest(F.floor((F.col(axis) - window) * CELL), F.floor(F.array_min(F.transform(g, lambda v: v[axis])) * CELL))
    d = d.withColumn("visit_x", met("lon")).withColumn("visit_y", met("lat"))
    d = geo.with_bearing(d, "geometry", F.col("snap_arc"), ~F.col("is_last"), "snap_bearing").drop("geometry")
    d = d.withColumn("snap_distance", F.when(F.col("snap_type") == "Interior", F.col("distance_m")).otherwise(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("snap_lon"), F.col("snap_lat"))))
    d = d.withColumn("excess_deg", intervals.circular_excess(F.col("bearing_lb"), F.col("bearing_ub"), F.col("snap_bearing")))
    wrong = F.when(F.col("is_last"), F.col("snap_type") == "Entry").otherwise(F.col("snap_type") == "Exit").cast("double")
    d = d.select(
        "*", (params.distance_weight * (F.col("snap_distance") / params.candidate_search_radius_m)).alias("distance_score"),
        (params.bearing_weight * (F.col("excess_deg") / F.greatest(F.col("bearing_ub") - F.col("bearing_lb"), F.lit(1.0))) * params.bearing_penalty_per_bucket).alias("bearing_score"),
        (params.frc_weight * table_cell(params.frc_penalty_table, F.col("frc"), F.col("seg_frc"))).alias("frc_score"), (params.fow_weight * table_cell(params.fow_penalty_table, F.col("fow"), F.col("seg_fow"))).alias("fow_score"),
        F.when(F.col("snap_type") == "Interior", params.interior_weight).otherwise(0.0).alias("interior_score"), (params.wrong_endpoint_weight * wrong).alias("wrong_endpoint_score"),
    )
    total = F.col("distance_score") + F.col("bearing_score") + F.col("frc_score") + F.col("fow_score") + F.col("interior_score") + F.col("wrong_endpoint_score")
    verdict = F.when(F.col("excess_deg") > params.max_bearing_deviation_deg, "FailBearing").when(F.col("total") > params.max_candidate_score, "FailScore").otherwise("Pass")
    return d.withColumn("total", total).withColumn("verdict", verdict).withColumn("exit_node", F.when(F.col("traversal") == "Forward", F.col("end_node")).otherwise(F.col("start_node"))).withColumn("entry_node", F.when(F.col("traversal") == "Forward", F.col("start_node")).otherwise(F.col("end_node")))


CANDIDATE = ("snap_type", "snap_arc", "snap_lon", "snap_lat", "snap_distance", "snap_bearing", "excess_deg", "distance_score", "bearing_score", "frc_score", "fow_score", "interior_score", "wrong_endpoint_score", "total", "seg_length", "entry_node", "exit_node", "seg_frc", "seg_fow", "visit_x", "visit_y")


def best_snaps(all_snaps: DataFrame) -> DataFrame:
    """The accepted candidates: of each (lrp, segment, traversal) the snap of the least total, the first of equals."""
    ok = all_snaps.where("verdict = 'Pass'")
    best = ok.groupBy("lrp_id", "segment_id", "traversal").agg(F.min_by(F.struct(*CANDIDATE), F.struct("total", "snap_order")).alias("c"))
    return best.select("lrp_id", "segment_id", "traversal", "c.*")


def rejected(all_snaps: DataFrame) -> DataFrame:
    """Where no snap passes: the one that came furthest, the last of equals."""
    rank = F.when(F.col("verdict") == "FailScore", 2).when(F.col("verdict") == "FailBearing", 1).otherwise(3)
    by = all_snaps.groupBy("lrp_id", "segment_id", "traversal").agg(F.max(F.struct(rank.alias("g"), "snap_order", "verdict", "snap_type", "snap_arc", "snap_distance", "snap_bearing", "total")).alias("r"))
    return by.where("r.g < 3").select("lrp_id", "segment_id", "traversal", "r.verdict", "r.snap_type", "r.snap_arc", "r.snap_distance", "r.snap_bearing", "r.total")


def ranked(candidates: DataFrame, most: int = DEFAULT.max_candidates_per_lrp) -> DataFrame:
    """rank from 1, least total first; equal totals by the cell they were met in, the segment, forward first. 0 keeps all."""
    order = Window.partitionBy("lrp_id").orderBy("total", "visit_x", "visit_y", "segment_id", F.col("traversal").desc())
    r = candidates.withColumn("rank", F.row_number().over(order))
    return r.where(F.col("rank") <= most) if most else r


def select_candidates(points: DataFrame, segments: DataFrame, params: DecodeParams = DEFAULT) -> DataFrame:
    return ranked(best_snaps(evaluated(points, segments, params)), params.max_candidates_per_lrp)


def first_without(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """ref_id, lrp_idx of the first point of each reference that has no candidate. points: ref_id, lrp_idx, lrp_id."""
    return points.join(candidates.select("lrp_id").distinct(), "lrp_id", "left_anti").groupBy("ref_id").agg(F.min("lrp_idx").alias("lrp_idx"))
