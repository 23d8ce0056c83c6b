"""Shortest paths, combinations, length checks, offsets and path geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.plans.tables import settled

DNP_MISSING = (0.0, 15_000.0)


def shortest_paths(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """req_id, length_m, path: the shortest way on from a segment's end to a node, the start segment not driven again.

    requests: req_id, from_seg, node (where the search starts), goal, lfrcnp, max_dist, cap. A frontier of arcs is relaxed round
    by round with one join against the turns, for all requests at once; of the ways to one arc the shortest stays, ways longer
    than one that has reached the goal are dropped, and equal lengths are settled by the path. What is known is one table, rewritten
    each round for the requests that are still open, so plans don't grow with the rounds; it ends when no arc improves. A node that
    is its own goal is reached at once. (exact.routed() searches towards the goal instead, a block of the map in one task.)
    """
    r = requests.select("req_id", "from_seg", "node", "goal", "lfrcnp", "max_dist", "cap")
    state = r.select("req_id", "node", F.col("from_seg").alias("via"), F.lit(0.0).alias("g"), F.array().cast("array<bigint>").alias("path"))
    frontier, known, reached = state, state.drop("path"), state.join(r.where("node = goal").select("req_id"), "req_id", "left_semi").select("req_id", "g", "path")
    frontier = frontier.join(reached.select("req_id"), "req_id", "left_anti")
    ask = r.drop("node")
    onward = turns.withColumnRenamed("from_seg", "via").withColumnRenamed("via_node", "node")
    while True:
        step = frontier.join(ask, "req_id").join(onward, ["node", "via"])
        sharp = (F.col("cap") < 180) & F.coalesce(F.col("deviation_deg") > F.col("cap"), F.lit(False))
        step = step.where((F.col("to_frc") <= F.col("lfrcnp")) & ~F.col("restricted") & ~sharp & (F.col("g") + F.col("to_len") <= F.col("max_dist")))
        step = step.select("req_id", F.col("to_head").alias("node"), F.col("to_seg").alias("via"), (F.col("g") + F.col("to_len")).alias("g"), F.concat("path", F.array("to_seg")).alias("path"), "goal", "from_seg")
        step = step.groupBy("req_id", "node", "via", "goal", "from_seg").agg(F.min(F.struct("g", "path")).alias("b")).select("req_id", "node", "via", "goal", "from_seg", "b.*")
        step = step.join(known.withColumnRenamed("g", "had"), ["req_id", "node", "via"], "left").where("had is null or g < had")
        best = reached.select("req_id", F.col("g").alias("best"))
        step = settled(step.join(best, "req_id", "left").where("best is null or g < best").drop("had", "best"))
        if step.isEmpty():
            return reached.select("req_id", F.col("g").alias("length_m"), "path")
        at_goal = step.where("node = goal and via != from_seg").select("req_id", "g", "path")
        reached = settled(reached.unionByName(at_goal).groupBy("req_id").agg(F.min(F.struct("g", "path")).alias("b")).select("req_id", "b.*"))
        frontier = step.where("not (node = goal and via != from_seg)").select("req_id", "node", "via", "g", "path")
        still = frontier.select("req_id").distinct()
        known = known.join(still, "req_id", "left_semi").unionByName(step.select("req_id", "node", "via", "g"))
        known = settled(known.groupBy("req_id", "node", "via").agg(F.min("g").alias("g")))


def combinations(ranked: DataFrame, most: int) -> DataFrame:
    """ref_id, combo (ranks in order of the points), score, place: the `most` least sums of one candidate for each point.

    ranked: ref_id, lrp_idx, rank, total. Sums grow point by point, so partial sums beyond the best `most` can't come back."""
    w = Window.partitionBy("ref_id").orderBy("score", "combo")
    top = ranked.agg(F.max("lrp_idx")).first()[0]
    step = lambda k: ranked.where(F.col("lrp_idx") == k).select("ref_id", "rank", "total")
    out = step(0).select("ref_id", F.array("rank").alias("combo"), F.col("total").alias("score"))
    for k in range(1, (top or 0) + 1):
        longer = out.join(step(k), "ref_id").select("ref_id", F.concat("combo", F.array("rank")).alias("combo"), (F.col("score") + F.col("total")).alias("score"))
        out = longer.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")
    return out.withColumn("place", F.row_number().over(w))


def dnp_ok(length: Column, lb: Column, ub: Column, tolerance: float) -> Column:
    """Whether the bounds, widened by a share of the length found, hold it."""
    return (length >= lb - tolerance * length) & (length <= ub + tolerance * length)


def offset_interval(raw: Column, exact_lb: Column, exact_ub: Column, leg: Column) -> tuple[Column, Column]:
    """A raw byte is a 256th of the leg; else the exact bounds."""
    return F.coalesce(raw / 256.0 * leg, exact_lb), F.coalesce((raw + 1) / 256.0 * leg, exact_ub)


def approximate_offset(raw: Column, exact: Column, dnp_lb: Column, dnp_ub: Column) -> tuple[Column, Column]:
    """Bounds where no leg was found: a raw byte's share of the leg's own window, else the exact value, else none."""
    zero = F.lit(0.0)
    return F.coalesce(raw / 256.0 * dnp_lb, exact, zero), F.coalesce((raw + 1) / 256.0 * dnp_ub, exact, zero)


def beyond_leg(pos: Column, neg: Column, first_leg: Column, last_leg: Column) -> Column:
    """'first' or 'last' where an offset isn't within its leg, else null."""
    return F.when((pos > 0) & (pos >= first_leg), "first").when((neg > 0) & (neg >= last_leg), "last")


def forced_prefix(path: DataFrame, validity: DataFrame) -> DataFrame:
    """ref_id, hops: until the first node with a choice, or the end. path: ref_id, step (from 0), node (where the segment ends)."""
    p = path.join(validity.select("node", "is_valid"), "node", "left")
    first = F.min(F.when(F.coalesce("is_valid", F.lit(True)), F.col("step") + 1))
    return p.groupBy("ref_id").agg(F.coalesce(first, F.max("step") + 1).alias("hops"))


def traversals(path: DataFrame, segments: DataFrame) -> DataFrame:
    """ref_id, step, segment_id, traversal from the nodes that neighbours share; a path of one segment counts as Forward."""
    p = path.select("ref_id", "step", "segment_id").join(segments.select("segment_id", "start_node", "end_node"), "segment_id")
    w = Window.partitionBy("ref_id").orderBy("step")
    near = lambda f: [f(c).over(w).alias(f"{f.__name__}_{c}") for c in ("start_node", "end_node")]
    p = p.select("*", *near(F.lag), *near(F.lead))
    enters = F.col("start_node").isin(F.col("lag_start_node"), F.col("lag_end_node"))
    leaves = F.col("end_node").isin(F.col("lead_start_node"), F.col("lead_end_node"))
    ahead = F.coalesce(enters, leaves, F.lit(True))
    return p.select("ref_id", "step", "segment_id", F.when(ahead, "Forward").otherwise("Backward").alias("traversal"))


def running(path: DataFrame) -> DataFrame:
    """path: ref_id, step, segment_id, length_m. Adds before and upto, the metres of the path before and with each segment."""
    upto = F.sum("length_m").over(Window.partitionBy("ref_id").orderBy("step"))
    return path.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("length_m"))


def coverage(path: DataFrame, cuts: DataFrame) -> DataFrame:
    """ref_id, first_step, last_step, first_left, last_left: the segments that remain after cutting pos metres at the start and neg
    at the end, and the metres cut off in them; an exact boundary stays with the segment before it. cuts: ref_id, pos, neg."""
    p = running(path).join(cuts, "ref_id")
    total = F.max("upto").over(Window.partitionBy("ref_id"))
    p = p.withColumn("end", total - F.col("neg"))
    first = F.min(F.when(F.col("pos") <= F.col("upto"), F.struct("step", (F.col("pos") - F.col("before")).alias("left"))))
    last = F.max(F.when(F.col("end") >= F.col("before"), F.struct("step", (F.col("upto") - F.col("end")).alias("left"))))
    c = p.where("pos < end").groupBy("ref_id").agg(first.alias("f"), last.alias("l"))
    return c.select("ref_id", F.col("f.step").alias("first_step"), F.col("l.step").alias("last_step"), F.col("f.left").alias("first_left"), F.col("l.left").alias("last_left"))


def path_vertices(path: DataFrame, segments: DataFrame) -> DataFrame:
    """ref_id, geometry: the vertices of a path in its direction of travel, junctions once. path: ref_id, step, segment_id, start_node."""
    g = path.join(segments.select("segment_id", "geometry", F.col("start_node").alias("s")), "segment_id")
    g = g.select("ref_id", "step", F.when(F.col("start_node") == F.col("s"), F.col("geometry")).otherwise(F.reverse("geometry")).alias("geometry"))
    parts = g.groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("step", "geometry"))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: p["geometry"]))
    near = lambda a, b: (F.abs(a["lon"] - b["lon"]) < 1e-8) & (F.abs(a["lat"] - b["lat"]) < 1e-8)
    return parts.select("ref_id", flat.alias("v")).select("ref_id", F.filter("v", lambda x, i: (i == 0) | ~near(x, F.get("v", i - 1))).alias("geometry"))


def wkt(geometry: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(geometry, lambda v: F.format_string("%.7f %.7f", v["lon"], v["lat"])), ", "), F.lit(")"))


def geojson(geometry: Column, properties: Column) -> Column:
    line = F.struct(F.lit("LineString").alias("type"), F.transform(geometry, lambda v: F.array(v["lon"], v["lat"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), line.alias("geometry")))


def leg_attributes(legs: DataFrame, segments: DataFrame) -> DataFrame:
    """ref_id, frc, fow, lfrcnp, dnp_m, bearing: first segment's class and form, the worst class, the length, the bearing away from
    the start. legs: ref_id, step, segment_id, start_node."""
    from waymark.operators.network import bearings_away

    p = legs.join(segments.select("segment_id", "frc", "fow", "length_m"), "segment_id")
    a = p.groupBy("ref_id").agg(F.min_by(F.struct("segment_id", "start_node", "frc", "fow"), "step").alias("first"), F.max("frc").alias("lfrcnp"), F.sum("length_m").alias("dnp_m"))
    a = a.select("ref_id", F.col("first.segment_id").alias("segment_id"), F.col("first.start_node").alias("node"), "first.frc", "first.fow", "lfrcnp", "dnp_m")
    return a.join(bearings_away(segments), ["segment_id", "node"], "left").select("ref_id", "frc", "fow", "lfrcnp", "dnp_m", "bearing")


def expanded(ends: DataFrame, segments: DataFrame, budget_m: float, cap_deg: float) -> DataFrame:
    """ref_id, node, hops, metres, stop: from the end of a path on along the only other segment until a node is valid, or the budget,
    a sharp turn, the direction or a dead end stops it. ends: ref_id, node, via."""
    from waymark.operators.network import bearings_away, deviation, node_validity, topology

    valid = settled(node_validity(segments).select("node", "is_valid"))
    away = settled(bearings_away(segments))
    links = topology(segments).join(segments.select("segment_id", "length_m", "direction", "start_node"), "segment_id")
    links = settled(links.select(F.col("node"), F.col("other"), F.col("segment_id").alias("to_seg"), "length_m", ((F.col("direction") == "Both") | ((F.col("direction") == "Forward") == (F.col("node") == F.col("start_node")))).alias("may")))
    open_, closed = ends.select("ref_id", "node", "via", F.lit(0).alias("hops"), F.lit(0.0).alias("metres")), None
    while True:
        at = open_.join(valid, "node", "left").withColumn("ok", F.coalesce("is_valid", F.lit(True))).drop("is_valid")
        done = at.where("ok").select("ref_id", "node", "hops", "metres", F.lit("Valid").alias("stop"))
        go = at.where("not ok").join(links.withColumnRenamed("node", "at_node"), (F.col("node") == F.col("at_node")) & (F.col("via") != F.col("to_seg")), "left")
        go = go.join(away.select(F.col("segment_id").alias("via"), "node", F.col("bearing").alias("b1")), ["via", "node"], "left").join(away.select(F.col("segment_id").alias("to_seg"), "node", F.col("bearing").alias("b2")), ["to_seg", "node"], "left")
        stop = (
            F.when(F.col("to_seg").isNull(), "DeadEnd").when(~F.col("may"), "WrongDirection").when(F.col("metres") + F.col("length_m") > budget_m, "OverBudget")
            .when(F.coalesce(deviation(F.col("b1"), F.col("b2")) > cap_deg, F.lit(False)), "SharpTurn")
        )
        go = settled(go.withColumn("stop", stop))
        ended = done.unionByName(go.where("stop is not null").select("ref_id", "node", "hops", "metres", "stop"))
        closed = settled(ended if closed is None else closed.unionByName(ended))
        open_ = go.where("stop is null").select("ref_id", F.col("other").alias("node"), F.col("to_seg").alias("via"), (F.col("hops") + 1).alias("hops"), (F.col("metres") + F.col("length_m")).alias("metres"))
        if open_.isEmpty():
            return closed


def at_distance(vertices: DataFrame, metres: Column) -> DataFrame:
    """ref_id, lon, lat of the point so many metres along a path's vertices."""
    p = vertices.withColumn("p", geo.interpolate(F.col("geometry"), metres))
    return p.select("ref_id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
