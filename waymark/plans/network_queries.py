"""Queries over the derived network: tables of M0, geometry and tile scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo, intervals
from waymark.operators import network
from waymark.plans import fixtures as fx
from waymark.plans.fixture_sql import NET, POINTS, WALKS, along, bear, bear_at, contains, excess, hav, pmod
from waymark.plans.registry import query

Z = 12
R6 = lambda c: F.round(c, 6)


def net(body: str, *more: str) -> str:
    return "WITH " + ", ".join([NET.strip(), *[m.strip() for m in more]]) + " " + body


@query("m0_segments", net("SELECT segment_id, start_node, end_node, length_m, poly_len_m, frc, fow, direction FROM segments"))
def m0_segments(spark, sf):
    return fx.segments(spark, sf).drop("geometry")


@query("m0_walks", net("SELECT ref_id, step, segment_id, start_node FROM walks", WALKS))
def m0_walks(spark, sf):
    return fx.walks(spark, sf)


@query("n1_topology", net("SELECT start_node AS node, end_node AS other, segment_id FROM segments UNION ALL SELECT end_node, start_node, segment_id FROM segments"))
def n1_topology(spark, sf):
    return network.topology(fx.segments(spark, sf))


@query(
    "n1_grid_cells",
    net("SELECT segment_id, cx, unnest(generate_series(b, d)) AS cy FROM (SELECT segment_id, unnest(generate_series(a, c)) AS cx, b, d FROM (SELECT segment_id, CAST(floor(least(x0,xm,x1)*500.0) AS BIGINT) a, CAST(floor(least(y0,ym,y1)*500.0) AS BIGINT) b, CAST(floor(greatest(x0,xm,x1)*500.0) AS BIGINT) c, CAST(floor(greatest(y0,ym,y1)*500.0) AS BIGINT) d FROM segments))"),
)
def n1_grid_cells(spark, sf):
    return network.grid_cells(fx.segments(spark, sf))


@query("n2_outgoing_segments", net("SELECT segment_id, traversal, tail, head, length_m, frc, fow FROM arcs"))
def n2_outgoing_segments(spark, sf):
    return network.arcs(fx.segments(spark, sf))


@query("n3_topology_neighbors", net("SELECT node, count(DISTINCT other) AS n_neighbours, count(*) AS n_segments FROM (SELECT start_node AS node, end_node AS other FROM segments UNION ALL SELECT end_node, start_node FROM segments) GROUP BY node"))
def n3_topology_neighbors(spark, sf):
    return network.topology(fx.segments(spark, sf)).groupBy("node").agg(F.count_distinct("other").alias("n_neighbours"), F.count("*").alias("n_segments"))


@query("n4_restrictions", net("SELECT from_seg, via_node, to_seg FROM restrictions"))
def n4_restrictions(spark, sf):
    return fx.restrictions(spark, sf)


@query("n5_node_validity", net("SELECT node, count(*) AS n_neighbours, count(*) <> 2 OR max(n) > 1 AS is_valid FROM (SELECT node, other, count(*) AS n FROM (SELECT start_node AS node, end_node AS other FROM segments UNION ALL SELECT end_node, start_node FROM segments) GROUP BY ALL) GROUP BY node"))
def n5_node_validity(spark, sf):
    return network.node_validity(fx.segments(spark, sf))


@query("n6_bearing_away_from_node", net("SELECT segment_id, node, round(b, 6) AS bearing FROM away"))
def n6_bearing_away_from_node(spark, sf):
    return network.bearings_away(fx.segments(spark, sf)).withColumn("bearing", R6(F.col("bearing")))


DEV = "180.0 - CASE WHEN abs(i.b-o.b) > 180 THEN 360.0 - abs(i.b-o.b) ELSE abs(i.b-o.b) END"
TURNS = f"""
turns AS (SELECT i.segment_id AS from_seg, a.tail AS via_node, a.segment_id AS to_seg, a.traversal AS to_traversal, a.head AS to_head, a.length_m AS to_len, a.frc AS to_frc, r.from_seg IS NOT NULL AS restricted, {DEV} AS deviation_deg
  FROM arcs a JOIN away i ON i.node = a.tail AND i.segment_id <> a.segment_id JOIN away o ON o.node = a.tail AND o.segment_id = a.segment_id
  LEFT JOIN restrictions r ON r.from_seg = i.segment_id AND r.via_node = a.tail AND r.to_seg = a.segment_id)
"""


def turn_table(spark, sf):
    return network.turns(fx.segments(spark, sf), fx.restrictions(spark, sf))


@query("n7_turn_deviation", net("SELECT from_seg, via_node, to_seg, to_traversal, to_head, to_len, to_frc, restricted, round(deviation_deg, 6) AS deviation_deg FROM turns", TURNS))
def n7_turn_deviation(spark, sf):
    return turn_table(spark, sf).withColumn("deviation_deg", R6(F.col("deviation_deg")))


@query("n8_successors", net("SELECT from_seg, via_node, to_seg, to_head, to_len FROM turns WHERE to_frc <= 5 AND NOT restricted AND deviation_deg <= 80.0", TURNS))
def n8_successors(spark, sf):
    return network.successors(turn_table(spark, sf), 5, 80.0).select("from_seg", "via_node", "to_seg", "to_head", "to_len")


@query("n9_successors_skipped", net("SELECT from_seg, via_node, to_seg, CASE WHEN to_frc > 5 THEN 'FrcBelowLfrcnp' WHEN restricted THEN 'TurnRestricted' ELSE 'SharpTurn' END AS reason FROM turns WHERE to_frc > 5 OR restricted OR deviation_deg > 80.0", TURNS))
def n9_successors_skipped(spark, sf):
    return network.successors_skipped(turn_table(spark, sf), 5, 80.0).select("from_seg", "via_node", "to_seg", "reason")


@query("n10_node_dist", net(f"SELECT lrp_id, node_id, round({hav('n.lon_e7/1e7', 'n.lat_e7/1e7', 'p.lon', 'p.lat')}, 6) AS metres FROM points p JOIN nodes n ON n.node_id = p.lrp_id % (SELECT count(*) FROM part)", POINTS))
def n10_node_dist(spark, sf):
    n = fx.nodes(spark, sf).select("node_id", F.col("lon").alias("nx"), F.col("lat").alias("ny"))
    p = fx.points(spark, sf).withColumn("node_id", F.col("lrp_id") % n.count())
    return p.join(n, "node_id").select("lrp_id", "node_id", R6(geo.haversine_m(F.col("nx"), F.col("ny"), F.col("lon"), F.col("lat"))).alias("metres"))


TX = lambda lon, z=Z: f"least(greatest(CAST(floor((({lon})+180.0)/360.0*{float(1 << z)}) AS BIGINT),0),{(1 << z) - 1})"
TY = lambda lat, z=Z: f"least(greatest(CAST(floor((1.0-asinh(tan(radians({lat})))/pi())/2.0*{float(1 << z)}) AS BIGINT),0),{(1 << z) - 1})"
AROUND = "(SELECT unnest([-1,0,1]) AS d)"


@query(
    "n11_prefetch_tiles",
    net(
        f"""SELECT DISTINCT ref_id, x, y FROM (
        SELECT ref_id, {TX("e0/1e7")}+dx.d AS x, {TY("n0/1e7")}+dy.d AS y FROM legs, {AROUND} dx, {AROUND} dy
        UNION ALL SELECT ref_id, x, unnest(generate_series({TY("greatest(n0,n1)/1e7+p")}, {TY("least(n0,n1)/1e7-p")})) FROM (SELECT *, unnest(generate_series({TX("least(e0,e1)/1e7-p")}, {TX("greatest(e0,e1)/1e7+p")})) AS x FROM legs))""",
        WALKS,
        f"""legs AS (SELECT w.ref_id, a.lon_e7 AS e0, a.lat_e7 AS n0, b.lon_e7 AS e1, b.lat_e7 AS n1, (30.0+least(0.3*{hav("a.lon_e7/1e7", "a.lat_e7/1e7", "b.lon_e7/1e7", "b.lat_e7/1e7")},3000.0))/111000.0 AS p
        FROM walks w JOIN segments s USING (segment_id) JOIN nodes a ON a.node_id = s.start_node JOIN nodes b ON b.node_id = s.end_node WHERE w.step = 0)""",
    ),
)
def n11_prefetch_tiles(spark, sf):
    n = fx.nodes(spark, sf)
    end = lambda k: n.select(F.col("node_id").alias(f"n{k}"), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}"))
    w = fx.walks(spark, sf).where("step = 0").join(fx.segments(spark, sf).select("segment_id", F.col("start_node").alias("n1"), F.col("end_node").alias("n2")), "segment_id")
    legs = w.join(end(1), "n1").join(end(2), "n2").select("ref_id", "lon1", "lat1", "lon2", "lat2")
    return network.prefetch_tiles(legs.select("ref_id", F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), legs, Z, 30.0)


@query("n12_tiles_near_point", net(f"SELECT lrp_id, {TX('lon')}+dx.d AS x, {TY('lat')}+dy.d AS y FROM points, {AROUND} dx, {AROUND} dy", POINTS))
def n12_tiles_near_point(spark, sf):
    near = geo.tile_neighbours(geo.tile_x(F.col("lon"), Z), geo.tile_y(F.col("lat"), Z), Z)
    return fx.points(spark, sf).select("lrp_id", F.explode(near).alias("t")).select("lrp_id", "t.x", "t.y")


@query("n13_tile_index", net(f"SELECT segment_id, x, y, row_number() OVER (PARTITION BY x, y ORDER BY segment_id) - 1 AS local_index FROM (SELECT segment_id, {TX('x0')} AS x, {TY('y0')} AS y FROM segments)"))
def n13_tile_index(spark, sf):
    return tiled(spark, sf).select("segment_id", "x", "y", "local_index")


def tiled(spark, sf):
    from pyspark.sql import Window

    first = F.element_at("geometry", 1)
    s = fx.segments(spark, sf).withColumn("x", geo.tile_x(first["lon"], Z)).withColumn("y", geo.tile_y(first["lat"], Z))
    return s.withColumn("local_index", (F.row_number().over(Window.partitionBy("x", "y").orderBy("segment_id")) - 1).cast("long"))


@query("n14_counts_per_tile", net(f"SELECT x, y, count(*) AS n_segments FROM (SELECT {TX('x0')} AS x, {TY('y0')} AS y FROM segments) GROUP BY ALL"))
def n14_counts_per_tile(spark, sf):
    first = F.element_at("geometry", 1)
    return fx.segments(spark, sf).groupBy(geo.tile_x(first["lon"], Z).alias("x"), geo.tile_y(first["lat"], Z).alias("y")).agg(F.count("*").alias("n_segments"))


# geometry scalars, over the segments


def ends(spark, sf):
    a, m, b = (F.element_at("geometry", k) for k in (1, 2, 3))
    return fx.segments(spark, sf).withColumn("a", a).withColumn("m", m).withColumn("b", b)


@query("g1_haversine", net(f"SELECT segment_id, round({hav('x0', 'y0', 'x1', 'y1')}, 6) AS metres FROM segments"))
def g1_haversine(spark, sf):
    return ends(spark, sf).select("segment_id", R6(geo.haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))).alias("metres"))


@query("g2_bearing", net(f"SELECT segment_id, round({bear('x0', 'y0', 'x1', 'y1')}, 6) AS bearing FROM segments"))
def g2_bearing(spark, sf):
    return ends(spark, sf).select("segment_id", R6(geo.bearing_deg(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))).alias("bearing"))


@query("g4_polyline_length", net("SELECT segment_id, round(l1+l2, 6) AS metres FROM segments"))
def g4_polyline_length(spark, sf):
    return fx.segments(spark, sf).select("segment_id", R6(geo.polyline_length_m(F.col("geometry"))).alias("metres"))


@query("g5_bearing_at_offset", net(f"SELECT segment_id, round({bear_at('', '(l1+l2)*0.4', True)}, 6) AS ahead, round({bear_at('', '(l1+l2)*0.4', False)}, 6) AS behind FROM segments"))
def g5_bearing_at_offset(spark, sf):
    s, at = fx.segments(spark, sf).select("segment_id", "geometry"), geo.polyline_length_m(F.col("geometry")) * 0.4
    s = geo.with_bearing(geo.with_bearing(s, "geometry", at, F.lit(True), "ahead"), "geometry", at, F.lit(False), "behind")
    return s.select("segment_id", R6(F.col("ahead")).alias("ahead"), R6(F.col("behind")).alias("behind"))


@query("g6_interpolate_at", net(f"SELECT segment_id, k, round({along('', '(l1+l2)*k/4.0', 'x')}, 9) AS lon, round({along('', '(l1+l2)*k/4.0', 'y')}, 9) AS lat FROM segments, (SELECT unnest([0,1,2,3,4]) AS k)"))
def g6_interpolate_at(spark, sf):
    g = F.col("geometry")
    s = fx.segments(spark, sf).select("segment_id", "geometry", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    s = s.withColumn("p", geo.interpolate(g, geo.polyline_length_m(g) * F.col("k") / 4.0))
    return s.select("segment_id", "k", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query("g7_tile_of_point", net(f"SELECT lrp_id, {TX('lon')} AS x, {TY('lat')} AS y FROM points", POINTS))
def g7_tile_of_point(spark, sf):
    return fx.points(spark, sf).select("lrp_id", geo.tile_x(F.col("lon"), Z).alias("x"), geo.tile_y(F.col("lat"), Z).alias("y"))


NORTH = lambda y: f"degrees(atan(sinh(pi()*(1.0-2.0*({y})/{float(1 << Z)}))))"


@query("g8_tile_bbox", net(f"SELECT x, y, round(x/{float(1 << Z)}*360.0-180.0, 6) AS west, round((x+1)/{float(1 << Z)}*360.0-180.0, 6) AS east, round({NORTH('y')}, 6) AS north, round({NORTH('y+1')}, 6) AS south FROM (SELECT DISTINCT {TX('lon')} AS x, {TY('lat')} AS y FROM points)", POINTS))
def g8_tile_bbox(spark, sf):
    x, y = F.col("x"), F.col("y")
    return g7_tile_of_point(spark, sf).select("x", "y").distinct().select("x", "y", R6(geo.tile_west(x, Z)).alias("west"), R6(geo.tile_west(x + 1, Z)).alias("east"), R6(geo.tile_north(y, Z)).alias("north"), R6(geo.tile_north(y + 1, Z)).alias("south"))


@query("g9_tile_neighbourhood", net(f"SELECT x+dx.d AS x, y+dy.d AS y, count(*) AS n FROM (SELECT DISTINCT {TX('lon')} AS x, {TY('lat')} AS y FROM points), {AROUND} dx, {AROUND} dy GROUP BY ALL", POINTS))
def g9_tile_neighbourhood(spark, sf):
    t = g7_tile_of_point(spark, sf).select("x", "y").distinct()
    return t.select(F.explode(geo.tile_neighbours(F.col("x"), F.col("y"), Z)).alias("t")).groupBy("t.x", "t.y").agg(F.count("*").alias("n"))


@query("g10_tiles_in_bbox", net(f"SELECT segment_id, x, unnest(generate_series({TY('greatest(y0,ym,y1)', 16)}, {TY('least(y0,ym,y1)', 16)})) AS y FROM (SELECT *, unnest(generate_series({TX('least(x0,xm,x1)', 16)}, {TX('greatest(x0,xm,x1)', 16)})) AS x FROM segments)"))
def g10_tiles_in_bbox(spark, sf):
    v = lambda f, axis: f(F.transform("geometry", lambda p: p[axis]))
    s = fx.segments(spark, sf).select("segment_id", geo.tile_x(v(F.array_min, "lon"), 16).alias("x0"), geo.tile_x(v(F.array_max, "lon"), 16).alias("x1"), geo.tile_y(v(F.array_max, "lat"), 16).alias("y0"), geo.tile_y(v(F.array_min, "lat"), 16).alias("y1"))
    return s.select("segment_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("segment_id", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def dest(lon, lat, b, m):
    q = f"asin(sin(radians({lat}))*cos(({m})/6371000.0)+cos(radians({lat}))*sin(({m})/6371000.0)*cos(radians({b})))"
    return f"degrees(radians({lon})+atan2(sin(radians({b}))*sin(({m})/6371000.0)*cos(radians({lat})), cos(({m})/6371000.0)-sin(radians({lat}))*sin({q})))", f"degrees({q})"


D = dest("lon", "lat", "bearing_lb", "50.0+lrp_id%7")


@query("g11_destination", net(f"SELECT lrp_id, round({D[0]}, 6) AS lon, round({D[1]}, 6) AS lat FROM points", POINTS))
def g11_destination(spark, sf):
    x, y = geo.destination(F.col("lon"), F.col("lat"), F.col("bearing_lb"), 50.0 + F.col("lrp_id") % 7)
    return fx.points(spark, sf).select("lrp_id", R6(x).alias("lon"), R6(y).alias("lat"))


C = dest("lon", "lat", "bearing_lb+11.25/2-11.25/2+11.25*k/48", "100.0")


@query("g12_bearing_cone", net(f"SELECT lrp_id, round({C[0]}, 6) AS lon, round({C[1]}, 6) AS lat, k FROM points, (SELECT unnest(generate_series(0,48)) AS k)", POINTS))
def g12_bearing_cone(spark, sf):
    ring = geo.cone_polygon(F.col("lon"), F.col("lat"), F.col("bearing_lb"), F.col("bearing_ub"), 100.0)
    rows = fx.points(spark, sf).select("lrp_id", F.posexplode(F.slice(ring, 2, 49)).alias("k", "p"))
    return rows.select("lrp_id", R6(F.col("p.lon")).alias("lon"), R6(F.col("p.lat")).alias("lat"), F.col("k").cast("long").alias("k"))


K = dest("lon", "lat", "k*5.625", "30.0")


@query("g13_radius_circle", net(f"SELECT lrp_id, round({K[0]}, 6) AS lon, round({K[1]}, 6) AS lat, k FROM points, (SELECT unnest(generate_series(0,64)) AS k)", POINTS))
def g13_radius_circle(spark, sf):
    rows = fx.points(spark, sf).select("lrp_id", F.posexplode(geo.circle_polygon(F.col("lon"), F.col("lat"), 30.0)).alias("k", "p"))
    return rows.select("lrp_id", R6(F.col("p.lon")).alias("lon"), R6(F.col("p.lat")).alias("lat"), F.col("k").cast("long").alias("k"))


@query("g15_polyline_midpoint", net("SELECT segment_id, xm AS lon, ym AS lat FROM segments"))
def g15_polyline_midpoint(spark, sf):
    g = F.element_at("geometry", (F.floor(F.size("geometry") / 2) + 1).cast("int"))
    return fx.segments(spark, sf).select("segment_id", g["lon"].alias("lon"), g["lat"].alias("lat"))


V = "lrp_id*7.3"


@query("g18_intervals", net(f"SELECT lrp_id, {contains('bearing_lb', 'bearing_ub', pmod(V))} AS inside, round({excess('bearing_lb', 'bearing_ub', pmod(V))}, 6) AS excess, CAST(greatest(100.0-lrp_id, lrp_id-200.0, 0.0) AS DOUBLE) AS linear_excess, lrp_id BETWEEN 100 AND 200 AS linear_inside FROM points", POINTS))
def g18_intervals(spark, sf):
    v, lb, ub = F.pmod(F.col("lrp_id") * 7.3, F.lit(360.0)), F.col("bearing_lb"), F.col("bearing_ub")
    m = F.col("lrp_id").cast("double")
    return fx.points(spark, sf).select("lrp_id", intervals.circular_contains(lb, ub, v).alias("inside"), R6(intervals.circular_excess(lb, ub, v)).alias("excess"), intervals.linear_excess(F.lit(100.0), F.lit(200.0), m).alias("linear_excess"), intervals.linear_contains(F.lit(100.0), F.lit(200.0), m).alias("linear_inside"))


HILBERT = f"""
distinct_tiles AS (SELECT DISTINCT {TX('lon')} AS x, {TY('lat')} AS y FROM points),
curve AS (SELECT x, y, x AS u, y AS v, 0::BIGINT AS d, {Z - 1} AS level FROM distinct_tiles UNION ALL
  SELECT x, y, CASE WHEN ry = 0 THEN fv ELSE fu END, CASE WHEN ry = 0 THEN fu ELSE fv END, d + side*side*xor(3*rx, ry), level-1 FROM (
    SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN side-1-(u & (side-1)) ELSE u & (side-1) END AS fu, CASE WHEN ry = 0 AND rx = 1 THEN side-1-(v & (side-1)) ELSE v & (side-1) END AS fv FROM (
      SELECT *, CASE WHEN u & side > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN v & side > 0 THEN 1 ELSE 0 END AS ry FROM (SELECT *, (1::BIGINT << level) AS side FROM curve WHERE level >= 0))))
"""


@query("s7_hilbert_id", "WITH RECURSIVE " + net(f"SELECT x, y, CAST(d + {sum(4**k for k in range(Z))} AS BIGINT) AS tile_id FROM curve WHERE level < 0", POINTS, HILBERT)[5:])
def s7_hilbert_id(spark, sf):
    t = g7_tile_of_point(spark, sf).select("x", "y").distinct()
    return t.select("x", "y", geo.hilbert_id(Z, F.col("x"), F.col("y")).alias("tile_id"))
