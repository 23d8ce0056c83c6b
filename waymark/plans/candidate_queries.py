"""Queries over candidate selection, and the flagship: which segments a two-point line covers where no search is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import candidates
from waymark.plans import fixtures as fx
from waymark.plans.fixture_sql import POINTS, bear_at, excess, hav
from waymark.plans.network_queries import net
from waymark.plans.params import DEFAULT, FOW_TABLE, FRC_STEPS
from waymark.plans.registry import query

R6 = lambda c: F.round(c, 6)


def edge_t(a: str, b: str) -> str:
    cos = f"cos(radians((y{a}+y{b})/2))"
    dx, dy = f"((x{b}-x{a})*{cos})", f"(y{b}-y{a})"
    return f"least(greatest(((lon-x{a})*{cos}*{dx}+(lat-y{a})*{dy})/({dx}*{dx}+{dy}*{dy}),0.0),1.0)"


def at(t: str, axis: str, a: str, b: str) -> str:
    return f"{axis}{a}+{t}*({axis}{b}-{axis}{a})"


def array(values) -> str:
    return "[" + ",".join(str(float(v)) for v in values) + "]"


NEAR = f"""
joined AS (SELECT * EXCLUDE (frc, fow), p.frc AS frc, p.fow AS fow, s.frc AS seg_frc, s.fow AS seg_fow FROM points p JOIN segments s ON p.lon BETWEEN least(x0,xm,x1)-0.001 AND greatest(x0,xm,x1)+0.001 AND p.lat BETWEEN least(y0,ym,y1)-0.001 AND greatest(y0,ym,y1)+0.001),
ts AS (SELECT *, {edge_t("0", "m")} AS ta, {edge_t("m", "1")} AS tb FROM joined),
ds AS (SELECT *, {hav("lon", "lat", at("ta", "x", "0", "m"), at("ta", "y", "0", "m"))} AS da, {hav("lon", "lat", at("tb", "x", "m", "1"), at("tb", "y", "m", "1"))} AS db FROM ts),
near AS (SELECT *, l1+l2 AS len, CASE WHEN db < da THEN l1+tb*l2 ELSE ta*l1 END AS arc, CASE WHEN db < da THEN {at("tb", "x", "m", "1")} ELSE {at("ta", "x", "0", "m")} END AS px, CASE WHEN db < da THEN {at("tb", "y", "m", "1")} ELSE {at("ta", "y", "0", "m")} END AS py, least(da, db) AS d FROM ds WHERE least(da, db) <= 30.0)
"""
FLIP = ", ".join(f"CASE WHEN w.traversal='Backward' THEN {b} ELSE {a} END AS o{a}" for a, b in (("x0", "x1"), ("y0", "y1"), ("xm", "xm"), ("ym", "ym"), ("x1", "x0"), ("y1", "y0"), ("l1", "l2"), ("l2", "l1")))
WINDOW = "(30.0::DOUBLE/111000.0::DOUBLE + 1.0::DOUBLE/500.0::DOUBLE)"
WAYS = f"""
ways AS (SELECT 'Forward' AS traversal UNION ALL SELECT 'Backward'),
dirs AS (SELECT n.* EXCLUDE (arc), w.traversal, CASE WHEN w.traversal='Backward' THEN greatest(len-arc,0.0) ELSE arc END AS arc, {FLIP} FROM near n JOIN ways w ON n.direction IN ('Both', w.traversal)),
snaps AS (
  SELECT *, 0 AS snap_order, 'Interior' AS snap_type, arc AS snap_arc, px AS sx, py AS sy FROM dirs WHERE arc > 15.0 AND len-arc > 15.0
  UNION ALL SELECT *, 1, 'Entry', 0.0, ox0, oy0 FROM dirs WHERE arc <= 15.0
  UNION ALL SELECT *, 2, 'Exit', len, ox1, oy1 FROM dirs WHERE len-arc <= 15.0),
faced AS (SELECT *, CASE WHEN is_last THEN {bear_at("o", "snap_arc", False)} ELSE {bear_at("o", "snap_arc", True)} END AS snap_bearing, CASE WHEN snap_order=0 THEN d ELSE {hav("lon", "lat", "sx", "sy")} END AS snap_distance FROM snaps),
measured AS (SELECT *, {excess("bearing_lb", "bearing_ub", "snap_bearing")} AS excess_deg FROM faced),
scored AS (SELECT *, 0.5*(snap_distance/30.0) AS distance_score, 0.3*(excess_deg/greatest(bearing_ub-bearing_lb,1.0))*0.05 AS bearing_score,
  0.10*{array(FRC_STEPS)}[abs(frc-seg_frc)+1] AS frc_score, 0.20*{array(v for r in FOW_TABLE for v in r)}[fow*8+seg_fow+1] AS fow_score,
  CASE WHEN snap_order=0 THEN 0.10 ELSE 0.0 END AS interior_score, 0.20*CASE WHEN snap_order = CASE WHEN is_last THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END AS wrong_endpoint_score FROM measured),
totals AS (SELECT *, distance_score+bearing_score+frc_score+fow_score+interior_score+wrong_endpoint_score AS total FROM scored),
judged AS (SELECT *, CASE WHEN excess_deg > 45.0 THEN 'FailBearing' WHEN total > 1.5 THEN 'FailScore' ELSE 'Pass' END AS verdict FROM totals),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lrp_id, segment_id, traversal ORDER BY total, snap_order) AS k FROM judged WHERE verdict='Pass') WHERE k = 1),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lrp_id ORDER BY total, greatest(floor((lon-{WINDOW})*500.0), floor(least(x0,xm,x1)*500.0)), greatest(floor((lat-{WINDOW})*500.0), floor(least(y0,ym,y1)*500.0)), segment_id, traversal DESC) AS rank FROM best) WHERE rank <= 8)
"""


def over(body: str, *more: str) -> str:
    return net(body, POINTS, NEAR, WAYS, *more)


def inputs(spark, sf):
    return fx.points(spark, sf), fx.segments(spark, sf)


@query("k1_spatial_join", over("SELECT lrp_id, segment_id, round(d, 6) AS distance_m, round(arc, 6) AS arc FROM near"))
def k1_spatial_join(spark, sf):
    p, s = inputs(spark, sf)
    return candidates.near(p, s, DEFAULT.candidate_search_radius_m).select("lrp_id", "segment_id", R6(F.col("distance_m")).alias("distance_m"), R6(F.col("arc")).alias("arc"))


@query("g3_project_onto_polyline", over("SELECT lrp_id, segment_id, round(px, 6) AS px, round(py, 6) AS py FROM near"))
def g3_project_onto_polyline(spark, sf):
    p, s = inputs(spark, sf)
    return candidates.near(p, s, DEFAULT.candidate_search_radius_m).select("lrp_id", "segment_id", R6(F.col("px")).alias("px"), R6(F.col("py")).alias("py"))


@query("k2_directed", over("SELECT lrp_id, segment_id, traversal, round(arc, 6) AS arc FROM dirs"))
def k2_directed(spark, sf):
    p, s = inputs(spark, sf)
    return candidates.directed(candidates.near(p, s, DEFAULT.candidate_search_radius_m), s).select("lrp_id", "segment_id", "traversal", R6(F.col("arc")).alias("arc"))


@query("k4_snaps", over("SELECT lrp_id, segment_id, traversal, snap_type, round(snap_arc, 6) AS snap_arc, round(snap_distance, 6) AS snap_distance FROM measured"))
def k4_snaps(spark, sf):
    return candidates.evaluated(*inputs(spark, sf)).select("lrp_id", "segment_id", "traversal", "snap_type", R6(F.col("snap_arc")).alias("snap_arc"), R6(F.col("snap_distance")).alias("snap_distance"))


SCORES = ("distance_score", "bearing_score", "frc_score", "fow_score", "interior_score", "wrong_endpoint_score", "total")


@query("k5_scores", over(f"SELECT lrp_id, segment_id, traversal, snap_type, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in SCORES)}, verdict FROM judged"))
def k5_scores(spark, sf):
    return candidates.evaluated(*inputs(spark, sf)).select("lrp_id", "segment_id", "traversal", "snap_type", *[R6(F.col(c)).alias(c) for c in SCORES], "verdict")


@query("k6_gate_counts", over("SELECT verdict, count(*) AS n FROM judged GROUP BY verdict"))
def k6_gate_counts(spark, sf):
    return candidates.evaluated(*inputs(spark, sf)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("k7_best_snap", over("SELECT lrp_id, segment_id, traversal, snap_type, round(total, 6) AS total FROM best"))
def k7_best_snap(spark, sf):
    return candidates.best_snaps(candidates.evaluated(*inputs(spark, sf))).select("lrp_id", "segment_id", "traversal", "snap_type", R6(F.col("total")).alias("total"))


@query(
    "k8_rejected",
    over("SELECT lrp_id, segment_id, traversal, verdict, snap_type FROM (SELECT *, bool_or(verdict='Pass') OVER w AS any_ok, row_number() OVER (PARTITION BY lrp_id, segment_id, traversal ORDER BY CASE verdict WHEN 'FailScore' THEN 0 ELSE 1 END, snap_order DESC) AS k FROM judged WINDOW w AS (PARTITION BY lrp_id, segment_id, traversal)) WHERE NOT any_ok AND k = 1"),
)
def k8_rejected(spark, sf):
    return candidates.rejected(candidates.evaluated(*inputs(spark, sf))).select("lrp_id", "segment_id", "traversal", "verdict", "snap_type")


@query("k9_ranked", over("SELECT lrp_id, CAST(rank AS INTEGER) AS rank, segment_id, traversal, round(total, 6) AS total FROM ranked"))
def k9_ranked(spark, sf):
    return candidates.select_candidates(*inputs(spark, sf)).select("lrp_id", "rank", "segment_id", "traversal", R6(F.col("total")).alias("total"))


@query("k10_first_without", over("SELECT p.lrp_id // 4 AS ref_id, min(p.lrp_id % 4) AS lrp_idx FROM points p WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.lrp_id = p.lrp_id) GROUP BY ALL"))
def k10_first_without(spark, sf):
    p, s = inputs(spark, sf)
    refs = p.select("lrp_id", F.expr("lrp_id div 4").alias("ref_id"), (F.col("lrp_id") % 4).alias("lrp_idx"))
    return candidates.first_without(refs, candidates.select_candidates(p, s))


@query("a6_rejection_breakdown", over("SELECT lrp_id, verdict, count(*) AS n FROM judged WHERE verdict <> 'Pass' GROUP BY ALL"))
def a6_rejection_breakdown(spark, sf):
    return candidates.evaluated(*inputs(spark, sf)).where("verdict != 'Pass'").groupBy("lrp_id", "verdict").agg(F.count("*").alias("n"))


@query("k11_nodes_near", net(f"SELECT lrp_id, node_id, round(d, 6) AS metres FROM (SELECT lrp_id, n.node_id, {hav('p.lon', 'p.lat', 'n.lon_e7/1e7', 'n.lat_e7/1e7')} AS d FROM points p JOIN nodes n ON abs(n.lon_e7/1e7-p.lon) < 0.002 AND abs(n.lat_e7/1e7-p.lat) < 0.002) WHERE d <= 50.0", POINTS))
def k11_nodes_near(spark, sf):
    from waymark.functions import geo
    from waymark.operators.network import CELL

    cell = lambda c, by=0: F.floor((F.col(c) + by) * CELL)
    pad = 50.0 / 60_000.0  # degrees that hold 50 m at latitudes below 57
    p = fx.points(spark, sf).select("lrp_id", "lon", "lat", F.explode(F.sequence(cell("lon", -pad), cell("lon", pad))).alias("cx")).select("*", F.explode(F.sequence(cell("lat", -pad), cell("lat", pad))).alias("cy"))
    n = fx.nodes(spark, sf).select("node_id", F.col("lon").alias("nx"), F.col("lat").alias("ny"), cell("lon").alias("cx"), cell("lat").alias("cy"))
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("nx"), F.col("ny"))
    return p.join(n, ["cx", "cy"]).withColumn("d", d).where("d <= 50").select("lrp_id", "node_id", R6(F.col("d")).alias("metres"))


# the flagship: pairs of points 2k and 2k+1 as two-point lines

PAIRS = """
legs AS (SELECT a.lrp_id // 2 AS ref_id, a.segment_id AS s1, a.traversal AS t1, a.rank AS r1, b.segment_id AS s2, b.traversal AS t2, b.rank AS r2, a.total+b.total AS score,
  CASE WHEN a.segment_id = b.segment_id AND a.traversal = b.traversal AND a.snap_arc <= b.snap_arc THEN b.snap_arc-a.snap_arc
       WHEN CASE WHEN a.traversal='Forward' THEN a.end_node ELSE a.start_node END = CASE WHEN b.traversal='Forward' THEN b.start_node ELSE b.end_node END AND a.segment_id <> b.segment_id THEN greatest(a.length_m-a.snap_arc,0.0)+greatest(least(b.snap_arc,b.length_m),0.0) END AS length_m
  FROM ranked a JOIN ranked b ON b.lrp_id = a.lrp_id+1 AND a.lrp_id % 2 = 0),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score, r1, r2) AS k FROM legs WHERE length_m IS NOT NULL AND length_m <= 300.0) WHERE k = 1)
"""


@query("m3_adjacent_lines", over("SELECT ref_id, s1, t1, s2, t2, round(length_m, 6) AS length_m, round(score, 6) AS score FROM chosen", PAIRS))
def m3_adjacent_lines(spark, sf):
    """Same-segment and adjacent pairs of candidates of two-point lines: the best by score, then ranks, whose length fits."""
    p, s = inputs(spark, sf)
    c = candidates.select_candidates(p, s).join(s.select("segment_id", "length_m"), "segment_id")
    pick = lambda k: [F.col("segment_id").alias(f"s{k}"), F.col("traversal").alias(f"t{k}"), F.col("rank").alias(f"r{k}"), F.col("snap_arc").alias(f"arc{k}"), F.col("total").alias(f"v{k}"), F.col("length_m").alias(f"len{k}")]
    ref = F.expr("lrp_id div 2").alias("ref_id")
    pairs = c.where("lrp_id % 2 = 0").select(ref, *pick(1), F.col("exit_node").alias("out")).join(c.where("lrp_id % 2 = 1").select(ref, *pick(2), F.col("entry_node").alias("into")), "ref_id")
    same = (F.col("s1") == F.col("s2")) & (F.col("t1") == F.col("t2")) & (F.col("arc1") <= F.col("arc2"))
    joined = (F.col("out") == F.col("into")) & (F.col("s1") != F.col("s2"))
    rest, lead = F.greatest(F.col("len1") - F.col("arc1"), F.lit(0.0)), F.greatest(F.least("arc2", "len2"), F.lit(0.0))
    pairs = pairs.withColumn("length_m", F.when(same, F.col("arc2") - F.col("arc1")).when(joined, rest + lead)).withColumn("score", F.col("v1") + F.col("v2")).where("length_m <= 300")
    best = pairs.groupBy("ref_id").agg(F.min_by(F.struct("s1", "t1", "s2", "t2", "length_m", "score"), F.struct("score", "r1", "r2")).alias("b")).select("ref_id", "b.*")
    return best.withColumn("length_m", R6(F.col("length_m"))).withColumn("score", R6(F.col("score")))
