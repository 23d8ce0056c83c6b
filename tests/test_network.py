"""Small graphs: intervals, turns, validity, candidates, shortest paths, trims."""

import json
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, intervals
from waymark.operators import candidates, network, routing
from waymark.plans.params import DEFAULT, PERMISSIVE, merged, resolve

STEP = 0.001


def roads(spark, rows):
    """(segment_id, start, end, [(x, y), ...] in thousandths of a degree at the equator, frc, direction)."""
    data = [(i, a, b, [(x * STEP, y * STEP) for x, y in g], f, 3, d) for i, a, b, g, f, d in rows]
    s = spark.createDataFrame(data, "segment_id long, start_node long, end_node long, geometry array<struct<lon:double,lat:double>>, frc int, fow int, direction string")
    return s.withColumn("length_m", F.round(geo.polyline_length_m(F.col("geometry")), 2))


def no_restrictions(spark):
    return spark.createDataFrame([], "from_seg long, via_node long, to_seg long")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_intervals(spark):
    c = lambda lb, ub, v: one(spark, intervals.circular_contains(F.lit(lb), F.lit(ub), F.lit(v)))
    assert c(350.0, 10.0, 5.0) and not c(350.0, 10.0, 20.0) and c(0.0, 360.0, 123.0)
    assert one(spark, intervals.circular_excess(F.lit(350.0), F.lit(10.0), F.lit(30.0))) == 20.0


def test_hilbert(spark):
    got = [one(spark, geo.hilbert_id(1, F.lit(x), F.lit(y))) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))]
    assert got == [1, 2, 3, 4]
    xs = spark.range(64).select((F.col("id") % 8).alias("x"), F.expr("id div 8").alias("y"))
    ids = {(r["x"], r["y"]): r["d"] for r in xs.select("x", "y", geo.hilbert_id(3, F.col("x"), F.col("y")).alias("d")).collect()}
    assert sorted(ids.values()) == list(range(21, 85))
    order = sorted(ids, key=ids.get)
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(order, order[1:], strict=False))


def test_validity(spark):
    line = [(0, 0), (1, 0)]
    s = roads(spark, [(1, 0, 1, line, 3, "Both"), (2, 1, 2, line, 3, "Forward"), (3, 2, 3, line, 3, "Both"), (4, 2, 4, line, 3, "Both"), (5, 5, 6, line, 3, "Both"), (6, 6, 5, line, 3, "Both"), (7, 6, 7, line, 3, "Both")])
    v = {r["node"]: r["is_valid"] for r in network.node_validity(s).collect()}
    assert v == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True, 6: True, 7: True}


def test_turns(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 2, "Both"), (2, 1, 2, [(1, 0), (2, 0)], 4, "Both"), (3, 1, 3, [(1, 0), (0, 0.2)], 3, "Both"), (4, 4, 1, [(1, 1), (1, 0)], 3, "Forward")])
    t = network.turns(s, no_restrictions(spark)).where("from_seg = 1").cache()
    assert {r["to_seg"] for r in network.successors(t, 3, 180.0).collect()} == {3}
    skipped = {r["to_seg"]: r["reason"] for r in network.successors_skipped(t, 3, 150.0).collect()}
    assert skipped == {2: "FrcBelowLfrcnp", 3: "SharpTurn"}
    assert t.where("to_seg = 2").first()["deviation_deg"] == pytest.approx(0, abs=1e-6)


def ask(spark, rows):
    return spark.createDataFrame(rows, "req_id long, from_seg long, node long, goal long, lfrcnp int, max_dist double, cap double")


def test_shortest_path(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (2, 0)], 3, "Both"), (3, 2, 3, [(2, 0), (3, 0)], 3, "Both"), (4, 1, 3, [(1, 0), (2, 2), (3, 0)], 3, "Both"), (5, 8, 9, [(8, 0), (9, 0)], 3, "Both")])
    t = network.turns(s, no_restrictions(spark))
    r = ask(spark, [(1, 1, 1, 3, 7, 1000.0, 180.0), (2, 1, 1, 9, 7, 5000.0, 180.0), (3, 1, 1, 1, 7, 10.0, 180.0), (4, 1, 1, 3, 2, 1000.0, 180.0), (5, 1, 1, 3, 7, 100.0, 180.0)])
    got = {x["req_id"]: (x["path"], round(x["length_m"])) for x in routing.shortest_paths(r, t).collect()}
    assert got == {1: ([2, 3], 222), 3: ([], 0)}
    banned = spark.createDataFrame([(1, 1, 2)], "from_seg long, via_node long, to_seg long")
    got = {x["req_id"]: x["path"] for x in routing.shortest_paths(r.where("req_id = 1"), network.turns(s, banned)).collect()}
    assert got == {1: [4]}


def test_candidates(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both")])
    point = lambda i, lb, last=False: (i, 0.5 * STEP, 0.0001, 3, 3, lb, lb + 11.25, last)
    p = spark.createDataFrame([point(1, 84.375), point(2, 45.0), point(3, 0.0), point(4, 258.75, True)], "lrp_id long, lon double, lat double, frc int, fow int, bearing_lb double, bearing_ub double, is_last boolean")
    got = {(r["lrp_id"], r["traversal"]): r for r in candidates.select_candidates(p, s).collect()}
    assert (1, "Forward") in got and (1, "Backward") not in got and got[1, "Forward"]["rank"] == 1
    assert got[2, "Forward"]["total"] > got[1, "Forward"]["total"] and (3, "Forward") not in got
    assert got[1, "Forward"]["snap_type"] == "Interior" and (4, "Forward") in got
    wide = merged(DEFAULT, {"max_bearing_deviation_deg": 180.0})
    assert candidates.select_candidates(p, s, wide).where("lrp_id = 3").count() == 2
    assert {r["verdict"] for r in candidates.rejected(candidates.evaluated(p, s)).collect()} == {"FailBearing"}


def test_combinations(spark):
    rows = [(0, 0, 1, 1.0), (0, 0, 2, 3.0), (0, 1, 1, 2.0), (0, 1, 2, 4.0), (0, 2, 1, 0.0), (0, 2, 2, 1.0)]
    r = spark.createDataFrame(rows, "ref_id long, lrp_idx int, rank int, total double")
    two = [x["score"] for x in routing.combinations(r.where("lrp_idx < 2"), 10).orderBy("place").collect()]
    assert two == [3, 5, 5, 7]
    three = [x["score"] for x in routing.combinations(r, 100).orderBy("place").collect()]
    assert len(three) == 8 and three == sorted(three)
    assert [x["score"] for x in routing.combinations(r, 3).orderBy("place").collect()] == three[:3]


def test_dnp_window(spark):
    ok = lambda length, lb, ub: one(spark, routing.dnp_ok(F.lit(length), F.lit(lb), F.lit(ub), 0.25))
    assert ok(530.0, 500.0, 558.6) and not ok(100.0, 500.0, 558.6) and ok(600.0, 500.0, 500.0) and ok(0.0, 0.0, 58.6)


def test_trims(spark):
    path = spark.createDataFrame([(1, k, k, 100.0) for k in range(3)], "ref_id long, step int, segment_id long, length_m double")
    cut = lambda pos, neg: tuple(routing.coverage(path, spark.createDataFrame([(1, pos, neg)], "ref_id long, pos double, neg double")).first() or ())
    assert cut(120.0, 0.0) == (1, 1, 2, 20.0, 0.0) and cut(0.0, 115.0) == (1, 0, 1, 0.0, 15.0)
    assert cut(100.0, 0.0)[1] == 0 and cut(200.0, 150.0) == ()


def test_expansion(spark):
    corridor = [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (2, 0)], 3, "Both"), (3, 2, 3, [(2, 0), (3, 0)], 3, "Both"), (4, 3, 4, [(3, 0), (3, 1)], 3, "Both"), (5, 3, 5, [(3, 0), (4, 0)], 3, "Both")]
    e = spark.createDataFrame([(1, 1, 1)], "ref_id long, node long, via long")
    r = routing.expanded(e, roads(spark, corridor), 1000.0, 150.0).first()
    assert (r["node"], r["hops"], r["stop"]) == (3, 2, "Valid")
    assert routing.expanded(e, roads(spark, corridor), 150.0, 150.0).first()["stop"] == "OverBudget"
    wrong = [*corridor[:1], (2, 1, 2, [(1, 0), (2, 0)], 3, "Backward"), *corridor[2:]]
    assert routing.expanded(e, roads(spark, wrong), 1000.0, 150.0).first()["stop"] == "WrongDirection"


def test_params():
    assert resolve(None) is DEFAULT and resolve("Permissive") is PERMISSIVE
    given = asdict(DEFAULT) | {"max_candidates_per_lrp": 3}
    for left_out in ("max_routing_attempts", "max_candidate_score"):
        del given[left_out]
    assert resolve(json.dumps(given)).max_candidates_per_lrp == 3
    with pytest.raises(ValueError, match="missing"):
        resolve('{"max_candidates_per_lrp": 3}')
    assert DEFAULT.frc_penalty_table[2][5] == 0.45
    with pytest.raises(ValueError, match="unknown"):
        merged(DEFAULT, {"nope": 1})
