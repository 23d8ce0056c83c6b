"""Whole decodes on small graphs."""

import pytest
from pyspark.sql import functions as F

from tests.test_network import STEP, no_restrictions, roads
from waymark.operators.decode import decode
from waymark.plans.params import DEFAULT, PERMISSIVE

LRPS = "ref_id long, lrp_idx int, lon double, lat double, frc int, fow int, bearing_lb double, bearing_ub double, lfrcnp int, dnp_lb double, dnp_ub double"


def lrp(i, x, y, lb, last=False, ref=1):
    more = (None, None, None) if last else (7, 0.0, 1000.0)
    return (ref, i, x * STEP, y * STEP, 3, 3, lb, lb + 11.25, *more)


def test_zigzag(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (1, 1)], 3, "Both"), (3, 2, 3, [(1, 1), (2, 1)], 3, "Both")])
    points = [lrp(0, 0.5, 0, 84.375), lrp(1, 1, 0.5, 0.0), lrp(2, 1.5, 1, 258.75, True), lrp(0, 50, 50, 0.0, ref=2), lrp(1, 50, 51, 180.0, True, ref=2)]
    got = {r["ref_id"]: r for r in decode(spark.createDataFrame(points, LRPS), s, no_restrictions(spark), PERMISSIVE).collect()}
    assert got[1]["ok"] and got[1]["path"] == [1, 2, 3] and got[1]["length_m"] == pytest.approx(222.4, abs=0.5)
    assert (got[2]["ok"], got[2]["error_code"], got[2]["failed_leg"]) == (False, "NoCandidates", 0)


def test_forced_turn(spark):
    """A way that doubles back at a dead end is refused under the cap and taken without it."""
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (2, 0)], 3, "Both"), (3, 1, 3, [(1, 0), (0, 0.05)], 3, "Both")])
    points = spark.createDataFrame([lrp(0, 0.5, 0, 84.375), lrp(1, 0.2, 0.04, 84.375, True)], LRPS)
    forced = spark.createDataFrame([(1, 0, 1, "Forward", 50.0), (1, 1, 3, "Forward", 90.0)], "ref_id long, lrp_idx int, segment_id long, traversal string, snap_arc double")
    r = decode(points, s, no_restrictions(spark), DEFAULT, forced).first()
    assert r["ok"] and r["path"] == [1, 3]  # one leg: the turn is between its own two ends


def test_one_point_has_no_route(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both")])
    r = decode(spark.createDataFrame([lrp(0, 0.5, 0, 84.375, True)], LRPS), s, no_restrictions(spark)).first()
    assert (r["ok"], r["error_code"]) == (False, "NoRoute")


def test_length_window(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (2, 0)], 3, "Both"), (3, 2, 3, [(2, 0), (3, 0)], 3, "Both")])
    row = lambda lb, ub: [(1, 0, 0.0, 0.0, 3, 3, 84.375, 95.625, 7, lb, ub), lrp(1, 3, 0, 258.75, True)]
    run = lambda lb, ub: decode(spark.createDataFrame(row(lb, ub), LRPS), s, no_restrictions(spark), DEFAULT).select("ok", F.col("error_code"), "path").first()
    assert run(300.0, 360.0)["path"] == [1, 2, 3]
    assert run(900.0, 960.0)["error_code"] == "NoRoute"
