"""The search, decodes and encodes on small graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_decode import LRPS, lrp
from tests.test_network import STEP, no_restrictions, roads
from waymark.operators import exact, kernel
from waymark.plans.params import DEFAULT, PERMISSIVE, merged


def net(rows, banned=(), missing=()):
    """(segment, start, end, [(x, y) in thousandths of a degree], frc, direction)."""
    out = []
    for i, a, b, g, f, d in rows:
        line = [(x * STEP, y * STEP) for x, y in g]
        out.append({"segment_id": i, "start_node": a, "end_node": b, "line": line, "frc": f, "fow": 3, "direction": d, "length_m": round(sum(kernel.metres(p, q) for p, q in zip(line, line[1:], strict=False)), 2)})
    return kernel.Net(out, banned, missing)


def chain(*lengths, direction="Both"):
    """Nodes 0, 1, 2... in line, segments 1, 2, 3... of so many metres."""
    x, rows = 0.0, []
    for k, n in enumerate(lengths):
        y = x + n / 111.19492664455873
        rows.append((k + 1, k, k + 1, [(x, 0), (y, 0)], 3, direction))
        x = y
    return rows


def test_search():
    n = net(chain(100, 100))
    find = lambda via, a, b, **k: kernel.search(n, via, a, b, None, 7, k.get("most", 1e9), 150.0, k.get("limit", 0))
    assert find(0, 0, 2).segments == [1, 2] and find(0, 0, 2).length == pytest.approx(200, abs=0.1)
    assert find(1, 0, 0).segments == [] and find(1, 1, 2).segments == [2]
    assert find(0, 0, 9) is None and find(0, 0, 2, most=150.0) is None and find(0, 0, 2, limit=1) is None
    assert kernel.search(n, 0, 0, 2, 2, 7, 1e9, 150.0, 0).segments == [1]  # the last step is the segment the way goes on
    said = []
    kernel.search(n, 0, 0, 9, None, 2, 1e9, 150.0, 0, lambda e, **f: said.append((e, f)))
    assert said[-1][0] == "AStarTerminated" and said[-1][1]["skipped_FrcBelowLfrcnp"] == 1 and said[-1][1]["reason"] == "OpenSetExhausted"
    with pytest.raises(kernel.NeedsTile):
        kernel.search(net(chain(100, 100), missing=[1]), 0, 0, 2, None, 7, 1e9, 150.0, 0)
    assert kernel.search(net(chain(100, 100), banned=[(1, 1, 2)]), 0, 0, 2, None, 7, 1e9, 150.0, 0) is None


def test_combination_order():
    rng = random.Random(1)
    lists = [[{"total": t} for t in sorted(rng.random() for _ in range(n))] for n in (3, 4, 2)]
    got = list(kernel.by_score(lists))
    sums = [sum(lists[k][i]["total"] for k, i in enumerate(c)) for c in got]
    assert len(set(got)) == 24 and sums == sorted(sums) and list(kernel.by_score([lists[0], []])) == []


def test_expansion_stops():
    t = [(9, 1, 9, [(100 / 111.19492664455873, 0), (100 / 111.19492664455873, 1)], 3, "Both")]
    go = lambda rows, node, skip, at_end=True, budget=15_000.0, cap=150.0: kernel.expanded(net(rows), node, skip, at_end, budget, cap)
    assert go(chain(60, 100, 60), 0, 1).stop == "AlreadyValid"
    e = go(chain(60, 100, 60), 1, 1)
    assert (e.stop, e.segments, e.node) == ("ReachedValidNode", [2, 3], 3) and e.metres == pytest.approx(160, abs=0.1)
    assert go(chain(60, 100, 60), 1, 1, budget=120.0).segments == [2] and go(chain(60, 100, 60), 1, 1, budget=120.0).stop == "BudgetExhausted"
    one_way = [*chain(60), (2, 2, 1, [(200 / 111.19492664455873, 0), (60 / 111.19492664455873, 0)], 3, "Forward")]
    assert go(one_way, 1, 1).stop == "WrongDirection" and go(one_way, 1, 1, at_end=False).segments == [2]
    back = [*chain(60), (2, 1, 2, [(60 / 111.19492664455873, 0), (0, 0.01)], 3, "Both")]
    assert go(back, 1, 1).stop == "SharpTurn" and t


def test_encode_budgets():
    """A corridor of 60, 100 and 60 m: how far the ends move follows from the longest leg."""
    n = net(chain(60, 100, 60))
    dnp = lambda longest, f=lambda m: kernel.encode_line(n, [2], 1, 0.0, 0.0, (), 150.0, m): f(longest)
    assert dnp(15_000.0)["points"][0]["dnp"] == pytest.approx(220, abs=0.1) and dnp(15_000.0)["pos_offset"] == pytest.approx(60, abs=0.1)
    assert dnp(150.0)["points"][0]["dnp"] == pytest.approx(100, abs=0.1) and dnp(175.0)["points"][0]["dnp"] == pytest.approx(160, abs=0.1)
    assert dnp(50.0)["error_code"] == "LegTooLong"
    point = lambda m, at=10.0: kernel.encode_point(n, 2, 1, at, 150.0, m)
    assert point(15_000.0)["points"][0]["dnp"] == pytest.approx(220, abs=0.1) and point(15_000.0)["pos_offset"] == pytest.approx(70, abs=0.1)
    assert point(150.0)["points"][0]["dnp"] == pytest.approx(100, abs=0.1) and point(50.0)["error_code"] == "LegTooLong"
    assert point(150.0, 100.0)["error_code"] == "OffsetExceedsLeg" and kernel.encode_point(n, 7, 1, 0.0)["error_code"] == "UnknownSegment" and kernel.encode_point(n, 2, 0, 0.0)["error_code"] == "UnknownNode"
    wrong = net(chain(60, 100, 60, direction="Backward"))
    assert kernel.encode_line(wrong, [1, 2], 0)["error_code"] == "IllegalDirection" and kernel.encode_point(wrong, 2, 1, 0.0)["error_code"] == "IllegalDirection"
    assert kernel.encode_line(n, [1, 3], 0) == {"error_code": "Disconnected", "at": 1} and kernel.encode_line(n, [], 0)["error_code"] == "EmptyPath"
    assert kernel.encode_line(n, [1, 2, 3], 0, 230.0)["error_code"] == "OffsetExceedsLeg"


def test_sweep():
    """One leg where the shortest way is the path, a second one where a shortcut leaves it at a junction."""
    path = [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (1, 1), (2, 1)], 3, "Both"), (3, 2, 3, [(2, 1), (3, 1)], 3, "Both"), (8, 1, 8, [(1, 0), (1, -3)], 3, "Both"), (9, 2, 9, [(2, 1), (2, 4)], 3, "Both")]
    assert [leg for _, leg in kernel.legs_of(net(path), [1, 2, 3], 0, 3, 15_000.0, 150.0)] == [[1, 2, 3]]
    short = [*path, (4, 1, 3, [(1, 0), (3, 1)], 3, "Both")]
    assert [leg for _, leg in kernel.legs_of(net(short), [1, 2, 3], 0, 3, 15_000.0, 150.0)] == [[1], [2, 3]]
    attributes = kernel.point_of(net([(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (3, 0)], 5, "Both")]), 0, [1, 2])
    assert (attributes["frc"], attributes["lfrcnp"], round(attributes["bearing"])) == (3, 5, 90) and attributes["dnp"] == pytest.approx(333.6, abs=0.1)


def test_connection():
    rows = [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (2, 0)], 3, "Both"), (3, 2, 3, [(2, 0), (0.5, 0.4)], 3, "Both")]
    got = kernel.connection(net(rows), 1, 1, 3, 150.0)
    assert got["within_m"] is None and got["free_m"] > 250 and got["blocked"] and [t["node"] for t in got["sharp"]] == [2]
    assert kernel.connection(net(rows), 1, 1, 3, 175.0)["within_m"] == got["free_m"] and kernel.connection(net(rows), 1, 1, 77, 150.0)["free_m"] is None


def test_decode_log(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (1, 1)], 3, "Both"), (3, 2, 3, [(1, 1), (2, 1)], 3, "Both")])
    points = [lrp(0, 0.5, 0, 84.375), lrp(1, 1, 0.5, 0.0), lrp(2, 1.5, 1, 258.75, True), lrp(0, 50, 50, 0.0, ref=2), lrp(1, 50, 51, 180.0, True, ref=2), lrp(0, 0.5, 0, 84.375, True, ref=3)]
    log = exact.decode_log(spark.createDataFrame(points, LRPS), s, no_restrictions(spark), merged(PERMISSIVE, {"trace_level": "Full"})).cache()
    got = {r["ref_id"]: r for r in exact.results(log).collect()}
    assert got[1]["ok"] and got[1]["path"] == [1, 2, 3] and got[1]["length_m"] == pytest.approx(222.4, abs=0.5) and len(got[1]["lengths"]) == 2
    assert (got[2]["error_code"], got[2]["failed_leg"]) == ("NoCandidates", 0) and got[3]["error_code"] == "NoRoute"
    seen = {r["event"] for r in log.where("ref_id = 1").collect()}
    assert {"CandidatesRanked", "RouteSearchStarted", "AStarNodeExpanded", "RouteFound", "DnpChecked", "DecodeComplete", "Result"} <= seen
    off = exact.decode_log(spark.createDataFrame(points[:3], LRPS), s, no_restrictions(spark), merged(PERMISSIVE, {"trace_level": "Off"}))
    assert [r["event"] for r in off.collect()] == ["Result"]


def test_decode_sharp_boundary(spark):
    """The way into the second point's road doubles back: refused under the cap, taken without it."""
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (3, 1, 3, [(1, 0), (0, 0.05)], 3, "Both"), (4, 3, 4, [(0, 0.05), (-1, 0.05)], 3, "Both")])
    points = spark.createDataFrame([lrp(0, 0.5, 0, 84.375), lrp(1, 1, 0, 270.0), lrp(2, -0.5, 0.05, 84.375, True)], LRPS)
    pins = spark.createDataFrame([(1, 0, 1, "Forward", 55.0), (1, 1, 3, "Forward", 10.0), (1, 2, 4, "x", 55.0)], "ref_id long, lrp_idx int, segment_id long, traversal string, snap_arc double")
    run = lambda cap: exact.results(exact.decode_log(points, s, no_restrictions(spark), merged(DEFAULT, {"max_interior_turn_deviation_deg": cap}), pins)).first()
    sharp, loose = run(150.0), run(180.0)
    assert (sharp["ok"], sharp["error_code"], sharp["failed_leg"]) == (False, "NoRoute", 1)
    assert loose["ok"] and loose["path"] == [1, 3, 4] and len(loose["lengths"]) == 2
    codes = exact.validate_forced(pins.where("lrp_idx < 2").union(spark.createDataFrame([(2, 0, 99, "Forward", 0.0)], pins.schema)), points.unionByName(points.where("lrp_idx = 0").withColumn("ref_id", F.lit(2).cast("long"))), s)
    assert {r["ref_id"]: r["error_code"] for r in codes.collect()} == {1: "CandidateCount", 2: "UnknownSegment"}


def test_offsets_and_overflow(spark):
    s = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (2, 0)], 3, "Both")])
    both = LRPS + ", pos_offset_raw int, neg_offset_raw int"
    row = lambda ref, pos, neg: [(*lrp(0, 0, 0, 84.375, ref=ref), pos, None), (*lrp(1, 2, 0, 258.75, True, ref=ref), None, neg)]
    got = {r["ref_id"]: r for r in exact.results(exact.decode_log(spark.createDataFrame(row(1, 64, None) + row(2, 200, 100), both), s, no_restrictions(spark))).collect()}
    assert got[1]["ok"] and got[1]["pos_lb"] == pytest.approx(got[1]["length_m"] / 4) and got[1]["neg_lb"] is None
    assert got[2]["error_code"] == "OffsetOverflow" and got[2]["path"] == [1, 2]


def test_encode_on_network(spark):
    s = roads(spark, chain(60, 100, 60))
    paths = spark.createDataFrame([(1, [2], 1, 5.0, 0.0, "line"), (2, [2], 1, 5.0, 0.0, "point"), (3, [77], 1, 0.0, 0.0, "line")], "ref_id long, path array<bigint>, start_node long, start_offset double, end_offset double, kind string")
    got = {r["ref_id"]: r for r in exact.encoded(paths, s, no_restrictions(spark)).collect()}
    assert got[1]["path"] == [1, 2, 3] and got[1]["pos_offset"] == pytest.approx(65, abs=0.1) and got[1]["start_stop"] == "ReachedValidNode"
    assert got[2]["pos_offset"] == pytest.approx(65, abs=0.1) and got[3]["error_code"] == "Disconnected" and json.dumps(got[1]["legs"]) == "[[1, 2, 3]]"
