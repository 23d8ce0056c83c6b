"""What a review of larger and odder tables found."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.plans import catalog


def both(spark, folder, name):
    """Rows of a query and of its SQL."""
    c = duckdb.connect()
    for t in ("part", "orders", "events"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    got = sorted(map(tuple, df.collect()), key=repr)
    return got, sorted(c.execute(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall(), key=repr)


def lengths(spark, monkeypatch, module, ref_id, parts, rng):
    """One path with these lengths, in any order of rows; in some the sum of doubles is above or below the real one."""
    rows = [(ref_id, m) for m in rng.sample(parts, len(parts))]
    monkeypatch.setattr(module, "path", lambda s, sf: spark.createDataFrame(rows, "ref_id long, length_m double").coalesce(1))


def test_an_offset_of_the_very_length_is_beyond_its_leg(spark, monkeypatch):
    from waymark.plans import more_queries as m

    parts = [140.37, 134.58, 135.88, 129.05, 133.58, 140.54]
    rng, said = random.Random(1), set()
    for _ in range(6):
        lengths(spark, monkeypatch, m, 6214, parts, rng)
        said.add(m.e13_offset_bounds(spark, "").first()["beyond"])
    assert said == {"first"}


def test_a_length_at_the_edge_of_its_window_fits(spark, monkeypatch):
    from waymark.plans import routing_queries as m

    parts, rng, said = [33.68, 74.37, 41.35, 25.3, 137.8], random.Random(2), set()
    for _ in range(8):
        lengths(spark, monkeypatch, m, 1141912, parts, rng)
        said.add(m.r13_validate_dnp(spark, "").first()["ok"])
    assert said == {True}


@pytest.fixture(scope="module")
def north(spark, tmp_path_factory):
    """Walks so far north that a segment east is shorter than the distances asked for."""
    folder = tmp_path_factory.mktemp("north")
    c = duckdb.connect()
    c.execute(f"copy (select i as p_partkey, (i%50)::INTEGER as p_size from range(620000) t(i)) to '{folder}/part.parquet'")
    c.execute(f"copy (select i as o_orderkey from range(619000, 619300) t(i)) to '{folder}/orders.parquet'")
    c.execute(f"copy (select i as event_id from range(619000, 619100) t(i)) to '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize("name", ["o5_path_band", "o6_point_at_distance", "o9_point_of_offset", "a26_segments_near"])
def test_queries_in_the_north(spark, north, name):
    got, wanted = both(spark, north, name)
    assert got == wanted and len(got) > 100


def test_drawings_round_like_c(spark):
    from waymark.operators import shapes

    values = [16.25, 16.75, 0.35, 0.25, 0.05, 99.95, 0.0, 100.0, 33.349999999999994, 2.675, *[random.Random(3).random() * 100 for _ in range(50)]]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", shapes.fixed(F.col("v"), 1).alias("a"), shapes.fixed(F.col("v"), 7).alias("b"))
    for r in df.collect():
        assert (r["a"], r["b"]) == (f"{r['v']:.1f}", f"{r['v']:.7f}")
    line = [(0.0, 0.0), (16.25, 50.0), (0.0, 100.0)]
    p = spark.createDataFrame([(1, line)], "ref_id long, geometry array<struct<lon:double,lat:double>>")
    assert shapes.drawing(p).first()["d"] == "M 0.0 100.0 L 16.2 50.0 L 0.0 0.0"


def test_walks_alike_are_encoded_and_decoded_once(spark, monkeypatch):
    from waymark.operators import candidates, exact
    from waymark.plans import exact_queries as q

    sf, asked, select = "/root/testdata/sf0.001", [], candidates.select_candidates
    kinds = q.paths(spark, sf).drop("ref_id").distinct().count()
    assert kinds < q.paths(spark, sf).count() == q.e1_encode_line(spark, sf).count()
    assert q.encoded(spark, sf).count() == kinds
    monkeypatch.setattr(candidates, "select_candidates", lambda points, *more: asked.append(points.count()) or select(points, *more))
    refs = q.strings(spark, sf).orderBy("ref_id").limit(3).localCheckpoint()
    twice = refs.unionByName(refs.withColumn("ref_id", F.col("ref_id") + 1_000_000)).localCheckpoint()
    r = exact.results(exact.decode_log(exact.strings_of(twice), *q.map_of(spark, sf), q.FULL)).withColumn("ref_id", F.col("ref_id") % 1_000_000).groupBy("ref_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_json(F.struct("path", "lengths"))).alias("kinds")).collect()
    assert [(x["n"], x["kinds"]) for x in r] == [(2, 1)] * 3 and asked[0] <= exact.strings_of(refs).count()


def test_equal_requests_are_searched_once(spark, monkeypatch):
    from waymark.plans import routing_queries as m

    sf, asked, search = "/root/testdata/sf0.001", [], m.routing.shortest_paths
    monkeypatch.setattr(m.routing, "shortest_paths", lambda requests, turns: asked.append(requests.count()) or search(requests, turns))
    rows, r = m.r12_shortest_path(spark, sf).count(), m.requests(spark, sf)
    assert asked[0] == r.drop("req_id").distinct().count() < r.count()
    assert rows > asked[0]


def test_segments_near_are_ranked_where_they_are_joined(spark):
    """No shuffle by point: pairs were many times the input on disk."""
    plan = catalog.QUERIES["a26_segments_near"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lrp_id" not in plan


def test_a_net_works_out_no_road_that_nothing_asks_for(monkeypatch):
    """A task holds tens of thousands of roads, its searches see a few of them."""
    from tests.test_exact import chain, net
    from waymark.operators import kernel

    asked, facing = [], kernel.facing
    monkeypatch.setattr(kernel, "facing", lambda line: asked.append(line) or facing(line))
    n = net(chain(*[100] * 50))
    assert not asked
    assert kernel.search(n, 1, 1, 3, None, 7, 1e9, 150.0, 0).segments == [2, 3] and len(asked) < 20
    ring = kernel.Net([{"segment_id": 1, "start_node": 5, "end_node": 5, "line": [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], "frc": 3, "fow": 3, "direction": "Both", "length_m": 9.0}])
    assert ring.place(5) == (0.0, 0.0) and ring.meets[5] == [1] and ring.roads[1].faces(5) == 90.0 and ring.place(6) is None


def test_references_are_worked_out_once(spark):
    """Not for the size of their blocks and again for what is in them."""
    from waymark.operators import regions

    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    refs = spark.range(40).selectExpr("id as ref_id", "'{}' as payload", "13.0 as lon0", "52.0 as lat0", "13.01 as lon1", "52.01 as lat1", "500.0 as reach_m")
    blocks = regions.with_blocks(refs.mapInArrow(tell, refs.schema))
    assert blocks.count() == 40 and blocks.select("part").distinct().count() == 1 and seen.value == 40


def test_a_radius_is_as_wide_in_the_north(spark):
    """25 m east of a point at 88 degrees are more degrees than a cell is wide; at home a point asks for the cells of its radius alone."""
    from waymark.operators import candidates

    line = lambda x, y: [{"lon": x, "lat": y}, {"lon": x, "lat": y + 0.001}]
    s = spark.createDataFrame([(1, line(13.0064, 88.0)), (2, line(13.0085, 88.0)), (3, line(13.0003, 52.0)), (4, line(13.0005, 52.0))], "segment_id long, geometry array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(1, 13.0, 88.0005), (2, 13.0, 52.0005), (3, 13.0009, 52.0005)], "lrp_id long, lon double, lat double")
    assert sorted((r["lrp_id"], r["segment_id"]) for r in candidates.near(p, s, 30.0).collect()) == [(1, 1), (2, 3), (3, 4)]


def test_walks_of_a_kind_are_those_asked_for(spark, tmp_path):
    """Paths made once a kind are those made walk by walk, also for orders that come twice, which count as the SQL of the walks counts them."""
    from waymark.plans import exact_queries as q
    from waymark.plans import fixtures as fx

    c = duckdb.connect()
    c.execute(f"copy (select * from '/root/testdata/sf0.001/part.parquet') to '{tmp_path}/part.parquet'")
    c.execute(f"copy (select i as o_orderkey from range(3000) t(i) union all select 1200 union all select 2401 union all select null) to '{tmp_path}/orders.parquet'")
    sf = str(tmp_path)
    by_walk = fx.walks(spark, sf).groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("step", "segment_id"))).alias("p"), F.min_by("start_node", "step").alias("start_node"))
    wanted = {(r["ref_id"], tuple(x["segment_id"] for x in r["p"]), r["start_node"]) for r in by_walk.collect()}
    got = q.paths(spark, sf)
    assert {(r["ref_id"], tuple(r["path"]), r["start_node"]) for r in got.collect()} == wanted and got.count() == len(wanted) > 500
    assert all(r["start_offset"] == r["ref_id"] % 50 and r["end_offset"] == r["ref_id"] % 40 for r in got.collect())
    assert q.walked(spark, sf).count() == got.drop("ref_id").distinct().count() < got.count()


def test_ways_that_cannot_be_shorter_are_not_searched(monkeypatch):
    """Between two waypoints four pairs of ways on are there; the straight line rules out those that lead away."""
    from tests.test_exact import chain, net
    from waymark.operators import kernel

    n, asked, search = net(chain(500, 500, 500, 500)), [], kernel.search
    on = lambda s, at: [{"segment_id": s, "anchor": s - 1, "continuation": s, "offset_m": 500.0 - at}, {"segment_id": s, "anchor": s, "continuation": s - 1, "offset_m": at}]
    monkeypatch.setattr(kernel, "search", lambda *a: asked.append(a[2:4]) or search(*a))
    got = kernel.route_waypoints(n, [on(1, 400.0), on(4, 100.0)], 150.0)
    assert len(asked) == 2 and got["path"] == [1, 2, 3, 4] and got["length_m"] == pytest.approx(1200, abs=0.1)


def test_candidates_are_chosen_once(spark, monkeypatch):
    """Not again for decodes of the same strings under other limits, nor in each round of tiles."""
    from waymark.operators import candidates
    from waymark.plans import exact_queries as q

    sf, asked, select = "/root/testdata/sf0.001", [], candidates.select_candidates
    monkeypatch.setattr(candidates, "select_candidates", lambda *a: asked.append(1) or select(*a))
    monkeypatch.setattr(q, "_made", {})
    assert q.a12_spliced_log(spark, sf).count() and len(asked) == 1
    rounds = {r["tiles_loaded"]: r["n"] for r in q.r19_tiles_on_demand(spark, sf).groupBy("tiles_loaded").agg(F.sum("n").alias("n")).collect()}
    assert max(rounds) > 0 and len(asked) == 2


def test_a_net_from_columns_is_the_net_of_its_rows():
    """Loops, ways alike, banned turns, missing nodes and lines of any length; what isn't there isn't there."""
    import numpy as np

    from waymark.operators import kernel

    rng, rows = random.Random(5), []
    for s in rng.sample(range(900), 300):
        line = [(rng.random(), rng.random()) for _ in range(rng.randint(2, 5))]
        rows.append({"segment_id": s, "start_node": rng.randrange(60), "end_node": rng.randrange(60), "length_m": rng.random() * 90, "frc": rng.randrange(8), "fow": 3, "direction": rng.choice(["Both", "Forward", "Backward"]), "line": line})
    banned = [(rows[0]["segment_id"], rows[0]["end_node"], s["segment_id"]) for s in rows[:40]]
    a = kernel.Net(rows, banned, [7])
    column = [np.array([r[c] for r in rows]) for c in ("segment_id", "start_node", "end_node", "length_m", "frc", "fow", "direction")]
    b = kernel.Net.of(*column, np.cumsum([0] + [2 * len(r["line"]) for r in rows]), np.array([x for r in rows for xy in r["line"] for x in xy]), banned, [7])
    assert not b.roads and not b.meets and b.missing == a.missing and b.roads.get(1000) is None and 1000 not in b.roads and b.place(99) is None
    for node in range(60):
        assert a.place(node) == b.place(node) and list(a.meets.get(node, ())) == list(b.meets.get(node, ()))
        for via in a.meets.get(node, ()):
            tell = lambda n: [(s, r.start, r.end, r.length, r.frc, r.direction, why) for s, r, why in n.ways(node, via, 5, 100.0)]  # noqa: B023, E731
            assert tell(a) == tell(b)


def test_roads_reach_a_task_packed_by_tile(spark):
    """A row for hundreds of roads, not a row for each road and block; nothing that the box of a block touches is left out."""
    import pyarrow as pa

    from waymark.operators import kernel, regions
    from waymark.plans import exact_queries as q
    from waymark.plans.tables import settled

    s, no = q.map_of(spark, "/root/testdata/sf0.01")
    far = s.limit(1).selectExpr("900000000L as segment_id", "start_node", "end_node", "transform(geometry, v -> named_struct('lon', v.lon + if(v = geometry[0], -3D, 0D), 'lat', v.lat)) as geometry", *s.columns[4:])
    refs = spark.range(40).selectExpr("id as ref_id", "'{}' as payload", "13.0 + id % 2 as lon0", "52.0 as lat0", "13.01 + id % 2 as lon1", "52.01 as lat1", "500.0 as reach_m")
    rows = regions.roads_of(regions.with_blocks(refs), settled(regions.packed(s.unionByName(far), no)))
    assert 1 <= rows.count() < s.count() / 10
    net = regions.net_of(pa.Table.from_batches(rows.select("roads").toArrow().to_batches()))
    inside = [r[0] for r in s.where("geometry[0].lon between 12.99 and 13.02 and geometry[0].lat between 51.99 and 52.014").select("segment_id").collect()]
    assert inside and all(x in net.roads for x in [*inside, 900000000]) and isinstance(net, kernel.Net)
    got = regions.on_network(refs, s, no, lambda net, r: iter([(net.place(200) is not None, None)]), "there boolean, nothing double").collect()
    assert sorted((r["ref_id"], r["there"], r["nothing"]) for r in got) == [(i, i % 2 == 0, None) for i in range(40)]


def test_only_edges_within_the_radius_are_dealt_out(spark):
    """Points far from a long segment of many edges; arcs are counted over all edges before."""
    from waymark.functions import geo
    from waymark.operators import candidates

    line = [(13.0 + 0.0001 * k, 52.0 + 0.00001 * (k % 3)) for k in range(40)]
    s = spark.createDataFrame([(1, line), (2, line[::-1])], "segment_id long, geometry array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(k, 13.0 + 0.0001 * k + 0.00003, 52.0001) for k in range(38)], "lrp_id long, lon double, lat double")
    found = candidates.near(p, s, 30.0)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.join(s, "segment_id").select("*", geo.polyline_length_m(F.col("geometry")).alias("whole"), geo.interpolate(F.col("geometry"), F.col("arc")).alias("at")).collect()
    assert len(rows) == 76 and all(r["seg_length"] == r["whole"] and abs(r["at"]["lon"] - r["px"]) < 1e-9 and abs(r["at"]["lat"] - r["py"]) < 1e-9 for r in rows)


def test_the_last_point_asks_for_no_roads_beyond_its_reference(spark):
    """It has no leg; taken for one of the longest, it had every task load the roads of 75 km around."""
    from waymark.operators import exact
    from waymark.plans import exact_queries as q

    sf = "/root/testdata/sf0.001"
    points = exact.strings_of(q.strings(spark, sf))
    longest = {r["ref_id"]: r["m"] for r in points.groupBy("ref_id").agg(F.max("dnp_ub").alias("m")).collect()}
    got = {r["ref_id"]: r["reach_m"] for r in q.asked(spark, sf).collect()}
    assert got and all(v == longest[k] * 5.0 + 30.0 < 20_000.0 for k, v in got.items())
    some = points.limit(1).withColumn("lrp_idx", F.lit(0))
    none = [F.lit(None).cast("double").alias(c) if c in ("dnp_lb", "dnp_ub") else F.col(c) for c in points.columns]
    more = some.select(*none).unionByName(some.withColumn("lrp_idx", F.lit(1))).localCheckpoint()
    assert exact.asked(more, q.map_of(spark, sf)[0]).first()["reach_m"] == 75_030.0  # a leg of unknown length may be the longest
    assert exact.asked(some, q.map_of(spark, sf)[0]).first()["reach_m"] == 30.0


def test_roads_are_packed_once_and_lie_in_several_files(spark, monkeypatch):
    """Encodes and decodes of one map share its tiles; a table in one file is read by one task."""
    from waymark.operators import regions
    from waymark.plans import exact_queries as q

    sf, asked, packed = "/root/testdata/sf0.001", [], regions.packed
    monkeypatch.setattr(regions, "packed", lambda *a: asked.append(1) or packed(*a))
    monkeypatch.setattr(q, "_made", {})
    assert q.a12_spliced_log(spark, sf).count() and len(asked) == 1
    assert len(q.map_of(spark, sf)[0].inputFiles()) > 1


def test_strings_are_read_and_written_from_values_worked_out_once(spark):
    """The points of a line and the type of a binary were worked out again at every use: plans of hundreds of kilobytes."""
    from waymark.operators import exact

    refs = spark.createDataFrame([(1, "CwRbWyNG9RpsCQCb/jsbtAT/6/+jK1kE")], "ref_id long, ref string")
    read = exact.strings_of(refs)
    assert [r["lrp_idx"] for r in read.orderBy("lrp_idx").collect()] == [0, 1, 2]
    own = F.array(*[F.struct(F.lit(13.0 + k / 1000).alias("lon"), F.lit(52.0).alias("lat"), F.lit(3).alias("frc"), F.lit(3).alias("fow"), F.lit(90.0).alias("bearing"), F.lit(4).alias("lfrcnp"), F.lit(100.0).alias("dnp")) for k in range(3)])
    none = F.lit(None).cast("double")
    written = spark.range(1).repartition(1).select(exact.v3_string(F.when(F.col("id") >= 0, own), none, none).alias("ref"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert plan(written).count("transform") <= 2 and written.first()["ref"].startswith("C")
    assert plan(read).count("AccessPoint") < 40


def test_candidates_chosen_in_a_task_are_those_that_joins_find(spark):
    """Bent, one-way, doubled and closed roads; points near ends, inside and out of reach, at any bearing, first and last ones."""
    import numpy as np

    from waymark.functions import geo
    from waymark.operators import candidates, nearby
    from waymark.plans.params import DEFAULT, PERMISSIVE, merged

    rng, rows = random.Random(5), []
    spot = lambda: (13 + rng.randrange(40) / 1e4, 52 + rng.randrange(40) / 1e4)
    for i in range(60):
        line = [spot() for _ in range(rng.choice([2, 2, 3, 5, 9]))]
        if i % 7 == 0:
            line.append(line[0])
        if i % 11 == 0:
            line.insert(1, line[0])
        rows.append((i, 2 * i, 2 * i if i % 7 == 0 else 2 * i + 1, line, rng.randrange(8), rng.randrange(8), rng.choice(["Both", "Forward", "Backward"])))
    rows.append((60, *rows[1][1:]))
    s = spark.createDataFrame(rows, "segment_id long, start_node long, end_node long, geometry array<struct<lon:double,lat:double>>, frc int, fow int, direction string").withColumn("length_m", F.round(geo.polyline_length_m(F.col("geometry")), 2))
    points = []
    for i in range(400):
        x, y = rng.choice(rng.choice(rows)[3]) if i % 3 else spot()
        b = rng.randrange(32) * 11.25
        points.append((str(i), x + rng.randrange(-20, 20) / 1e5, y + rng.randrange(-20, 20) / 1e5, rng.randrange(8), rng.randrange(8), b, b + 11.25, i % 2 == 1))
    names = ("lrp_id", "lon", "lat", "frc", "fow", "bearing_lb", "bearing_ub", "is_last")
    p = spark.createDataFrame(points, "lrp_id string, lon double, lat double, frc int, fow int, bearing_lb double, bearing_ub double, is_last boolean")
    one = lambda k: np.array([r[k] for r in rows], dtype=object if k == 6 else np.int64)
    roads = {"segment_id": one(0), "start_node": one(1), "end_node": one(2), "frc": one(4), "fow": one(5), "direction": one(6), "offsets": np.cumsum([0] + [2 * len(r[3]) for r in rows]), "line": np.array([c for r in rows for v in r[3] for c in v])}
    for params in (DEFAULT, PERMISSIVE, merged(DEFAULT, {"max_candidates_per_lrp": 0, "snap_to_endpoint_threshold_m": 0.0})):
        want = {}
        for r in sorted(candidates.select_candidates(p, s, params).collect(), key=lambda r: r["rank"]):
            want.setdefault(r["lrp_id"], []).append(r.asDict())
        got = nearby.Chooser(roads, params).candidates([dict(zip(names, x, strict=True)) for x in points])
        assert sum(map(len, got)) > 300
        for x, found in zip(points, got, strict=True):
            expected = want.get(x[0], [])
            for c in found:
                other = next(w for w in expected if (w["segment_id"], w["traversal"]) == (c["segment_id"], c["traversal"]))
                assert (c["snap_type"], c["entry_node"], c["exit_node"]) == (other["snap_type"], other["entry_node"], other["exit_node"])
                assert [c[k] for k in ("snap_arc", "snap_distance", "snap_lon", "snap_lat", "total")] == pytest.approx([other[k] for k in ("snap_arc", "snap_distance", "snap_lon", "snap_lat", "total")], rel=1e-9, abs=1e-7)
            # in the same order, but for totals that differ by their last digits
            assert len(found) == len(expected) and [c["total"] for c in found] == pytest.approx([w["total"] for w in expected], abs=1e-9)


def test_strings_decode_alike_with_candidates_from_joins_and_from_tasks(spark):
    from waymark.operators import exact
    from waymark.plans import exact_queries as q

    sf = "/root/testdata/sf0.001"
    s, no = q.map_of(spark, sf)
    from_joins = exact.asked(exact.strings_of(q.strings(spark, sf)), s, q.STRICT)
    want, got = (exact.results(exact.log_of(r, s, no, q.STRICT, tiles=q.tiles_of(spark, sf))).select("ref_id", "ok", "error_code", "failed_leg", "attempts", "places", "path") for r in (from_joins, exact.read(q.strings(spark, sf), q.STRICT)))
    want, got = (sorted(map(tuple, x.collect())) for x in (want, got))
    assert want == got and len(want) > 100
    broken = spark.createDataFrame([(1, "???"), (2, ""), (3, None), (4, "AAAA")], "ref_id long, ref string")
    assert exact.read(broken).count() == 0


def test_every_reference_is_decoded_with_all_its_points_pinned(spark):
    """Those of more than two points and those without a route were left out."""
    from waymark.operators import exact
    from waymark.plans import exact_queries as q

    sf = "/root/testdata/sf0.001"
    free = q.for_all(spark, sf, exact.results(q.log_of(spark, sf))).select("ref_id", "ok", F.size("places").alias("n")).localCheckpoint()
    assert free.where("n > 2").count() > 50 and free.where("not ok").count() > 0
    got = q.r17_forced_decode(spark, sf).collect()
    assert sum(r["n"] for r in got) == free.count() == q.for_all(spark, sf, q.strings(spark, sf)).count()
    assert sum(r["n"] for r in got if r["ok"]) == free.where("ok").count() and all(r["same"] for r in got)


def test_pins_are_the_candidates_of_the_decode(spark):
    """Also of the points in between; where there is no route the first ones, and none for a point without candidates."""
    from tests.test_exact import LRPS, lrp, no_restrictions, roads
    from waymark.operators import exact
    from waymark.plans.params import PERMISSIVE

    s, no = roads(spark, [(1, 0, 1, [(0, 0), (1, 0)], 3, "Both"), (2, 1, 2, [(1, 0), (1, 1)], 3, "Both"), (3, 2, 3, [(1, 1), (2, 1)], 3, "Both"), (4, 4, 5, [(9, 0), (10, 0)], 3, "Both")]), no_restrictions(spark)
    way = lambda ref: [lrp(0, 0.5, 0, 84.375, ref=ref), lrp(1, 1, 0.5, 0.0, ref=ref)]
    points = spark.createDataFrame([*way(1), lrp(2, 1.5, 1, 258.75, True), *way(2), lrp(2, 9.5, 0, 258.75, True, ref=2), *way(3), lrp(2, 50, 50, 0.0, True, ref=3)], LRPS)
    log = exact.decode_log(points, s, no, PERMISSIVE).localCheckpoint()
    assert {r["ref_id"]: r["error_code"] for r in exact.results(log).collect()} == {1: None, 2: "NoRoute", 3: "NoCandidates"}
    pins = exact.pins_of(log).localCheckpoint()
    assert sorted((r["ref_id"], r["lrp_idx"], r["segment_id"]) for r in pins.collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1), (2, 1, 2), (2, 2, 4), (3, 0, 1), (3, 1, 2)]
    told = lambda x: sorted((r["ref_id"], r["error_code"], r["path"], r["lengths"]) for r in exact.results(x).collect())
    assert told(exact.decode_log(points, s, no, PERMISSIVE, pins)) == told(log)
