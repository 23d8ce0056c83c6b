"""Decodes and encodes one reference at a time on the roads around it, with the event log of what was tried."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import v3
from waymark.operators import candidates as cand
from waymark.operators import kernel, nearby, waypoints
from waymark.operators.regions import on_network, with_blocks
from waymark.plans.params import DEFAULT, DecodeParams
from waymark.plans.tables import settled

EVENT = "seq int, event string, leg int, info string"
FULL = ("AStarNodeExpanded", "AStarEdgeSkipped", "CandidateEvaluated")
CANDIDATE = ("segment_id", "traversal", "snap_arc", "snap_distance", "snap_lon", "snap_lat", "snap_type", "total", "entry_node", "exit_node")
RESULT = (
    "ok boolean, error_code string, failed_leg int, needs_node bigint, attempts int, places array<int>, path array<bigint>, lengths array<double>, length_m double, "
    "pos_lb double, pos_ub double, neg_lb double, neg_ub double, first_arc double, last_arc double, first_way string, last_way string"
)
PINS = "array<struct<lrp_idx:int,segment_id:bigint,traversal:string,snap_arc:double>>"
OFFSETS = ("pos_offset_raw", "neg_offset_raw", "pos_offset", "neg_offset")


def with_offsets(lrps: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("int" if c.endswith("raw") else "double") for c in OFFSETS if c not in lrps.columns}
    return lrps.withColumns(missing) if missing else lrps


def asked(lrps: DataFrame, segments: DataFrame, params: DecodeParams = DEFAULT, forced: DataFrame | None = None) -> DataFrame:
    """References with their candidates as on_network() takes them; a table that decodes with other limits may share."""
    last = F.max("lrp_idx").over(Window.partitionBy("ref_id"))
    wanted = ("lon", "lat", "frc", "fow", "bearing_lb", "bearing_ub", "is_last")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wanted]
    keyed = F.concat_ws(":", *said) if forced is None else F.concat_ws(":", "ref_id", "lrp_idx")  # points that ask for the same share candidates
    points = settled(with_offsets(lrps).withColumn("is_last", F.col("lrp_idx") == last).withColumn("lrp_id", keyed))
    if forced is None:
        c = cand.select_candidates(points.select("lrp_id", *wanted).distinct(), segments, params).select("lrp_id", "rank", *CANDIDATE)
    else:
        c = forced_candidates(forced, segments).select(F.concat_ws(":", "ref_id", "lrp_idx").alias("lrp_id"), F.lit(1).alias("rank"), *CANDIDATE)
    own = c.groupBy("lrp_id").agg(F.sort_array(F.collect_list(F.struct("rank", *CANDIDATE))).alias("candidates"))
    attributes = ("lon", "lat", "frc", "fow", "bearing_lb", "bearing_ub", "lfrcnp", "dnp_lb", "dnp_ub", *OFFSETS)
    leg = F.when(~F.col("is_last"), F.when(F.col("dnp_lb").isNull() | F.col("dnp_ub").isNull(), kernel.LONGEST_LEG_M).otherwise(F.col("dnp_ub")))  # none begins at the last point
    each = points.join(own, "lrp_id", "left").select("ref_id", "lon", "lat", leg.alias("leg"), F.struct("lrp_idx", F.struct(*attributes).alias("lrp"), F.coalesce("candidates", F.array().cast(own.schema["candidates"].dataType)).alias("candidates")).alias("p"))
    reach = F.coalesce(F.max("leg"), F.lit(0.0)) * params.max_path_search_factor + params.candidate_search_radius_m
    return each.groupBy("ref_id").agg(F.to_json(F.sort_array(F.collect_list("p"))).alias("payload"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), reach.alias("reach_m"))


def decode_log(lrps: DataFrame, segments: DataFrame, restrictions: DataFrame, params: DecodeParams = DEFAULT, forced: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """ref_id, seq, event, leg, info (JSON): all events of every decode, and its result as the last row (event Result).

    lrps: ref_id, lrp_idx (from 0), lon, lat, frc, fow, bearing_lb, bearing_ub, lfrcnp, dnp_lb, dnp_ub and, where there are any,
    pos_offset_raw, neg_offset_raw, pos_offset, neg_offset. forced gives the one candidate of each point: ref_id, lrp_idx,
    segment_id, traversal, snap_arc. missing: node, those whose own tile isn't there. Levels: Off keeps the result alone, Summary leaves out single expansions and edges.
    """
    return log_of(asked(lrps, segments, params, forced), segments, restrictions, params, missing)


def text_of(event: str, fields: dict) -> str:
    """JSON as json.dumps() writes it; of the two events that come in millions without its detours."""
    if event == "AStarNodeExpanded":
        return '{"node_id": %r, "via_segment": %r, "g_m": %r, "h_m": %r}' % tuple(fields.values())
    if event == "AStarEdgeSkipped":
        return '{"from_node": %r, "segment_id": %r, "reason": "%s"}' % tuple(fields.values())
    return json.dumps(fields)


def log_of(refs: DataFrame, segments: DataFrame, restrictions: DataFrame, params: DecodeParams = DEFAULT, missing: DataFrame | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """decode_log() from references with their candidates, which must be those of the same params but for limits of the search, or
    from references as read() gives them, whose candidates are chosen where they are decoded."""
    level = params.trace_level

    def choose(roads: dict, payloads: list[list[dict]]) -> None:
        bare = [p for payload in payloads for p in payload if "candidates" not in p]
        if bare:
            chosen = nearby.Chooser(roads, params).candidates([p["lrp"] | {"is_last": p["is_last"]} for p in bare])
            for p, c in zip(bare, chosen, strict=True):
                p["candidates"] = c

    def decode(net: kernel.Net, payload: list[dict]) -> Iterator[tuple]:
        log: list[tuple] = []

        def emit(event: str, leg: int | None = None, **fields) -> None:
            if level == "Full" or level == "Summary" and event not in FULL:
                log.append((len(log), event, leg, text_of(event, fields)))

        lists = [p["candidates"] for p in payload]
        for k, c in enumerate(lists):
            emit("CandidatesRanked", lrp_idx=k, accepted=[x["segment_id"] for x in c])
        got = kernel.Decoder(net, [p["lrp"] for p in payload], lists, params, emit).run()
        picked = [c[i] for c, i in zip(lists, got.get("places", []), strict=False)]
        got["snaps"] = [[p.get("snap_lon"), p.get("snap_lat")] for p in picked]
        chosen = got.get("places") or [0] * len(lists)
        got["pins"] = [{"lrp_idx": p["lrp_idx"]} | {k: c[i][k] for k in ("segment_id", "traversal", "snap_arc")} for p, c, i in zip(payload, lists, chosen, strict=True) if c]
        yield from log
        yield len(log), "Result", None, json.dumps(got)

    return on_network(refs, segments, restrictions, decode, EVENT, missing, tiles, choose)


def forced_candidates(forced: DataFrame, segments: DataFrame) -> DataFrame:
    """ref_id, lrp_idx and the candidate that each pin names; unknown words for the traversal mean Forward, pins on unknown roads
    are dropped here (validate_forced() says so)."""
    back = F.col("traversal") == "Backward"
    f = forced.join(segments.select("segment_id", "start_node", "end_node"), "segment_id")
    return f.select(
        "ref_id", "lrp_idx", "segment_id", F.when(back, "Backward").otherwise("Forward").alias("traversal"), "snap_arc", F.lit(0.0).alias("snap_distance"), F.lit(None).cast("double").alias("snap_lon"), F.lit(None).cast("double").alias("snap_lat"), F.lit("Interior").alias("snap_type"),
        F.lit(0.0).alias("total"), F.when(back, F.col("end_node")).otherwise(F.col("start_node")).alias("entry_node"), F.when(back, F.col("start_node")).otherwise(F.col("end_node")).alias("exit_node"),
    )


def validate_forced(forced: DataFrame, points: DataFrame, segments: DataFrame) -> DataFrame:
    """ref_id, error_code (null: may be decoded): one pin for each point, on roads that are there."""
    n = points.groupBy("ref_id").agg(F.count_distinct("lrp_idx").alias("n"))
    known = forced.join(segments.select("segment_id", F.lit(True).alias("there")), "segment_id", "left")
    k = known.groupBy("ref_id").agg(F.count("*").alias("pins"), F.count_distinct("lrp_idx").alias("pinned"), F.count("there").alias("there"))
    code = F.when(F.coalesce("pinned", F.lit(0)) != F.col("n"), "CandidateCount").when(F.col("pins") != F.col("n"), "CandidateCount").when(F.col("there") < F.col("pins"), "UnknownSegment")
    return n.join(k, "ref_id", "left").select("ref_id", code.alias("error_code"))


def results(log: DataFrame) -> DataFrame:
    """One row a reference from its log."""
    return log.where("event = 'Result'").select("ref_id", F.from_json("info", RESULT).alias("r")).select("ref_id", "r.*")


def pins_of(log: DataFrame) -> DataFrame:
    """ref_id, lrp_idx, segment_id, traversal, snap_arc, as decode_log() takes them: the candidate that each point was decoded with
    or, where no combination has a route, its first one. A point without candidates has no pin."""
    p = log.where("event = 'Result'").select("ref_id", F.from_json("info", f"pins {PINS}").alias("r"))
    return p.select("ref_id", F.explode("r.pins").alias("p")).select("ref_id", "p.*")


def events(log: DataFrame) -> DataFrame:
    return log.where("event != 'Result'")


def strings_of(refs: DataFrame) -> DataFrame:
    """Typed points of references in the v3 format. refs: ref_id, ref (base64). ref_id, lrp_idx and the columns of decode_log()."""
    b = v3.with_bytes(refs.select("ref_id", F.try_to_binary("ref", F.lit("base64")).alias("raw")), "raw", "b")
    return b.select("ref_id", F.posexplode(v3.lrps(F.col("b"))).alias("lrp_idx", "p")).select("ref_id", "lrp_idx", "p.*")


def read(refs: DataFrame, params: DecodeParams = DEFAULT) -> DataFrame:
    """References for log_of() with their blocks, from strings in the v3 format; what can't be read is left out. refs: ref_id,
    ref (base64), an id once. Decodes with the same radius and search factor may share them."""
    b = v3.with_bytes(refs.select("ref_id", F.try_to_binary("ref", F.lit("base64")).alias("raw")), "raw", "b")
    p = b.select("ref_id", F.explode(F.array(v3.lrps(F.col("b")))).alias("p")).where("size(p) > 0")
    kept = ", ".join(f"'{c}', x.{c}" for c in ("lon", "lat", "frc", "fow", "bearing_lb", "bearing_ub", "lfrcnp", "dnp_lb", "dnp_ub", "pos_offset_raw", "neg_offset_raw"))
    payload = f"to_json(transform(p, (x, i) -> named_struct('lrp_idx', i, 'is_last', i = size(p) - 1, 'lrp', named_struct({kept})))) AS payload"
    leg = f"if(x.dnp_lb IS NULL OR x.dnp_ub IS NULL, {kernel.LONGEST_LEG_M}D, x.dnp_ub)"  # none begins at the last point
    reach = f"coalesce(array_max(transform(slice(p, 1, size(p) - 1), x -> {leg})), 0D) * {params.max_path_search_factor}D + {params.candidate_search_radius_m}D AS reach_m"
    box = [f"array_{f}(transform(p, x -> x.{c})) AS {c}{k}" for c in ("lon", "lat") for k, f in enumerate(("min", "max"))]
    return with_blocks(p.selectExpr("ref_id", payload, *box, reach))


# encoding

POINTS = "array<struct<lon:double,lat:double,frc:int,fow:int,bearing:double,lfrcnp:int,dnp:double>>"
ENCODED = f"error_code string, at int, points {POINTS}, pos_offset double, neg_offset double, legs array<array<bigint>>, path array<bigint>, start_stop string, end_stop string, start_m double, end_m double"


def encoded(paths: DataFrame, segments: DataFrame, restrictions: DataFrame, cap: float = 150.0, longest: float = kernel.LONGEST_LEG_M, tiles: DataFrame | None = None) -> DataFrame:
    """ref_id and the columns of ENCODED. paths: ref_id, path array<bigint>, start_node, start_offset, end_offset and, where there are
    any, splits array<int> (places of via points in the path) and kind ('line' or 'point': a point start_offset metres along the
    path's one segment)."""
    more = {"splits": F.array().cast("array<int>"), "kind": F.lit("line")}
    p = paths.withColumns({c: v for c, v in more.items() if c not in paths.columns})
    on = p.select("ref_id", F.explode("path").alias("segment_id")).join(segments.select("segment_id", "length_m", "geometry"), "segment_id")
    edge = lambda f, axis: f(F.transform("geometry", lambda v: v[axis]))
    box = on.groupBy("ref_id").agg(F.min(edge(F.array_min, "lon")).alias("lon0"), F.max(edge(F.array_max, "lon")).alias("lon1"), F.min(edge(F.array_min, "lat")).alias("lat0"), F.max(edge(F.array_max, "lat")).alias("lat1"), (F.sum("length_m") + F.lit(float(longest))).alias("reach_m"))
    nowhere = {c: F.coalesce(c, F.lit(0.0)) for c in ("lon0", "lon1", "lat0", "lat1", "reach_m")}
    refs = p.join(box, "ref_id", "left").withColumns(nowhere).select("ref_id", "lon0", "lon1", "lat0", "lat1", "reach_m", F.to_json(F.struct("path", "start_node", "start_offset", "end_offset", "splits", "kind")).alias("payload"))

    def encode(net: kernel.Net, r: dict) -> Iterator[tuple]:
        start, pos = r.get("start_node"), r.get("start_offset") or 0.0
        if r["kind"] == "point":
            got = kernel.encode_point(net, r["path"][0], start, pos, cap, longest)
        else:
            got = kernel.encode_line(net, r["path"], start, pos, r.get("end_offset") or 0.0, r["splits"], cap, longest)
        yield (json.dumps(got),)

    out = on_network(refs, segments, restrictions, encode, "info string", tiles=tiles)
    return out.select("ref_id", F.from_json("info", ENCODED).alias("r")).select("ref_id", "r.*")


def v3_string(points: Column, pos: Column, neg: Column) -> Column:
    """Encoded points as a base64 string."""
    own = F.transform(points, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["frc"].alias("frc"), p["fow"].alias("fow"), p["lfrcnp"].alias("lfrcnp"), p["bearing"].alias("bearing_lb"), p["dnp"].alias("dnp_lb")))
    return F.base64(v3.worked_out(own, lambda p: v3.encode_line(p, pos, neg)))


def diagnosed(asks: DataFrame, segments: DataFrame, restrictions: DataFrame, cap: float, reach_m: float) -> DataFrame:
    """ref_id, within_m, free_m, blocked, n_sharp: whether a node is reached under the turn cap, or only without it. asks: ref_id,
    from_node, from_seg, to_node, lon0, lat0, lon1, lat1 (the box of both ends)."""

    def ask(net: kernel.Net, r: dict) -> Iterator[tuple]:
        got = kernel.connection(net, r["from_node"], r["from_seg"], r["to_node"], cap)
        yield got["within_m"], got["free_m"], got["blocked"], len(got["sharp"]), json.dumps(got["sharp"])

    refs = asks.select("ref_id", "lon0", "lat0", "lon1", "lat1", F.lit(float(reach_m)).alias("reach_m"), F.to_json(F.struct("from_node", "from_seg", "to_node")).alias("payload"))
    return on_network(refs, segments, restrictions, ask, "within_m double, free_m double, blocked boolean, n_sharp int, sharp string")


def routed(asks: DataFrame, segments: DataFrame, restrictions: DataFrame, cap: float, limit: int = 0) -> DataFrame:
    """ref_id, length_m, path, pops, reason: the best-first search, goal-directed, under a bound of length and of expansions. asks:
    ref_id, from_seg, node, goal, lfrcnp, max_dist, lon0, lat0, lon1, lat1."""

    def ask(net: kernel.Net, r: dict) -> Iterator[tuple]:
        seen = {"pops": 0}

        def emit(event: str, **f) -> None:
            seen["pops"] += event == "AStarNodeExpanded"
            if event == "AStarTerminated":
                seen.update(f)

        way = kernel.search(net, r["from_seg"], r["node"], r["goal"], None, r["lfrcnp"], r["max_dist"], cap, limit, emit)
        yield way and way.length, way and way.segments, seen["pops"], None if way else seen["reason"]

    refs = asks.select("ref_id", "lon0", "lat0", "lon1", "lat1", F.col("max_dist").alias("reach_m"), F.to_json(F.struct("from_seg", "node", "goal", "lfrcnp", "max_dist")).alias("payload"))
    return on_network(refs, segments, restrictions, ask, "length_m double, path array<bigint>, pops int, reason string")



def expanded_ends(ends: DataFrame, segments: DataFrame, restrictions: DataFrame, budget: float, cap: float) -> DataFrame:
    """ref_id, side, node, hops, metres, stop: both ends of paths moved out to valid nodes. ends: ref_id, at_end, node, via, lon, lat."""

    def walk(net: kernel.Net, r: dict) -> Iterator[tuple]:
        e = kernel.expanded(net, r["node"], r["via"], r["at_end"], budget, cap)
        yield "end" if r["at_end"] else "start", e.node, len(e.segments), e.metres, e.stop

    refs = ends.select("ref_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lit(float(budget)).alias("reach_m"), F.to_json(F.struct("node", "via", "at_end")).alias("payload"))
    return on_network(refs, segments, restrictions, walk, "side string, node bigint, hops int, metres double, stop string")


def traced_ends(paths: DataFrame, segments: DataFrame, restrictions: DataFrame) -> DataFrame:
    """ref_id, node, error_code, at: where paths end, or the first segment that doesn't connect or may not be driven that way. paths:
    ref_id, path, start_node, lon0, lat0, lon1, lat1."""

    def trace(net: kernel.Net, r: dict) -> Iterator[tuple]:
        try:
            yield kernel.end_of(net, r["start_node"], r["path"], strict=True), None, None
        except kernel.CannotEncode as e:
            yield None, *e.args

    refs = paths.select("ref_id", "lon0", "lat0", "lon1", "lat1", F.lit(500.0).alias("reach_m"), F.to_json(F.struct("start_node", "path")).alias("payload"))
    return on_network(refs, segments, restrictions, trace, "node bigint, error_code string, at int")


ROUTED = "path array<bigint>, start_node bigint, start_offset double, end_offset double, length_m double, splits array<int>"


def routed_waypoints(points: DataFrame, segments: DataFrame, restrictions: DataFrame, cap: float = 150.0, reach_m: float = 3_000.0) -> DataFrame:
    """ref_id and the columns of ROUTED, nulls where there is no way or a waypoint has no road near. points: ref_id, idx, lon, lat."""
    keyed = points.withColumn("lrp_id", F.concat_ws(":", "ref_id", "idx"))
    ways = waypoints.boundaries(keyed, segments).groupBy("lrp_id").agg(F.sort_array(F.collect_list(F.struct("anchor", "continuation", "segment_id", "offset_m"))).alias("ways"))
    p = keyed.join(ways, "lrp_id", "left").select("ref_id", "lon", "lat", F.struct("idx", F.coalesce("ways", F.array().cast(ways.schema["ways"].dataType)).alias("ways")).alias("p"))
    refs = p.groupBy("ref_id").agg(F.to_json(F.sort_array(F.collect_list("p"))).alias("payload"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.lit(float(reach_m)).alias("reach_m"))

    def route(net: kernel.Net, payload: list[dict]) -> Iterator[tuple]:
        ends = [p["ways"] for p in payload]
        got = kernel.route_waypoints(net, ends, cap) if len(ends) > 1 and all(ends) else None
        yield (json.dumps(got or {}),)

    out = on_network(refs, segments, restrictions, route, "info string")
    return out.select("ref_id", F.from_json("info", ROUTED).alias("r")).select("ref_id", "r.*")


def decode_with_tiles(lrps: DataFrame, segments: DataFrame, restrictions: DataFrame, edge_nodes: DataFrame, loaded: DataFrame, params: DecodeParams = DEFAULT, rounds: int = 20) -> DataFrame:
    """Results where only some tiles are there. edge_nodes: node, tile_id of nodes at the edge of their tile; loaded: tile_id. A search
    that comes to a node whose tile isn't loaded asks for it; its reference is decoded again with that tile, `rounds` times at most,
    and keeps the error NeedsTile after that. Adds tiles_loaded."""
    edge, have, todo, done = settled(edge_nodes), settled(loaded.select("tile_id").distinct()), settled(asked(lrps, segments, params)), None
    for n in range(rounds + 1):
        missing = edge.join(have, "tile_id", "left_anti").select("node")
        r = settled(results(log_of(todo, segments, restrictions, params, missing)).withColumn("tiles_loaded", F.lit(n)))
        stuck = r.where("error_code = 'NeedsTile'").select("ref_id", F.col("needs_node").alias("node"))
        last = n == rounds or stuck.isEmpty()
        part = r if last else r.join(stuck.select("ref_id"), "ref_id", "left_anti")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        have = settled(have.unionByName(stuck.join(edge, "node").select("tile_id")).distinct())
        todo = settled(todo.join(stuck.select("ref_id"), "ref_id", "left_semi"))
