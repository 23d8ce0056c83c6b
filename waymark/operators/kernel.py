"""What a search, a decode and an encode do on a part of the network that one task holds.

Joins alone can't count expansions, stop after so many, try combinations one after another or walk a path until a search leaves
it; these are written here for one reference at a time. `regions` brings each task the references and the roads they need.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

EARTH_M, WINDOW_M, LONGEST_LEG_M = 6_371_000.0, 20.0, 15_000.0
#: Why a way on from a node isn't taken, in the order of the tests.
REASONS = ("FrcBelowLfrcnp", "TurnRestricted", "DirectionBlocked", "SharpTurn", "ExceedsMaxDistance")


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    s, t = math.sin(math.radians(b[1] - a[1]) / 2), math.sin(math.radians(b[0] - a[0]) / 2)
    return 2 * EARTH_M * math.asin(math.sqrt(s * s + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * t * t))


def bearing(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360.0


def point_along(line: list[tuple[float, float]], offset: float) -> tuple[float, float]:
    """The point so many metres along; the last vertex beyond the end."""
    for a, b in zip(line, line[1:], strict=False):
        step = metres(a, b)
        if offset <= step or step < 1e-12:
            t = min(max(offset / step, 0.0), 1.0) if step > 0 else 0.0
            return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
        offset -= step
    return line[-1]


def facing(line: list[tuple[float, float]]) -> float | None:
    """The bearing over the first metres of a line."""
    if len(line) < 2:
        return None
    a, b = line[0], point_along(line, WINDOW_M)
    return bearing(a, line[-1] if math.hypot(a[0] - b[0], a[1] - b[1]) < 1e-12 else b)


class Road:
    """A road. Its line and what one faces at its ends are worked out when a search first asks: of a task's roads it sees few."""

    __slots__ = ("start", "end", "length", "frc", "fow", "direction", "shape", "look")

    def __init__(self, start: int, end: int, length: float, frc: int, fow: int, direction: str, shape):
        self.start, self.end, self.length, self.frc, self.fow, self.direction, self.shape = start, end, length, frc, fow, direction, shape
        self.look: dict[int, float | None] | None = None

    @property
    def line(self) -> list[tuple[float, float]]:
        """Vertices; shape holds them as pairs or as one flat array."""
        if hasattr(self.shape, "tolist"):
            flat = self.shape.tolist()
            self.shape = list(zip(flat[::2], flat[1::2], strict=True))
        return self.shape

    def faces(self, node: int) -> float | None:
        """The bearing into it from one of its ends; None for other nodes."""
        if self.look is None:
            self.look = {self.end: facing(self.line[::-1])}
            self.look[self.start] = facing(self.line)
        return self.look.get(node)

    def other(self, node: int) -> int | None:
        return self.end if node == self.start else self.start if node == self.end else None

    def leaves(self, node: int) -> bool:
        """Whether one may drive into it from the node."""
        return node == self.start and self.direction != "Backward" or node == self.end and self.direction != "Forward"


class Lazy(dict):
    """Filled by a function as keys are asked for; what it gives nothing for isn't there."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        got = self.make(key)
        if not got:
            raise KeyError(key)
        self[key] = got
        return got

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def __contains__(self, key) -> bool:
        return self.get(key) is not None


class Net:
    """Roads by id, what meets at each node, and the turns that are forbidden. `missing`: nodes whose own tile isn't there."""

    def __init__(self, rows: Iterable[dict], banned: Iterable[tuple[int, int, int]] = (), missing: Iterable[int] = ()):
        self.roads: dict[int, Road] = {}
        self.meets: dict[int, list[int]] = defaultdict(list)
        self.xy: dict[int, tuple[float, float]] = {}
        self.banned, self.missing = set(banned), set(missing)
        for r in sorted(rows, key=lambda r: r["segment_id"]):
            s, start, end = r["segment_id"], r["start_node"], r["end_node"]
            self.roads[s] = Road(start, end, r["length_m"], r["frc"], r["fow"], r["direction"], r["line"])
            self.meets[start].append(s)
            if end != start:
                self.meets[end].append(s)

    @classmethod
    def of(cls, ids, start, end, length, frc, fow, direction, offsets, line, banned=(), missing=()) -> Net:
        """From columns (numpy). Road i has line[offsets[i]:offsets[i + 1]]; roads and what meets at a node are made when first asked for."""
        net, order, two = cls((), banned, missing), np.argsort(ids, kind="stable"), end != start
        key, place = ids[order].tolist(), order.tolist()
        nodes, segments = np.concatenate([start, end[two]]), np.concatenate([ids, ids[two]])
        by = np.lexsort((segments, nodes))
        node, there = nodes[by].tolist(), segments[by].tolist()

        def road(s: int) -> Road | None:
            k = bisect_right(key, s) - 1
            if k < 0 or key[k] != s:
                return None
            i = place[k]
            values = (c[i].item() if hasattr(c[i], "item") else c[i] for c in (start, end, length, frc, fow, direction))
            return Road(*values, line[offsets[i] : offsets[i + 1]])

        net.roads, net.meets = Lazy(road), Lazy(lambda n: there[bisect_left(node, n) : bisect_right(node, n)])
        return net

    def place(self, node: int) -> tuple[float, float] | None:
        """Where a node lies, by the first road that meets it."""
        if node not in self.xy and node in self.meets:
            road = self.roads[self.meets[node][0]]
            self.xy[node] = tuple(road.line[-1] if node == road.end else road.line[0])
        return self.xy.get(node)

    def deviation(self, a: int, node: int, b: int) -> float | None:
        """0 straight on, 180 back; None if unknown."""
        seen = [self.roads[s].faces(node) if s in self.roads else None for s in (a, b)]
        if None in seen:
            return None
        turn = abs(seen[0] - seen[1]) % 360.0
        return 180.0 - min(turn, 360.0 - turn)

    def valid(self, node: int) -> bool:
        """Neither a mere corridor between two others nor one without a way to turn."""
        others = [self.roads[s].other(node) for s in self.meets.get(node, ())]
        return len(set(others)) != 2 or len(others) > 2

    def ways(self, node: int, via: int, lfrcnp: int, cap: float) -> Iterator[tuple[int, Road, str | None]]:
        """(segment, road, why not) of everything that goes on from a node but the way back."""
        for s in self.meets.get(node, ()):
            road = self.roads[s]
            if s == via:
                continue
            why = None
            if road.frc > lfrcnp:
                why = REASONS[0]
            elif (via, node, s) in self.banned:
                why = REASONS[1]
            elif not road.leaves(node):
                why = REASONS[2]
            elif cap < 180 and (self.deviation(via, node, s) or 0.0) > cap:
                why = REASONS[3]
            yield s, road, why


def silent(event: str, **fields) -> None:
    pass


@dataclass
class Route:
    segments: list[int]
    length: float


class NeedsTile(Exception):
    """A search came to a node whose own tile isn't there."""


def search(net: Net, via: int, node: int, goal: int, into: int | None, lfrcnp: int, most: float, cap: float, limit: int, emit: Callable = silent) -> Route | None:
    """The shortest way from a node, reached via a segment, to another node, which isn't to be reached by that same segment. A last
    step over `into` (where the way goes on) is left out. States are popped by length so far plus distance to the goal; of equal
    ones the further one, then the larger ids. limit: pops at most, 0 for any number."""
    if node == goal:
        emit("AStarNodeExpanded", node_id=node, via_segment=via, g_m=0.0, h_m=0.0)
        return Route([], 0.0)
    aim = net.place(goal) or (0.0, 0.0)
    far: dict[int, float] = {}

    def left(n: int) -> float:
        if n not in far:
            at = net.place(n)
            far[n] = metres(at, aim) if at else 0.0
        return far[n]

    settled: list[tuple[int, int, float, int]] = []  # node, via, length so far, number of the one before
    best: dict[tuple[int, int], float] = {}
    queue = [(left(node), -0.0, -node, -via, -1)]
    pops, skipped, hit = 0, dict.fromkeys(REASONS, 0), False
    while queue:
        _, g, at, by, before = heapq.heappop(queue)
        g, at, by = -g, -at, -by
        pops += 1
        if limit and pops > limit:
            hit = True
            break
        if best.get((at, by), math.inf) <= g:
            continue
        best[at, by] = g
        settled.append((at, by, g, before))
        here = len(settled) - 1
        emit("AStarNodeExpanded", node_id=at, via_segment=by, g_m=g, h_m=left(at))
        if at == goal and by != via:
            last = settled[here][3] if by == into else here
            length, chain = settled[last][2], []
            while last >= 0:
                chain.append(settled[last][1])
                last = settled[last][3]
            return Route([s for s in reversed(chain) if s != via], length)
        if at in net.missing:
            raise NeedsTile(at)
        for s, road, why in net.ways(at, by, lfrcnp, cap):
            ahead = g + road.length
            why = why or (REASONS[4] if ahead > most else None)
            if why:
                skipped[why] += 1
                emit("AStarEdgeSkipped", from_node=at, segment_id=s, reason=why)
                continue
            head = road.other(at)
            if best.get((head, s), math.inf) > ahead:
                heapq.heappush(queue, (ahead + left(head), -ahead, -head, -s, here))
    emit("AStarTerminated", reason="ExpansionLimitHit" if hit else "OpenSetExhausted", nodes_expanded=pops, **{f"skipped_{k}": v for k, v in skipped.items()})
    return None


# decoding


def by_score(candidates: list[list[dict]]) -> Iterator[tuple[int, ...]]:
    """Places of one candidate for each point, by the sum of their scores; made as they are asked for."""
    if not all(candidates):
        return
    total = lambda c: sum(candidates[k][i]["total"] for k, i in enumerate(c))
    first = (0,) * len(candidates)
    queue, known = [(total(first), tuple(-i for i in first))], {first}
    while queue:
        _, back = heapq.heappop(queue)
        c = tuple(-i for i in back)
        yield c
        for k in range(len(c)):
            if c[k] + 1 < len(candidates[k]):
                further = c[:k] + (c[k] + 1,) + c[k + 1 :]
                if further not in known:
                    known.add(further)
                    heapq.heappush(queue, (total(further), tuple(-i for i in further)))


class Decoder:
    """One reference: its points and their ranked candidates, tried until one combination has a route for every leg."""

    def __init__(self, net: Net, lrps: list[dict], candidates: list[list[dict]], params, emit: Callable = silent):
        self.net, self.lrps, self.candidates, self.params, self.emit = net, lrps, candidates, params, emit
        self.routes: dict[tuple[int, int, int], Route | None] = {}
        self.deepest = 0

    def fits(self, leg: int, length: float) -> bool:
        lb, ub = self.window(leg)
        slack = length * self.params.dnp_tolerance_pct
        ok = lb - slack <= length <= ub + slack
        self.emit("DnpChecked", leg=leg, lb=lb - slack, ub=ub + slack, actual_m=length, passed=ok)
        return ok

    def window(self, leg: int) -> tuple[float, float]:
        lb, ub = self.lrps[leg].get("dnp_lb"), self.lrps[leg].get("dnp_ub")
        return (0.0, LONGEST_LEG_M) if lb is None or ub is None else (lb, ub)

    def route(self, leg: int, a: dict, b: dict) -> Route | None:
        """Between two candidates, as the first pair with the same ends and floor had it."""
        floor = self.lrps[leg].get("lfrcnp")
        lfrcnp = min(7, (7 if floor is None else floor) + self.params.lfrcnp_tolerance)
        key = (a["exit_node"], b["entry_node"], lfrcnp)
        if key not in self.routes:
            self.emit("RouteSearchStarted", leg=leg, from_segment=a["segment_id"], to_segment=b["segment_id"])
            tell = lambda event, **f: self.emit(event, leg=leg, **f)
            most = self.window(leg)[1] * self.params.max_path_search_factor
            self.routes[key] = search(self.net, a["segment_id"], a["exit_node"], b["entry_node"], b["segment_id"], lfrcnp, most, self.params.max_interior_turn_deviation_deg, self.params.max_astar_expansions, tell)
            if self.routes[key] is None:
                self.emit("RouteFailed", leg=leg, reason="NoPathFound")
        return self.routes[key]

    def attempt(self, places: tuple[int, ...]) -> tuple[list[int], list[float]] | int:
        """(path, lengths of the legs), or the leg that fails."""
        picked = [c[i] for c, i in zip(self.candidates, places, strict=True)]
        path: list[int] = []
        lengths: list[float] = []
        walked = None
        for leg, (a, b) in enumerate(zip(picked, picked[1:], strict=False)):
            if a["segment_id"] == b["segment_id"] and a["traversal"] == b["traversal"] and a["snap_arc"] <= b["snap_arc"]:
                length, between, ending = b["snap_arc"] - a["snap_arc"], [], []
                if not self.fits(leg, length):
                    return leg
            else:
                turn = None if walked is None else self.net.deviation(walked, a["entry_node"], a["segment_id"])
                if turn is not None and turn > self.params.max_interior_turn_deviation_deg:
                    self.emit("RouteFailed", leg=leg, reason="SharpBoundaryTurn")
                    return leg
                route = self.route(leg, a, b)
                if route is None:
                    return leg
                rest = max(self.net.roads[a["segment_id"]].length - a["snap_arc"], 0.0)
                length = rest + route.length + min(b["snap_arc"], self.net.roads[b["segment_id"]].length)
                if not self.fits(leg, length):
                    return leg
                between = route.segments
                ending = [b["segment_id"]] if between or b["segment_id"] != a["segment_id"] else []
            tail = [b["segment_id"]] if b["segment_id"] != a["segment_id"] else []
            self.emit("RouteFound", leg=leg, path=[a["segment_id"], *between, *tail], length_m=length)
            path += [*([] if path else [a["segment_id"]]), *between, *ending]
            lengths.append(length)
            walked = between[-1] if between else a["segment_id"]
        if any(x == y for x, y in zip(path, path[1:], strict=False)):
            return 0
        return path, lengths

    def simple_pairs(self) -> Iterator[tuple[int, int]]:
        """Of two points: both near candidates of one segment in order, or end to end."""
        close = self.params.candidate_search_radius_m * 0.25
        for i, a in enumerate(self.candidates[0]):
            for j, b in enumerate(self.candidates[1]):
                same = a["segment_id"] == b["segment_id"] and a["traversal"] == b["traversal"] and a["snap_arc"] <= b["snap_arc"]
                if max(a["snap_distance"], b["snap_distance"]) <= close and (same or a["exit_node"] == b["entry_node"]):
                    yield i, j

    def run(self) -> dict:
        """ok, error_code, failed_leg, places, path, lengths, offsets and what else a result holds."""
        for k, c in enumerate(self.candidates):
            if not c:
                self.emit("DecodeComplete", outcome="NoCandidates", lrp_idx=k)
                return {"ok": False, "error_code": "NoCandidates", "failed_leg": k}
        if len(self.candidates) < 2:
            self.emit("DecodeComplete", outcome="NoRoute", leg=0)
            return {"ok": False, "error_code": "NoRoute", "failed_leg": 0}
        try:
            found, attempts = self.tried()
        except NeedsTile as e:
            return {"ok": False, "error_code": "NeedsTile", "needs_node": e.args[0]}
        if found is None:
            self.emit("DecodeComplete", outcome="NoRoute", leg=self.deepest)
            return {"ok": False, "error_code": "NoRoute", "failed_leg": self.deepest, "attempts": attempts}
        places, (path, lengths) = found
        return self.result(places, path, lengths) | {"attempts": attempts}

    def tried(self):
        attempts = 0

        def go(places, counts=True):
            nonlocal attempts
            attempts += 1
            got = self.attempt(places)
            if isinstance(got, int):
                self.deepest = max(self.deepest, got) if counts else self.deepest
                return None
            return places, got

        if found := go((0,) * len(self.candidates)):
            return found, attempts
        if len(self.candidates) == 2:
            for pair in self.simple_pairs():
                if found := go(pair, False):
                    return found, attempts
        most = self.params.max_routing_attempts
        for n, places in enumerate(by_score(self.candidates)):
            if most and n >= most:
                self.emit("RouteAttemptsExhausted", limit=most, attempted=n)
                break
            if found := go(places):
                return found, attempts
        return None, attempts

    def offset(self, lrp: dict, side: str, leg: float) -> tuple[float, float] | None:
        raw = lrp.get(f"{side}_offset_raw")
        if raw is not None:
            return raw / 256.0 * leg, (raw + 1) / 256.0 * leg
        exact = lrp.get(f"{side}_offset")
        return None if exact is None else (exact, exact)

    def result(self, places: tuple[int, ...], path: list[int], lengths: list[float]) -> dict:
        total = sum(lengths)
        pos, neg = self.offset(self.lrps[0], "pos", lengths[0]), self.offset(self.lrps[-1], "neg", lengths[-1])
        for side, interval in (("pos", pos), ("neg", neg)):
            if interval:
                self.emit("OffsetApplied", is_positive=side == "pos", lb=interval[0], ub=interval[1])
        picked = [c[i] for c, i in zip(self.candidates, places, strict=True)]
        out = {"places": list(places), "path": path, "lengths": lengths, "length_m": total}
        out |= {"pos_lb": pos and pos[0], "pos_ub": pos and pos[1], "neg_lb": neg and neg[0], "neg_ub": neg and neg[1]}
        cut = (pos[0] if pos else 0.0) + (neg[0] if neg else 0.0)
        if (pos or neg) and cut >= total:
            return out | {"ok": False, "error_code": "OffsetOverflow"}
        out |= {"first_arc": picked[0]["snap_arc"], "last_arc": picked[-1]["snap_arc"], "first_way": picked[0]["traversal"], "last_way": picked[-1]["traversal"]}
        self.emit("DecodeComplete", outcome="Success", path=path)
        return out | {"ok": True, "error_code": None}


# encoding


class CannotEncode(Exception):
    """Carries the code and where."""


@dataclass
class Expansion:
    node: int
    metres: float
    segments: list[int]
    stop: str


def expanded(net: Net, node: int, skip: int, at_end: bool, budget: float, cap: float) -> Expansion:
    """From an end of a path outward over corridor nodes. At the end the walk goes with the traffic, at the start against it."""
    out = Expansion(node, 0.0, [], "AlreadyValid")
    while not net.valid(out.node):
        others = [s for s in net.meets.get(out.node, ()) if s != skip]
        open_ = [s for s in others if net.roads[s].leaves(out.node if at_end else net.roads[s].other(out.node))]
        if not open_:
            out.stop = "WrongDirection" if others else "DeadEnd"
            return out
        road = net.roads[open_[0]]
        if out.metres + road.length > budget:
            out.stop = "BudgetExhausted"
            return out
        if (net.deviation(skip, out.node, open_[0]) or 0.0) > cap:
            out.stop = "SharpTurn"
            return out
        out.metres, out.node, skip = out.metres + road.length, road.other(out.node), open_[0]
        out.segments.append(skip)
        out.stop = "ReachedValidNode"
    return out


def end_of(net: Net, node: int, path: list[int], strict: bool = False) -> int:
    """Where a path ends that starts at a node; strict: every segment may be driven that way."""
    for k, s in enumerate(path):
        road = net.roads.get(s)
        if road is None or road.other(node) is None:
            raise CannotEncode("Disconnected", k)
        if strict and not road.leaves(node):
            raise CannotEncode("IllegalDirection", k)
        node = road.other(node)
    return node


def forced(net: Net, node: int, by: int | None, path: list[int], cap: float) -> int:
    """Hops until the first node with a choice, or the end."""
    for k, s in enumerate(path):
        if by is not None and (s == by or cap < 180 and (net.deviation(by, node, s) or 0.0) > cap):
            raise CannotEncode("NoRoute", k)
        node, by = net.roads[s].other(node), s
        if net.valid(node):
            return k + 1
    return len(path)


def legs_of(net: Net, path: list[int], node: int, goal: int, longest: float, cap: float) -> list[tuple[int, list[int]]]:
    """(start node, segments) of each leg: a new one begins where the shortest way from the last choice leaves the path."""
    legs: list[tuple[int, list[int]]] = []
    by = None
    while path:
        upto = forced(net, node, by, path, cap)
        take = len(path)
        if upto < take:
            anchor = end_of(net, node, path[:upto])
            way = search(net, path[upto - 1], anchor, goal, None, 7, math.inf, cap, 0)
            if way is None:
                raise CannotEncode("NoRoute", upto)
            tail = path[upto:]
            agreed = next((k for k, (a, b) in enumerate(zip(tail, way.segments, strict=False)) if a != b), min(len(tail), len(way.segments)))
            if agreed < len(tail):
                valid = [k for k in range(1, agreed + 1) if net.valid(end_of(net, anchor, tail[:k]))]
                take = upto + (valid[-1] if valid else agreed)
        leg, path = path[:take], path[take:]
        if sum(net.roads[s].length for s in leg) > longest:
            raise CannotEncode("LegTooLong", len(legs))
        legs.append((node, leg))
        node, by = end_of(net, node, leg), leg[-1]
    return legs


def point_of(net: Net, node: int, leg: list[int], at_end: bool = False) -> dict:
    """A location reference point from the leg that begins, or from the path that ends, at a node."""
    road = net.roads[leg[-1 if at_end else 0]]
    lon, lat = net.place(node)
    out = {"lon": lon, "lat": lat, "frc": road.frc, "fow": road.fow, "bearing": road.faces(node) or 0.0}
    own = None if at_end else {"lfrcnp": max(net.roads[s].frc for s in leg), "dnp": sum(net.roads[s].length for s in leg)}
    return out | (own or {"lfrcnp": None, "dnp": None})


def encode_line(net: Net, path: list[int], start: int, start_offset: float = 0.0, end_offset: float = 0.0, splits: Iterable[int] = (), cap: float = 150.0, longest: float = LONGEST_LEG_M) -> dict:
    """points, pos_offset, neg_offset, legs, expansions; or error_code and at. splits: places of via points in the path."""
    splits, longest = list(splits), min(longest, LONGEST_LEG_M)
    try:
        if not path:
            raise CannotEncode("EmptyPath", 0)
        end = end_of(net, start, path, strict=True)
        length = lambda part: sum(net.roads[s].length for s in part)
        first_core, last_core = length(path[: splits[0]] if splits else path), length(path[splits[-1] :] if splits else path)
        before = expanded(net, start, path[0], False, max(longest - first_core, 0.0), cap)
        # without via points both ends draw on the one leg's budget
        after = expanded(net, end, path[-1], True, max(longest - last_core - (0.0 if splits else before.metres), 0.0), cap)
        whole = [*reversed(before.segments), *path, *after.segments]
        pos, neg = start_offset + before.metres, end_offset + after.metres
        legs = legs_of(net, whole, before.node, after.node, longest, cap)
        points = [point_of(net, node, leg) for node, leg in legs] + [point_of(net, after.node, legs[-1][1], at_end=True)]
        if pos > 0 and pos >= points[0]["dnp"] or neg > 0 and neg >= points[-2]["dnp"]:
            raise CannotEncode("OffsetExceedsLeg", 0 if pos > 0 and pos >= points[0]["dnp"] else len(legs) - 1)
    except CannotEncode as e:
        return {"error_code": e.args[0], "at": e.args[1]}
    return {"error_code": None, "points": points, "pos_offset": pos if pos > 0 else None, "neg_offset": neg if neg > 0 else None, "legs": [leg for _, leg in legs], "path": whole, "start_stop": before.stop, "end_stop": after.stop, "start_m": before.metres, "end_m": after.metres}


def encode_point(net: Net, segment: int, start: int, offset: float, cap: float = 150.0, longest: float = LONGEST_LEG_M) -> dict:
    """A point so many metres along a segment from one of its nodes: two points, always one leg."""
    longest = min(longest, LONGEST_LEG_M)
    road = net.roads.get(segment)
    if road is None:
        return {"error_code": "UnknownSegment", "at": 0}
    if road.other(start) is None:
        return {"error_code": "UnknownNode", "at": 0}
    if not road.leaves(start):
        return {"error_code": "IllegalDirection", "at": 0}
    before = expanded(net, start, segment, False, max(longest - road.length, 0.0), cap)
    after = expanded(net, road.other(start), segment, True, max(longest - road.length - before.metres, 0.0), cap)
    leg = [*reversed(before.segments), segment, *after.segments]
    points = [point_of(net, before.node, leg), point_of(net, after.node, leg, at_end=True)]
    pos = offset + before.metres
    if points[0]["dnp"] > longest:
        return {"error_code": "LegTooLong", "at": 0}
    if pos >= points[0]["dnp"]:
        return {"error_code": "OffsetExceedsLeg", "at": 0}
    return {"error_code": None, "points": points, "pos_offset": pos if pos > 0 else None, "neg_offset": None, "legs": [leg], "path": leg, "start_stop": before.stop, "end_stop": after.stop, "start_m": before.metres, "end_m": after.metres}


def connection(net: Net, node: int, via: int, goal: int, cap: float) -> dict:
    """Whether a goal is reached under a turn cap, without it, and the turns that the cap forbids."""
    within = search(net, via, node, goal, None, 7, math.inf, cap, 0)
    free = within or search(net, via, node, goal, None, 7, math.inf, 180.0, 0)
    sharp = []
    if free and not within:
        for s in free.segments:
            turn = net.deviation(via, node, s)
            if turn is not None and turn > cap:
                sharp.append({"node": node, "from_segment": via, "to_segment": s, "deviation_deg": turn})
            node, via = net.roads[s].other(node), s
    return {"within_m": within and within.length, "free_m": free and free.length, "blocked": bool(sharp), "sharp": sharp}


# waypoints


def route_waypoints(net: Net, ends: list[list[dict]], cap: float) -> dict | None:
    """The shortest way over waypoints. ends: for each the ways on from it (segment_id, anchor, continuation, offset_m). Between two,
    all pairs are tried together; of more, those in between pass through the nearer end of their road, one leg after another."""

    def way(a: int, via: int, b: int) -> Route | None:
        return search(net, via, a, b, None, 7, math.inf, cap, 0)

    def part(c: dict) -> list[int]:
        return [c["segment_id"]] if c["anchor"] != c["continuation"] else []

    first, last = ends[0], ends[-1]
    best = None

    def beyond(a: dict, b: dict) -> bool:
        """Whether even the straight line between two ways on is longer than the best way so far; roads may be given a little too short."""
        x, y = net.place(a["continuation"]), net.place(b["continuation"])
        return bool(best and x and y) and a["offset_m"] + metres(x, y) * 0.99 - 1.0 + b["offset_m"] >= best[0]

    if len(ends) == 2:
        for a in first:
            for b in last:
                if beyond(a, b):
                    continue
                r = way(a["continuation"], a["segment_id"], b["continuation"])
                total = math.inf if r is None else a["offset_m"] + r.length + b["offset_m"]
                if total < (best[0] if best else math.inf):
                    best = total, a, b, [*part(a), *r.segments, *part(b)], []
    else:
        nodes = [min(e, key=lambda c: c["offset_m"])["anchor"] for e in ends[1:-1]]
        starts = [(a["offset_m"] + r.length, i, a, r) for i, a in enumerate(first) if (r := way(a["continuation"], a["segment_id"], nodes[0]))]
        if not starts:
            return None
        total, _, a, r = min(starts, key=lambda s: s[:2])
        path, splits = [*part(a), *r.segments], []
        for x, y in zip(nodes, nodes[1:], strict=False):
            splits.append(len(path))
            r = way(x, path[-1] if path else -1, y)
            if r is None:
                return None
            path, total = path + r.segments, total + r.length
        splits.append(len(path))
        stops = [(b["offset_m"] + r.length, i, b, r) for i, b in enumerate(last) if (r := way(nodes[-1], path[-1] if path else -1, b["continuation"]))]
        if not stops:
            return None
        more, _, b, r = min(stops, key=lambda s: s[:2])
        best = total + more, a, b, [*path, *r.segments, *part(b)], splits
    if best is None:
        return None
    total, a, b, path, splits = best
    return {"path": path, "start_node": a["anchor"], "start_offset": a["offset_m"], "end_offset": b["offset_m"], "length_m": total, "splits": splits}
