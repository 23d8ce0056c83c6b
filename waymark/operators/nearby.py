"""The candidates of many points at once, on the columns of the roads that one task holds.

The same snaps, scores, gates and order as `candidates` gives, for points whose attributes are all known. There every point meets
the whole map by joins; here a task has the roads around its references anyway, so no candidate has to travel.
"""

from __future__ import annotations

import numpy as np

from waymark.operators.kernel import EARTH_M, WINDOW_M
from waymark.operators.network import CELL
from waymark.plans.params import DecodeParams

#: Points that meet their cells at once; bounds what is held of pairs.
AT_ONCE = 1_024


def metres(lon1, lat1, lon2, lat2):
    s, t = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * np.arcsin(np.sqrt(s * s + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * t * t))


def bearing(lon1, lat1, lon2, lat2):
    a, b, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    return np.mod(np.degrees(np.arctan2(np.sin(d) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d))) + 360.0, 360.0)


def turned(x):
    """x modulo a whole turn, from 0 on."""
    r = np.fmod(x, 360.0)
    return np.where(r < 0, np.fmod(r + 360.0, 360.0), r)


def spread(starts, counts):
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i after one another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Shapes:
    """Edges of roads. Road i has the vertices line[offsets[i]:offsets[i + 1]], longitudes and latitudes in turn."""

    def __init__(self, offsets: np.ndarray, line: np.ndarray):
        at, self.x, self.y = offsets.astype(np.int64) // 2, line[0::2], line[1::2]
        self.first, self.last = at[:-1], at[1:] - 1
        self.n = np.maximum(self.last - self.first, 0)
        self.edge = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        v = spread(self.first, self.n)
        self.ax, self.ay, self.bx, self.by = self.x[v], self.y[v], self.x[v + 1], self.y[v + 1]
        self.len = metres(self.ax, self.ay, self.bx, self.by)
        # added up one by one from either end, as walking does
        self.before, self.total, self.back = np.zeros(len(v)), np.zeros(len(self.n)), np.zeros(len(self.n))
        rows = np.flatnonzero(self.n)
        for k in range(int(self.n.max(initial=0))):
            rows = rows[self.n[rows] > k]
            e = self.edge[rows] + k
            self.before[e] = self.total[rows]
            self.total[rows] += self.len[e]
            self.back[rows] += self.len[self.edge[rows] + self.n[rows] - 1 - k]
        cells = lambda f, a, b: np.floor(f(a, b) * CELL).astype(np.int64)
        self.x0, self.x1, self.y0, self.y1 = cells(np.minimum, self.ax, self.bx), cells(np.maximum, self.ax, self.bx), cells(np.minimum, self.ay, self.by), cells(np.maximum, self.ay, self.by)
        self.cell_of, cx, cy = cells_of(self.x0, self.x1, self.y0, self.y1)
        self.key = cx << 32 | cy & 0xFFFFFFFF
        order = np.argsort(self.key, kind="stable")
        self.cell_of, self.key = self.cell_of[order], self.key[order]

    def along(self, road, back, offset):
        """Where one is after so many metres; the last vertex beyond the end."""
        x, y = self.x[np.where(back, self.first[road], self.last[road])], self.y[np.where(back, self.first[road], self.last[road])]
        left, n, rows = offset.copy(), self.n[road], np.arange(len(road))
        for k in range(int(n.max(initial=0))):
            rows = rows[n[rows] > k]
            e = self.edge[road[rows]] + np.where(back[rows], n[rows] - 1 - k, k)
            here = (left[rows] <= self.len[e]) | (self.len[e] < 1e-12)
            r, f = rows[here], e[here]
            t = np.where(self.len[f] > 0, np.clip(left[r] / np.where(self.len[f] > 0, self.len[f], 1.0), 0.0, 1.0), 0.0)
            side = lambda a, b, r=r, t=t: np.where(back[r], b + t * (a - b), a + t * (b - a))
            x[r], y[r] = side(self.ax[f], self.bx[f]), side(self.ay[f], self.by[f])
            rows, e = rows[~here], e[~here]
            left[rows] -= self.len[e]
        return x, y

    def faced(self, road, back, at, ahead):
        """The bearing over a window ahead of an offset, or behind it and looking back; of a window of no length over the road."""
        whole = np.where(back, self.back[road], self.total[road])
        clamp = lambda v: np.minimum(np.maximum(v, 0.0), whole)
        px, py = self.along(road, back, clamp(at))
        qx, qy = self.along(road, back, clamp(np.where(ahead, at + WINDOW_M, at - WINDOW_M)))
        flat = np.hypot(px - qx, py - qy) < 1e-12
        one, two = np.where(ahead ^ back, self.first[road], self.last[road]), np.where(ahead ^ back, self.last[road], self.first[road])
        px, py, qx, qy = np.where(flat, self.x[one], px), np.where(flat, self.y[one], py), np.where(flat, self.x[two], qx), np.where(flat, self.y[two], qy)
        return np.where(self.n[road] > 0, bearing(px, py, qx, qy), 0.0)

    def near(self, lon, lat, radius: float):
        """(point, road, arc, x, y, metres) of the roads within the radius of points; the first of equally near edges counts."""
        high = radius / 111_000.0
        wide = high / np.maximum(np.cos(np.radians(np.minimum(np.abs(lat) + high, 90.0))), 0.01)
        cell = lambda v: np.floor(v * CELL).astype(np.int64)
        x0, x1, y0, y1 = cell(lon - wide), cell(lon + wide), cell(lat - high), cell(lat + high)
        p, cx, cy = cells_of(x0, x1, y0, y1)
        key = cx << 32 | cy & 0xFFFFFFFF
        a, b = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
        p, cx, cy, e = np.repeat(p, b - a), np.repeat(cx, b - a), np.repeat(cy, b - a), self.cell_of[spread(a, b - a)]
        beside = lambda v, s, t, by: (v >= np.minimum(s, t) - by) & (v <= np.maximum(s, t) + by)
        once = (cx == np.maximum(x0[p], self.x0[e])) & (cy == np.maximum(y0[p], self.y0[e]))  # what meets in several cells
        ok = once & beside(lon[p], self.ax[e], self.bx[e], wide[p]) & beside(lat[p], self.ay[e], self.by[e], high)
        p, e = p[ok], e[ok]
        ax, ay, bx, by, lon, lat = self.ax[e], self.ay[e], self.bx[e], self.by[e], lon[p], lat[p]
        cos = np.cos(np.radians((ay + by) / 2))
        dx, dy = (bx - ax) * cos, by - ay
        square = dx * dx + dy * dy
        none = square < 1e-20
        t = np.where(none, 0.0, np.clip(((lon - ax) * cos * dx + (lat - ay) * dy) / np.where(none, 1.0, square), 0.0, 1.0))
        x, y = ax + t * (bx - ax), ay + t * (by - ay)
        d = metres(lon, lat, x, y)
        ok = np.flatnonzero(d <= radius)
        ok = ok[np.lexsort((e[ok], d[ok], self.owner[e[ok]], p[ok]))]
        road = self.owner[e[ok]]
        ok = ok[leads(p[ok], road)]
        e = e[ok]
        return p[ok], self.owner[e], self.before[e] + t[ok] * self.len[e], x[ok], y[ok], d[ok]


def cells_of(x0, x1, y0, y1):
    """(i, cx, cy): every cell of every box."""
    wide = x1 - x0 + 1
    i, cx = np.repeat(np.arange(len(x0)), wide), spread(x0, wide)
    high = (y1 - y0 + 1)[i]
    return np.repeat(i, high), np.repeat(cx, high), spread(y0[i], high)


def leads(*keys):
    """Mask of the rows that begin a run of equal keys."""
    first = np.ones(len(keys[0]), dtype=bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def looked_up(table: tuple, row, column):
    place = lambda v: np.minimum(np.nan_to_num(v, nan=7.0), 7).astype(np.int64)  # noqa: E731 - an unknown class counts as the last one
    return np.array(table, dtype=float)[place(row), place(column)]


class Chooser:
    """Ranked candidates on some roads. roads: columns segment_id, start_node, end_node, frc, fow, direction, offsets and line."""

    def __init__(self, roads: dict, params: DecodeParams):
        self.roads, self.params = roads, params
        self.shapes = s = Shapes(roads["offsets"], roads["line"])
        v, owner = spread(s.first, s.last - s.first + 1), np.repeat(np.arange(len(s.n)), s.last - s.first + 1)
        self.west, self.south = np.full(len(s.n), np.inf), np.full(len(s.n), np.inf)
        np.minimum.at(self.west, owner, s.x[v])
        np.minimum.at(self.south, owner, s.y[v])

    def candidates(self, points: list[dict]) -> list[list[dict]]:
        """points: lon, lat, frc, fow, bearing_lb, bearing_ub, is_last. For each its candidates, best first."""
        out: list[list[dict]] = []
        for k in range(0, len(points), AT_ONCE):
            out += self._candidates(points[k : k + AT_ONCE])
        return out

    def _candidates(self, points: list[dict]) -> list[list[dict]]:
        s, par, roads = self.shapes, self.params, self.roads
        lon, lat, lb, ub = (np.array([x[c] for x in points], dtype=float) for c in ("lon", "lat", "bearing_lb", "bearing_ub"))
        frc, fow = (np.array([x[c] for x in points], dtype=np.int64) for c in ("frc", "fow"))
        is_last = np.array([x["is_last"] for x in points], dtype=bool)
        p, road, arc, px, py, far = s.near(lon, lat, par.candidate_search_radius_m)
        way = roads["direction"][road]
        # a row for each direction; arcs count from where one drives in
        ways = [np.flatnonzero(way != "Backward"), np.flatnonzero((way == "Both") | (way == "Backward"))]
        back = np.repeat([False, True], [len(w) for w in ways])
        i = np.concatenate(ways)
        p, road, arc, px, py, far = (a[i] for a in (p, road, arc, px, py, far))
        length = np.maximum(s.total[road], 0.001)
        arc = np.where(back, np.maximum(length - arc, 0.0), arc)
        near_end = par.snap_to_endpoint_threshold_m
        inside = (arc > 1e-6) & (arc < length - 1e-6) & (arc > near_end) & (length - arc > near_end)
        entry, leaving = arc <= near_end, length - arc <= near_end
        none = ~(inside | entry | leaving)
        entry, leaving = entry | none & (arc <= length / 2), leaving | none & ~(arc <= length / 2)
        kinds = [np.flatnonzero(m) for m in (inside, entry, leaving)]
        kind = np.repeat([0, 1, 2], [len(m) for m in kinds])
        i = np.concatenate(kinds)
        p, road, back, arc, px, py, far, length = (a[i] for a in (p, road, back, arc, px, py, far, length))
        arc = np.where(kind == 0, arc, np.where(kind == 1, 0.0, length))
        end = np.where((kind == 1) ^ back, s.first[road], s.last[road])
        x, y = np.where(kind == 0, px, s.x[end]), np.where(kind == 0, py, s.y[end])
        far = np.where(kind == 0, far, metres(lon[p], lat[p], x, y))
        faced = s.faced(road, back, arc, ~is_last[p])
        low, high = lb[p], ub[p]
        within = (high - low >= 360.0) | (turned(faced - low) <= turned(high - low))
        excess = np.where(within, 0.0, np.minimum(turned(low - faced), turned(faced - high)))
        wrong = np.where(is_last[p], kind == 1, kind == 2).astype(float)
        total = (
            par.distance_weight * (far / par.candidate_search_radius_m) + par.bearing_weight * (excess / np.maximum(high - low, 1.0)) * par.bearing_penalty_per_bucket
            + par.frc_weight * looked_up(par.frc_penalty_table, frc[p], roads["frc"][road]) + par.fow_weight * looked_up(par.fow_penalty_table, fow[p], roads["fow"][road])
            + np.where(kind == 0, par.interior_weight, 0.0) + par.wrong_endpoint_weight * wrong
        )
        ids = roads["segment_id"][road]
        ok = np.flatnonzero(~((excess > par.max_bearing_deviation_deg) | (total > par.max_candidate_score)))
        # of each point, road and direction the snap of the least total, the first of equals
        ok = ok[np.lexsort((kind[ok], total[ok], back[ok], ids[ok], p[ok]))]
        ok = ok[leads(p[ok], ids[ok], back[ok])]
        # the first cell in which a walk over the search window meets the road
        window = par.candidate_search_radius_m / 111_000.0 + 1 / CELL
        met = lambda at, edge: np.maximum(np.floor((at[p[ok]] - window) * CELL), np.floor(edge[road[ok]] * CELL))
        ok = ok[np.lexsort((back[ok], ids[ok], met(lat, self.south), met(lon, self.west), total[ok], p[ok]))]
        if par.max_candidates_per_lrp:
            counts = np.bincount(p[ok], minlength=len(points))
            ok = ok[np.arange(len(ok)) - np.repeat(np.cumsum(counts) - counts, counts) < par.max_candidates_per_lrp]
        start, stop = roads["start_node"][road[ok]], roads["end_node"][road[ok]]
        turn = back[ok]
        columns = (ids[ok], np.where(turn, "Backward", "Forward"), arc[ok], far[ok], x[ok], y[ok], np.array(["Interior", "Entry", "Exit"])[kind[ok]], total[ok], np.where(turn, stop, start), np.where(turn, start, stop))
        found: list[list[dict]] = [[] for _ in points]
        names = ("segment_id", "traversal", "snap_arc", "snap_distance", "snap_lon", "snap_lat", "snap_type", "total", "entry_node", "exit_node")
        for k, *values in zip(p[ok].tolist(), *(c.tolist() for c in columns), strict=True):
            found[k].append(dict(zip(names, values, strict=True)))
        return found
