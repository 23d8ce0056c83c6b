"""The same network, points and walks in DuckDB's SQL, and expressions that the oracle queries share."""

from __future__ import annotations


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2*6371000.0*asin(sqrt(pow(sin(radians(({d})-({b}))/2),2)+cos(radians({b}))*cos(radians({d}))*pow(sin(radians(({c})-({a}))/2),2))))"


def pmod(x: str, m: str = "360.0") -> str:
    return f"(({x}) - {m}*floor(({x})/{m}))"


def bear(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians(({c})-({a})))*cos(radians({d}))"
    x = f"cos(radians({b}))*sin(radians({d}))-sin(radians({b}))*cos(radians({d}))*cos(radians(({c})-({a})))"
    return pmod(f"degrees(atan2({y},{x}))+360.0")


def contains(lb: str, ub: str, v: str) -> str:
    return f"(({ub})-({lb})>=360.0 OR {pmod(f'({v})-({lb})')}<={pmod(f'({ub})-({lb})')})"


def excess(lb: str, ub: str, v: str) -> str:
    return f"(CASE WHEN {contains(lb, ub, v)} THEN 0.0 ELSE least({pmod(f'({lb})-({v})')},{pmod(f'({v})-({ub})')}) END)"


def along(p: str, o: str, axis: str) -> str:
    """Coordinate o metres along the two edges of a row with prefix p: (x|y)0, m, 1 and l1, l2."""
    a, m, b = (f"{p}{axis}{k}" for k in "0m1")
    return f"(CASE WHEN ({o})<={p}l1 THEN {a}+least(greatest(({o})/{p}l1,0),1)*({m}-{a}) WHEN ({o})-{p}l1<={p}l2 THEN {m}+least(greatest((({o})-{p}l1)/{p}l2,0),1)*({b}-{m}) ELSE {b} END)"


def bear_at(p: str, o: str, forward: bool) -> str:
    t = f"({p}l1+{p}l2)"
    clamp = lambda x: f"least(greatest({x},0.0),{t})"
    s, e = clamp(f"({o})"), clamp(f"({o}){'+' if forward else '-'}20.0")
    a, b = ("0", "1") if forward else ("1", "0")
    whole = bear(f"{p}x{a}", f"{p}y{a}", f"{p}x{b}", f"{p}y{b}")
    return f"(CASE WHEN abs({s}-{e}) < 1e-9 THEN {whole} ELSE {bear(along(p, s, 'x'), along(p, s, 'y'), along(p, e, 'x'), along(p, e, 'y'))} END)"


NET = f"""
base AS (SELECT p_partkey AS node_id, p_partkey % 50 AS x, p_partkey // 50 AS y, CAST(p_size AS BIGINT) AS s FROM part),
nodes AS (SELECT node_id, x, y, 130000000 + x*20000 + (s*37)%11*100 AS lon_e7, 520000000 + y*12000 + (s*53)%7*100 AS lat_e7 FROM base),
pairs AS (
  SELECT 2*a.node_id AS segment_id, a.node_id AS start_node, b.node_id AS end_node, a.x, a.y, a.lon_e7 AS e0, a.lat_e7 AS n0, b.lon_e7 AS e1, b.lat_e7 AS n1 FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1 WHERE a.x < 49
  UNION ALL SELECT 2*a.node_id+1, a.node_id, b.node_id, a.x, a.y, a.lon_e7, a.lat_e7, b.lon_e7, b.lat_e7 FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 50),
bent AS (SELECT *, (e0+e1)//2 + CASE WHEN segment_id%2=0 THEN 0 ELSE segment_id%7*150 END AS em, (n0+n1)//2 + CASE WHEN segment_id%2=0 THEN segment_id%7*150 ELSE 0 END AS nm FROM pairs WHERE (segment_id*7919)%17 <> 0),
degs AS (SELECT *, e0/1e7 AS x0, n0/1e7 AS y0, em/1e7 AS xm, nm/1e7 AS ym, e1/1e7 AS x1, n1/1e7 AS y1 FROM bent),
lens AS (SELECT *, {hav("x0", "y0", "xm", "ym")} AS l1, {hav("xm", "ym", "x1", "y1")} AS l2 FROM degs),
segments AS (SELECT segment_id, start_node, end_node, x0, y0, xm, ym, x1, y1, l1, l2, round(l1+l2, 2) AS length_m, round(l1+l2, 6) AS poly_len_m,
  CAST(CASE WHEN segment_id%2=0 AND y%10=0 THEN 1 WHEN segment_id%2=1 AND x%10=0 THEN 2 WHEN (x+y)%5=0 THEN 3 ELSE 4+segment_id%3 END AS INTEGER) AS frc,
  CAST(CASE WHEN segment_id%23=0 THEN 4 WHEN segment_id%2=0 AND y%10=0 THEN 2 ELSE 3 END AS INTEGER) AS fow,
  CASE segment_id%8 WHEN 0 THEN 'Forward' WHEN 1 THEN 'Backward' ELSE 'Both' END AS direction FROM lens),
restrictions AS (SELECT f.segment_id AS from_seg, n.node_id AS via_node, t.segment_id AS to_seg FROM nodes n JOIN segments f ON f.segment_id = 2*(n.node_id-1) JOIN segments t ON t.segment_id = 2*n.node_id+1 WHERE n.node_id % 9 = 4),
arcs AS (SELECT segment_id, 'Forward' AS traversal, start_node AS tail, end_node AS head, length_m, frc, fow FROM segments WHERE direction <> 'Backward' UNION ALL SELECT segment_id, 'Backward', end_node, start_node, length_m, frc, fow FROM segments WHERE direction <> 'Forward'),
away AS (SELECT segment_id, start_node AS node, {bear_at("", "0.0", True)} AS b FROM segments UNION ALL SELECT segment_id, end_node, {bear_at("", "(l1+l2)", False)} FROM segments)
"""
POINTS = """
points AS (SELECT event_id AS lrp_id, (n.lon_e7 + event_id%13*20 + event_id%5*2500)/1e7 AS lon, n.lat_e7/1e7 AS lat, CAST(event_id%8 AS INTEGER) AS frc, CAST(event_id//8%8 AS INTEGER) AS fow,
  event_id%32*11.25 AS bearing_lb, (event_id%32+1)*11.25 AS bearing_ub, event_id%2=1 AS is_last FROM events JOIN nodes n ON n.node_id = event_id % (SELECT count(*) FROM part))
"""
WALKS = """
asked AS (SELECT o_orderkey AS ref_id, o_orderkey % (SELECT count(*) FROM part) AS start, 1 + o_orderkey%4 AS east, 1 + o_orderkey//4%3 AS north FROM orders),
steps AS (SELECT ref_id, start, east, north, unnest(generate_series(0, east+north-1)) AS step FROM asked),
placed AS (SELECT *, CASE WHEN step < east THEN start+step ELSE start+east+50*(step-east) END AS start_node FROM steps),
taken AS (SELECT p.ref_id, p.step, s.segment_id, p.start_node, east+north AS n FROM placed p JOIN segments s ON s.segment_id = 2*p.start_node + CASE WHEN step < east THEN 0 ELSE 1 END AND s.direction <> 'Backward'),
walks AS (SELECT ref_id, step, segment_id, start_node FROM (SELECT *, count(*) OVER (PARTITION BY ref_id) AS have FROM taken) WHERE have = n)
"""
