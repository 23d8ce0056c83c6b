"""Decode parameters: defaults, presets and overlays."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

#: Penalties by difference of road class, and by form of way (rows: wanted, columns: found).
FRC_STEPS = (0.00, 0.10, 0.25, 0.45, 0.65, 0.80, 0.90, 1.00)
FOW_TABLE = (
    (0.00, 0.30, 0.30, 0.30, 0.30, 0.30, 0.30, 0.30),
    (0.30, 0.00, 0.10, 0.40, 0.60, 0.70, 0.20, 0.80),
    (0.30, 0.10, 0.00, 0.20, 0.40, 0.50, 0.25, 0.70),
    (0.30, 0.40, 0.20, 0.00, 0.20, 0.25, 0.30, 0.40),
    (0.30, 0.60, 0.40, 0.20, 0.00, 0.30, 0.40, 0.50),
    (0.30, 0.70, 0.50, 0.25, 0.30, 0.00, 0.50, 0.40),
    (0.30, 0.20, 0.25, 0.30, 0.40, 0.50, 0.00, 0.50),
    (0.30, 0.80, 0.70, 0.40, 0.50, 0.40, 0.50, 0.00),
)


@dataclass(frozen=True)
class DecodeParams:
    candidate_search_radius_m: float = 30.0
    snap_to_endpoint_threshold_m: float = 15.0
    distance_weight: float = 0.5
    bearing_weight: float = 0.3
    bearing_penalty_per_bucket: float = 0.05
    frc_weight: float = 0.10
    fow_weight: float = 0.20
    interior_weight: float = 0.10
    wrong_endpoint_weight: float = 0.20
    frc_penalty_table: tuple = tuple(tuple(FRC_STEPS[abs(i - j)] for j in range(8)) for i in range(8))
    fow_penalty_table: tuple = FOW_TABLE
    max_bearing_deviation_deg: float = 45.0
    max_candidate_score: float = 1.5
    max_candidates_per_lrp: int = 8
    dnp_tolerance_pct: float = 0.25
    max_path_search_factor: float = 5.0
    max_astar_expansions: int = 100_000
    lfrcnp_tolerance: int = 2
    max_interior_turn_deviation_deg: float = 150.0
    max_routing_attempts: int = 10
    trace_level: str = "Summary"


DEFAULT = DecodeParams()
PERMISSIVE = replace(
    DEFAULT, candidate_search_radius_m=200.0, snap_to_endpoint_threshold_m=25.0, bearing_weight=0.2, bearing_penalty_per_bucket=0.03, frc_weight=0.05, fow_weight=0.10, interior_weight=0.05, wrong_endpoint_weight=0.10,
    max_bearing_deviation_deg=90.0, max_candidates_per_lrp=10, dnp_tolerance_pct=0.40, max_path_search_factor=4.0, max_astar_expansions=50_000, max_interior_turn_deviation_deg=180.0, max_routing_attempts=0,
)
STRICT = replace(
    DEFAULT, candidate_search_radius_m=50.0, snap_to_endpoint_threshold_m=10.0, bearing_weight=0.4, bearing_penalty_per_bucket=0.08, frc_weight=0.20, fow_weight=0.30, interior_weight=0.20, wrong_endpoint_weight=0.30,
    max_bearing_deviation_deg=30.0, max_candidate_score=1.0, max_candidates_per_lrp=5, dnp_tolerance_pct=0.10, max_path_search_factor=3.0, max_astar_expansions=0, lfrcnp_tolerance=0, max_interior_turn_deviation_deg=120.0, max_routing_attempts=5,
)
PRESETS = {"Default": DEFAULT, "Permissive": PERMISSIVE, "Strict": STRICT}


#: Fields that a JSON object may leave out.
OPTIONAL = frozenset({"max_bearing_deviation_deg", "max_candidate_score", "max_interior_turn_deviation_deg", "max_routing_attempts"})


def resolve(text: str | None) -> DecodeParams:
    """Nothing, a preset's name, or a JSON object of all fields but the optional ones."""
    if not text or text in ("null", "Default"):
        return DEFAULT
    if text in PRESETS:
        return PRESETS[text]
    given = json.loads(text)
    if missing := {f.name for f in fields(DecodeParams)} - OPTIONAL - set(given):
        raise ValueError(f"missing parameters: {sorted(missing)}")
    return merged(DEFAULT, given)


def merged(params: DecodeParams, overlay: dict) -> DecodeParams:
    """A shallow overlay; unknown fields are refused."""
    known = {f.name for f in fields(DecodeParams)}
    if unknown := set(overlay) - known:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    tables = {k: tuple(map(tuple, v)) if k.endswith("_table") else v for k, v in overlay.items()}
    return DecodeParams(**asdict(params) | tables)
