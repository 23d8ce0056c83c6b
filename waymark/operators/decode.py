"""From location reference points to a path, one row a reference."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from waymark.operators import exact
from waymark.plans.params import DEFAULT, DecodeParams


def decode(lrps: DataFrame, segments: DataFrame, restrictions: DataFrame, params: DecodeParams = DEFAULT, forced: DataFrame | None = None) -> DataFrame:
    """ref_id, ok, error_code, failed_leg, attempts, places, path, lengths, length_m, offsets, first_arc, last_arc, first_way, last_way.

    lrps: ref_id, lrp_idx (from 0), lon, lat, frc, fow, bearing_lb, bearing_ub, lfrcnp, dnp_lb, dnp_ub. `forced` gives the one
    candidate of each point instead: ref_id, lrp_idx, segment_id, traversal, snap_arc. Combinations are tried in the order of their
    score, made as they are needed; the first whose every leg has a route within its length window wins.
    """
    return exact.results(exact.decode_log(lrps, segments, restrictions, replace(params, trace_level="Off"), forced))
