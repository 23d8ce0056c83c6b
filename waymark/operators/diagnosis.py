"""Questions asked of the event log of decodes. log: ref_id, seq, event, leg, info as from exact.decode_log()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.kernel import REASONS

SKIPPED = tuple(f"skipped_{r}" for r in REASONS)
TERMINATED = "reason string, nodes_expanded bigint, " + ", ".join(f"{s} bigint" for s in SKIPPED)
CHECKED = "lb double, ub double, actual_m double, passed boolean"
#: Signals: fewer expansions than this and no route; shorter legs and nearer points than these many metres.
FEW_EXPANDED, SHORT_LEG_M, NEAR_POINTS_M = 10, 10.0, 25.0


def of(log: DataFrame, event: str, schema: str) -> DataFrame:
    return log.where(F.col("event") == event).select("ref_id", "seq", "leg", F.from_json("info", schema).alias("e")).select("ref_id", "seq", "leg", "e.*")


def outcomes(log: DataFrame) -> DataFrame:
    """ref_id, outcome, at: what the decode ended with; null for logs without an end."""
    return of(log, "DecodeComplete", "outcome string, lrp_idx int").select("ref_id", "outcome", F.coalesce("lrp_idx", "leg").alias("at"))


def searches(log: DataFrame) -> DataFrame:
    """ref_id, leg, n_searches, expanded, the sums of each reason, hit_limit: the failed searches of a leg together."""
    t = of(log, "AStarTerminated", TERMINATED)
    sums = [F.sum(s).alias(s) for s in SKIPPED]
    return t.groupBy("ref_id", "leg").agg(F.count("*").alias("n_searches"), F.sum("nodes_expanded").alias("expanded"), *sums, F.max(F.col("reason") == "ExpansionLimitHit").alias("hit_limit"))


def no_route(log: DataFrame) -> DataFrame:
    """ref_id, leg, headline, hint: of references without a route, whether only the length didn't fit, the limit was hit, or what
    was skipped most."""
    end = of(log, "DecodeComplete", "outcome string").where("outcome = 'NoRoute'").select("ref_id", F.coalesce("leg", F.lit(0)).alias("leg"))
    failed = log.where("event = 'RouteFailed'").groupBy("ref_id", "leg").agg(F.count("*").alias("n_failed"))
    checks = of(log, "DnpChecked", CHECKED).groupBy("ref_id", "leg").agg(F.count("*").alias("n_checked"), F.count(F.when(~F.col("passed"), 1)).alias("n_long"), F.min("actual_m").alias("least_m"))
    d = end.join(failed, ["ref_id", "leg"], "left").join(checks, ["ref_id", "leg"], "left").join(searches(log), ["ref_id", "leg"], "left")
    most = F.greatest(*[F.coalesce(s, F.lit(0)) for s in SKIPPED])
    by = F.coalesce(*[F.when((most > 0) & (F.col(s) == most), F.lit(r)) for s, r in zip(SKIPPED, REASONS, strict=True)])
    headline = F.when((F.coalesce("n_long", F.lit(0)) > 0) & F.col("n_failed").isNull(), "length out of range").when(F.col("n_searches").isNull(), "no path").when(F.col("hit_limit"), "expansion limit").otherwise("search exhausted")
    hint = F.when(headline == "length out of range", "dnp_tolerance_pct").when(headline == "expansion limit", "max_astar_expansions").when(headline == "search exhausted", by)
    return d.select("ref_id", "leg", headline.alias("headline"), hint.alias("hint"), "least_m", F.coalesce("expanded", F.lit(0)).alias("expanded"))


def signals(log: DataFrame) -> DataFrame:
    """ref_id, leg, signal: one row for each thing of note in a leg."""
    found = log.where("event = 'RouteFound'").select("ref_id", "leg").distinct().withColumn("found", F.lit(True))
    s = searches(log).join(found, ["ref_id", "leg"], "left")
    none = F.coalesce("found", F.lit(False))
    frc, sharp = F.col(SKIPPED[0]), F.col(SKIPPED[3])
    from_search = F.array(
        F.when((frc > 0) & (frc >= F.col("expanded")), "class floor blocks the search").when(frc > 0, "class floor skips edges"),
        F.when(sharp > 0, "turn gate skips edges"), F.when((F.col("expanded") < FEW_EXPANDED) & ~none, "hardly anything to expand"),
    )
    last = of(log, "DnpChecked", CHECKED).groupBy("ref_id", "leg").agg(F.max_by(F.struct("actual_m", "passed"), "seq").alias("d")).select("ref_id", "leg", "d.*")
    from_check = F.array(F.when(~F.col("passed"), "length check failed"), F.when(F.col("passed") & (F.col("actual_m") < SHORT_LEG_M), "very short leg"))
    rows = s.select("ref_id", "leg", F.explode(from_search).alias("signal")).unionByName(last.select("ref_id", "leg", F.explode(from_check).alias("signal")))
    return rows.where("signal is not null")


def leg_summary(log: DataFrame) -> DataFrame:
    """ref_id, leg, found, length_m, dnp_ok, failed_reason, n_searches: the last event of each kind for every leg."""
    last = lambda event, schema, *names: of(log, event, schema).groupBy("ref_id", "leg").agg(F.max_by(F.struct(*names), "seq").alias("x")).select("ref_id", "leg", "x.*")
    legs = log.where("leg is not null and event in ('RouteSearchStarted', 'RouteFound', 'RouteFailed', 'DnpChecked')").select("ref_id", "leg").distinct()
    out = legs.join(last("RouteFound", "length_m double", "length_m"), ["ref_id", "leg"], "left").join(last("DnpChecked", CHECKED, "passed", "actual_m"), ["ref_id", "leg"], "left")
    out = out.join(last("RouteFailed", "reason string", "reason"), ["ref_id", "leg"], "left")
    n = log.where("event = 'RouteSearchStarted'").groupBy("ref_id", "leg").agg(F.count("*").alias("n_searches"))
    return out.join(n, ["ref_id", "leg"], "left").select("ref_id", "leg", F.col("length_m").isNotNull().alias("found"), "length_m", F.col("passed").alias("dnp_ok"), F.col("reason").alias("failed_reason"), F.coalesce("n_searches", F.lit(0)).alias("n_searches"))


def skipped_edges(log: DataFrame) -> DataFrame:
    """ref_id, leg, from_node, segment_id, reason of every edge that a search skipped; needs the Full level."""
    return of(log, "AStarEdgeSkipped", "from_node bigint, segment_id bigint, reason string").drop("seq")


def attempted(log: DataFrame) -> DataFrame:
    """ref_id, attempt, leg, from_segment, to_segment, outcome: each search with the next thing said of its leg."""
    kinds = ("RouteSearchStarted", "RouteFound", "RouteFailed", "DnpChecked")
    w = Window.partitionBy("ref_id", "leg").orderBy("seq")
    e = log.where(F.col("event").isin(*kinds)).withColumn("next", F.lead("event").over(w)).withColumn("said", F.lead("info").over(w)).where("event = 'RouteSearchStarted'")
    both = e.select("ref_id", "leg", "seq", F.from_json("info", "from_segment bigint, to_segment bigint").alias("s"), "next", F.get_json_object("said", "$.passed").alias("passed"))
    said = F.when(F.col("next") == "RouteFailed", "no path").when(F.col("passed") == "false", "length out of range").when(F.col("next").isNotNull(), "found")
    order = F.row_number().over(Window.partitionBy("ref_id").orderBy("seq"))
    return both.select("ref_id", order.alias("attempt"), "leg", "s.from_segment", "s.to_segment", said.alias("outcome"))


PHASES = {"CandidatesRanked": "candidates", "RouteSearchStarted": "routing", "AStarNodeExpanded": "routing", "AStarEdgeSkipped": "routing", "AStarTerminated": "routing", "RouteFound": "routing", "RouteFailed": "routing", "DnpChecked": "validation", "OffsetApplied": "offsets", "DecodeComplete": "done"}


def phase_of(event: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), event)


def replay(log: DataFrame) -> DataFrame:
    """ref_id, step, phase, event, leg, n_open (nodes expanded so far in the leg's running search), best_g: the state after each step; a
    new search starts over."""
    e = log.where("event != 'Result'").withColumn("g", F.get_json_object("info", "$.g_m").cast("double"))
    order = Window.partitionBy("ref_id").orderBy("seq")
    e = e.withColumn("run", F.sum(F.when(F.col("event") == "RouteSearchStarted", 1).otherwise(0)).over(order))
    state = Window.partitionBy("ref_id", "run").orderBy("seq")
    expanded = F.sum(F.when(F.col("event") == "AStarNodeExpanded", 1).otherwise(0)).over(state)
    return e.select("ref_id", F.row_number().over(order).alias("step"), phase_of(F.col("event")).alias("phase"), "event", "leg", expanded.alias("n_open"), F.max("g").over(state).alias("best_g"))


def ramp(share: Column) -> Column:
    """Colour from green over yellow to red for 0 to 1."""
    s = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    red, green = F.least(2 * s, F.lit(1.0)), F.least(2 - 2 * s, F.lit(1.0))
    return F.format_string("#%02x%02x00", F.round(red * 255).cast("int"), F.round(green * 255).cast("int"))


def already_tried(log: DataFrame, pins: DataFrame) -> DataFrame:
    """ref_id, tried: whether the segments pinned for every leg were searched between before. pins: ref_id, lrp_idx, segment_id."""
    w = Window.partitionBy("ref_id").orderBy("lrp_idx")
    legs = pins.withColumn("to_segment", F.lead("segment_id").over(w)).where("to_segment is not null").select("ref_id", F.col("lrp_idx").alias("leg"), F.col("segment_id").alias("from_segment"), "to_segment")
    had = of(log, "RouteSearchStarted", "from_segment bigint, to_segment bigint").select("ref_id", "leg", "from_segment", "to_segment").distinct().withColumn("had", F.lit(True))
    return legs.join(had, ["ref_id", "leg", "from_segment", "to_segment"], "left").groupBy("ref_id").agg(F.min(F.coalesce("had", F.lit(False))).alias("tried"))


def spliced(original: DataFrame, forced: DataFrame) -> DataFrame:
    """The candidate events of the first log with everything else from the second, numbered anew."""
    both = original.where("event = 'CandidatesRanked'").withColumn("part", F.lit(0)).unionByName(forced.where("event != 'CandidatesRanked'").withColumn("part", F.lit(1)))
    seq = F.row_number().over(Window.partitionBy("ref_id").orderBy("part", "seq")) - 1
    return both.withColumn("n", seq).select("ref_id", F.col("n").cast("int").alias("seq"), "event", "leg", "info")


def report(log: DataFrame) -> DataFrame:
    """ref_id, text: a line an event."""
    line = F.concat_ws(" ", F.lpad(F.col("seq").cast("string"), 4, " "), "event", F.when(F.col("leg").isNotNull(), F.concat(F.lit("leg "), F.col("leg") + 1)), "info")
    rows = log.where("event != 'Result'").groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    return rows.select("ref_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
