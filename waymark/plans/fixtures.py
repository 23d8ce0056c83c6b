"""A road network, points and walks derived from the driver's tables with integer arithmetic, so that any engine builds the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x, y, lon, lat and both in 1e-7 degrees."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("long").alias("s"))
    p = p.withColumn("x", F.col("node_id") % 50).withColumn("y", F.expr("node_id div 50"))
    p = p.withColumn("lon_e7", 130_000_000 + F.col("x") * 20_000 + (F.col("s") * 37) % 11 * 100).withColumn("lat_e7", 520_000_000 + F.col("y") * 12_000 + (F.col("s") * 53) % 7 * 100)
    return p.select("node_id", "x", "y", "lon_e7", "lat_e7", (F.col("lon_e7") / 1e7).alias("lon"), (F.col("lat_e7") / 1e7).alias("lat"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, start_node, end_node, geometry, length_m (to centimetres), poly_len_m, frc, fow, direction."""
    n = nodes(spark, sf_dir)
    a, b = n.select(*[F.col(c).alias(f"a_{c}") for c in n.columns]), n.select(F.col("node_id").alias("end_node"), F.col("lon_e7").alias("lon1"), F.col("lat_e7").alias("lat1"))
    ends = F.explode(F.array(F.when(F.col("a_x") < 49, F.struct((2 * F.col("a_node_id")).alias("segment_id"), (F.col("a_node_id") + 1).alias("end_node"))), F.struct((2 * F.col("a_node_id") + 1).alias("segment_id"), (F.col("a_node_id") + 50).alias("end_node"))))
    s = a.withColumn("e", ends).where("e is not null").select("*", "e.segment_id", "e.end_node").drop("e").join(b, "end_node").where("(segment_id * 7919) % 17 != 0")
    across = F.col("segment_id") % 2 == 0
    bend = F.col("segment_id") % 7 * 150
    s = s.withColumn("lonm", F.expr("(a_lon_e7 + lon1) div 2") + F.when(across, 0).otherwise(bend)).withColumn("latm", F.expr("(a_lat_e7 + lat1) div 2") + F.when(across, bend).otherwise(0))
    vertex = lambda x, y: F.struct((F.col(x) / 1e7).alias("lon"), (F.col(y) / 1e7).alias("lat"))
    d = [F.col(c) / 1e7 for c in ("a_lon_e7", "a_lat_e7", "lonm", "latm", "lon1", "lat1")]
    length = geo.haversine_m(*d[:4]) + geo.haversine_m(*d[2:])
    frc = F.when(across & (F.col("a_y") % 10 == 0), 1).when(~across & (F.col("a_x") % 10 == 0), 2).when((F.col("a_x") + F.col("a_y")) % 5 == 0, 3).otherwise(4 + F.col("segment_id") % 3)
    fow = F.when(F.col("segment_id") % 23 == 0, 4).when(across & (F.col("a_y") % 10 == 0), 2).otherwise(3)
    way = F.when(F.col("segment_id") % 8 == 0, "Forward").when(F.col("segment_id") % 8 == 1, "Backward").otherwise("Both")
    return s.select(
        "segment_id", F.col("a_node_id").alias("start_node"), "end_node", F.array(vertex("a_lon_e7", "a_lat_e7"), vertex("lonm", "latm"), vertex("lon1", "lat1")).alias("geometry"),
        F.round(length, 2).alias("length_m"), F.round(length, 6).alias("poly_len_m"), frc.cast("int").alias("frc"), fow.cast("int").alias("fow"), way.alias("direction"),
    )


def restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_seg, via_node, to_seg: no turn from the road west of a node to the one north of it, at every ninth node."""
    ids = segments(spark, sf_dir).select("segment_id")
    n = nodes(spark, sf_dir).where("node_id % 9 = 4").select((2 * (F.col("node_id") - 1)).alias("from_seg"), F.col("node_id").alias("via_node"), (2 * F.col("node_id") + 1).alias("to_seg"))
    return n.join(ids.withColumnRenamed("segment_id", "from_seg"), "from_seg", "left_semi").join(ids.withColumnRenamed("segment_id", "to_seg"), "to_seg", "left_semi").select("from_seg", "via_node", "to_seg")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to match: lrp_id, lon, lat, frc, fow, bearing_lb, bearing_ub, is_last."""
    n = nodes(spark, sf_dir)
    count = n.agg(F.count("*")).first()[0]  # a number, not rows
    e = table(spark, sf_dir, "events").select("event_id").withColumn("node_id", F.col("event_id") % count)
    e = e.join(n.select("node_id", "lon_e7", "lat_e7"), "node_id")
    s = F.col("event_id") % 32
    return e.select(
        F.col("event_id").alias("lrp_id"), ((F.col("lon_e7") + F.col("event_id") % 13 * 20 + F.col("event_id") % 5 * 2500) / 1e7).alias("lon"), (F.col("lat_e7") / 1e7).alias("lat"),
        (F.col("event_id") % 8).cast("int").alias("frc"), F.expr("cast(event_id div 8 % 8 as int)").alias("fow"), (s * 11.25).alias("bearing_lb"), ((s + 1) * 11.25).alias("bearing_ub"), (F.col("event_id") % 2 == 1).alias("is_last"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, start, east, north: where each order's walk begins and how many segments it takes either way."""
    n = nodes(spark, sf_dir).agg(F.count("*")).first()[0]
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"))
    return o.withColumn("start", F.col("ref_id") % n).withColumn("east", 1 + F.col("ref_id") % 4).withColumn("north", 1 + F.expr("ref_id div 4") % 3)


def taken(o: DataFrame, segments: DataFrame) -> DataFrame:
    """ref_id, step, segment_id, start_node, steps (how many there should be): what exists and may be driven that way of walks asked for."""
    o = o.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("east") + F.col("north") - 1)))
    at = F.when(F.col("step") < F.col("east"), F.col("start") + F.col("step")).otherwise(F.col("start") + F.col("east") + 50 * (F.col("step") - F.col("east")))
    o = o.withColumn("start_node", at).withColumn("segment_id", 2 * at + F.when(F.col("step") < F.col("east"), 0).otherwise(1)).withColumn("steps", F.col("east") + F.col("north"))
    return o.join(segments.where("direction != 'Backward'").select("segment_id"), "segment_id")


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, step, segment_id, start_node: east, then north, from a node; only walks all of whose segments exist and may be
    driven that way."""
    o = taken(asked(spark, sf_dir), segments(spark, sf_dir))
    whole = o.groupBy("ref_id").agg(F.count("*").alias("have"), F.first("steps").alias("steps")).where("have = steps").select("ref_id")
    return o.join(whole, "ref_id", "left_semi").select("ref_id", "step", "segment_id", "start_node")
