"""What the training-data operators share: word columns, tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_by_hand = spark.sparkContext.getCheckpointDir()
        if set_by_hand:
            return set_by_hand
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="waymark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_path() named, through the file system Spark uses."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name that no table's column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def with_ids(df: DataFrame, name: str, key: str = "doc_id") -> tuple[DataFrame, int | None]:
    """Adds a column of ids that rows of null key have too, all of those above the number returned (None: no such rows)."""
    own = df.withColumn(name, F.col(key).cast("long"))
    nameless = own.where(F.col(key).isNull())
    if nameless.isEmpty():
        return own, None
    most = df.agg(F.max(key)).first()[0] or 0
    given = shared_table(nameless.withColumn(name, F.lit(most).cast("long") + 1 + F.monotonically_increasing_id()), "nameless")
    return own.where(F.col(key).isNotNull()).unionByName(given), most


def real_id(column: Column, most: int | None) -> Column:
    """Ids as they came: null for those that with_ids() gave."""
    return column if most is None else F.when(column <= most, column)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; empty for null and for blank texts."""
    blanks = " " * (len(SPACES) - 1)
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], blanks), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def join_sized(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join with `small` broadcast when it was measured to have at most `rows` rows, else by a shuffle that AQE may split."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, on, how)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph given by edges between longs; component is the smallest node reached.

    Alternating large and small stars: each round rewires edges to the least neighbour, so long chains end in a
    logarithmic number of rounds and no adjacency list is ever gathered. Nodes without edges don't appear.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = shared_table(e, "cc")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
        e = shared_table(small.where("u > v").distinct(), "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
