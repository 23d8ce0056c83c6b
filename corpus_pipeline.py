"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes what its predecessor kept and returns it with the columns of `documents`; the last returns the mix, one row a
document that is taken at least once: doc_id, size, source_size, target, copies, taken.

Quality rules drop null, blank and short texts; rows of null doc_id are judged one by one in every stage (line dedup leaves their
lines alone, of their near duplicates one row stays), null sources are one source of the mix. Repeated rows are copies, of which the
n-gram stage keeps those of the least id. Very long texts are taken whole, further columns are carried along whatever their names,
and empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import shared_table
from waymark.llm.decontamination import decontaminate
from waymark.llm.line_dedup import without_repeats
from waymark.llm.mixing import mix
from waymark.llm.ngram_join import one_of_each
from waymark.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Edit distances over all lines and the rounding of the mix aren't for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
