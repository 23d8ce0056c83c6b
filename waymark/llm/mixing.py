"""Mixing sources to target weights by entropy balancing.

Of all ways to repeat documents so that each source yields its target number of words while the lengths of documents stay spread
as they are in the corpus, the one closest in relative entropy to the corpus tilts every document exponentially:

    rate = min(exp(lambda of its source + mu of its length band), most)

The multipliers solve the convex dual of token constraints, one for each source (met exactly) and one for each band of lengths
(powers of two; met up to SOFT times mu, so no two constraints can contradict each other):

    minimise  sum_cells words * tilt(lambda + mu) - sum_s target_s * lambda_s - sum_b band_b * mu_b + SOFT / 2 * sum_b band_b * mu_b^2

The lambdas of a given mu separate by source; Newton's iterations run on mu. Each is one pass of Spark over a table with a row
a source: it solves that source's lambda and adds its part to the value, the gradient and the Hessian (the Schur complement of
the lambdas), which Spark sums; the driver gets bands x bands numbers and solves for the step, halved until the dual falls. With
a single band mu is 0 and the rates are target over size.

Rates are then rounded into copies: within a source, sizes are visited from long to short and each takes the whole number of
copies that brings the words taken so far closest to what the rates ask for, so the rounding error left at the end is that of
the shortest documents. Which documents of one size get the extra copy goes by a hash of doc_id, in buckets of bounded size, so
reruns agree and no task ranks a whole source.

Null texts and texts without words have size 0 and are taken 0 times over; very long texts are sized whole. Null sources are one
source, last in order. Repeated rows are documents of their own; rows of one doc_id (or of none), source and size look alike in
the result, so they are counted first and dealt out at the end. Other columns don't matter, whatever their names. Empty tables
give no rows. A source may hold any share of the rows: only its counts by size (at most as many as the longest text has words)
meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, shared_table

#: Weights in turn by order of source, and how often a word may be taken at most.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: How far a band may stray from its share of the words: by SOFT times its multiplier.
SOFT = 0.1
BANDS, NEWTON_STEPS, CLOSE = 40, 60, 1e-10
BUCKET_ROWS = 50_000


def source_targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """by_source: sk, source, source_size. Adds weight and target: shares by weight, capped at `most` times the source's size,
    the excess reshared. The common level c is the largest that any source sees with those of smaller cap per weight served."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    t = by_source.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).withColumn("cap", F.col("source_size") * float(most))
    every = Window.partitionBy()
    ladder = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(ladder), F.lit(0.0))
    level = (F.sum("source_size").over(every) - before("cap")) / (F.sum("weight").over(every) - before("weight"))
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return t.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).drop("level", "cap")


def band_of(size):
    """Powers of two; all longer documents share the last band."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(BANDS - 1)).cast("int")


def source_lambda(words: np.ndarray, target: float, mu: np.ndarray, most: float) -> float:
    """The lambda that makes one source's tilted words add up to its target; `most` times all words needs no finite one."""
    here = words > 0
    w, m = words[here], mu[here]
    if target >= most * w.sum() * (1 - 1e-12):
        return np.log(most) - m.min()  # every band at its cap
    low, high = np.log(target / (most * w.sum())) - m.max(), np.log(most) - m.min()
    lam = min(max(np.log(target / (w * np.exp(m)).sum()), low), high)
    for _ in range(100):  # the sum grows with lambda: Newton, kept between bounds that close in
        rate = np.exp(lam + m)
        free = rate < most
        gap = (w * np.minimum(rate, most)).sum() - target
        if abs(gap) <= 1e-13 * target:
            break
        low, high = (low, lam) if gap > 0 else (lam, high)
        slope = (w * rate)[free].sum()
        step = lam - gap / slope if slope > 0 else low
        lam = step if low < step < high else (low + high) / 2
    return float(lam)


def dual_parts(sources: DataFrame, mu: np.ndarray, most: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian in mu of the sources' share of the dual, lambdas solved. sources: sk, target, words (by band)."""
    n = len(mu)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, grad, hess = 0.0, np.zeros(n), np.zeros((n, n))
        for pdf in batches:
            for target, words in zip(pdf["target"], pdf["words"], strict=True):
                words = np.asarray(words, dtype=float)
                lam = source_lambda(words, target, mu, most)
                rate = np.exp(np.minimum(lam + mu, 700.0))
                free, got = rate < most, words * np.minimum(rate, most)
                beyond = np.where(free, 0.0, most * (lam + mu - np.log(most)))
                value += (got + words * beyond).sum() - target * lam
                grad += got
                slope = np.where(free, got, 0.0)
                if slope.sum() > 0:
                    hess += np.diag(slope) - np.outer(slope, slope) / slope.sum()
        i, j = np.nonzero(hess)
        yield pd.DataFrame({"i": np.concatenate([[-1], np.full(n, -2), i]), "j": np.concatenate([[0], np.arange(n), j]), "x": np.concatenate([[value], grad, hess[i, j]])}).astype({"i": "int32", "j": "int32"})

    value, grad, hess = 0.0, np.zeros(n), np.zeros((n, n))
    for r in sources.select("target", "words").mapInPandas(parts, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        if r["i"] == -1:
            value = r["x"]
        elif r["i"] == -2:
            grad[r["j"]] = r["x"]
        else:
            hess[r["i"], r["j"]] = r["x"]
    return value, grad, hess


def balance(sources: DataFrame, bands: np.ndarray, most: int = MOST, soft: float = SOFT) -> np.ndarray:
    """mu by band. sources: sk, target (above 0), words; bands: words asked for by band, 0 for bands without documents."""
    mu, held = np.zeros(BANDS), np.flatnonzero(bands > 0)
    if len(held) < 2:
        return mu

    def dual(at: np.ndarray):
        value, grad, hess = dual_parts(sources, at, most)
        return value - bands @ at + soft / 2 * (bands * at * at).sum(), grad - bands + soft * bands * at, hess + np.diag(soft * bands)

    value, grad, hess = dual(mu)
    for _ in range(NEWTON_STEPS):
        if np.abs(grad[held]).max() <= CLOSE * bands.sum():
            break
        step = np.zeros(BANDS)
        step[held] = -np.linalg.solve(hess[np.ix_(held, held)], grad[held])
        if -(grad @ step) <= 1e-13 * max(1.0, abs(value)):  # what a step could win is below what the value can show
            break
        size = 1.0
        while size > 1e-6:
            ahead = dual(mu + size * step)
            if ahead[0] <= value + 1e-4 * size * (grad @ step) + 1e-14 * abs(value):
                break
            size /= 2
        mu, (value, grad, hess) = mu + size * step, ahead
    return mu


def tilts(cells: DataFrame, targets: DataFrame, most: int = MOST, soft: float = SOFT) -> DataFrame:
    """sk, band, rate. cells: sk, band, words; targets: sk, source_size, target."""
    spark = cells.sparkSession
    by_band = cells.groupBy("band").agg(F.sum("words").alias("words")).collect()  # BANDS rows at most
    bands = np.zeros(BANDS)
    for r in by_band:
        bands[r["band"]] = r["words"] or 0.0
    listed = cells.groupBy("sk").agg(F.map_from_entries(F.collect_list(F.struct("band", "words"))).alias("m"))
    listed = listed.select("sk", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)).cast("double")).alias("words"))
    sources = shared_table(listed.join(targets.where("target > 0 and source_size > 0").select("sk", "target"), "sk"), "dual")
    mu = balance(sources, bands, most, soft)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sk, target, words in zip(pdf["sk"], pdf["target"], pdf["words"], strict=True):
                lam = source_lambda(np.asarray(words, dtype=float), target, mu, most)
                yield pd.DataFrame({"sk": sk, "band": np.arange(BANDS, dtype=np.int32), "rate": np.minimum(np.exp(np.minimum(lam + mu, 700.0)), most)})

    return sources.select("sk", "target", "words").mapInPandas(rates, "sk string, band int, rate double") if not sources.isEmpty() else spark.createDataFrame([], "sk string, band int, rate double")


def whole_copies(most: int):
    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's counts by size: how many copies the documents of each size take together."""
        pdf = pdf.sort_values("size", ascending=False)
        carry, out = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            if size <= 0:
                out.append(0)
                continue
            ask = carry + rate * size * n
            m = int(min(max(np.floor(ask / size + 0.5), 0), most * n))
            carry = ask - m * size
            out.append(m)
        return pdf.assign(copies=np.asarray(out, dtype=np.int64))[["sk", "size", "n", "copies"]]

    return rounded


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, soft: float = SOFT) -> DataFrame:
    """docs: doc_id, text, source. One row a document: doc_id, size, source_size, target, copies, taken."""
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    d = d.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("sk"), "source", "size")
    d = shared_table(d.groupBy("sk", "size", "doc_id").agg(F.count("*").alias("rows"), F.first("source").alias("source")), "sizes")
    by_size = shared_table(d.groupBy("sk", "size").agg(F.sum("rows").alias("n"), F.first("source").alias("source")).withColumn("band", band_of(F.col("size"))), "by-size")
    cells = by_size.groupBy("sk", "band").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("words"))
    by_source = cells.groupBy("sk").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = shared_table(source_targets(by_source, weights, most), "targets")
    rates = tilts(cells.select("sk", "band", "words"), targets, most, soft)
    counts = by_size.select("sk", "size", "n", "band").join(rates, ["sk", "band"], "left").select("sk", "size", "n", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    copies = counts.groupBy("sk").applyInPandas(whole_copies(most), "sk string, size long, n long, copies long")
    copies = shared_table(copies.select("sk", "size", "n", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("extra"), F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets")), "copies")
    d = d.select("sk", "size", "doc_id", "rows").join(copies, ["sk", "size"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    # extras by bucket: each gets its share of them, whole numbers that add up
    per = d.groupBy("sk", "size", "bucket").agg(F.sum("rows").alias("own"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    upto = F.sum("own").over(Window.partitionBy("sk", "size").orderBy("bucket"))
    share = lambda c: F.floor(F.col("extra") * c / F.col("n"))
    per = per.withColumn("upto", upto).select("sk", "size", "bucket", (share(F.col("upto")) - share(F.col("upto") - F.col("own"))).alias("bucket_extra"))
    d = d.drop("n", "extra", "buckets").join(per, ["sk", "size", "bucket"])
    upto = F.sum("rows").over(Window.partitionBy("sk", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id"))
    d = d.withColumn("more", F.least(F.greatest(F.col("bucket_extra") - (upto - F.col("rows")), F.lit(0)), F.col("rows")))
    d = d.join(targets.select("sk", "source_size", "target"), "sk")
    # rows that look alike come back one by one, those with the extra copy first
    d = d.select("doc_id", "size", "source_size", "target", "each", "more", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("k"))
    taken = F.col("each") + F.when(F.col("k") <= F.col("more"), 1).otherwise(0)
    return d.select("doc_id", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
