"""Benchmark decontamination by spaced seeds: masks that ignore some token positions, hashed on both sides and joined.

Texts are lower-cased and stripped of punctuation, then cut at white space. Every window of every document is hashed under
every mask; a bitmap of the benchmark's hashes, of SPARSE bits a seed and 2**MOST_BITS at most, drops nearly all of them inside
the row, and an equi-join finds the rest. Around each hit the item is laid along the document and compared word by word, substitutions allowed.

The masks follow the length of the item: each set is proven by enumeration (in the tests) to have a mask that misses every set
of substituted words that still makes a leak, so no leak is without a hit. Only the sets of lengths that occur are hashed.

Null and blank texts and items match nothing. Items so short that all their words must agree have one mask that takes them
whole. Documents of null id take part under an id of their own, and so do items; a document id that repeats counts as one
document with the passages of all its rows. Very long texts are taken whole. Other columns don't matter, whatever their names. An
empty table on either side returns no rows. Only hits carry on, so documents that share no passage with the benchmark never
leave their task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, join_sized, real_id, shared_table, unused, with_ids

#: The masks by the words in line that must agree (MIN_WORDS or a shorter item); 1 takes a word into the hash, 0 ignores it.
MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("11101011", "101100111", "111111"),
    13: ("11101011", "11001111"),
}
#: A leak is `MIN_WORDS` words in line (or the whole item, if shorter) of which at least `MIN_SAME` percent agree.
MIN_WORDS, MIN_SAME = 13, 80
BITS, MOST_BITS, SPARSE = 20, 26, 64
BROADCAST_ROWS = 2_000_000
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>`_~^=+/\\"


def norm_words(text: Column) -> Column:
    blanks = " " * (len(SPACES) - 1)
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), SPACES[1:] + PUNCTUATION, blanks)
    return F.array_remove(F.split(plain, " "), "")


def seed_at(hashes: str, number: int, taken: list[int]):
    return lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + j) for j in taken])


def most_wrong(run: int, min_same: int = MIN_SAME) -> int:
    """How many words of a run may differ."""
    return run * (100 - min_same) // 100


def masks_of(run: int, min_same: int = MIN_SAME, masks=MASKS) -> tuple[str, ...]:
    """Masks that hit every leak of so many words in line: the given ones as far as they are proven, else one row of words that
    the words that differ can't all touch."""
    wrong = most_wrong(run, min_same)
    if run in masks and wrong <= most_wrong(run):
        return masks[run]
    return ("1" * -(-(run - wrong) // (wrong + 1)),)


def windows(hashes: str, masks) -> list[Column]:
    """For each mask an array of the hashes of all windows, by position."""
    n, out = F.size(hashes), []
    for number, mask in enumerate(masks):
        taken = [i for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(n >= len(mask), F.transform(F.sequence(F.lit(0), n - len(mask)), seed_at(hashes, number, taken))).alias(f"m{number}"))
    return out


def placed(windows_of: str, keep=None) -> Column:
    """array of (pos, h) of the windows whose hash passes `keep`."""
    put = lambda h, i: F.struct(i.alias("pos"), h.alias("h"))
    if keep is None:
        return F.coalesce(F.transform(windows_of, put), F.array().cast("array<struct<pos:int,h:bigint>>"))
    return F.coalesce(F.filter(F.transform(windows_of, lambda h, i: F.when(keep(h), put(h, i))), lambda s: s.isNotNull()), F.array().cast("array<struct<pos:int,h:bigint>>"))


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, norm_words(F.col(text)).alias("w")).withColumn("wh", F.transform("w", lambda w: F.xxhash64(w)))


def bitmap(seeds: DataFrame, bits: int = BITS) -> DataFrame:
    """One row: the seeds' hashes as 2**bits bits in longs. Its size depends on `bits` alone."""
    cell = F.pmod(F.col("h"), F.lit(1 << bits))
    filled = seeds.select(F.shiftright(cell, 6).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(h, {1 << bits}) & 63 as int))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("x"))
    every = seeds.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("i")).join(filled, "i", "left").select("i", F.coalesce("x", F.lit(0).cast("long")).alias("x"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, min_words: int = MIN_WORDS, min_same: int = MIN_SAME) -> DataFrame:
    """(doc_id, item_id, n_same, n_items_words): every document and item that share a passage, with the most words that agree
    along one alignment. docs: doc_id, text; benchmark: item_id, text."""
    docs, last_doc = with_ids(docs.select("doc_id", "text"), "_id")
    benchmark, last_item = with_ids(benchmark.select("item_id", "text"), "_id", "item_id")
    docs, benchmark = docs.select(F.col("_id").alias("doc_id"), "text"), benchmark.select(F.col("_id").alias("item_id"), "text")
    items = hashed(benchmark, "item_id", "text").where(F.size("w") > 0).withColumn("run", F.least(F.size("w"), F.lit(min_words)))
    runs = sorted(r["run"] for r in items.select("run").distinct().collect())  # min_words rows at most
    sets = {r: masks_of(r, min_same, masks) for r in runs}
    used = sorted({m for x in sets.values() for m in x})
    names = [f"m{i}" for i in range(len(used))]
    none = F.lit(None).cast("array<bigint>")
    own = [F.when(F.col("run").isin([r for r in sets if m in sets[r]]), w).otherwise(none).alias(name) for m, name, w in zip(used, names, windows("wh", used), strict=True)]
    seeds = items.select("item_id", *own).select("item_id", F.explode(F.concat(F.array().cast("array<struct<pos:int,h:bigint>>"), *map(placed, names))).alias("s")).select("item_id", F.col("s.pos").alias("item_pos"), F.col("s.h").alias("h"))
    # the bitmap is a column so that each row's array functions can read it; its size follows the benchmark, not the documents
    seeds = shared_table(seeds, "seeds")
    bits = min(max(BITS, (SPARSE * seeds.count()).bit_length()), MOST_BITS)
    d = hashed(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id", *windows("wh", used), bitmap(seeds, bits).scalar().alias("bits"))
    cell = lambda h: F.pmod(h, F.lit(1 << bits))
    known = lambda h: F.get("bits", F.shiftright(cell(h), 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), cell(h).bitwiseAND(F.lit(63)).cast("int"))) != 0
    found = d.select("doc_id", F.explode(F.concat(F.array().cast("array<struct<pos:int,h:bigint>>"), *[placed(m, known) for m in names])).alias("s")).select("doc_id", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"))
    hits = shared_table(found.join(seeds, "h").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")
    checked = verified(docs, items.drop("run"), hits, min_words, min_same)
    return checked.select(real_id(F.col("doc_id"), last_doc).alias("doc_id"), real_id(F.col("item_id"), last_item).alias("item_id"), "n_same", "n_item_words")


def verified(docs: DataFrame, items: DataFrame, hits: DataFrame, min_words: int, min_same: int) -> DataFrame:
    """Lay each item along the document at each hit's shift and count the words that agree in every run of `min_words`."""
    shifts = hits.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))  # at most words x words of one item
    # only documents with hits are needed; their ids are broadcast if they are few
    needed = join_sized(docs.select("doc_id", "text"), hits.select("doc_id").distinct(), "doc_id", "left_semi", BROADCAST_ROWS)
    rows = needed.select("doc_id", norm_words(F.col("text")).alias("dw")).join(shifts, "doc_id").join(items.select("item_id", F.col("w").alias("iw")), "item_id")
    n = F.size("iw")
    run = F.least(n, F.lit(min_words))
    same = lambda s: F.transform("iw", lambda x, i: F.coalesce(F.when(s + i >= 0, F.get("dw", s + i)) == x, F.lit(False)).cast("int"))
    # `one` shift a row: a document has few items and shifts, and the arrays of a row are as long as one item
    rows = rows.select("doc_id", "item_id", "dw", "iw", F.explode("shifts").alias("shift")).withColumn("same", same(F.col("shift"))).select("doc_id", "item_id", "same", n.alias("n"), run.alias("run"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("run") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("run")), F.lit(0), lambda a, x: a + x)))
    rows = rows.withColumn("best", best).where(F.col("best") * 100 >= F.col("run") * min_same)
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    return rows.groupBy("doc_id", "item_id").agg(F.max(total).cast("long").alias("n_same"), F.max("n").cast("long").alias("n_item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a leak, with the columns they came with; rows of null doc_id are judged one by one."""
    name = unused("own", docs.columns)
    every, _ = with_ids(docs, name)
    bad = leaks(every.select(F.col(name).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return join_sized(every, bad, name, "left_anti", BROADCAST_ROWS).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
