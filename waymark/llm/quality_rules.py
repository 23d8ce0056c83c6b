"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Null text counts as empty: no words, so the base rule (50 words) rejects it. Texts of any length are taken whole.
Repeated rows each get their own verdict; no row depends on another, so there is no shuffle. Extra columns of the input
are ignored by the query and passed on by keep_good().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, words

#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in a is that for it was with as be by on are this at from or an have not you "
    "der die das und ist in den von zu mit ein eine nicht auf für als auch sich dem des "
    "le la les de des et en un une du que qui dans pour pas sur est au par avec "
    "el la los las de y en un una que es por con para del se no su lo mi"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure has to lie within [low, high]; either end may be open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Ratios are per word, per line or per character as their names say.
RULES = (
    Rule("n_words", low=50, high=1_000_000),
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("exclamations_per_word", high=0.3),
    Rule("upper_case_ratio", high=0.3),
    Rule("n_stop_words", low=2),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


def removed(text: Column, chars: str) -> Column:
    """How many characters of the set the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with a struct column `q` of measures. Array steps stay in projections of their own, so that each runs once."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    step = docs.withColumn("_t", t).withColumn("_w", words(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n"), has_word))
    step = step.withColumn("_n", F.size("_w")).withColumn(
        "_win",
        F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
    )
    repeats = F.size("_win") > F.size(F.array_distinct("_win"))
    step = step.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, k: F.coalesce(F.get("_sorted", k)["h"] == s["h"], F.lit(False))
    step = step.withColumn("_again", F.transform("_sorted", lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["i"])))
    covered = F.array_distinct(F.flatten(F.transform(F.filter("_again", lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2))))
    n, lines = F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    n_dup = F.size("_lines") - F.size(F.array_distinct("_lines"))
    chars = F.length(F.translate(F.col("_t"), SPACES, ""))
    symbols = removed(F.col("_t"), "#*$%&|<>")
    q = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_sorted").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        (chars / n).alias("mean_word_chars"),
        (symbols / n).alias("symbols_per_word"),
        (removed(F.col("_t"), "!") / n).alias("exclamations_per_word"),
        (removed(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ") / F.greatest(chars, F.lit(1))).alias("upper_case_ratio"),
        F.size(F.array_intersect("_w", F.array(*map(F.lit, sorted(set(STOP_WORDS)))))).alias("n_stop_words"),
        (n_dup / lines).alias("dup_line_ratio"),
        (F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•]"))) / lines).alias("bullet_line_ratio"),
        (F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))) / lines).alias("ellipsis_line_ratio"),
    )
    return step.withColumn("q", q).drop("_t", "_w", "_lines", "_n", "_win", "_sorted", "_again")


def passes(rules: tuple[Rule, ...] = RULES, of: str = "q") -> Column:
    """The table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        m = F.col(f"{of}.{r.measure}")
        out = out & (m >= r.low if r.low is not None else F.lit(True)) & (m <= r.high if r.high is not None else F.lit(True))
    return out


def base_failed(of: str = "q") -> Column:
    q = F.col(of)
    return (q["n_words"] < BASE_WORDS) | (100 * q["n_repeat_words"] > BASE_REPEAT_PERCENT * q["n_words"])


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    failed = base_failed()
    columns = [F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return measured(docs.select("doc_id", "text")).select("doc_id", *columns, failed.alias("base_failed"), (~failed & passes(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes the base rules and the table, with the columns they came with."""
    names = docs.columns
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    # the generator keeps the filter above the measures; pushed below, it would repeat them in itself again and again
    return measured(plain).select("_row", F.explode(F.array("q")).alias("q")).where(~base_failed() & passes(rules)).select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
