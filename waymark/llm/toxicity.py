"""Toxicity: embeddings of character n-grams, averaged over a text, into a linear softmax; all trained jointly in numpy.

A word is a run of letters, lower-cased; its features are the n-grams of 3 to 5 characters of <word> and the word itself, each
hashed to a row of the embedding table, so a misspelling shares most rows with the word it comes from. A text is the mean of all
rows of all its words. Because the softmax is linear in that mean, scoring needs one number a row.

Fitted on a bounded sample of labelled rows, taken by a hash of doc_id: at most MOST_TOXIC toxic and MOST_CLEAN clean ones (the
rows of the held-out fold never). The class shares of all labelled rows outside that fold correct the sample's. Scoring reads
all texts whole. Null and empty texts and texts without letters get the score of the mean text of no words, the bias alone.
Documents labelled more than once count as toxic if any label says so; null labels are ignored. Without any label every score
is that of the bias 0 corrected by nothing, one half. Repeated rows each get their score. Rows of null doc_id are scored and not
held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TOXIC, MOST_CLEAN = 1500, 2500
ROWS, DIM, EPOCHS, BATCH, RATE, DECAY = 1 << 17, 4, 20, 250, 0.2, 1e-6
CHUNK = 2 << 20
P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x10000: the lower-case code point of letters, else 0; and a fixed random number."""
    lower = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            s = chr(c).lower()
            lower[c] = ord(s) if len(s) == 1 and ord(s) < 0x10000 else c
    return lower, mixed(np.arange(0x10000, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + P) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], (codes > 0).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, table row) of every n-gram of the words."""
    n = ends - starts
    size = n + 2
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(first[-1], 1, dtype=np.uint64)  # 1 stands for both ends of a word
    inside = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    flat[np.repeat(first[:-1], n) + 1 + inside] = codes[np.repeat(starts, n) + inside]
    word = np.repeat(np.arange(len(n)), size)
    left = np.repeat(first[1:], size) - np.arange(first[-1])  # characters to the word's end
    m = tables()[1][flat.astype(np.int64)]
    words, rows = [], []
    h = m.copy()
    for k in range(2, 6):
        h = h[: len(m) - k + 1] * P + m[k - 1 :]
        if k >= 3:
            ok = np.flatnonzero(left[: len(h)] >= k)
            words.append(word[ok])
            rows.append(mixed(h[ok] + np.uint64(k)) % np.uint64(ROWS))
    whole = np.zeros(len(n), dtype=np.uint64)
    np.add.at(whole, word, m * (np.arange(first[-1]) - np.repeat(first[:-1], size) + 1).astype(np.uint64) * P)
    words.append(np.arange(len(n)))
    rows.append(mixed(whole) % np.uint64(ROWS))
    return np.concatenate(words), np.concatenate(rows).astype(np.int64)


def codes_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(raw < 0x10000, tables()[0][np.minimum(raw, 0xFFFF)], 0)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, document number of each code) over many texts, a bounded number of characters at a time, cut between words."""
    held: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    size = 0
    for d, text in enumerate(texts):
        codes = codes_of(text or "")
        at = 0
        while at < len(codes):
            end = min(len(codes), at + CHUNK)
            while end < len(codes) and codes[end] and codes[end - 1]:  # a word longer than that is taken whole
                end += 1
            held += [codes[at:end], np.zeros(1, dtype=np.uint32)]
            docs.append(np.full(end - at + 1, d))
            size += end - at + 1
            at = end
            if size >= CHUNK:
                yield np.concatenate(held), np.concatenate(docs)
                held, docs, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(docs)


def distinct_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of one occurrence of each word, the number of each occurrence's word, and all starts."""
    starts, ends = word_spans(codes)
    if not len(starts):
        return starts, ends, starts, starts
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), P)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tables()[1][codes] * powers[:-1], dtype=np.uint64)])
    inverse = np.uint64(pow(int(P), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), inverse)]))
    h = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    _, at, number = np.unique(h, return_index=True, return_inverse=True)
    return starts[at], ends[at], number, starts


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows in order of document: (document, table row, share of the document's n-grams)."""
    keys, counts = [], []
    for codes, docs in pieces(texts):
        s, e, number, starts = distinct_words(codes)
        if not len(s):
            continue
        word, row = grams(codes, s, e)
        pair, times = np.unique(docs[starts].astype(np.int64) * (len(s) + 1) + number, return_counts=True)
        d, w = pair // (len(s) + 1), pair % (len(s) + 1)
        order = np.argsort(word, kind="stable")
        first = np.searchsorted(word[order], np.arange(len(s) + 1))
        n = (first[1:] - first[:-1])[w]
        at = np.repeat(first[:-1][w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key, where = np.unique(np.repeat(d, n) * ROWS + row[order][at], return_inverse=True)
        keys.append(key)
        counts.append(np.bincount(where, weights=np.repeat(times, n)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(where, weights=np.concatenate(counts))
    d = key // ROWS
    return d, key % ROWS, (count / np.bincount(d, weights=count)[d]).astype(np.float32)


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, weights of the softmax, biases), by Adam over mini-batches."""
    rng = np.random.default_rng(7)
    table = np.zeros((ROWS, DIM), dtype=np.float32)  # so that n-grams never seen add nothing
    weights, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    doc, row, share = features(texts)
    used, row = np.unique(row, return_inverse=True)
    small = table[used]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (small, weights, bias)]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            n = (first[1:] - first[:-1])[batch]
            pick = np.repeat(first[:-1][batch], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            r, s, d = row[pick], share[pick], np.repeat(np.arange(len(batch)), n)
            there, local = np.unique(r, return_inverse=True)
            rows = small[there]
            mean = np.stack([np.bincount(d, weights=rows[local, k] * s, minlength=len(batch)) for k in range(DIM)], axis=1).astype(np.float32)
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            back = (p @ weights.T).astype(np.float32)
            g_rows = np.stack([np.bincount(local, weights=back[d, k] * s, minlength=len(there)) for k in range(DIM)], axis=1).astype(np.float32) + DECAY * rows
            t += 1
            fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for x, g, (m, v), where in ((small, g_rows, state[0], there), (weights, mean.T @ p, state[1], slice(None)), (bias, p.sum(axis=0), state[2], slice(None))):
                m[where] = 0.9 * m[where] + 0.1 * g
                v[where] = 0.999 * v[where] + 0.001 * g * g
                x[where] -= rate * fix * m[where] / (np.sqrt(v[where]) + 1e-8)
    table[used] = small
    return table, weights, bias


def logits_of(texts: list[str | None], per_row: np.ndarray) -> np.ndarray:
    """The mean of per_row over the n-grams of each text; 0 for none."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for codes, docs in pieces(texts):
        s, e, number, starts = distinct_words(codes)
        if not len(s):
            continue
        word, row = grams(codes, s, e)
        value, count = np.bincount(word, weights=per_row[row], minlength=len(s)), np.bincount(word, minlength=len(s))
        d = docs[starts]
        total += np.bincount(d, weights=value[number], minlength=len(texts))
        n += np.bincount(d, weights=count[number], minlength=len(texts))
    return total / np.maximum(n, 1)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> tuple[np.ndarray, float]:
    """(what each table row adds to the log odds of toxic, their offset). One task trains on the bounded sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return np.zeros(ROWS, dtype=np.float32), float({(): 0, (0,): -2, (1,): 2}[tuple(n)])
    part = lambda v, k: known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    sample = part(1, most_toxic).unionByName(part(0, most_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("_one", F.lit(0))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        y = pdf["toxic"].to_numpy(dtype=np.int64)
        table, weights, bias = train(list(pdf["text"]), y)
        side = weights[:, 1] - weights[:, 0]
        prior = np.log(max(n[1], 1) / max(n[0], 1)) - np.log(max((y == 1).sum(), 1) / max((y == 0).sum(), 1))
        return pd.DataFrame({"w": [(table @ side).astype(np.float32).tobytes()], "b": [float(bias[1] - bias[0] + prior)]})

    got = rows.groupBy("_one").applyInPandas(one, "w binary, b double").collect()
    if not got:
        return np.zeros(ROWS, dtype=np.float32), 0.0
    return np.frombuffer(bytes(got[0]["w"]), dtype=np.float32), got[0]["b"]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs: doc_id, text. doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_row, offset = shared.value
        for batch in batches:
            z = logits_of(batch.column(2).to_pylist(), per_row) + offset
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
