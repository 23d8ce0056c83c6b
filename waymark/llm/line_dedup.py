"""Line dedup by a segment-partition edit join.

Lines are the \\n-split parts of a text, trimmed of white space; those without a word are left alone. Equal lines are one (by a
64-bit hash). Two distinct lines are linked within e edits, e being one for every CHARS_PER_EDIT characters of the shorter line
and EDITS at most (so lines below CHARS_PER_EDIT characters are linked when equal only: one edit makes another list number of
them). They are found by cutting the shorter line into e + 1 segments: edits can't touch them all, so one segment occurs in the
other line, near its place. Segments are indexed under (length of the line, number of the segment, hash); a line probes the
indexes of all lengths up to EDITS shorter than its own with the substrings that multi-match-aware selection leaves. Lines that
meet are verified with a banded bit-parallel edit distance. Linked lines form classes; the first line of a class, by document
and line number, stays.

Rolling hashes give every substring's hash by one subtraction, over whole Arrow batches. A key under which more than BLOCK lines
meet is split by a second segment: what is left of two linked lines without the segment they share is within e edits too, so it
shares a segment again; what still meets in large numbers is dealt out in pairs of blocks. Null texts have no lines. Rows of null
doc_id take no part. Rows that repeat a doc_id are taken for the same document. Very long texts and lines are taken whole. An
empty table gives no rows; columns of any other name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, connected_components, join_sized, shared_table, unused

EDITS, CHARS_PER_EDIT = 2, 10
BLOCK = 256
#: Characters whose hashes are held at once.
CHARS_AT_ONCE = 1 << 19
BROADCAST_ROWS = 2_000_000
P = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(P)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any [start, start + n) of an array of code points."""

    def __init__(self, codes: np.ndarray):
        size = len(codes)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(codes.astype(np.uint64)) * powers(P, size)[:-1], dtype=np.uint64)])
        self.back = powers(pow(P, -1, 1 << 64), size)

    def __call__(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.back[start]


def allowed(length, edits: int = EDITS, per_edit: int = CHARS_PER_EDIT):
    """How many edits a line of such a length may be from a longer one."""
    return np.minimum(edits, length // per_edit)


def segment(length: np.ndarray, i: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of `parts`: sizes differ by one at most, the longer ones last."""
    size, extra = length // parts, length % parts
    longer = np.maximum(0, i - (parts - extra))
    return i * size + longer, size + (i >= parts - extra)


def keys(codes: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int = EDITS, allow=allowed) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the line, key, role, where the substring begins, its size) in arrays; role 3: in the index and probing, 2:
    probing only."""
    rolling, every = Rolling(codes), np.arange(len(start))
    for shorter in range(edits + 1):
        l = length - shorter
        e = allow(np.maximum(l, 0), edits)
        for i in range(edits + 1):
            p, q = segment(l, i, e + 1)
            low = np.maximum(p - i, p + shorter - (e - i))
            high = np.minimum(p + i, p + shorter + (e - i))
            for step in range(2 * edits + 1):
                at = low + step
                ok = np.flatnonzero((e >= np.maximum(shorter, max(i, 1))) & (at <= high) & (at >= 0) & (at + q <= length) & (q > 0))
                if not len(ok):
                    continue
                own = (shorter == 0) & (at[ok] == p[ok])
                key = mixed(rolling(start[ok] + at[ok], q[ok]) + mixed((l[ok] * (edits + 1) + i).astype(np.uint64)))
                for role, pick in ((3, own), (2, ~own)):
                    if pick.any():
                        yield every[ok[pick]], key[pick], role, at[ok[pick]], q[ok[pick]]


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most `edits`: a band of 2 * edits + 1 diagonals in the bits of one number."""
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > edits:
        return False
    if a == b:
        return True
    w = 2 * edits + 1
    full, top = (1 << w) - 1, 1 << (w - 1)
    vp, vn, dist = (full << edits) & full, 0, edits
    level = top >> 1
    for j in range(n):
        x, c = 0, b[j]
        for k in range(w):  # bit k stands for row j - edits + k
            r = j - edits + k
            if 0 <= r < m and a[r] == c:
                x |= 1 << k
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + edits < m:  # down the band's lowest diagonal
            dist += not d0 & top
        else:  # along the last row
            dist += bool(hp & level) - bool(hn & level)
            level >>= 1
        if dist > edits + n - max(j + 1, m - edits):  # each step along the last row wins back one at most
            return False
        d0 >>= 1
        vp, vn = (hn | ~(d0 | hp)) & full, d0 & hp
    return dist <= edits


def close(a: str, b: str, edits: int = EDITS) -> bool:
    """within(), after what both share at their ends."""
    if abs(len(a) - len(b)) > edits:
        return False
    m, i = min(len(a), len(b)), 0
    step = 64
    while i < m and a[i : i + step] == b[i : i + step]:
        i += step
    i = min(i, m)
    while i < m and a[i] == b[i]:
        i += 1
    e = 0
    while e < m - i and a[len(a) - 1 - e] == b[len(b) - 1 - e]:
        e += 1
        if e % step == 0:
            while e + step <= m - i and a[len(a) - e - step : len(a) - e] == b[len(b) - e - step : len(b) - e]:
                e += step
    return within(a[i : len(a) - e], b[i : len(b) - e], edits)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, h: each line with a word."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where("line != ''")
    return lines.withColumn("h", F.xxhash64("line"))


def meetings(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, h, role) of lines that meet others under a key. lines: h, line."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task's copies of a line; those of other tasks fall together below
        for batch in batches:
            hs, texts, size = [], [], 0
            n = batch.num_rows
            for r, (h, line) in enumerate(zip(batch.column(0).to_numpy().tolist(), batch.column(1), strict=True)):
                if h not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(h)
                    hs.append(h)
                    texts.append(line.as_py())
                    size += len(texts[-1])
                if texts and (size > CHARS_AT_ONCE or r == n - 1):
                    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    length = np.array([len(t) for t in texts])
                    start, h_of = np.cumsum(length) - length, np.array(hs, dtype=np.int64)
                    for who, key, role, _, _ in keys(codes, start, length, edits):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h_of[who]), pa.array(np.full(len(who), role, dtype=np.int8))], ["key", "h", "role"])
                    hs, texts, size = [], [], 0

    every = lines.select("h", "line").mapInArrow(rows, "key long, h long, role byte")
    at = Window.partitionBy("key")
    met = every.select("key", "h", "role", F.min("h").over(at).alias("lo"), F.max("h").over(at).alias("hi"), F.max("role").over(at).alias("any"))
    return met.where("lo < hi and any = 3").select("key", "h", "role").distinct()


def split(crowded: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, h, role) of lines that share a second segment beside their first. crowded: key, h, role, line.

    A line goes without the substring it has under its key; what is left is cut anew. A remainder is as long as its line less the
    same segment, so the number of edits still follows from the shorter line's length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, hs, roles, lines = (batch.column(k).to_pylist() for k in range(4))
            for r in range(batch.num_rows):
                codes = np.frombuffer(lines[r].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                whole, found = len(codes), []
                for _, key, role, at, q in keys(codes, np.zeros(1, np.int64), np.array([whole]), edits):
                    if role >= roles[r] and int(key.view(np.int64)[0]) == first[r]:
                        found.append((int(at[0]), int(q[0]), role))
                out: list[tuple[int, int]] = []
                for at, q, role in found:
                    rest = np.concatenate([codes[:at], codes[at + q :]])
                    if not len(rest):
                        out.append((first[r], role))
                        continue
                    # lengths that may meet here are those of the whole lines, whatever was cut out of both
                    allow = lambda l, most, q=q: allowed(l + q, most)
                    for _, key, again, _, _ in keys(rest, np.zeros(1, np.int64), np.array([len(rest)]), edits, allow):
                        out.append((int(mixed(key + np.uint64(first[r] & (2**64 - 1))).view(np.int64)[0]), min(role, again)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([hs[r]] * len(out), pa.int64()), pa.array([x for _, x in out], pa.int8())], ["key", "h", "role"])

    return crowded.select("key", "h", "role", "line").mapInArrow(rows, "key long, h long, role byte")


def links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b) hashes of lines within `edits` of each other, enough of them to span every class. lines: h, line."""
    met = shared_table(meetings(lines, edits), "lines-met")
    sizes = met.groupBy("key").agg(F.count("*").alias("g"))
    texts = join_sized(lines.select("h", "line"), met.select("h").distinct(), "h", "left_semi", BROADCAST_ROWS).groupBy("h").agg(F.first("line").alias("line"))
    few = met.join(sizes.where(F.col("g") <= BLOCK).select("key"), "key")
    large = sizes.where(F.col("g") > BLOCK).select("key")
    if not large.isEmpty():
        again = split(met.join(large, "key").join(texts, "h"), edits).groupBy("key", "h").agg(F.max("role").alias("role"))
        few = few.unionByName(shared_table(again, "lines-split"))
        sizes = few.groupBy("key").agg(F.count("*").alias("g"))
    blocks = few.join(sizes.where("g > 1"), "key").withColumn("nb", F.ceil(F.col("g") / BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("h"), F.col("nb")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least("b", k).alias("i"), F.greatest("b", k).alias("j")))
    blocks = blocks.select("key", "h", "role", F.explode(pair).alias("p")).select("key", "h", "role", "p.i", "p.j")
    rows = blocks.join(texts, "h").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def settle() -> None:
            root = list(range(len(group)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, (h, role, line, n) in enumerate(group):
                for j in range(i):
                    _, role2, line2, n2 = group[j]
                    if (role == 3 or role2 == 3) and abs(n - n2) <= edits and find(i) != find(j) and close(line, line2, int(allowed(min(n, n2), edits))):
                        root[find(i)] = find(j)
                        out.append((h, group[j][0]))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for *key, h, role, line in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if key != now:
                    settle()
                    now, group = key, []
                group.append((h, role, line, len(line)))
            if len(out) > 5000:
                yield batch_of()
                out.clear()
        settle()
        yield batch_of()

    return rows.select("key", "i", "j", "h", "role", "line").mapInArrow(joined, "a long, b long")


def repeats(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, line_no, h, first_h, first_doc, first_line: every line that repeats an earlier line of its class."""
    lines = occurrences(docs)
    found = links(lines.where(F.length("line") >= CHARS_PER_EDIT), edits)
    cc = connected_components(found)
    narrow = lines.select("doc_id", "line_no", "h")
    by_line = shared_table(narrow.groupBy("h").agg(F.min(F.struct("doc_id", "line_no", "h")).alias("first"), F.count("*").alias("n")), "lines")
    classed = by_line.join(cc, by_line["h"] == cc["node"], "left").select("h", F.coalesce("component", "h").alias("class"), "first", "n")
    firsts = classed.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    wanted = classed.select("h", "class").join(firsts.select("class", "first"), "class").select("h", "first")
    out = narrow.join(wanted, "h").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no")))
    return out.select("doc_id", "line_no", "h", F.col("first.h").alias("first_h"), F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_near, removed: array of (line_no, first_doc, first_line), by line. One row a document with any."""
    r = repeats(docs)
    return r.groupBy("doc_id").agg(F.count_distinct("line_no").alias("n_removed"), F.count_distinct(F.when(F.col("h") != F.col("first_h"), F.col("line_no"))).alias("n_near"), F.sort_array(F.collect_set(F.struct("line_no", "first_doc", "first_line"))).alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the lines that repeat earlier ones; documents of which nothing is left go. All columns stay, whatever their
    names; n_chars, where there is one, follows the text."""
    own = unused("gone", docs.columns)
    gone = removals(docs.select("doc_id", "text")).select(F.col("doc_id").alias(own), F.transform("removed", lambda x: x["line_no"]).alias(f"{own}_lines"))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(f"{own}_lines", i))
    rest = F.array_join(left, "\n")
    out = docs.join(gone, docs["doc_id"] == gone[own], "left")
    touched = F.col(own).isNotNull()
    out = out.where(~touched | F.exists(left, lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    put = {"text": F.when(touched, rest).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(touched, F.length(rest).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    listed = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["line_no"], x["first_doc"], x["first_line"])), ",")
    out = docs.select("doc_id", n_lines.cast("long").alias("n_lines")).join(removals(docs), "doc_id", "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(listed, F.lit("")).alias("removed"))
