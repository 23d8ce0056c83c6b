"""N-gram Jaccard join: prefix-tree join over globally ordered sets of word shingles, down to connected components.

A document's set holds 64-bit hashes of its distinct five-word shingles. One order holds everywhere: shingles that are frequent
among prefixes come last, the others by hash. Two sets of Jaccard similarity 0.8 or more share a shingle among the first
n - ceil(0.8 n) + 1 of each, so sets meet under the shingles of their prefixes. A meeting is skipped if all who meet there have
met under the previous shingle of their prefixes already. Those who meet are stored in a trie in the global order and joined
with one another: overlaps of shared trie paths are counted once, subtrees are pruned by the lengths that remain, and by
components already known to be one. Small meetings go to their tries as pairs (one set against a trie of its partners); meetings
of more than PAIRED sets that no pivot explains go as pairs of blocks, each joined with itself in one trie, so no task holds more
than two blocks at once; every pair still meets. Equal sets are one node throughout, so exact copies cost nothing.

Null texts and texts without words have an empty set and are their own component. Texts of fewer than five words have their
whole sequence as one shingle. Repeated rows are copies. Rows of null doc_id take part under ids of their own above all others,
so a component has a null id only if all of its members have. An empty table gives no rows. Very long texts are taken whole.
Other columns don't matter, whatever their names. Any two hashes that collide (64 bits) are taken for the same shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, join_sized, real_id, shared_table, unused, with_ids

WORDS, SAME, OF = 5, 80, 100
#: A shingle in more prefixes than this is moved to the end of the order, as long as the list of them stays this short.
FREQUENT, MOST_FREQUENT, ROUNDS = 48, 1_000_000, 2
BLOCK, PAIRED, STRIDE = 512, 64, 32
BROADCAST_ROWS = 2_000_000
SLICE, TALLY, CELLS = 1 << 20, 1 << 20, 1 << 24
P = 0x9E3779B97F4A7C15
INVERSE = pow(P, -1, 1 << 64)
TOP = np.uint64(1 << 63)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_in_word = np.ones(256, dtype=bool)
_in_word[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(P)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_byte = mixed(np.arange(256, dtype=np.uint64))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """0 to n, at least; kept for the next piece of text unless it was a very long one."""
    if len(_powers.get(base, ())) <= n:
        out = np.full(max(n, SLICE) + 1, np.uint64(base % (1 << 64)))
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > SLICE:
            return out
        _powers[base] = out
    return _powers[base]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes with documents starting at `cuts`: (hash of each word, document of each word)."""
    word = _in_word[data]
    before = np.concatenate([[False], word[:-1]])
    first = np.zeros(len(data) + 1, dtype=bool)
    first[cuts] = True
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    value = _byte[_lower[data]]
    # a window over the powers keeps them small in number; words are hashed relative to their start
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value * powers(P, len(data))[: len(data)], dtype=np.uint64)])
    back = powers(INVERSE, len(data))[starts]
    h = mixed((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(cuts, starts, side="right") - 1


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes, 63 bits each."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        part, cuts = data[offsets[at] : offsets[end]], (offsets[at:end] - offsets[at])
        if len(part):
            h, doc = word_hashes(part, cuts)
        else:
            h, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        count = np.bincount(doc, minlength=end - at)
        if len(h) >= words:
            s = np.zeros(len(h) - words + 1, dtype=np.uint64)
            for k in range(words):
                s = s * np.uint64(P) + h[k : len(h) - words + 1 + k]
            s = mixed(s) >> np.uint64(1)
        else:
            s = np.zeros(0, dtype=np.uint64)
        begin = np.concatenate([[0], np.cumsum(count)])
        for i in range(end - at):
            n = count[i]
            if n >= words:
                own = np.sort(s[begin[i] : begin[i] + n - words + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif n:
                few = np.array([n], dtype=np.uint64)
                for k in range(begin[i], begin[i] + n):
                    few = few * np.uint64(P) + h[k]
                yield mixed(few) >> np.uint64(1)
            else:
                yield s[:0]
        at = end


def signature(s: np.ndarray) -> np.int64:
    """Of a set: 64 bits that don't depend on its order."""
    total = mixed(s ^ np.uint64(P)).sum(dtype=np.uint64, keepdims=True)
    return (total * np.uint64(P) + np.uint64(len(s))).view(np.int64)[0]


def prefix_length(n: int) -> int:
    return n - -(-SAME * n // OF) + 1


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set in the global order; the top bit marks frequent shingles, so the order is that of unsigned numbers."""
    if not len(frequent) or not len(s):
        return s
    at = np.searchsorted(frequent, s)
    hot = frequent[np.minimum(at, len(frequent) - 1)] == s
    return np.concatenate([s[~hot], s[hot] | TOP]) if hot.any() else s


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig and the prefix by hash alone, for each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, prefixes = [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                sig.append(signature(s))
                prefixes.append(s[: prefix_length(len(s))].view(np.int64) if len(s) else s.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), listed(prefixes)], ["doc_id", "n", "sig", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, sig long, prefix array<long>")


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def tallied(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(t, n): how often each token occurs in a piece of a partition, so that a frequent one moves as one row a piece."""
    fresh, size = [], 0

    def out() -> pa.RecordBatch:
        t, n = np.unique(np.concatenate(fresh) if fresh else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(n, pa.int32())], ["t", "n"])

    for tokens in arrays:
        fresh.append(tokens)
        size += len(tokens)
        if size >= TALLY:
            yield out()
            fresh, size = [], 0
    yield out()


def counted(tallies: DataFrame, over: int) -> DataFrame:
    """(t, n) of the tokens seen more than `over` times; each partition keeps a running table of distinct tokens only."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, times, fresh, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every, where = np.unique(np.concatenate([have, *[t for t, _ in fresh]]), return_inverse=True)
            return every, np.bincount(where, weights=np.concatenate([times, *[n for _, n in fresh]])).astype(np.int64)

        for batch in batches:
            fresh.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= TALLY:
                (have, times), fresh, size = merged(), [], 0
        if fresh:
            have, times = merged()
        keep = times > over
        yield pa.RecordBatch.from_arrays([pa.array(have[keep]), pa.array(times[keep])], ["t", "n"])

    return tallies.repartition("t").mapInArrow(rows, "t long, n long")


def frequent_shingles(docs: DataFrame, firsts: DataFrame) -> np.ndarray:
    """The sorted hashes of what is frequent among prefixes, then among the prefixes that this order gives, and so on."""
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tallied(batch.column(0).flatten().to_numpy() for batch in batches)

    tallies, known = firsts.select("prefix").mapInArrow(first, "t long, n int"), np.zeros(0, np.uint64)
    for _ in range(ROUNDS):
        table = shared_table(counted(tallies, FREQUENT), "frequent")
        over = FREQUENT
        while table.where(F.col("n") > over).count() > MOST_FREQUENT - len(known):
            over *= 2
        fresh = np.array([r["t"] for r in table.where(F.col("n") > over).select("t").collect()], dtype=np.int64).view(np.uint64)
        if not len(fresh):
            break
        old, known = known, np.union1d(known, fresh)
        shared = spark.sparkContext.broadcast((old, known))

        def later(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            before, now = shared.value

            def brought_in() -> Iterator[np.ndarray]:
                for batch in batches:
                    for s in shingle_sets(batch.column(1)):
                        p = prefix_length(len(s))
                        was, new = ordered(s, before)[:p], ordered(s, now)[:p]
                        if len(s) and not np.array_equal(was, new):  # only what this order brought in
                            yield np.setdiff1d(new[new < TOP], was, assume_unique=True).view(np.int64)

            yield from tallied(brought_in())

        tallies = docs.select("doc_id", "text").mapInArrow(later, "t long, n int")
    return known


def meetings(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(t, sig, n, at): who has t in the prefix and where, if at least two different sets meet there that haven't all met before."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task; other tasks' copies fall together below
        for batch in batches:
            tokens, sigs, ns, befores, places = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                sig = int(signature(s))
                if not len(s) or sig in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(sig)
                p = ordered(s, shared.value)[: prefix_length(len(s))].view(np.int64)
                tokens.append(p)
                befores.append(np.concatenate([[0], p[:-1]]))
                sigs.append(np.full(len(p), sig, dtype=np.int64))
                ns.append(np.full(len(p), len(s), dtype=np.int32))
                places.append(np.arange(len(p), dtype=np.int32))
            for a in range(0, len(tokens), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x[a : a + 1000])) for x in (tokens, befores, sigs, ns, places)], ["t", "before", "sig", "n", "at"])

    every = docs.select("doc_id", "text").mapInArrow(rows, "t long, before long, sig long, n int, at int")
    at = Window.partitionBy("t")
    met = every.select("t", "before", "sig", "n", "at", F.min("sig").over(at).alias("lo"), F.max("sig").over(at).alias("hi"), F.min("before").over(at).alias("b0"), F.max("before").over(at).alias("b1"))
    met = met.where((F.col("lo") < F.col("hi")) & ~((F.col("b0") == F.col("b1")) & (F.col("b0") != 0)))
    return met.select("t", "before", "sig", "n", "at").distinct()


def common_start(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def trie_search(x: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of the sets are linked with x. Sorted sets and the lengths of the starts that neighbours share are their trie: what
    x has of a shared start is counted once and taken over from set to set."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    nx, found, before = len(x), [], np.zeros(0, np.uint64)
    counts, depth, pruned = np.zeros(1, np.int64), 0, None
    for i in order:
        y = sets[i]
        ny = len(y)
        depth = min(depth, common_start(before, y))  # of the last set counted and this one
        if pruned is not None and depth >= pruned:
            continue  # below a pruned node
        pruned = None
        if OF * min(nx, ny) < SAME * max(nx, ny):
            continue
        rest = y[depth:]
        hit = x[np.minimum(np.searchsorted(x, rest), nx - 1)] == rest
        counts = np.concatenate([counts[: depth + 1], counts[depth] + np.cumsum(hit)])
        if counts[ny] * (OF + SAME) >= SAME * (nx + ny):
            found.append(i)
        else:
            # the first node below which what was shared and what is left of x fall short of what any link of x needs
            left = nx - np.concatenate([[0], np.searchsorted(x, y, side="right")])
            hopeless = np.flatnonzero(counts[: ny + 1] + left < -(-SAME * nx // OF))
            pruned = int(hopeless[0]) if len(hopeless) and hopeless[0] > 0 else None
        before, depth = y, ny
    return found


def may_link(n1, at1, n2, at2):
    """Length bound, and what can be shared before, at and after the shingle that both have at these places."""
    most = F.least(at1, at2) + 1 + F.least(n1 - at1 - 1, n2 - at2 - 1)
    return (OF * F.least(n1, n2) >= SAME * F.greatest(n1, n2)) & (most * (OF + SAME) >= SAME * (n1 + n2))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those pairs that are linked. pairs: distinct (a, b); sets: sig, s. The partners of one `a` are searched as a
    trie, at most about BLOCK of them in one task."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    partners = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("nb")).cast("int").alias("i"), F.col("b").alias("sig"))
    queries = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.col("a").alias("sig"))
    rows = partners.unionByName(queries).join(sets, "sig").withColumn("first", F.col("a") == F.col("sig"))
    rows = rows.repartition("a", "i").sortWithinPartitions("a", "i", F.desc("first"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets = None, [], []
        out: list[tuple[int, int]] = []

        def settle():
            if len(sets) > 1 and names[0] == key[0]:
                out.extend((key[0], names[1 + k]) for k in trie_search(sets[0], sets[1:]))

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            a, i, sig = (batch.column(k).to_numpy().tolist() for k in range(3))
            values, offsets = batch.column(3).values.to_numpy().view(np.uint64), batch.column(3).offsets.to_numpy()
            for r in range(batch.num_rows):
                now = (a[r], i[r])
                if now != key:
                    settle()
                    key, names, sets = now, [], []
                names.append(sig[r])
                sets.append(values[offsets[r] : offsets[r + 1]].copy())
            if len(out) > 5000:
                yield batch_of()
                out.clear()
        settle()
        yield batch_of()

    return rows.select("a", "i", "sig", "s").mapInArrow(joined, "a long, b long")


def possible(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """The pairs that their prefixes by hash don't rule out. Below the lesser of the two last hashes both prefixes are complete,
    so what is shared there and the shorter remainder bound the overlap. starts: sig, n, prefix."""
    side = lambda x: starts.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("top", F.least(F.element_at("pa", -1), F.element_at("pb", -1)))
    rest = lambda x: F.col(f"n{x}") - F.size(F.filter(f"p{x}", lambda v: v <= F.col("top")))
    most = F.size(F.array_intersect("pa", "pb")) + F.least(rest("a"), rest("b"))
    return both.where(most * (OF + SAME) >= SAME * (F.col("na") + F.col("nb"))).select("a", "b")


def crowded(many: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) that link components among the members of large meetings. many: t, k, g, sig, c, own; block by block, each pair of
    blocks once, the overlaps of all pairs of a block counted at once from the shingles that the block shares."""
    blocks = many.withColumn("nb", F.ceil(F.col("g") / BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j")))
    blocks = blocks.select("t", "k", "sig", "c", "own", F.explode(pair).alias("p")).select("t", "k", "p.i", "p.j", "sig", "c", "own")
    rows = blocks.join(sets, "sig").repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            s = batch.column(7)
            values, offsets = s.values.to_numpy().view(np.uint64), s.offsets.to_numpy()
            for r, row in enumerate(zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True)):
                if row[:4] != now:
                    out.extend(block_links(group))
                    now, group = row[:4], []
                group.append((*row[4:], values[offsets[r] : offsets[r + 1]].copy()))
            if len(out) > 5000:
                yield batch_of()
                out.clear()
        out.extend(block_links(group))
        yield batch_of()

    return rows.select("t", "k", "i", "j", "sig", "c", "own", "s").mapInArrow(joined, "a long, b long")


def block_links(group: list[tuple]) -> list[tuple[int, int]]:
    """group: (sig, component, own, set). Links between members of different components, of which one at least is `own`, enough of
    them to span what they join."""
    if len(group) < 2:
        return []
    label, own = np.array([g[1] for g in group]), np.array([g[2] for g in group])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    links = []
    for i, others in trie_join([g[3] for g in group], lambda i: (label != label[i]) & (own | own[i])):
        for j in others:
            x, y = find(int(label[i])), find(int(label[j]))
            if x != y:
                root[x] = y
                links.append((group[i][0], group[j][0]))
    return links


def trie_join(sets: list[np.ndarray], wanted) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those before i in the order of the trie that are linked with set i), for each i with any.

    The sets in the global order are the paths of a trie. It is walked level by level, STRIDE shingles at a time, with the overlaps
    of all sets at once: the counts at a node hold for everything below it, so what paths share is counted once. After every
    level a path is given up where no set can reach with what is left of it what a link needs, and a node with its last path.
    wanted(i): mask of the sets to be linked with i.
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()))
    rank, n = np.argsort(order), np.array([len(s) for s in sets])
    shared = np.array([0, *(common_start(sets[a], sets[b]) for a, b in zip(order, order[1:], strict=False))])
    tokens, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    vocabulary, place = np.unique(tokens, return_inverse=True)
    members, often = which[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(vocabulary))
    first, begin = np.cumsum(often) - often, np.cumsum(n) - n

    def hits(nodes: np.ndarray, start: int, size: np.ndarray) -> np.ndarray:
        """How many of the next shingles of each node every set has."""
        at = place[spread(begin[nodes] + start, size)]
        row, column = np.repeat(np.arange(len(nodes)), size), spread(np.zeros(len(nodes), np.int64), size)
        many = often[at] > 1  # what only one set has is shared with none
        distinct, local = np.unique(at[many], return_inverse=True)
        has = np.zeros((len(distinct) + 1, len(sets)), dtype=np.uint8)
        has[np.repeat(np.arange(len(distinct)), often[distinct]), members[spread(first[distinct], often[distinct])]] = 1
        path = np.full((len(nodes), STRIDE), len(distinct))
        path[row[many], column[many]] = local
        step = max(1, CELLS // (STRIDE * len(sets)))
        return np.concatenate([has[path[k : k + step]].sum(axis=1, dtype=np.uint8) for k in range(0, len(nodes), step)])

    may = np.array([wanted(i) & (rank < rank[i]) & (OF * np.minimum(n, n[i]) >= SAME * np.maximum(n, n[i])) for i in range(len(sets))])
    alive = order[may[order].any(axis=1)]
    counts, parent = np.zeros((1, len(sets)), dtype=np.int32), np.zeros(len(alive), dtype=np.int64)
    upto = 0
    while len(alive):
        start, upto = upto, upto + STRIDE
        node = np.cumsum(shared < upto)[rank[alive]]  # one for all paths that are the same up to here
        lead = np.append(True, node[1:] != node[:-1])
        size = np.minimum(n[alive], upto) - start
        counts = counts[parent[lead]] + hits(alive[lead], start, size[lead])
        own = np.cumsum(lead) - 1
        left = n[alive] - start - size
        can = may[alive] & ((counts[own] + left[:, None]) * (OF + SAME) >= SAME * (n + n[alive][:, None]))
        some = can.any(axis=1)
        for k in np.flatnonzero(some & (left == 0)):
            yield int(alive[k]), np.flatnonzero(can[k])
        go = some & (left > 0)
        alive, parent = alive[go], own[go]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i after one another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def linked(docs: DataFrame, met: DataFrame, firsts: DataFrame, reps: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(a, b) signatures of sets that are linked, enough of them to span every component.

    First everyone is held against one pivot of each meeting, then against another; at last all pairs of a meeting that are
    still in different components.
    """
    wanted = met.select("sig").distinct().join(reps, "sig").select("sig", F.col("rep").alias("doc_id"))
    starts = shared_table(join_sized(firsts.select("doc_id", "sig", "n", "prefix"), wanted, ["doc_id", "sig"], "left_semi", BROADCAST_ROWS).select("sig", "n", "prefix").dropDuplicates(["sig"]), "starts")
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(want, s) for want, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True)]
            got = [(want, ordered(s, shared.value).view(np.int64)) for want, s in got if int(signature(s)) == want]  # an id may have several texts
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.int64()), listed([s for _, s in got])], ["sig", "s"])

    # what most others share most of makes the best pivot: in a family of edited copies that is the text they were made from
    weights = met.join(met.groupBy("t").agg(F.count("*").alias("g")), "t").groupBy("sig").agg((F.sum("g") / F.first("n")).alias("w"))
    met = shared_table(met.join(weights, "sig"), "weighed")
    links, done, rows = None, None, met.withColumn("c", F.col("sig"))
    for turn in (1, 2, 3):
        last = turn == 3
        if last:
            # only sets of about the same size can link: a meeting falls apart into classes of size, each with the next one above
            level = F.floor(F.log(F.col("n")) / float(np.log(OF / SAME))).cast("int")
            part = rows.select("*", F.explode(F.array(F.struct(level.alias("k"), F.lit(True).alias("own")), F.struct((level - 1).alias("k"), F.lit(False).alias("own")))).alias("x")).select("*", "x.*").drop("x", "w")
            sizes = part.groupBy("t", "k").agg(F.count("*").alias("g"), F.max("own").alias("any"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("any and lo < hi").select("t", "k", "g")
            part = shared_table(part.join(sizes, ["t", "k"]), "classes")
            few = part.where(F.col("g") <= PAIRED)
            other = few.where("own").select("t", "k", *[F.col(x).alias(f"p_{x}") for x in ("before", "c", "sig", "n", "at")])
            apart = (F.col("before") != F.col("p_before")) | (F.col("before") == 0)  # else they have met there
            both = few.join(other, ["t", "k"]).where(apart & (~F.col("own") | (F.col("sig") < F.col("p_sig"))))
        else:
            heaviest = F.max(F.struct("w", "sig", "n", "at", "c")).alias("p")
            pivot = rows.groupBy("t").agg(heaviest)
            if turn == 2:  # of those whom the first pivot doesn't have
                pivot = rows.join(pivot.select("t", F.col("p.c").alias("first")), "t").where("c != first").groupBy("t").agg(heaviest)
            both = rows.join(pivot, "t").select("t", "sig", "n", "at", "c", *[F.col(f"p.{x}").alias(f"p_{x}") for x in ("c", "sig", "n", "at")])
        pairs = both.where((F.col("c") != F.col("p_c")) & may_link(F.col("n"), F.col("at"), F.col("p_n"), F.col("p_at"))).select(F.least("sig", "p_sig").alias("a"), F.greatest("sig", "p_sig").alias("b")).distinct()
        pairs = shared_table(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        likely = shared_table(possible(pairs, starts), "likely")
        ids = likely.select(F.col("a").alias("sig")).unionByName(likely.select(F.col("b").alias("sig"))).distinct().join(reps, "sig").select("sig", F.col("rep").alias("doc_id"))
        texts = join_sized(docs.where("doc_id is not null").select("doc_id", "text"), ids, "doc_id", "inner", BROADCAST_ROWS)
        sets = texts.select("sig", "text").mapInArrow(sets_of, "sig long, s array<long>").dropDuplicates(["sig"])
        found = shared_table(verified(likely, sets), "links")
        if last:
            many = part.where(F.col("g") > PAIRED)
            needed = many.select("sig").distinct().join(reps, "sig").select("sig", F.col("rep").alias("doc_id"))
            texts = join_sized(docs.where("doc_id is not null").select("doc_id", "text"), needed, "doc_id", "inner", BROADCAST_ROWS)
            found = found.unionByName(shared_table(crowded(many, texts.select("sig", "text").mapInArrow(sets_of, "sig long, s array<long>").dropDuplicates(["sig"])), "links"))
        links = found if links is None else links.unionByName(found)
        if not last:
            cc = connected_components(links)
            labelled = met.join(cc, met["sig"] == cc["node"], "left").select("t", "before", "sig", "n", "at", "w", F.coalesce("component", "sig").alias("c"))
            at = Window.partitionBy("t")
            rows = shared_table(labelled.withColumn("lo", F.min("c").over(at)).withColumn("hi", F.max("c").over(at)).where("lo < hi").drop("lo", "hi"), "apart")
    return links


def components(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row a document: doc_id, n_shingles, component_id."""
    docs, most = with_ids(docs.select("doc_id", "text"), "_id")
    docs = docs.select(F.col("_id").alias("doc_id"), "text")
    firsts = shared_table(summaries(docs), "prefixes")
    frequent = frequent_shingles(docs, firsts)
    reps = firsts.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    met = shared_table(meetings(docs, frequent), "meetings")
    links = linked(docs, met, firsts, reps, frequent)
    named = links.join(reps.select(F.col("sig").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("sig").alias("b"), F.col("rep").alias("rb")), "b")
    cc = connected_components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    out = firsts.select("doc_id", "n", "sig").join(reps.join(cc, reps["rep"] == cc["node"], "left").select("sig", F.coalesce("component", "rep").alias("c")), "sig", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("c"))
    return out.select(real_id(F.col("doc_id"), most).alias("doc_id"), F.col("n").alias("n_shingles"), real_id(component, most).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that name their component, with the columns they came with. Of a component without any id one row stays."""
    name = unused("own", docs.columns)
    every, most = with_ids(docs, name)
    own = components(every.select(F.col(name).alias("doc_id"), "text"))
    kept = own.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return every.join(kept, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
