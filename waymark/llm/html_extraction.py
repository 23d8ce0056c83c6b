"""HTML extraction by wrapper inference: union-free regular expressions from the pages of a host.

A page is a stream of tags and texts. Streams of one host are folded (a group that follows itself becomes `+`) and aligned with
one another: where they differ, what one has and the other lacks becomes optional (`?`), what one repeats becomes a repeat for
both, and texts stay slots. The result is the host's wrapper. Its slots are then judged once for the host: those below an
article or main element, or else those that hold the changing, unlinked text; never those below menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments, nor slots that say the same on every page of the host
outside its article. Each page's stream is matched against the wrapper (an automaton, its first choice counts), which tells
the slot of each text; a slot inside a repeat counts anew for each turn of it, so two texts at one tag path are judged apart.
The texts of the chosen slots are the result. A page that wasn't there when its wrapper was inferred and that doesn't match it
has slots of its own, by path.

Attributes are read by their names. A class or role marks an element as no article if its words are such words and plain
helpers of layout (`site-footer`, not `social-history` or `side-by-side`); an id does so on containers only, as headings and
paragraphs have ids to be linked to.

Wrappers are inferred from each distinct folded stream once, in rounds that align at most FAN_IN of them in one task, until a host
has one; so a host with a third of all pages sends its distinct streams to many tasks. Copies of a page count as one page when
slots are judged. Other columns don't matter, whatever their names; an empty table gives no rows. Null html is empty: empty
text. Null urls and urls without host share one wrapper. Repeated rows each get their text. Hosts with one page are judged by
that page. Pages are parsed whole, once; what was parsed is kept in the shared folder.
"""

from __future__ import annotations

import ast
import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table, small_enough
from .url_filters import host_of

FAN_IN = 32
BROADCAST_HOSTS = 20_000
#: Held per task before counts of streams and slots are passed on.
MOST_HELD = 20_000
LONGEST_GROUP = 12
WHITE = re.compile(r"[\x20\x09-\x0D]+")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
DROPPED = frozenset("head nav aside footer form script style noscript template iframe button select textarea title svg object canvas dialog menu".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that mark what isn't the article, and words that may stand beside them.
NOT_MAIN = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar side aside cookie cookies consent notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login comment comments reply replies disqus respond discussion contentinfo complementary search toolbar pagination widget hidden".split())
HELPERS = frozenset("site page main top bottom left right box bar wrap wrapper container list item items section block inner outer area link links button buttons form title heading body content text post posts article articles story stories slot unit user reader global primary secondary desktop mobile sticky fixed row col column panel group thread count policy privacy icon icons media us follow js is has the id tag tags layout grid module component region zone holder frame head foot".split())
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p li td th dt dd tr caption blockquote pre figcaption".split())


def marks_of(name: str, attributes: str) -> tuple[list[str], bool]:
    """The words of class, id and role of an element, and whether they say that it isn't part of the article."""
    found: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), html.unescape(value.strip("\"'")) if value else "")
    out, gone = set(), "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    for key in ("class", "id", "role"):
        for token in found.get(key, "").split():
            own = [w.lower() for w in WORD.findall(token)]
            out.update(f"{key}:{w}" for w in own if w.isascii())
            said = any(w in NOT_MAIN for w in own) and all(w in NOT_MAIN or w in HELPERS for w in own)
            gone = gone or said and not (key == "id" and (name in ANCHORS or name in INLINE))
    return sorted(out), gone


class Page:
    """Events of a page: tags for the stream, and texts with the path of structural elements above them."""

    def __init__(self, source: str):
        self.stream: list[str] = []
        self.blocks: list[tuple[str, str, bool]] = []  # path, text, linked
        self.stack: list[str] = []
        self.path: list[str] = []
        self.text: list[str] = []
        self.linked = 0
        self.slot = ""
        at, n, raw = 0, len(source), ""
        while at < n:
            if raw:  # nothing but the end tag ends these
                end = re.compile(rf"</{raw}\b[^>]*>", re.I).search(source, at)
                at, raw = (end.end(), "") if end else (n, "")
                self.close(self.stack[-1].split(".")[0])
                continue
            m = TOKEN.search(source, at)
            self.add(source[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self.close(name)
                else:
                    self.open(name, m[3])
                    raw = name if name in RAW and not m[3].endswith("/") else ""
        self.flush()

    def add(self, text: str) -> None:
        if text:
            self.text.append(html.unescape(text))
            if any(x == "a" for x in self.stack):
                self.linked += len(text)

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.text)).strip(" ")
        if text:
            path = "/".join(self.path)
            self.stream.append("#")
            self.blocks.append((path, text, 2 * self.linked > len(text)))
        self.text, self.linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text.append(" ")
        if name in VOID:
            if name not in INLINE:
                self.flush()
            return
        if name in CLOSES_P and "p" in self.stack:
            self.close("p")
        if name in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1].split(".")[0] == name:
            self.close(name)
        sig = name
        if attributes:
            marks, gone = marks_of(name, attributes)
            sig = ".".join([name, *["!"] * gone, *marks])
        if name not in INLINE:
            self.flush()
            self.stream.append(f"<{sig}>")
            self.path.append(sig)
        self.stack.append(sig)

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].split(".")[0] == name:
                if name in INLINE and any(x.split(".")[0] not in INLINE for x in self.stack[i + 1 :]):
                    del self.stack[i]  # an inline element ends; blocks inside it stay open
                    return
                gone = [x for x in self.stack[i:] if x.split(".")[0] not in INLINE]
                if gone:
                    self.flush()
                    del self.path[-len(gone) :]
                    self.stream.append(f"</{name}>")
                del self.stack[i:]
                return


def traced(stream: list) -> tuple[tuple, list[list[int]]]:
    """The folded stream and, for each of its texts, the numbers of the page's texts that fall there."""
    out: list = []
    at: list[list[list[int]]] = []  # for each node of out, the texts of its leaves
    n = 0

    def joined(first: list, second: list) -> list:
        both = [[x for node in side for x in node] for side in (first, second)]
        return [x + y for x, y in zip(*both, strict=True)]

    for token in stream:
        out.append(token)
        at.append([[n]] if token == "#" else [])
        n += token == "#"
        changed = True
        while changed:
            changed = False
            for k in range(1, min(LONGEST_GROUP, len(out)) + 1):
                tail = out[-k:]
                before = out[-k - 1] if len(out) > k else None
                if isinstance(before, tuple) and before[0] == "+" and list(before[1]) == tail:
                    at[-k - 1 :] = [joined(at[-k - 1 : -k], at[-k:])]
                    del out[-k:]
                    changed = True
                elif len(out) >= 2 * k and out[-2 * k : -k] == tail and tail != ["#"]:
                    at[-2 * k :] = [joined(at[-2 * k : -k], at[-k:])]
                    if k == 1 and isinstance(tail[0], tuple) and tail[0][0] == "+":
                        del out[-1:]
                    else:
                        out[-2 * k :] = [("+", tuple(tail))]
                    changed = True
                if changed:
                    break
    return tuple(out), [x for node in at for x in node]


def folded(stream: list) -> tuple:
    """Groups that follow themselves become one repeat; ('+', group)."""
    return traced(stream)[0]


def with_group(nodes: tuple, group: tuple) -> tuple:
    """Where the nodes have the body of a group of the other wrapper in line, they get the group."""
    body, k, out, i = group[1], len(group[1]), [], 0
    if group[0] == "?" and all(x == "#" for x in body):
        return nodes
    while i < len(nodes):
        same = nodes[i : i + k] == body
        node = group if same else nodes[i]
        if not (node == group and group[0] == "+" and out and out[-1] == group):
            out.append(node)
        i += k if same else 1
    return tuple(out)


def aligned(a: tuple, b: tuple) -> tuple:
    """The wrapper of everything that either matches, without unions: what is missing on one side is optional."""
    if a == b:
        return a
    for x in {n for n in a if isinstance(n, tuple)}:
        b = with_group(b, x)
    for x in {n for n in b if isinstance(n, tuple)}:
        a = with_group(a, x)
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    missing: tuple[list, list] = ([], [])

    def settle() -> None:
        for side in missing:  # each side on its own, so that a page may have either
            out.extend(side if all(isinstance(x, tuple) and x[0] == "?" for x in side) else [("?", tuple(side))])
            side.clear()

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            settle()
            out.append(a[i])
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            missing[0].append(a[i])
            i += 1
        else:
            missing[1].append(b[j])
            j += 1
    settle()
    return tuple(out)


def program(wrapper: tuple) -> list[tuple]:
    """The wrapper as an automaton: (token, number of its slot) or (None, where to go on, in order of choice)."""
    out: list = []
    slots = 0

    def add(nodes: tuple) -> None:
        nonlocal slots
        for x in nodes:
            start = len(out)
            if isinstance(x, str):
                out.append((x, slots))
                slots += x == "#"
            elif x[0] == "+":
                add(x[1])
                out.append((None, (start, len(out) + 1)))
            else:
                out.append(())
                add(x[1])
                out[start] = (None, (start + 1, len(out)))

    add(wrapper)
    return out


def tokens_of(nodes: tuple) -> Iterator[str]:
    for x in nodes:
        if isinstance(x, str):
            yield x
        else:
            yield from tokens_of(x[1])


def places(steps: list[tuple], stream: tuple) -> list[int] | None:
    """For each text of a folded stream the slot of the wrapper that it matches; None if the wrapper doesn't match the stream."""
    end = len(steps)

    def reach(at: int, by: int, into: dict[int, int]) -> None:
        stack, seen = [at], set()
        while stack:
            x = stack.pop()
            if x in seen or x in into:
                continue
            seen.add(x)
            if x < end and steps[x][0] is None:
                stack.extend(reversed(steps[x][1]))
            else:
                into[x] = by

    now: dict[int, int] = {}
    reach(0, -1, now)
    trail = [now]
    for token in tokens_of(stream):
        after: dict[int, int] = {}
        for x in now:
            if x < end and steps[x][0] == token:
                reach(x + 1, x, after)
        now = after
        trail.append(now)
    if end not in now:
        return None
    out, x = [], end
    for now in reversed(trail):
        x = now[x]
        if x >= 0 and steps[x][0] == "#":
            out.append(steps[x][1])
    return out[::-1]


def is_dropped(path: str) -> bool:
    inside = False
    for element in path.split("/"):
        name, *marks = element.split(".")
        if name in DROPPED or name == "header" and not inside:
            return True
        if "!" in marks and name not in ("html", "body"):
            return True
        inside = inside or name in MAIN
    return False


def is_main(path: str) -> bool:
    return any(e.split(".")[0] in MAIN or ".role:main" in e for e in path.split("/"))


def slots_of(places_: list[int] | None, leaves: list[int], paths: list[str]) -> list[str]:
    """The slot of each text of a page: its number in the wrapper, which of the page's groups there it is in, its turn in the
    repeat, and the path. Without a match the path alone."""
    if places_ is None:
        return [f"* {p}" for p in paths]
    ranks: list[int] = []
    count: dict[int, int] = {}
    for x in places_:
        ranks.append(count.get(x, 0))
        count[x] = ranks[-1] + 1
    turn: dict[int, int] = {}
    out = []
    for leaf, path in zip(leaves, paths, strict=True):
        turn[leaf] = turn.get(leaf, -1) + 1
        out.append(f"{places_[leaf]}.{ranks[leaf]}.{turn[leaf]} {path}")
    return out


class Matcher:
    """Slots of pages under wrappers, both as text; what was matched before is kept."""

    def __init__(self) -> None:
        self.programs: dict[str, list[tuple]] = {}
        self.known: dict[tuple[str, str], list[int] | None] = {}

    def __call__(self, wrapper: str | None, stream: str, leaves: list[int], paths: list[str]) -> list[str]:
        if wrapper is None:
            return slots_of(None, leaves, paths)
        if len(self.known) > MOST_HELD:
            self.known.clear()
            self.programs.clear()
        if (wrapper, stream) not in self.known:
            if wrapper not in self.programs:
                self.programs[wrapper] = program(ast.literal_eval(wrapper))
            self.known[wrapper, stream] = places(self.programs[wrapper], ast.literal_eval(stream))
        return slots_of(self.known[wrapper, stream], leaves, paths)


def chosen(stats: pd.DataFrame) -> list[str]:
    """The slots of a wrapper that hold the article. stats: slot, pages, chars, linked, changing."""
    stats = stats.assign(path=stats["slot"].str.split(" ", n=1).str[1])
    verdict = {p: (not is_dropped(p), is_main(p)) for p in stats["path"].unique()}
    stats = stats[[verdict[p][0] for p in stats["path"]]]
    main = [verdict[p][1] for p in stats["path"]]
    if any(main):
        return sorted(stats.loc[main, "slot"])
    good = (2 * stats["linked"] <= stats["chars"]) & (stats["changing"] | (stats["pages"] <= 2))
    return sorted(stats.loc[good, "slot"])


PARSED = "page_id long, url string, host string, stream string, leaves array<int>, paths array<string>, texts array<string>, linked array<boolean>"


def parsed(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. The folded stream of each page, and its texts: leaf of the stream, path, text, linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[str, list[int]]] = {}
        for batch in batches:
            streams, leaves, paths, texts, linked = [], [], [], [], []
            for source in batch.column(3):
                page = Page(source.as_py() or "")
                key = tuple(page.stream)
                if key not in known:
                    if len(known) > 2_000:
                        known.clear()
                    nodes, at = traced(page.stream)
                    leaf = {n: k for k, numbers in enumerate(at) for n in numbers}
                    known[key] = repr(nodes), [leaf[n] for n in range(len(page.blocks))]
                stream, of = known[key]
                streams.append(stream)
                leaves.append(of)
                paths.append([p for p, _, _ in page.blocks])
                texts.append([t for _, t, _ in page.blocks])
                linked.append([x for _, _, x in page.blocks])
            strings = pa.list_(pa.string())
            columns = [*batch.columns[:3], pa.array(streams, pa.string()), pa.array(leaves, pa.list_(pa.int32())), pa.array(paths, strings), pa.array(texts, strings), pa.array(linked, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARSED.split(", ")])

    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(rows, PARSED)


def inferred(p: DataFrame) -> DataFrame:
    """host, wrapper string. p as from parsed()."""

    def merged(streams: pd.Series) -> str:
        w: tuple | None = None
        for key in sorted(streams):
            s = ast.literal_eval(key)
            w = s if w is None else aligned(w, s)
        return repr(w)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "stream": [merged(pdf["stream"])]})

    w = shared_table(p.select("host", "stream").distinct(), "streams")
    while True:
        sizes = w.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return w.withColumnRenamed("stream", "wrapper")
        salted = w.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / FAN_IN)))
        w = shared_table(salted.groupBy("host", "salt").applyInPandas(one, "host string, stream string").distinct(), "streams")


def with_hosts(p: DataFrame, by_host: DataFrame) -> DataFrame:
    return p.join(F.broadcast(by_host) if small_enough(by_host, BROADCAST_HOSTS) else by_host, "host", "left")


def observed(p: DataFrame, by_host: DataFrame) -> DataFrame:
    """host, slot, pages (distinct ones, as far as three), chars, linked, lo, hi (of the digests of its texts)."""
    names = ["host", "slot", "chars", "linked", "lo", "hi", "digests"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        match = Matcher()

        def out() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*[(*k, *v) for k, v in held.items()], strict=True)] or [[]] * 7
            held.clear()
            kinds = [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for host, wrapper, stream, leaves, paths, texts, linked in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                page = hashlib.md5("\n".join(texts).encode("utf-8", "replace")).hexdigest()
                for slot, text, link in zip(match(wrapper, stream, leaves, paths), texts, linked, strict=True):
                    digest = hashlib.md5(text.encode("utf-8", "replace")).hexdigest()
                    x = held.setdefault((host, slot), [0, 0, digest, digest, []])
                    seen_in = x[4] if page in x[4] else sorted([*x[4], page])[:3]
                    x[:] = [x[0] + len(text), x[1] + len(text) * link, min(x[2], digest), max(x[3], digest), seen_in]
                if len(held) >= MOST_HELD:
                    yield out()
        yield out()

    seen = with_hosts(p, by_host).select("host", "wrapper", "stream", "leaves", "paths", "texts", "linked")
    seen = seen.mapInArrow(rows, "host string, slot string, chars long, linked long, lo string, hi string, digests array<string>")
    # three digests are enough to tell one or two pages from more; equal arrays fall together before the shuffle
    pages = F.size(F.array_distinct(F.flatten(F.collect_set("digests")))).cast("long").alias("pages")
    return seen.groupBy("host", "slot").agg(pages, F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def judged(p: DataFrame) -> DataFrame:
    """host, wrapper string, slots array<string>. p as from parsed()."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "slots": [chosen(pdf.assign(changing=pdf["lo"] != pdf["hi"]))]})

    found = shared_table(inferred(p), "wrappers")
    slots = observed(p, found).groupBy("host").applyInPandas(judge, "host string, slots array<string>")
    return found.join(slots, "host", "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper string, slots array<string>."""
    return judged(parsed(pages))


def applied(p: DataFrame, by_host: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. p as from parsed()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher()
        sets: dict[str, frozenset] = {}
        for batch in batches:
            out = []
            for wrapper, slots, stream, leaves, paths, texts in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                if slots not in sets:
                    if len(sets) > 1_000:
                        sets.clear()
                    sets[slots] = frozenset((slots or "").split("\n"))
                open_to = sets[slots]
                out.append("\n".join(t for slot, t in zip(match(wrapper, stream, leaves, paths), texts, strict=True) if slot in open_to))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    flat = by_host.select("host", "wrapper", F.array_join("slots", "\n").alias("slots"))
    return with_hosts(p, flat).select("page_id", "url", "wrapper", "slots", "stream", "leaves", "paths", "texts").mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def extract(pages: DataFrame, by_host: DataFrame) -> DataFrame:
    """pages: page_id, url, html; by_host as from wrappers(). page_id, url, text, n_chars."""
    return applied(parsed(pages), by_host)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shared_table(parsed(spark.read.parquet(f"{sf_dir}/pages.parquet")), "pages")
    return applied(p, shared_table(judged(p), "slots"))
