"""Edge cases and brute-force comparisons of the training-data operators, on small tables."""

import base64
import bz2
import gzip
import hashlib
import itertools
import random
import re
import urllib.parse
import zlib

import duckdb
import numpy as np
import pytest

from waymark.llm import decontamination, html_extraction, line_dedup, mixing, ngram_join, quality_rules, secret_scan, toxicity, url_filters, warc
from waymark.llm.common import connected_components, shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, sig long, h string, size long, `_t` string, q int, copies int"


def docs(spark, rows):
    """(doc_id, text, source) with further columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 7, 7, "h", 7, "t", 7, 7) for d, t, s in rows], DOCS)


def some_words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, a long text."""
    rng = random.Random(3)
    long = some_words(rng, 30_000, 5000)
    return docs(spark, [(1, None, "a"), (2, "", None), (3, "  \n\t ", "a"), (None, "some words here", "b"), (4, long, "b"), (4, long, "b"), (5, long, None), (6, "one", "a"), (None, None, None)])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(rows(connected_components(e)))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert rows(connected_components(e.limit(0))) == []


# 1


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "http://a.b/c d", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né", 1), (1, None, None, 1), (2, "", None, 1), (5, "http://a.b/", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né", 1), (None, "u", "z", 1)], "page_id long, url string, html string, payload int")
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path)
    assert records.count() == 15
    t = {r["metadata"]["fields"]: r for r in warc.transactions(records).collect()}
    assert len(t) == 5
    text = pages.where("page_id = 3").first()["html"].encode()
    response = t["page-id: 3\r\n"]["response"]
    assert bytes(response["payload"]) == text and response["payload_bytes"] == len(text)
    assert response["payload_digest"] == base64.b32encode(hashlib.sha1(text).digest()).decode()
    again = t["page-id: 5\r\n"]
    assert again["response"]["warc_type"] == "revisit" and again["response"]["payload_bytes"] == len(text) and again["n_requests"] == 1
    assert t["page-id: 2\r\n"]["response"]["payload_bytes"] == 0
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.captures(records).collect())
    assert got == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (5, "revisit", 3)]


def test_warc_many_archives(spark, monkeypatch):
    """Files that roll over, copies across archives, the smallest id twice, small payloads that aren't to be revisited."""
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 2)
    rng = random.Random(4)
    pages = [(i, f"http://h{i % 3}.b/{i}", "é" * (i % 5) if i % 4 else f"page {i}") for i in rng.sample(range(1, 61), 60)] + [(2, "http://again.b/", "éé")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for least in (0, 5):
        path = shared_path(spark, "warc-many")
        warc.write_archives(p, path, least)
        assert spark.read.format("binaryFile").load(path).count() > 20
        got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.captures(warc.read_records(spark, path)).collect() if r["page_id"] != 2)
        first = {}
        for i, _, text in sorted(pages):
            first.setdefault(text, i)
        raw = {i: (t, t.encode()) for i, _, t in pages}
        again = {i: first[t] != i and len(b) >= least for i, (t, b) in raw.items()}
        assert got == sorted((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again[i] else "response", first[t] if again[i] else None) for i, (t, b) in raw.items() if i != 2)


def test_warc_empty(spark):
    path = shared_path(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.transactions(warc.read_records(spark, path)).count() == 0


# 2

SECRET = 'token = "abcdefghijklmnop"'


@pytest.mark.parametrize(
    ("text", "span"),
    [
        (SECRET, "assign:0:25"),
        (urllib.parse.quote(SECRET), "assign:0:33"),
        ("é " + base64.b64encode(SECRET.encode()).decode(), "assign:2:36"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "assign:0:150"),
        (urllib.parse.quote(urllib.parse.quote(SECRET)), "assign:0:41"),
    ],
)
def test_layers(text, span):
    assert secret_scan.joined(secret_scan.scan(text)[1]) == span


def test_compressed_and_cycles():
    packed = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    assert [s[1] for s in secret_scan.scan("x " + packed)[1]] == [0]
    assert secret_scan.scan("%2525252541 \\u005cu0041")[1] == []
    assert secret_scan.joined(secret_scan.scan("TOKEN:AKIA" + "B" * 14 + " deadbeefdeadbeef")[0]) == "assign:0:24,access:6:24,hex:25:41"
    assert secret_scan.scan("ſecret=abcdefghijklmnop")[0] == []


B64 = lambda raw: base64.b64encode(raw).decode()
QUOTED = lambda raw: "".join(f"%{x:02X}" for x in raw)
GZ = gzip.compress(SECRET.encode())


@pytest.mark.parametrize(
    "text",
    [
        B64(gzip.compress(GZ)),
        B64(gzip.compress(bz2.compress(zlib.compress(SECRET.encode())))),
        QUOTED(GZ),
        urllib.parse.quote(gzip.compress(("é ÿ " + SECRET).encode())),
        "".join(f"\\x{x:02x}" for x in GZ),
        *[f"GET /{p}/{B64(SECRET.encode())} HTTP" for p in ("v", "v1", "v1a", "v1ab", "a_b-c")],
        *[f"auth{p}-{B64(SECRET.encode())}" for p in ("", "x", "xy", "xyz")],
        "/v1/" + B64(GZ),
        *[B64(f"{c}{SECRET}{c}".encode()) for c in "\u00a0\ufeff\0"],
        B64(gzip.compress(b"token = 'abcdefg") + gzip.compress(b"hijklmnop'")),
        B64(gzip.compress(b"") + GZ),
    ],
)
def test_nested_layers(text):
    assert secret_scan.scan(text)[0] == [] and 0 in {k for _, k, _ in secret_scan.scan(text)[1]}


def test_same_run_twice_and_large_streams(monkeypatch):
    run = "v1/" + B64(SECRET.encode())
    assert len({s for s, k, _ in secret_scan.scan(f"{run} and {run}")[1] if k == 0}) == 2
    monkeypatch.setattr(secret_scan, "MAX_INFLATED", 300_000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1000)
    for at in (0, 299_990, 300_000, 900_000):
        packed = B64(gzip.compress(b"-" * at + SECRET.encode() + b"-" * 100_000))
        assert [k for _, k, _ in secret_scan.scan("x " + packed)[1]] == [0]


def test_secret_rows(spark, odd):
    got = rows(secret_scan.scan_secrets(odd))
    assert len(got) == 9 and all(r[4] == hashlib.sha256(b"").hexdigest() for r in got)
    assert rows(secret_scan.scan_secrets(odd.limit(0))) == []


# 3


def test_mix(spark, odd):
    rng = random.Random(5)
    d = docs(spark, [(i, some_words(rng, rng.randrange(1, 60)), f"s{i % 4}" if i % 9 else None) for i in range(600)])
    got = mixing.mix(d).collect()
    assert len(got) == 600 and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert len(by) == 5
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 3 and target <= 3 * size + 1e-9
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6
    assert sorted(map(tuple, got)) == sorted(rows(mixing.mix(d)))
    assert mixing.mix(odd).count() == 9 and mixing.mix(odd.limit(0)).count() == 0


def test_mix_caps(spark):
    """Targets stop at three times a source's size; the rest is shared by weight until none is above."""
    d = docs(spark, [(0, "a " * 10, "a")] + [(i, "b " * 100, "b") for i in range(1, 11)] + [(20 + i, "c " * 100, "c") for i in range(10)])
    t = {r["source_size"]: r["target"] for r in mixing.mix(d.where("source != 'c'")).collect()}
    assert t == {10: 30.0, 1000: 980.0}


def test_mix_dual(spark):
    """Newton's end point: every source on target, the stated optimum held against a plain descent on all multipliers."""
    rng = np.random.default_rng(3)
    words = rng.uniform(0, 1000, (7, mixing.BANDS)) * (np.arange(mixing.BANDS) < 6) * (rng.random((7, mixing.BANDS)) < 0.8)
    words[:, 0] += 1
    target = words.sum(1) * rng.uniform(0.1, 2.9, 7)
    target[0] = 3 * words[0].sum()
    bands = words.sum(0) * target.sum() / words.sum()
    s = spark.createDataFrame([(str(i), float(target[i]), words[i].tolist()) for i in range(7)], "sk string, target double, words array<double>")
    mu = mixing.balance(s, bands)
    lam = np.array([mixing.source_lambda(words[i], target[i], mu, 3) for i in range(7)])
    got = words * np.minimum(np.exp(lam[:, None] + mu), 3)
    assert np.allclose(got.sum(1), target, rtol=1e-9)
    assert np.abs(got.sum(0) - bands + mixing.SOFT * bands * mu).max() <= 1e-8 * bands.sum()
    assert np.abs(mu).max() > 0.01 and np.isfinite(mu).all()
    value = lambda m: mixing.dual_parts(s, m, 3)[0] - bands @ m + mixing.SOFT / 2 * (bands * m * m).sum()
    for _ in range(5):
        assert value(mu) <= value(mu + rng.normal(0, 0.05, mixing.BANDS) * (bands > 0)) + 1e-9


def test_mix_repeated_and_nameless_rows(spark):
    d = docs(spark, [(None, "a b c", "x")] * 40 + [(5, "a b c", "x")] * 10 + [(i, "d " * i, "y") for i in range(60)])
    got = mixing.mix(d).collect()
    assert len(got) == 110 and sum(r["doc_id"] is None for r in got) == 40 and sorted(map(str, got)) == sorted(map(str, mixing.mix(d).collect()))
    by = {t: sum(r["taken"] for r in got if r["target"] == t) for t in {r["target"] for r in got}}
    assert all(abs(v - t) <= 3 for t, v in by.items())


def test_mix_targets_sql(spark, tmp_path):
    """Sizes and targets against SQL."""
    rng = random.Random(11)
    d = docs(spark, [(i, some_words(rng, rng.randrange(0, 90)) + rng.choice(("", "\u00a0x", "\t\n ")), rng.choice(("é", "a", "b", "B", None, "c"))) for i in range(400)])
    d.write.parquet(str(tmp_path / "d"))
    sql = f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS size FROM '{tmp_path}/d/*.parquet'),
      t AS (SELECT source, sum(size)::BIGINT AS n FROM s GROUP BY source),
      w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM t),
      c AS (SELECT *, 3.0 * n / w AS cap FROM w),
      l AS (SELECT max(level) AS level FROM (SELECT ((SELECT sum(n) FROM c) - coalesce((SELECT sum(3.0 * n) FROM c b WHERE b.cap < a.cap), 0)) / ((SELECT sum(w) FROM c) - coalesce((SELECT sum(w) FROM c b WHERE b.cap < a.cap), 0)) AS level FROM c a))
      SELECT doc_id, size, n, least(3.0 * n, level * w)::DOUBLE FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source, l"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"]) for r in mixing.mix(d).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-6 for k in got)


# 4


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, s, n, letters="abcdé "):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        k = rng.randrange(3)
        s[i : i + (k > 0)] = [rng.choice(letters)] if k < 2 else []
    return "".join(s)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        b = edited(rng, a, rng.randrange(5), "ab")
        for e in (1, 2, 3):
            assert line_dedup.within(a, b, e) == line_dedup.close(a, b, e) == (levenshtein(a, b) <= e)


@pytest.mark.parametrize("block", [256, 3])
def test_line_dedup_brute_force(spark, monkeypatch, block):
    """Lines of all lengths, short ones too; small blocks send most keys through a second segment and pairs of blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(2)
    bases = ["".join(rng.choice("abcdé xyz") for _ in range(rng.choice((6, 9, 11, 15, 19, 21, 23, 30, 45, 60)))).strip() for _ in range(16)]
    bases += ["Click here to subscribe", "Click here to subscribed", "Click here to subscrib", "All rights reserved"]
    d = [(i, "\n".join(edited(rng, rng.choice(bases), rng.randrange(4)).strip() for _ in range(4)), "s") for i in range(60)]
    lines = [(i, k, x.strip()) for i, t, _ in d for k, x in enumerate(t.split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in lines})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in distinct:
        for b in distinct:
            if a < b and abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= min(2, min(len(a), len(b)) // 10):
                root[find(a)] = find(b)
    first = {}
    for i, k, x in lines:
        first.setdefault(find(x), (i, k))
    expected = {(i, k, *first[find(x)]) for i, k, x in lines if first[find(x)] != (i, k)}
    got = {(r["doc_id"], r["line_no"], r["first_doc"], r["first_line"]) for r in line_dedup.repeats(docs(spark, d)).collect()}
    assert got == expected and len(expected) > 50


def test_line_dedup_keeps_columns(spark, odd):
    named = docs(spark, [(1, "the very same line\nmore", "a"), (2, "the very same line", "a")]).withColumnsRenamed({"n": "gone", "sig": "_gone", "h": "_rest", "q": "gone_lines"})
    assert [(r["doc_id"], r["text"], r["gone"], r["_rest"]) for r in line_dedup.without_repeats(named).collect()] == [(1, "the very same line\nmore", 7, "h")]
    out = line_dedup.without_repeats(odd)
    assert out.columns == odd.columns
    assert out.where("doc_id = 5").count() == 0 and out.where("doc_id = 4").count() == 2 and out.where("doc_id is null").count() == 2
    assert rows(line_dedup.without_repeats(odd.limit(0))) == []


# 5

PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><div class='cookie notice'>We use cookies</div>{body}<aside>Side</aside><section id=comments><p>Nice!</p></section><script>var a='<p>no</p>'</script><form><input><p>Mail</form><footer>&copy; 2020</footer></body></html>"


def test_extraction(spark):
    body = "<article><h1>A &amp; B</h1>\n<p>One\n  <b>two</b> three<p>Four<br>five<ul><li>x<li>y</ul></article>"
    plain = "<div id=content><p>Long text {i} with many words in it that changes</p><p>More text {i}</p></div>"
    pages = [(1, "http://a.b/1", PAGE.format(body=body), 1), (1, "http://a.b/1", PAGE.format(body=body), 1), (2, "http://A.B/2", None, 1), (3, None, "just text", 1), (None, "http://c.d/", "", 1)]
    pages += [(10 + i, "http://e.f/", PAGE.format(body=plain.format(i=i)), 1) for i in range(4)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string, host int")
    got = {}
    for r in html_extraction.extract(p, html_extraction.wrappers(p)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == ["A & B\nOne two three\nFour five\nx\ny"] * 2
    assert got[2] == [""] and got[3] == ["just text"] and got[None] == [""]
    assert got[12] == ["Long text 2 with many words in it that changes\nMore text 2"]
    assert html_extraction.extract(p.limit(0), html_extraction.wrappers(p.limit(0))).count() == 0


def test_wrapper_inference():
    a = html_extraction.folded(["<ul>", *["<li>", "#", "</li>"] * 3, "</ul>", "<p>", "#", "</p>"])
    b = html_extraction.folded(["<ul>", "<li>", "#", "</li>", "</ul>", "<h2>", "#", "</h2>", "<p>", "#", "</p>"])
    item = ("+", ("<li>", "#", "</li>"))
    assert a == ("<ul>", item, "</ul>", "<p>", "#", "</p>")
    assert html_extraction.aligned(a, b) == ("<ul>", item, "</ul>", ("?", ("<h2>", "#", "</h2>")), "<p>", "#", "</p>")


def test_slots_at_one_path(spark):
    """Article and boilerplate at the same tag path, in two places of the wrapper and in two turns of a repeat."""
    apart = "<html><body><div><p>Same on all pages</p></div><h1>Title {i}</h1><div><p>Article {i}</p></div></body></html>"
    turns = "<html><body><div><p>Same on all pages</p></div><div><p>Article {i}</p></div></body></html>"
    pages = [(i, "http://apart.b/", apart.format(i=i)) for i in range(4)] + [(10 + i, "http://turns.b/", turns.format(i=i)) for i in range(4)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(p, html_extraction.wrappers(p)).collect()}
    assert got == {i: f"Title {i}\nArticle {i}" for i in range(4)} | {10 + i: f"Article {i}" for i in range(4)}


def test_attributes_by_name():
    """What only looks like a mark stays; marks on containers go."""
    kept = ["<p data-id='menu-1'>", "<p title='the hidden ad'>", "<div class='side-by-side'>", "<h2 id='share'>", "<section id='social-history'>", "<p data-hidden=1>", "<div aria-hidden=false>", "<div class='navy-blue'>"]
    gone = ["<div class='site-footer'>", "<div class=adSlot>", "<div id=cookieBanner>", "<p class=share>", "<div role=navigation>", "<p hidden>", "<div aria-hidden='true'>", "<section class='x comments-list y'>", "<div class='ad'>"]
    for tag in kept + gone:
        page = html_extraction.Page(f"<article><p>a</p>{tag}text</{re.match('<([a-z0-9]+)', tag)[1]}></article>")
        path = next(path for path, text, _ in page.blocks if text == "text")
        assert html_extraction.is_dropped(path) == (tag in gone), tag


def test_copies_of_one_page(spark):
    """However often a page occurs, its host is judged as by that page; many distinct streams are merged in rounds."""
    one = "<html><body><nav>Menu</nav><div><p>First words of the page</p><p>Second words</p></div></body></html>"
    pages = [(i, f"http://c{n}.b/", one) for n in (1, 2, 3, 40) for i in range(n)]
    many = "<html><body><nav>Menu</nav><article>{x}</article></body></html>"
    pages += [(100 + i, "http://many.b/", many.format(x="".join(f"<h{1 + (i >> k & 1)}>t{i} {k}</h{1 + (i >> k & 1)}>" for k in range(6)))) for i in range(64)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = html_extraction.extract(p, html_extraction.wrappers(p)).collect()
    assert len(got) == len(pages)
    assert {r["text"] for r in got if r["page_id"] < 100} == {"First words of the page\nSecond words"}
    assert all(r["text"] == "\n".join(f"t{r['page_id'] - 100} {k}" for k in range(6)) for r in got if r["page_id"] >= 100)


def random_stream(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice("abc")
        out += ["#"] if depth > 2 or rng.random() < 0.4 else [f"<{tag}>", *random_stream(rng, depth + 1), f"</{tag}>"] * rng.choice([1, 1, 2, 3])
    return out


def test_wrapper_matches_its_pages():
    rng = random.Random(10)
    for _ in range(300):
        streams = [html_extraction.folded(random_stream(rng)) for _ in range(rng.randrange(2, 7))]
        w = streams[0]
        for s in streams[1:]:
            w = html_extraction.aligned(w, s)
        steps = html_extraction.program(w)
        for s in streams:
            assert len(html_extraction.places(steps, s)) == list(html_extraction.tokens_of(s)).count("#")


# 6


def test_url_rules(spark):
    urls = {None: ("", "", None), "nope": ("", "", None), "http://X.Net": ("x.net", "", None), "http://x.net/a?b": ("x.net", "/a", "net/"), "https://a.example.net/en/": ("a.example.net", "/en/", "example.net/en/"), "h://example.com/de/x#y": ("example.com", "/de/x", "example.com/de/"), "h://notexample.com/de/": ("notexample.com", "/de/", None), "h://b.org/fr/?": ("b.org", "/fr/", "org/fr/")}
    p = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(99, "http://bad.tv/", "x")], "page_id long, url string, host string")
    o = spark.createDataFrame([("bad.tv", 0)] * 60 + [("ok.tv", 1)] * 60 + [("b.org", 1)] * 60 + [("x.uk", None)], "host string, good int")
    got = {r["page_id"]: r for r in url_filters.filter_urls(p, o).collect()}
    for i, (host, path, rule) in enumerate(urls.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
    assert got[99]["verdict"] == "block" and got[6]["verdict"] == "allow" and len(got) == 9
    assert url_filters.filter_urls(p, o.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filters.filter_urls(p.limit(0), o).count() == 0


def test_registered_domains(spark):
    """Owners below a suffix of two labels aren't judged by each other's pages."""
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com:8080": ("y.com", "com"), "me.github.io": ("me.github.io", "github.io"), "10.0.0.7:80": ("10.0.0.7", "10.0.0.7"), "one": ("one", "one"), "": ("", "")}
    d = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r[0]: (r[1], r[2]) for r in d.select("h", url_filters.domain_of(d.h), url_filters.suffix_of(d.h)).collect()} == hosts
    o = spark.createDataFrame([("bad.co.uk", 0)] * 80 + [(f"good{i}.co.uk", 1) for i in range(40) for _ in range(9)] + [("ok.com", 1)] * 50, "host string, good int")
    p = spark.createDataFrame([(1, "http://www.bad.co.uk/"), (2, "http://new.co.uk/"), (3, "http://www.good1.co.uk/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(p, o).collect()} == {1: "block", 2: "allow", 3: "allow"}


# 7


def test_toxicity_learns_pieces(spark):
    rng = random.Random(4)
    bad = ["stupid", "idiotic", "worthless"]
    texts = [(i, some_words(rng, 40, 300) + (" " + rng.choice(bad) + " " + rng.choice(bad) if i % 3 == 0 else ""), "s") for i in range(1200)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1200)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels, 400, 400)
    got = toxicity.score(d, model).where("held_out").collect()
    assert sum((r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in got) > 0.95 * len(got)
    odd_ones = docs(spark, [(1, None, "a"), (None, "", "a"), (2, "stuppid idiotiic wrthless worthlesss", "a"), (3, "!!! 123", "a")])
    s = {r["doc_id"]: r["score"] for r in toxicity.score(odd_ones, model).collect()}
    assert s[1] == s[3] == s[None] and s[2] > 0.5
    assert toxicity.score(odd_ones, toxicity.fit(d, labels.limit(0))).where("score != 0.5").count() == 0


def test_toxicity_odd_tables(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    d = docs(spark, [(i, ("vile scum " if i % 2 else "kind words ") * 5, "s") for i in range(200)] + [(3, "another text of a repeated id", "s"), (3, None, "s")])
    model = toxicity.fit(d, labels)
    again = toxicity.fit(d.repartition(7), labels)
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    assert len(rows(toxicity.score(odd, model))) == odd.count() and toxicity.score(odd.limit(0), model).count() == 0
    for empty in (toxicity.fit(d.limit(0), labels), toxicity.fit(d, labels.limit(0))):
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, empty).collect())


def test_secret_base_columns(spark):
    """Base spans recomputed by plain patterns over a table."""
    rng = random.Random(21)
    bits = ["password = 'abcdefGHIJKL12'", "api-key", "apikey:abcdefghijklmnop", "AKIA" + "Z" * 20, "AKIAshort", "0123456789abcdef0", "token==x", 'Secret" :  "aaaaaaaaaaaa"', "é ", "x" * 20, "deadbeef" * 3]
    d = docs(spark, [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12))), "s") for i in range(200)])
    path = shared_path(spark, "secrets")
    d.write.parquet(f"{path}/documents.parquet")
    kinds = [("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    got = {r["doc_id"]: r for r in secret_scan.op2_secret_scan(spark, path).collect()}
    for r in d.collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(r["text"]) if ok(m))
        said = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert set(filter(None, said.split(","))) <= set(g["spans"].split(","))


# 8


def test_leaks(spark, odd):
    rng = random.Random(6)
    item = some_words(rng, 30, 9000)
    changed = item.split()
    changed[5], changed[17], changed[24] = "zz", "yy", "xx"
    d = docs(spark, [(1, some_words(rng, 50, 9000) + " " + item.upper() + ". " + some_words(rng, 50, 9000), "s"), (2, "a b " + " ".join(changed), "s"), (3, " ".join(item.split()[:8]) + " " + some_words(rng, 60, 9000), "s"), (4, some_words(rng, 200, 9000), "s"), (5, "so the tiny item is here", "s"), (None, item, "s"), (1, "repeated id", "s")])
    b = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "", 1), (13, "tiny item", 1), (None, "q", 1)], "item_id long, text string, h int")
    got = {(r["doc_id"], r["item_id"]): r["n_same"] for r in decontamination.leaks(d, b).collect()}
    assert got == {(1, 10): 30, (2, 10): 27, (5, 13): 2, (None, 10): 30}
    kept = decontamination.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [3, 4]
    assert sorted(str(r["doc_id"]) for r in decontamination.decontaminate(odd, b).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert decontamination.leaks(odd, b.limit(0)).count() == 0 and decontamination.leaks(odd.limit(0), b).count() == 0


def test_masks_hit_every_pattern():
    for run in range(1, decontamination.MIN_WORDS + 1):
        wrong = max(k for k in range(run + 1) if 100 * (run - k) >= decontamination.MIN_SAME * run)
        assert wrong == decontamination.most_wrong(run)
        hits = [{at + i for i, c in enumerate(m) if c == "1"} for m in decontamination.masks_of(run) for at in range(run - len(m) + 1)]
        assert all(m[0] == m[-1] == "1" for m in decontamination.masks_of(run))
        assert all(any(not h & set(p) for h in hits) for p in itertools.combinations(range(run), wrong))
    assert decontamination.masks_of(20, 50) == ("1",) and decontamination.masks_of(9, 100) == decontamination.MASKS[9]


def test_leaks_brute_force(spark):
    rng = random.Random(12)
    items = {i: some_words(rng, 1 + i % 20, 60).split() for i in range(60)}
    texts = {}
    for d in range(200):
        w = list(rng.choice(list(items.values())))
        for k in rng.sample(range(len(w)), min(len(w), rng.randrange(4))):
            w[k] = f"x{rng.randrange(99)}"
        texts[d] = some_words(rng, rng.randrange(20), 60).split() + w[: rng.choice([len(w), len(w) - 1, len(w)])] + some_words(rng, rng.randrange(20), 60).split()
    expected = {}
    for (d, t), (i, w) in itertools.product(texts.items(), items.items()):
        run = min(len(w), decontamination.MIN_WORDS)
        for shift in range(-len(w) + 1, len(t)):
            same = [0 <= shift + k < len(t) and t[shift + k] == x for k, x in enumerate(w)]
            if max(sum(same[k : k + run]) for k in range(len(w) - run + 1)) * 100 >= decontamination.MIN_SAME * run:
                expected[d, i] = max(expected.get((d, i), 0), sum(same))
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = [((r["doc_id"], r["item_id"]), r["n_same"]) for r in decontamination.leaks(docs(spark, [(d, " ".join(t), "s") for d, t in texts.items()]), b).collect()]
    assert sorted(got) == sorted(expected.items())


# 9

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality(spark, odd):
    rng = random.Random(7)
    texts = [(i, "\n".join(some_words(rng, rng.randrange(12), 6) + rng.choice(["", " *", "\u00a0x"]) for _ in range(rng.randrange(6))), "s") for i in range(80)]
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.verdicts(docs(spark, texts)).collect()}
    assert got == {i: measures(t) for i, t, _ in texts}
    v = quality_rules.verdicts(odd)
    assert v.count() == 9 and v.where("doc_id in (1, 2, 3) and (n_words > 0 or kept)").count() == 0
    good = quality_rules.keep_good(docs(spark, [(1, "the quick fox and " + some_words(rng, 60), "s"), (2, "WOW!! " * 60, "s")]))
    assert good.columns == odd.columns and [r["doc_id"] for r in good.collect()] == [1]
    assert quality_rules.keep_good(odd.limit(0)).count() == 0


# 10


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(d):
    sets = {i: shingles(t) for i, t, _ in d}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, n, words, changes):
    base = some_words(rng, words, 5000).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(words)] = f"v{rng.randrange(9999)}"
        yield " ".join(w)


def test_ngram_join_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)
    monkeypatch.setattr(ngram_join, "PAIRED", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(8)
    texts = [*family(rng, 60, 120, 5), *family(rng, 30, 80, 4), *family(rng, 40, 200, 12), "A b c", "a B c ", "x"]
    passage = some_words(rng, 40, 5000)
    texts += [passage + " " + some_words(rng, 40, 5000) for _ in range(25)] + texts[:10]
    d = [(i + 1, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs(spark, d)).collect()}
    assert got == brute_components(d)


def test_ngram_join_odd(spark, odd):
    got = sorted(rows(ngram_join.components(odd)), key=str)
    assert len(got) == 9 and (1, 0, 1) in got and (None, 0, None) in got and (None, 1, None) in got
    assert {r[2] for r in got if r[0] in (4, 5)} == {4}
    assert ngram_join.components(odd.limit(0)).count() == 0
    assert ngram_join.one_of_each(odd).columns == odd.columns


def test_trie_search():
    import numpy as np

    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(20, 50))], dtype=np.uint64)) for _ in range(120)]
    for x in sets[:20]:
        expected = {i for i, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
        assert set(ngram_join.trie_search(x, sets)) == expected


@pytest.mark.parametrize("stride", [1, 3, 32])
def test_trie_join(monkeypatch, stride):
    monkeypatch.setattr(ngram_join, "STRIDE", stride)
    rng = random.Random(10)
    base = rng.sample(range(10_000), 90)
    sets = [np.unique(np.array(rng.sample(base, rng.randrange(70, 91)) + [rng.randrange(10_000) for _ in range(rng.randrange(12))], dtype=np.uint64)) for _ in range(70)]
    sets += [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 50))], dtype=np.uint64)) for _ in range(70)]
    sets += [s[:-1] for s in sets[:5]] + [s[:1] for s in sets[:3]]
    near = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    expected = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if near(sets[i], sets[j]) and (i + j) % 3}
    which = np.arange(len(sets))
    got = [tuple(sorted((i, int(j)))) for i, js in ngram_join.trie_join(sets, lambda i: (which + i) % 3 != 0) for j in js]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 100


def test_ngram_join_links_null_ids(spark):
    rng = random.Random(12)
    text = some_words(rng, 100, 5000)
    d = docs(spark, [(None, text, "s"), (9, text.replace("w1", "v1", 1), "s"), (None, some_words(rng, 60), "s"), (3, some_words(rng, 50), "s")])
    got = sorted(rows(ngram_join.components(d)), key=str)
    assert [(i, c) for i, _, c in got] == [(3, 3), (9, 9), (None, None), (None, 9)]
    kept = ngram_join.one_of_each(d.withColumnsRenamed({"n": "own", "sig": "_own_id"}))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"] and "_own_id" in kept.columns


def test_a_family_of_copies_is_joined_faster_than_pair_by_pair():
    """All at once, and every link: 160 edited copies of a text, some of them half another one."""
    import time

    rng = np.random.default_rng(7)
    base, other = np.unique(rng.integers(0, 1 << 62, 400)).astype(np.uint64), np.unique(rng.integers(0, 1 << 62, 400)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.92], other[rng.random(len(other)) < (0.5 if i % 4 == 0 else 0.04)]])) for i in range(160)]

    def timed(f):
        spent = []
        for _ in range(3):
            began = time.process_time()
            got = f()
            spent.append(time.process_time() - began)
        return got, min(spent)

    def linked(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both * (100 + 80) >= 80 * (len(x) + len(y))

    want, slow = timed(lambda: {(i, j) for j in range(len(sets)) for i in range(j) if linked(sets[i], sets[j])})
    got, fast = timed(lambda: [tuple(sorted((i, int(j)))) for i, js in ngram_join.trie_join(sets, lambda i: np.ones(len(sets), bool)) for j in js])
    assert len(got) == len(set(got)) and set(got) == want and 100 < len(want) < 160 * 159 / 2
    assert fast < slow / 6
