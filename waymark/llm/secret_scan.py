"""Secret scan with a recursive decoding worklist.

Every text is scanned as it is; then each layer of it is decoded (URL escapes, Unicode escapes, base64, and compressed streams
inside any of them) into further layers, until no new layer appears. A layer is the whole text with what could be decoded replaced,
or bytes (a character each) that one place of it decodes to: a base64 run from each of four offsets, what isn't readable text,
large or damaged streams. It carries for each of its characters the span of the original text that it came from, so every finding
maps back. Layers are remembered by content and place, so encodings that decode to one another end.

Null texts count as empty: no spans, and the hash of the empty string. Repeated rows each get their own. Texts of any length are
scanned whole. What inflates beyond MAX_INFLATED bytes is scanned in pieces of that size, which overlap by OVERLAP bytes; what a
damaged stream gave before the damage is scanned. Most texts hold nothing that could
be a secret or a layer; one pass of a compiled automaton over the Arrow buffer sorts them out before any Python string is made.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The patterns of the contract; a match counts if its group (0 or 2) has so many characters.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Any text that has none of these has no span of any kind.
MAYBE = r"""AKIA|[0-9a-f]{16}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f{]|&#[0-9xX]|[A-Za-z0-9+/_-]{22}|[A-Za-z0-9+/_-]{15}[A-Za-z0-9+/_=-]="""
#: Where a compressed stream may start in bytes: gzip, bzip2, xz, or any valid zlib header without dictionary.
ZLIB = "|".join(re.escape(chr(a) + chr(b)) for a in range(0x08, 0x80, 0x10) for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 0x20)
PACKED = re.compile("\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|" + ZLIB)
#: Bytes without any of these give no span in any layer.
WORTH = re.compile(MAYBE.encode() + b"|" + PACKED.pattern.encode("latin-1"))
MAX_INFLATED, OVERLAP, CHUNK = 64 << 20, 1 << 20, 1 << 16

Span = tuple[int, int, int]


def found(text: str) -> Iterator[Span]:
    """(start, kind, end) in this text."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
            yield m.start(), 0, m.end()
    for m in ACCESS.finditer(text):
        yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


class Layer:
    """A text and, for each character, where it starts and ends in the original."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def whole(cls, text: str) -> Layer:
        at = np.arange(len(text) + 1, dtype=np.int64)
        return cls(text, at[:-1], at[1:])

    def one(self, start: int, end: int, raw: bytes) -> Layer:
        """A layer of bytes that came from all of these characters."""
        n = len(raw)
        return Layer(raw.decode("latin-1"), np.broadcast_to(self.starts[start], n), np.broadcast_to(self.ends[end - 1], n))

    def replaced(self, parts: list[tuple]) -> Layer:
        """parts: (start, end, new text, for each new character the first and past-the-last old character)."""
        texts, starts, ends, at = [], [], [], 0
        for start, end, new, first, past in parts:
            texts += [self.text[at:start], new]
            starts += [self.starts[at:start], self.starts[np.asarray(first, dtype=np.int64)]]
            ends += [self.ends[at:start], self.ends[np.asarray(past, dtype=np.int64) - 1]]
            at = end
        return Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))


def of_bytes(raw: bytes, first: list[int], past: list[int]) -> tuple[str, list[int], list[int]] | None:
    """Decode UTF-8, carrying the places along; None if it isn't text."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if len(text) == len(raw):
        return text, first, past
    f, p, at = [], [], 0
    for c in text:
        n = len(c.encode("utf-8"))
        f.append(first[at])
        p.append(past[at + n - 1])
        at += n
    return text, f, p


def percent(layer: Layer) -> Iterator[Layer]:
    """The text with its escapes as UTF-8 where they are that, and, if that differs, with each escape as one byte."""
    parts, plain = [], []
    for m in PERCENT.finditer(layer.text):
        n, s = (m.end() - m.start()) // 3, m.start()
        raw = binascii.unhexlify(m[0].replace("%", ""))
        at = [s + 3 * i for i in range(n)], [s + 3 * i + 3 for i in range(n)]
        plain.append((s, m.end(), raw.decode("latin-1"), *at))
        got = of_bytes(raw, *at)
        parts.append(plain[-1] if got is None else (s, m.end(), *got))
    if parts:
        yield layer.replaced(parts)
        if any(x[2] != y[2] for x, y in zip(parts, plain, strict=True)):
            yield layer.replaced(plain)


def escaped(layer: Layer) -> Iterator[Layer]:
    parts: list[tuple[int, int, str, list[int], list[int]]] = []
    for m in ESCAPED.finditer(layer.text):
        t, s, e = m[0], m.start(), m.end()
        code = int(t[3:-1], 16) if t[:3] == "\\u{" or t[:3].lower() == "&#x" else int(t[2:-1]) if t[0] == "&" else int(t[2:], 16)
        if code > 0x10FFFF:
            continue
        high = ord(parts[-1][2]) if parts and parts[-1][1] == s and len(parts[-1][2]) == 1 else 0
        if 0xDC00 <= code < 0xE000 and 0xD800 <= high < 0xDC00:
            before = parts.pop()
            parts.append((before[0], e, chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00), [before[0]], [e]))
        else:
            parts.append((s, e, chr(code), [s], [e]))
    if parts:
        yield layer.replaced(parts)


class Inflating:
    """The compressed stream at a place of a text of bytes (as latin-1), with the gzip, zlib, bzip2 or xz streams of the same kind
    that follow it. Iterating gives what it holds, in pieces; then `end` is the place behind it, `whole` whether it was undamaged."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.end, self.whole = text, at, at, False

    def __iter__(self) -> Iterator[bytes]:
        magic = self.text[self.at : self.at + 2]
        make = {"\x1f\x8b": lambda: zlib.decompressobj(47), "BZ": bz2.BZ2Decompressor, "\xfd7": lzma.LZMADecompressor}.get(magic, lambda: zlib.decompressobj(15))
        read = self.at
        try:
            while True:
                d, left = make(), b""
                while not d.eof:
                    if not left and getattr(d, "needs_input", True):
                        left = self.text[read : read + CHUNK].encode("latin-1")
                        read += len(left)
                        if not left:
                            return
                    out = d.decompress(left, CHUNK)
                    left = getattr(d, "unconsumed_tail", b"")
                    if out:
                        yield out
                read -= len(d.unused_data)
                self.end, self.whole = read, True
                if self.text[read : read + 2] != magic:
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):  # damaged, or text that isn't bytes
            return


def pieces(stream: Inflating) -> Iterator[bytes]:
    """What a stream holds in pieces of MAX_INFLATED bytes that overlap by OVERLAP."""
    held, size, fresh = [], 0, False
    for x in stream:
        held.append(x)
        size, fresh = size + len(x), True
        if size >= MAX_INFLATED:
            yield (all_ := b"".join(held))
            held, size, fresh = [all_[-OVERLAP:]], OVERLAP, False
    if fresh:
        yield b"".join(held)


def as_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def packed(layer: Layer) -> Iterator[Layer]:
    """Compressed streams among the characters of a layer. One that fits into a piece takes its place in the text; the others
    and what damaged ones gave are layers of their own."""
    parts, past = [], 0
    for m in PACKED.finditer(layer.text):
        if m.start() < past:
            continue
        stream, first = Inflating(layer.text, m.start()), None
        for n, raw in enumerate(pieces(stream)):
            if n == 0:
                first = raw
                continue
            if n == 1:
                yield layer.one(m.start(), len(layer.text), first)
            first = None
            yield layer.one(m.start(), len(layer.text), raw)
        if first is not None and stream.whole:
            n, past, text = len(as_text(first)), stream.end, as_text(first)
            parts.append((m.start(), past, text, np.full(n, m.start()), np.full(n, past)))
            if not text.isascii():
                yield layer.one(m.start(), past, first)
        elif first is not None and len(first) >= LEAST_ASSIGNED:
            yield layer.one(m.start(), len(layer.text), first)
        elif stream.whole:
            past = stream.end
    if parts:
        yield layer.replaced(parts)


def readable(text: str) -> bool:
    return len(text) >= 8 and all(c.isprintable() or c in "\t\r\n" for c in text)


def base64s(layer: Layer) -> Iterator[Layer]:
    """The text with its runs decoded where that gives readable text or a whole stream; and layers of their own for what each
    run holds from each of four offsets, since words before a run ('v1/', 'auth-') look like a part of it."""
    parts, rest = [], []
    for m in BASE64.finditer(layer.text):
        body, s = m[0].rstrip("="), m.start()
        std = body.replace("-", "+").replace("_", "/")
        for offset in range(4):
            n = len(std) - offset
            n -= n % 4 == 1
            raw = base64.b64decode(std[offset : offset + n] + "=" * (-n % 4))
            k = np.arange(len(raw), dtype=np.int64)
            first, past = s + offset + 8 * k // 6, s + offset + (8 * k + 7) // 6 + 1
            if offset == 0 and n == len(std):
                stream = Inflating(raw.decode("latin-1"), 0) if PACKED.match(raw.decode("latin-1")) else None
                got = list(itertools.islice(pieces(stream), 2)) if stream else []
                if len(got) == 1 and stream.whole:
                    text = as_text(got[0])
                    parts.append((s, m.end(), text, np.full(len(text), s), np.full(len(text), m.end())))
                    if not text.isascii():
                        rest.append((s, m.end(), got[0].decode("latin-1"), np.full(len(got[0]), s), np.full(len(got[0]), m.end())))
                    continue
                if (plain := of_bytes(raw, first, past)) and readable(plain[0]):
                    parts.append((s, m.end(), *plain))
                    continue
            if WORTH.search(raw):
                rest.append((s, m.end(), raw.decode("latin-1"), first, past))
    if parts:
        yield layer.replaced(parts)
    for _, _, text, first, past in rest:
        yield Layer(text, layer.starts[first], layer.ends[past - 1])


DECODERS = (percent, escaped, base64s)


def children(layer: Layer, decoders) -> Iterator[Layer]:
    for decode in decoders:
        yield from decode(layer)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans, each by start, kind, end, in code points of the text."""
    base = sorted(found(text))
    whole = Layer.whole(text)
    spans, seen, work = set(base), {(text, 0, len(text))}, [children(whole, DECODERS)]
    while work:
        if (child := next(work[-1], None)) is None:
            work.pop()
            continue
        if not child.text or (key := (child.text, int(child.starts[0]), int(child.ends[-1]))) in seen:
            continue
        seen.add(key)
        spans.update((int(child.starts[s]), k, int(child.ends[e - 1])) for s, k, e in found(child.text))
        work.append(children(child, (*DECODERS, packed)))
    return base, sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row per document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column(1)
            maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            counts, hashes, spans = np.zeros((3, n), dtype=np.int64), [nothing] * n, [""] * n
            for i in np.flatnonzero(maybe):
                base, every = scan(texts[int(i)].as_py())
                for _, k, _ in base:
                    counts[k, i] += 1
                hashes[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
