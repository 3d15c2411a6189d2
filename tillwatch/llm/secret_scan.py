"""Secrets in texts and in what is wrapped in them: a recursive decoding worklist.

Every text is scanned for three kinds of secret (assignments, access keys, long hex numbers). Its encoded parts are then unwrapped
and each result is put on a worklist as a layer of its own, to be scanned and unwrapped again, until nothing new comes out:

- url: the percent escapes of a layer, as UTF-8
- unicode: backslash escapes (u, U, x) and HTML character references of a layer
- lines: base64 that is broken over lines of 40 characters or more, put together
- base64: runs of the plain or the URL alphabet that give text or a compressed stream
- packed: gzip, zlib, bzip2, xz and zstandard streams inside base64, also nested

A layer knows for each of its characters the part of the original text it comes from, so a span found in any depth is mapped back
to code points of the text. A layer of escapes keeps the position of each character, a base64 layer that of its group of four
characters, a compressed stream stands for its whole run. A layer that was seen before (same content at the same place) is not
unwrapped again, so streams that unpack to themselves end. Every step shortens the layer or unpacks a stream; a stream of more than
`most_bytes` is not held in memory: its whole run becomes a span of kind `packed`, so nothing in it is passed over in silence.

Defined results: a null text is empty; repeated rows are scanned alike; an empty table gives an empty result; offsets are code
points, ends exclusive; base spans (those of the text itself) always stay, and a span from a layer that lies inside a base span of
its kind adds nothing and is left out; texts of any length are scanned whole; other columns stay untouched whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .decontaminate import row_type

KINDS = ("assign", "access", "hex", "packed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

SPAN = "struct<kind:string,start:bigint,end:bigint,path:string>"


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns; each kind leftmost and without overlaps."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield 1, m.start(), m.end()
    for m in _HEX.finditer(text):
        yield 2, m.start(), m.end()


@dataclass
class Layer:
    """A decoded text. Character i stands for starts[i] to ends[i] of the original; None: for all of (low, high)."""

    text: str
    path: str
    low: int
    high: int
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def place(self, a: int, b: int) -> tuple[int, int]:
        if not self.path:
            return a, b
        return (self.low, self.high) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))


# ---- escapes ----

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,31});")
#: A line break inside base64.
_BREAK = re.compile(r"(?<=[A-Za-z0-9+/]{40})\r?\n(?=[A-Za-z0-9+/])(?=(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?(?![A-Za-z0-9+/=]))")
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")


def _percent(run: str) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of percent escapes, each with its range in the run. Bytes that are no UTF-8 stay as escapes."""
    data = bytes.fromhex(run.replace("%", ""))
    at = 0
    while at < len(data):
        b = data[at]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            one = data[at : at + n].decode() if n else ""
        except UnicodeDecodeError:
            one = ""
        if one:
            yield one, 3 * at, 3 * (at + n)
            at += n
        else:
            yield from ((run[3 * at + j], 3 * at + j, 3 * at + j + 1) for j in range(3))
            at += 1


def _escaped(run: str) -> Iterator[tuple[str, int, int]]:
    if run[0] == "&":
        said = html.unescape(run)
        if said == run:
            yield from ((c, j, j + 1) for j, c in enumerate(run))
        else:
            yield from ((c, 0, len(run)) for c in said)
        return
    waiting: tuple[int, int] | None = None  # a high surrogate, and where it starts
    for m in _ONE_ESCAPE.finditer(run):
        code = int(m[1] or m[2] or m[3], 16)
        if waiting and 0xDC00 <= code < 0xE000:
            yield chr(0x10000 + ((waiting[0] - 0xD800) << 10) + code - 0xDC00), waiting[1], m.end()
            waiting = None
            continue
        if waiting:
            yield "�", waiting[1], m.start()
            waiting = None
        if 0xD800 <= code < 0xDC00:
            waiting = code, m.start()
        else:
            yield chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", m.start(), m.end()
    if waiting:
        yield "�", waiting[1], len(run)


def unescaped(layer: Layer, name: str, pattern: re.Pattern, read) -> Layer | None:
    """The whole layer with its escapes decoded; None if there are none."""
    parts: list[str] = []
    froms: list[np.ndarray] = []
    tos: list[np.ndarray] = []
    at, changed = 0, False

    def plain(a: int, b: int) -> None:
        if a < b:
            parts.append(layer.text[a:b])
            froms.append(np.arange(a, b))
            tos.append(np.arange(a + 1, b + 1))

    for m in pattern.finditer(layer.text):
        plain(at, m.start())
        found = list(read(m[0]))
        said = "".join(c for c, _, _ in found)
        changed |= said != m[0]
        parts.append(said)
        froms.append(np.array([a for _, a, _ in found], dtype=np.int64) + m.start())
        tos.append(np.array([b for _, _, b in found], dtype=np.int64) + m.start())
        at = m.end()
    if not changed:
        return None
    plain(at, len(layer.text))
    first, last = np.concatenate(froms), np.concatenate(tos)
    if layer.path and layer.starts is None:
        return Layer("".join(parts), f"{layer.path}/{name}", layer.low, layer.high)
    starts = first if not layer.path else layer.starts[first]
    ends = last if not layer.path else layer.ends[last - 1]
    return Layer("".join(parts), f"{layer.path}/{name}", layer.low, layer.high, starts, ends)


# ---- base64 and compressed streams ----

_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
_ALNUM64 = re.compile(r"[A-Za-z0-9]{12,}={0,2}")
_URL_SAFE = str.maketrans("-_", "+/")
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[9, 10, 13, *range(32, 127)]] = True


def base64_bytes(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.translate(_URL_SAFE) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def inflated(data: bytes, most: int) -> bytes | None:
    """What a compressed stream holds; None if it is none or broken from its start. OverflowError beyond `most` bytes."""
    try:
        if data[:4] == MAGIC[-1]:
            out, reader = bytearray(), zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
            while part := reader.read(1 << 16):
                out += part
                if len(out) > most:
                    raise OverflowError
            return bytes(out)
        if data[:3] == b"BZh":
            machine = bz2.BZ2Decompressor()
        elif data[:6] == MAGIC[6]:
            machine = lzma.LZMADecompressor()
        else:
            machine = zlib.decompressobj(47)
            out = machine.decompress(data, most + 1)
            if len(out) > most:
                raise OverflowError
            return out or None
        out = machine.decompress(data, most + 1)
        if len(out) > most:
            raise OverflowError
        return out or None
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
        return None


def as_text(data: bytes) -> str | None:
    """Bytes that read as text: UTF-8 of mostly visible characters, or UTF-16 of the same."""
    if not data:
        return None
    seen = np.frombuffer(data, np.uint8)
    for order, zeros, other in (("utf-16-le", seen[1::2], seen[0::2]), ("utf-16-be", seen[0::2], seen[1::2])):
        if len(data) >= 8 and len(data) % 2 == 0 and not zeros.any() and _LETTERS[other].all():
            return data.decode(order)
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    plain = _LETTERS[seen] | (seen >= 0x80)
    return text if plain.all() and _LETTERS[seen].mean() >= 0.5 else None


def _likely(run: str) -> bool:
    """A cheap look at the first eight characters: a stream's mark, or bytes that may start a text."""
    head = base64_bytes(run[:8])
    if head is None:
        return False
    if head.startswith(MAGIC):
        return True
    visible = sum(b in (9, 10, 13) or 32 <= b < 127 or b >= 0x80 for b in head)
    return visible == len(head) or (b"\x00" in head and visible >= len(head) // 2)


class Scan:
    """Runs the worklist of one text."""

    def __init__(self, most_bytes: int):
        self.most_bytes = most_bytes

    def added(self, text: str) -> set[tuple[int, int, int, str]]:
        """(kind, start, end, path) of all spans in layers, in positions of the text."""
        found: set[tuple[int, int, int, str]] = set()
        seen: set[tuple] = set()
        work = [Layer(text, "", 0, len(text))]
        while work:
            layer = work.pop()
            for inner in self.unwrapped(layer, found, seen):
                key = (hash(inner.text), len(inner.text), inner.low, inner.high)
                if key in seen:
                    continue
                seen.add(key)
                found.update((kind, *inner.place(a, b), inner.path) for kind, a, b in matches(inner.text))
                work.append(inner)
        return found

    def unwrapped(self, layer: Layer, found: set, seen: set) -> Iterator[Layer]:
        text = layer.text
        if "%" in text and (inner := unescaped(layer, "url", _PERCENT, _percent)):
            yield inner
        if ("\\" in text or "&" in text) and (inner := unescaped(layer, "unicode", _ESCAPE, _escaped)):
            yield inner
        if "\n" in text and (inner := unescaped(layer, "lines", _BREAK, lambda _: ())):
            yield inner
        for m in _BASE64.finditer(text):
            yield from self.run(layer, m[0], m.start(), found, seen) or self.parts(layer, m, found, seen)

    def parts(self, layer: Layer, m: re.Match, found: set, seen: set) -> list[Layer]:
        """A run that is no base64 as a whole, such as a path: its parts of letters and digits."""
        if not re.search("[+/_-]", m[0]):
            return []
        return [x for p in _ALNUM64.finditer(m[0]) for x in self.run(layer, p[0], m.start() + p.start(), found, seen)]

    def run(self, layer: Layer, run: str, at: int, found: set, seen: set) -> list[Layer]:
        if not _likely(run) or (data := base64_bytes(run)) is None:
            return []
        low, high = layer.place(at, at + len(run))
        path = f"{layer.path}/base64"
        inner = as_text(data)
        if inner is not None and len(inner) == len(data):
            groups = at + 4 * (np.arange(len(data)) // 3)
            last = np.minimum(groups + 4, at + len(run))
            if not layer.path:
                return [Layer(inner, path, low, high, groups, last)]
            if layer.starts is not None:
                return [Layer(inner, path, low, high, layer.starts[groups], layer.ends[last - 1])]
        if inner is not None:
            return [Layer(inner, path, low, high)]
        while data.startswith(MAGIC):
            if (key := (hash(data), len(data), low, high)) in seen:
                return []
            seen.add(key)
            path += "/packed"
            try:
                data = inflated(data, self.most_bytes)
            except OverflowError:
                found.add((3, low, high, path))
                return []
            if data is None:
                return []
            if (inner := as_text(data)) is not None:
                return [Layer(inner, path, low, high)]
        # unpacked, but not clean text: its readable bytes are scanned all the same
        return [Layer(data.decode("utf-8", "replace"), path, low, high)] if path.endswith("packed") else []


def scan_text(text: str, most_bytes: int = 64 << 20) -> tuple[list[tuple], list[tuple]]:
    """Base spans and all spans, both as (kind number, start, end, path) in order of start, kind, end."""
    base = list(matches(text))
    every = {(k, a, b): "" for k, a, b in base}
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(3):
        own = [(a, b) for kind, a, b in base if kind == k]
        held[k] = np.array([a for a, _ in own], np.int64), np.array([b for _, b in own], np.int64)
    for kind, a, b, path in sorted(Scan(most_bytes).added(text)):
        starts, ends = held.get(kind, (np.zeros(0, np.int64),) * 2)
        i = int(np.searchsorted(starts, a, side="right")) - 1
        if i < 0 or ends[i] < b:  # base spans of a kind don't overlap: only the last that starts by then can hold it
            every.setdefault((kind, a, b), path)
    order = lambda s: (s[1], s[0], s[2])
    return sorted(((k, a, b, "") for k, a, b in base), key=order), sorted(((k, a, b, p) for (k, a, b), p in every.items()), key=order)


def scanned(docs: DataFrame, text: str = "text", carry: list[str] | None = None, most_bytes: int = 64 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """docs as `row` with `base` and `spans`: (kind, start, end, path) in order; path names the layers a span was found under."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.col(f"`{text}`").alias("value"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())]))

    def run(batches):
        for block in blocks(batches, block_bytes, "value"):
            both = [scan_text(t or "", most_bytes) for t in block.column("value").to_pylist()]
            said = lambda found: [{"kind": KINDS[k], "start": a, "end": b, "path": p} for k, a, b, p in found]
            yield pa.RecordBatch.from_arrays(
                [block.column("row"), pa.array([said(x) for x, _ in both], kind), pa.array([said(x) for _, x in both], kind)], ["row", "base", "spans"])

    return rows.mapInArrow(run, f"row {row_type(rows)}, base array<{SPAN}>, spans array<{SPAN}>")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(rows: DataFrame) -> DataFrame:
    """The row per document of the contract."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    hidden = F.size(F.filter("spans", lambda s: s["path"] != "")).cast("long")
    return rows.select("row.doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), hidden.alias("n_hidden"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span, merged where they overlap, replaced by `<SECRET>`."""
    rows = scanned(docs, text)
    names = docs.columns
    out = rows.select("row", "spans")

    def run(batches):
        for batch in blocks(batches, 1 << 20, text):
            row = batch.column("row")
            values = row.field(text).to_pylist()
            new = []
            for value, spans in zip(values, batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [value[at : s["start"]], "<SECRET>"]
                    at = max(at, s["end"])
                new.append(value if not spans else "".join([*parts, value[at:]]))
            yield pa.RecordBatch.from_arrays([row, pa.array(new, pa.string())], ["row", "new"])

    done = out.mapInArrow(run, f"row {row_type(out)}, new string")
    return done.select(*[(F.col("new") if c == text else F.col(f"row.`{c}`")).alias(c) for c in names])
