"""Secrets: base spans by brute force, hidden ones against planted wrappings."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard
from tillwatch.llm import queries, secret_scan

SECRET = "api_key = 'Zx81kLm09QwErTy'"
AS_MATCHED = "api_key = 'Zx81kLm09QwErTy"


def base_by_force(text):
    """Character by character, without the operator's patterns."""
    text, spans = text or "", []
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(word, i):
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "=") or j >= len(text):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    return k, k - j >= 6
        return None

    i = 0
    while i < len(text):
        if hit := assign(i):
            spans += [(i, 0, hit[0])] if hit[1] else []
            i = hit[0]
        else:
            i += 1
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(spans)


def said(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


WRAPS = {
    "url": lambda b: urllib.parse.quote_from_bytes(b, safe="").encode(),
    "url_all": lambda b: "".join(f"%{x:02X}" for x in b).encode(),
    "unicode": lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode()).encode(),
    "entities": lambda b: "".join(f"&#{ord(c)};" for c in b.decode()).encode(),
    "base64": base64.b64encode,
    "base64url": lambda b: base64.urlsafe_b64encode(b).rstrip(b"="),
    "gzip": lambda b: base64.b64encode(gzip.compress(b)),
    "zlib": lambda b: base64.b64encode(zlib.compress(b)),
    "bz2": lambda b: base64.b64encode(bz2.compress(b)),
    "xz": lambda b: base64.b64encode(lzma.compress(b)),
    "zstd": lambda b: base64.b64encode(zstandard.compress(b)),
    "utf16": lambda b: base64.b64encode(b.decode().encode("utf-16-le")),
    "twice": lambda b: base64.b64encode(zstandard.compress(gzip.compress(b))),
}


@pytest.mark.parametrize("seed", range(4))
def test_every_nesting_is_unwrapped_and_mapped(seed):
    rng = random.Random(seed)
    for _ in range(40):
        names = [rng.choice(list(WRAPS)) for _ in range(rng.randint(1, 4))]
        data = f"left words {SECRET} right words".encode()
        for name in names:
            data = WRAPS[name](data)
        text = f"Überall é 😀 before {data.decode()} after"
        _, spans = secret_scan.scan_text(text)
        hidden = [s for s in spans if s[3]]
        assert any(text.index(data.decode()[:4]) <= a < b <= len(text) - 6 for _, a, b, _ in hidden), names


def test_positions_inside_layers():
    """Escapes map character by character, base64 by groups of four."""
    for name, slack in (("url", 0), ("url_all", 0), ("unicode", 0), ("entities", 0), ("base64", 3)):
        pieces = [WRAPS[name](x.encode()).decode() if slack == 0 else None for x in ("nothing ", AS_MATCHED, " more")]
        if slack:
            text = "x " + WRAPS[name](f"nothing {AS_MATCHED} more".encode()).decode()
            a, b = 2 + len("nothing ") * 4 // 3, 2 + len("nothing " + AS_MATCHED) * 4 // 3
        else:
            text = "x " + "".join(pieces)
            a, b = 2 + len(pieces[0]), 2 + len(pieces[0]) + len(pieces[1])
        found = [(s, e) for k, s, e, path in secret_scan.scan_text(text)[1] if k == 0 and path]
        assert any(abs(s - a) <= slack and abs(e - b) <= slack + 1 and s <= a and e >= b for s, e in found), (name, found, a, b)


def test_base64_over_several_lines():
    """Wrapped at 64 and 76 characters, also inside a compressed stream; the span covers the lines."""
    draw = random.Random(1)
    noise = bytes(draw.randrange(33, 127) for _ in range(400))
    for width, end in ((64, "\n"), (76, "\r\n")):
        for inner in (gzip.compress(noise + b" " + SECRET.encode()), b"plain words " * 9 + SECRET.encode()):
            code = base64.b64encode(inner).decode()
            text = "head\n" + end.join(code[i : i + width] for i in range(0, len(code), width)) + "\n-- tail"
            spans = [s for s in secret_scan.scan_text(text)[1] if s[0] == 0 and s[3].startswith("/lines/base64")]
            assert spans or width == 64 and inner[:5] == b"plain"
            assert all(5 <= a < b <= len(text) - 5 for _, a, b, _ in spans)


def test_streams_that_end_nowhere():
    """Oversized streams are reported, broken ones passed by, layers seen before are not unwrapped again."""
    bomb = base64.b64encode(zlib.compress(b"a" * 5_000_000)).decode()
    assert [k for k, *_ in secret_scan.scan_text(f"x {bomb} y", most_bytes=1 << 20)[1]] == [3]
    broken = base64.b64encode(gzip.compress(SECRET.encode())[:12] + b"\xff" * 30).decode()
    assert secret_scan.scan_text(broken)[1] == []
    scan, seen = secret_scan.Scan(1 << 20), set()
    stream = base64.b64encode(gzip.compress(b"plain text here")).decode()
    layer = secret_scan.Layer(stream, "", 0, len(stream))
    assert scan.run(layer, stream, 0, set(), seen) and not scan.run(layer, stream, 0, set(), seen)


def test_long_texts_take_linear_time():
    text = (SECRET + " " + WRAPS["gzip"](SECRET.encode()).decode() + " ") * 20_000 + "%41" * 200_000 + "a" * 1_000_000 + "/" * 100_000
    base, every = secret_scan.scan_text(text)
    assert len(base) == 20_001 and len(every) >= 40_001  # the run of a is a hex number


def test_odd_rows(spark, odd):
    want = sorted([(r.doc_id, said(base_by_force(r.text))) for r in odd.collect()], key=str)
    got = secret_scan.scanned(odd)
    assert sorted([(r.row.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base)) for r in got.collect()], key=str) == want
    assert secret_scan.redacted(odd).columns == odd.columns
    assert secret_scan.scanned(odd.limit(0)).count() == 0 and secret_scan.redacted(odd.limit(0)).count() == 0


def test_redacted_texts_hold_no_secret(spark):
    data = json.dumps([base64.b64encode(gzip.compress(SECRET.encode())).decode(), SECRET])
    rows = spark.createDataFrame([(1, data), (2, "clean words only"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secret_scan.redacted(rows).collect()}
    assert out[2] == "clean words only" and out[3] is None and out[1].count("<SECRET>") == 2 and not secret_scan.scan_text(out[1])[1]


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: base_by_force(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_secret_scan(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert set(filter(None, said(base).split(","))) <= set(r.spans.split(","))
