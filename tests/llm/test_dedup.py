"""op1, op2 and op7 against brute force."""

from __future__ import annotations

import dataclasses
import random
import re
from collections import Counter

import pytest
import xxhash

from tillwatch.llm import repeated_phrases, simhash, suffix_levels
from tillwatch.llm.components import components

UNITS = {
    "words": (repeated_phrases, 35, lambda t: tuple((t or "").encode().split()), lambda x: b" ".join(x)),
    "bytes": (suffix_levels, 200, lambda t: (t or "").encode(), bytes),
}


def removed_by_force(texts, window, split, join):
    parts = [split(t) for t in texts]
    times = Counter(u[i : i + window] for u in parts for i in range(len(u) - window + 1))
    out = []
    for u in parts:
        gone = bytearray(len(u))
        for i in range(len(u) - window + 1):
            if times[u[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((len(u), sum(gone), bytes(join([x for x, g in zip(u, gone, strict=True) if not g]))))
    return out


def check_removal(frame, kind, **changes):
    module, window, split, join = UNITS[kind]
    rows = frame.select("doc_id", "text").collect()
    want = sorted(removed_by_force([r.text for r in rows], window, split, join))
    got = module.without_repeats(frame, dataclasses.replace(module.GRID, **changes)).collect()
    assert sorted((r.n_units, sum(s.end - s.start for s in r.removed), bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("kind", UNITS)
def test_odd_rows(odd, kind):
    check_removal(odd, kind)


@pytest.mark.parametrize("kind", UNITS)
def test_documents_in_small_shards_with_crowded_anchors(docs, spark, kind):
    """Small blocks and shards, and a limit of kinds that sends common anchors to the counting of single windows."""
    draw = random.Random(3)
    word = lambda: draw.choice("abcdefgh") + str(draw.randrange(60))
    phrase = "permission is hereby granted free of charge to any person obtaining a copy"
    more = [" ".join([*[word() for _ in range(50)], phrase, *[word() for _ in range(50)]]) for _ in range(60)]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*more, more[0] + " z", more[1]])], "doc_id long, text string")
    check_removal(docs.select("doc_id", "text").union(extra), kind, block_bytes=20_000, shard_bytes=10_000, most_kinds=3)


@pytest.mark.parametrize("kind", UNITS)
def test_empty_table(docs, kind):
    assert UNITS[kind][0].without_repeats(docs.limit(0)).count() == 0


def plain_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


def test_classes(docs, odd):
    frame = docs.select("doc_id", "text").union(odd.select(odd.doc_id + 10**6, "text"))
    rows = frame.collect()
    prints = [plain_fingerprint(r.text, 3) for r in rows]
    label = roots(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[label[p]] = min(least.get(label[p], r.doc_id), r.doc_id)
    want = Counter((r.doc_id, p, least.get(label[p])) for r, p in zip(rows, prints, strict=True))
    got = simhash.classes(frame).collect()
    assert Counter((r.row.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert sum(r.rid == r["first"] for r in got) == len({label[p] for p in prints})


def test_links_of_chains(spark):
    draw = random.Random(1)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = set()
    for _ in range(15):
        x = draw.getrandbits(64)
        for _ in range(20):
            y = x
            for _ in range(draw.choice([1, 2, 3])):
                y ^= 1 << draw.randrange(64)
            values.add(signed(y))
            x = draw.choice([x, y])
    want = roots(values, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.label for r in components(found).collect()}
    assert {v: got.get(v, v) for v in values} == want


def test_keep_one_of_copies(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert Counter(texts)["The quick brown fox jumps over the lazy dog. " * 8] == 1
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_keep_one_of_each_class(docs):
    """The stage of the pipeline: one row, the first id, of every class of the SimHash operator."""
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text, 3) for r in rows]
    label = roots(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        least[label[p]] = min(least.get(label[p], r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(least.values())


@pytest.mark.parametrize("kind", UNITS)
def test_many_repeated_rows(spark, kind):
    """A thousand equal rows with one id, a thousand with none, a thousand with ids of their own: all covered, in bounded time."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text)] * 1000 + [(None, text)] * 1000 + [(10 + i, text) for i in range(1000)] + [(5000, "short"), (None, None)]
    out = UNITS[kind][0].without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = Counter((r.n_units > 1 and sum(s["end"] - s["start"] for s in r.removed) == r.n_units, bytes(r.kept)) for r in out.collect())
    assert got[True, b""] == 3000 and sum(got.values()) == 3002


def test_batches_against_written_levels(spark, docs, odd, tmp_path):
    """Three batches, one of them added twice: what is removed is what one run over all removes; levels grow geometrically."""
    frame = docs.select("doc_id", "text").union(odd.select(odd.doc_id + 10**6, "text"))
    rows = frame.collect()
    index = suffix_levels.LevelIndex(spark, str(tmp_path / "index"))
    batches = [rows[0::3], rows[1::3], rows[2::3], []]
    for k, some in enumerate(batches):
        index.add(spark.createDataFrame(some, frame.schema), k)
        if k == 1:
            index.add(spark.createDataFrame(some, frame.schema), k)
    sizes = [n for _, n in index.levels()]
    assert all(2 * b <= a for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 3
    want = sorted(removed_by_force([r.text for r in rows], 200, UNITS["bytes"][2], UNITS["bytes"][3]))
    got = index.without_repeats(frame).collect()
    assert sorted((r.n_units, sum(s.end - s.start for s in r.removed), bytes(r.kept)) for r in got) == want
