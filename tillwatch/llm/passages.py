"""Windows that start in two places: routing of candidate passages, shared by the word and the byte operator.

Each window of W units (words or bytes) has one anchor: the place of its smallest hashed gram of K units, the leftmost of equals.
Equal windows have equal anchors at equal places, so windows that share nothing but an anchor's hash are all that must be
compared. Neighbouring windows with the same anchor form a segment; a text of n units has about 2n / (W - K + 2) of them.

1. scan: one row (anchor, segment hash, place) per segment; texts are not shuffled.
2. Segments whose anchor stands in one place only are dropped after a grouping with map-side combine.
3. Equal segments count as one with a number of copies, so a group of copies of any size is one row here.
4. The text of one copy of each segment goes to a shard chosen by its anchor; the operator's own method finds the windows that
   recur there. Shards hold about `shard_bytes`.
5. What is found is joined with all places of the segments and gathered by text.

An anchor with over `most_kinds` different segments (a common phrase inside ever different text) would make a large shard. Its
segments are cut into single windows, which are counted by their hash in a plain grouping, however many there are.
Places name their text by its id and a 64-bit hash. Rows that share both are one text: their pieces are passed on once by the shard,
and the spans of a text are gathered as a set, so n repeated rows, also with null ids, cost n times one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Ranges, blocks, find_words, stored, text_buffers
from .decontaminate import row_type

SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Grid:
    words: bool  # units are words, else bytes
    window: int
    gram: int
    block_bytes: int
    shard_bytes: int = 2 << 20
    most_kinds: int = 20_000


@dataclass
class Piece:
    """One segment in a shard: its first window starts `lead` units before the anchor, and it has `n` windows."""

    key: tuple[int, int]
    lead: int
    n: int
    copies: int
    body: bytes


#: Takes the pieces of a shard; gives for each piece the spans of units that recurring windows cover, counted from its start.
Finder = Callable[[list[Piece]], list[list[tuple[int, int]]]]


@dataclass
class Sequence:
    """The units of a block of texts: a hash each, the first unit of each text (one more entry for the end), and their bytes."""

    symbols: np.ndarray
    per_text: np.ndarray
    raw: np.ndarray
    first: np.ndarray | None
    end: np.ndarray | None
    starts: np.ndarray


def units(column: pa.Array, grid: Grid) -> Sequence:
    raw, starts = text_buffers(column)
    numbers = raw.astype(np.uint64) + np.uint64(1)
    if not grid.words:
        return Sequence(numbers, starts, raw, None, None, starts)
    first, end, per_text = find_words(raw, starts, SPACED)
    return Sequence(Ranges(numbers).of(first, end), per_text, raw, first, end, starts)


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the smallest of values[i : i + span], the leftmost of equals."""
    best, at = values, np.arange(len(values))

    def joined(step: int) -> tuple[np.ndarray, np.ndarray]:
        right = best[step:] < best[:-step]
        return np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])

    width = 1
    while 2 * width <= span:
        best, at = joined(width)
        width *= 2
    if width < span:
        best, at = joined(span - width)
    return at


def segments(s: Sequence, grid: Grid) -> tuple[np.ndarray, ...] | None:
    """(text, start, lead, windows, anchor hash, segment hash) of each segment of a block; starts count from the text's start."""
    total = len(s.symbols)
    if total < grid.window:
        return None
    ranges = Ranges(s.symbols)
    grams = ranges.grams(grid.gram)
    at = smallest(grams, grid.window - grid.gram + 1)
    text = np.repeat(np.arange(len(s.per_text) - 1), np.diff(s.per_text))[: len(at)]
    valid = np.flatnonzero(s.per_text[text + 1] - np.arange(len(at)) >= grid.window)
    if not len(valid):
        return None
    place = at[valid]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    begin, n = valid[new], np.diff(np.append(new, len(valid)))
    anchor = place[new]
    whole = ranges.of(begin, begin + n - 1 + grid.window)
    return text[begin], begin - s.per_text[text[begin]], anchor - begin, n, grams[anchor].view(np.int64), whole.view(np.int64)


def scan(grid: Grid):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, grid.block_bytes):
            found = segments(units(block.column("text"), grid), grid)
            if found is None:
                continue
            text, start, lead, n, anchor, whole = found
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [block.column("id").take(take), block.column("th").take(take), pa.array(anchor), pa.array(whole), pa.array(start), pa.array(lead.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["id", "th", "anchor", "seg", "start", "lead", "n"])

    return run


def cut_out(grid: Grid):
    """The body of each wanted segment; with `split`, a row with the hash of each of its windows instead."""
    names = ["anchor", "seg", "lead", "n", "copies", "off", "window", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, grid.block_bytes):
            s = units(block.column("text"), grid)
            ranges = Ranges(s.symbols)
            rows: list[tuple] = []
            for d, wanted in enumerate(block.column("wanted").to_pylist()):
                base = int(s.per_text[d])
                for w in wanted:
                    a = base + w["start"]
                    if w["split"]:
                        begin = a + np.arange(w["n"])
                        hashes = ranges.of(begin, begin + grid.window).view(np.int64).tolist()
                        rows += [(w["anchor"], w["seg"], w["lead"], 1, w["copies"], k, h, None) for k, h in enumerate(hashes)]
                    else:
                        b = a + w["n"] - 1 + grid.window
                        body = b" ".join(s.raw[s.first[a] : s.end[b - 1]].tobytes().split()) if grid.words else s.raw[a:b].tobytes()
                        rows.append((w["anchor"], w["seg"], w["lead"], w["n"], w["copies"], -1, 0, body))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run, "anchor bigint, seg bigint, lead int, n int, copies bigint, off int, window bigint, body binary"


def by_shard(find: Finder):
    """Rows sorted by shard: one call of find for each shard."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def solved(pieces: list[Piece]) -> pa.RecordBatch:
        spans = find(pieces)
        keep = [k for k, x in enumerate(spans) if x]
        return pa.RecordBatch.from_arrays([
            pa.array([pieces[k].key[0] for k in keep], pa.int64()), pa.array([pieces[k].key[1] for k in keep], pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in spans[k]] for k in keep], span)], ["anchor", "seg", "spans"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        pieces: list[Piece] = []
        current = last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "anchor", "seg", "lead", "n", "copies", "body")]
            for shard, anchor, seg, lead, n, copies, body in zip(*columns, strict=True):
                if shard != current and pieces:
                    yield solved(pieces)
                    pieces = []
                current = shard
                if (anchor, seg) == last:  # the same text stood in several rows with one id
                    continue
                last = anchor, seg
                pieces.append(Piece((anchor, seg), lead, n, copies, body))
        if pieces:
            yield solved(pieces)

    return run


def placed(texts: DataFrame, grid: Grid) -> DataFrame:
    """(id, th, anchor, seg, start, lead, n): the segments of texts(id, th, text)."""
    ident = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(scan(grid), f"id {ident}, th bigint, anchor bigint, seg bigint, start bigint, lead int, n int")


def recurring(places: DataFrame) -> DataFrame:
    """The places whose anchor stands in more than one."""
    # A written table, so that the join's sides are plain shuffles and a hot anchor can be split among tasks.
    often = stored(places.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    return stored(places.join(often, "anchor", "left_semi"), "recurring")


def covered(texts: DataFrame, grid: Grid, find: Finder) -> DataFrame:
    """texts(id, th, text) -> (id, th, spans): the spans of units to remove, for texts that have any; spans may overlap."""
    return settled(recurring(stored(placed(texts, grid), "places")), texts, grid, find)


def settled(places: DataFrame, texts: DataFrame, grid: Grid, find: Finder) -> DataFrame:
    """(id, th, spans) of the texts with the given places, whose windows are compared with each other where they share an anchor."""
    of_first = [F.first(c).alias(c) for c in ("id", "th", "start", "lead", "n")]
    kinds = stored(places.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), *of_first), "kinds")
    size = kinds.agg(F.coalesce(F.sum((F.col("n") + grid.window) * (7 if grid.words else 1)), F.lit(0))).first()[0]
    hot = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > grid.most_kinds).select("anchor", F.lit(True).alias("split"))
    marked = kinds.join(hot, "anchor", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    wanted = marked.groupBy(F.col("id").alias("w_id"), F.col("th").alias("w_th")).agg(
        F.collect_list(F.struct("anchor", "seg", "start", "lead", "n", "copies", "split")).alias("wanted"))
    run, schema = cut_out(grid)
    chosen = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("text", "wanted")
    pieces = stored(chosen.mapInArrow(run, schema), "pieces")
    shards = int(size // grid.shard_bytes) + 1
    whole = (
        pieces.where("off < 0").withColumn("shard", F.pmod("anchor", F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "anchor", "seg")
        .mapInArrow(by_shard(find), f"anchor bigint, seg bigint, spans {SPANS}")
    )
    single = pieces.where("off >= 0")
    twice = single.groupBy("window").agg(F.sum("copies").alias("times")).where("times > 1").select("window")
    off = F.col("off").cast("bigint")
    split = single.join(twice, "window", "left_semi").select("anchor", "seg", F.array(F.struct(off.alias("start"), (off + grid.window).alias("end"))).alias("spans")).distinct()
    found = whole.union(split)
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    return places.join(found, ["anchor", "seg"]).select("id", "th", moved.alias("spans")).groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def kept_parts(grid: Grid):
    """Adds the number of units, the merged spans and what is left of each text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 8 << 20):
            raw, starts = text_buffers(block.column("text"))
            counts, spans, kept = [], [], []
            for d, found in enumerate(block.column("spans").to_pylist()):
                body = raw[starts[d] : starts[d + 1]].tobytes()
                parts = body.split() if grid.words else body
                n, merged = len(parts), []
                for a, b in sorted((s["start"], s["end"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                left, rest = 0, []
                for a, b in [*merged, [n, n]]:
                    rest.append(parts[left:a])
                    left = b
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b" ".join([w for r in rest for w in r]) if grid.words else b"".join(rest))
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["row", "n_units", "removed", "kept"])

    return run, f"n_units bigint, removed {SPANS}, kept binary"


def texts_of(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    return docs.select(F.col(f"`{ident}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))


def without_recurring(docs: DataFrame, grid: Grid, find: Finder, text: str = "text", ident: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """docs as `row` (its columns, or those of carry) with n_units, removed (merged spans of units) and kept (UTF-8 bytes)."""
    return without_spans(docs, covered(texts_of(docs, text, ident), grid, find), grid, text, ident, carry)


def without_spans(docs: DataFrame, spans: DataFrame, grid: Grid, text: str = "text", ident: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """docs as `row` with n_units, removed and kept, given the spans (id, th, spans) of their texts."""
    found = spans.select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "spans")
    value, th = F.col(f"`{text}`"), F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{ident}`").alias("id"), th.alias("th"), value.alias("text"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select("row", "text", "spans")
    run, extra = kept_parts(grid)
    return both.mapInArrow(run, f"row {row_type(rows)}, {extra}")
