"""Benchmark decontamination with an FM-index per shard of training text.

The test phrases (windows of ten words of each benchmark item; a shorter item is one window) go to every task. A benchmark of more
than `part_bytes` of text is searched for part by part: one part is collected, broadcast, and its hits are written before its
broadcast is destroyed and the next part comes, so driver and tasks hold one part at a time. Equal items count once; an item of
more than part_bytes is in a part by itself. A shard is a block of documents of about `block_bytes`. Its index holds, as word numbers, the runs of words that the part
knows and that are long enough for its shortest phrase; no phrase can occur outside. Phrases are searched backwards through the
wavelet matrix, located by sampled suffix positions, and merged into removal spans. Documents are never shuffled.

Defined results: null texts have no words and no hits; an item without words has no phrases; repeated items and rows count as
they are (an item id once); a null item id marks words but is not listed; an empty benchmark or table gives no hits; a word of
any length and a text of any length are handled whole; other columns of the documents stay untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Ranges, blocks, find_words, lower_ascii, stored, text_buffers, text_of, whole_rows
from .fm_index import FMIndex

SPAN = "array<struct<start:bigint,end:bigint>>"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text column: each word's hash, first byte and end byte, and each text's first word (one more for the end)."""
    raw, starts = text_buffers(column)
    raw = lower_ascii(raw)
    first, end, per_text = find_words(raw, starts, ALNUM)
    return Ranges(raw.astype(np.uint64) + np.uint64(1)).of(first, end), first, end, per_text


@dataclass
class Phrases:
    """Windows of one part of the benchmark: known word hashes (sorted), windows by length, and the items of each window."""

    known: np.ndarray
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]


def phrases(ids: list, texts: list, window: int) -> Phrases:
    hashes, _, _, per_text = words_of(pa.array(texts, pa.large_string()))
    known, number = np.unique(hashes, return_inverse=True)
    found: dict[int, dict[tuple, set]] = {}
    for item, a, b in zip(ids, per_text[:-1], per_text[1:], strict=True):
        row = (number[a:b] + 2).tolist()  # 0 ends the index, 1 divides runs
        size = min(window, len(row))
        for i in range(len(row) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(row[i : i + size]), set()).update([] if item is None else [str(item)])
    return Phrases(known, {m: np.array(list(x), dtype=np.int64) for m, x in found.items()}, {m: [sorted(v) for v in x.values()] for m, x in found.items()})


def parts(benchmark: DataFrame, window: int, part_bytes: int, item: str = "item_id", text: str = "text") -> Iterator[Phrases]:
    """The benchmark in parts of bounded size, told apart by a hash of the item."""
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = int(size // part_bytes) + 1
    for k in range(n if size else 0):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow()
        yield phrases(got.column("i").to_pylist(), got.column("t").to_pylist(), window)


def occurrences(p: Phrases, number: np.ndarray, per_text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, window numbers, first words) of all occurrences in a shard, whose words have the given numbers (-1: unknown)."""
    shortest, sigma = min(p.windows), len(p.known) + 1
    known = number >= 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    inner = per_text[1:-1]
    cut = inner[inner < len(number)]
    begins[cut] = known[cut]
    at = np.flatnonzero(known)
    if not len(at):
        return
    run = np.cumsum(begins[at]) - 1
    kept = np.bincount(run)[run] >= shortest
    at, run = at[kept], run[kept]
    if not len(at):
        return
    run = np.cumsum(np.concatenate([[0], (run[1:] != run[:-1]).astype(np.int64)]))
    place = np.arange(len(at)) + run
    text = np.ones(len(at) + int(run[-1]), dtype=np.int64)
    text[place] = number[at] + 2
    word_at = np.full(len(text), -1, dtype=np.int64)
    word_at[place] = at
    index = FMIndex(text, sigma)
    for length, windows in p.windows.items():
        low, high = index.search(windows)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        if len(rows):
            yield length, which, word_at[index.locate(rows)]


def hit_spans(flags: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged words, cut at the texts: text number, first word and end word, counted within the text."""
    padded = np.concatenate([[False], flags, [False]])
    firsts = padded[1:] & ~padded[:-1]
    edge = per_text[(per_text > 0) & (per_text < len(flags))]
    firsts[edge] |= flags[edge]
    start = np.flatnonzero(firsts)
    ends = padded[1:-1] & ~padded[2:]
    ends[edge - 1] |= flags[edge - 1]
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(per_text, start, side="right") - 1
    return doc, start - per_text[doc], end - per_text[doc]


def marker(part, block_bytes: int, text: str, cut: bool):
    """The task's function: adds n_words, hit spans, item ids and, with `cut`, the text without the spans (null: unchanged)."""

    def run(batches):
        p = part.value if part is not None else None
        for block in blocks(batches, block_bytes, text):
            column = text_of(block, text)
            hashes, first, end, per_text = words_of(column)
            flags = np.zeros(len(hashes) + 1, dtype=np.int64)
            items: dict[int, set] = {}
            if "hits" in block.schema.names:  # of an earlier part
                for d, (spans, ids) in enumerate(zip(block.column("hits").to_pylist(), block.column("items").to_pylist(), strict=True)):
                    for s in spans:
                        flags[per_text[d] + s["start"]] += 1
                        flags[per_text[d] + s["end"]] -= 1
                    if ids:
                        items[d] = set(ids)
            if p is not None and p.windows and len(hashes):
                slot = np.minimum(np.searchsorted(p.known, hashes), len(p.known) - 1)
                number = np.where(p.known[slot] == hashes, slot, -1)
                for length, which, word in occurrences(p, number, per_text):
                    np.add.at(flags, word, 1)
                    np.add.at(flags, word + length, -1)
                    doc = np.searchsorted(per_text, word, side="right") - 1
                    pairs = np.unique(doc * np.int64(len(p.items[length])) + which)
                    for d, w in zip((pairs // len(p.items[length])).tolist(), (pairs % len(p.items[length])).tolist(), strict=True):
                        items.setdefault(d, set()).update(p.items[length][w])
            doc, a, b = hit_spans(np.cumsum(flags[:-1]) > 0, per_text)
            n = block.num_rows
            offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"]))
            out = [block.column("row"), pa.array(np.diff(per_text)), spans, pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))]
            names = ["row", "n_words", "hits", "items"]
            if cut:
                raw, starts = text_buffers(column)
                clean: list[str | None] = [None] * n
                for d in np.unique(doc).tolist():
                    mine = slice(offsets[d], offsets[d + 1])
                    left, base, kept = int(starts[d]), per_text[d], []
                    for s, e in zip(a[mine].tolist(), b[mine].tolist(), strict=True):
                        kept.append(raw[left : first[base + s]].tobytes())
                        left = int(end[base + e - 1])
                    kept.append(raw[left : int(starts[d + 1])].tobytes())
                    clean[d] = b"".join(kept).decode("utf-8", "replace")
                out.append(pa.array(clean, pa.string()))
                names.append("clean")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = 16 << 20, block_bytes: int = 2 << 20, text: str = "text", cut: bool = False) -> DataFrame:
    """Each row of docs (struct `row`) with n_words, hits (spans of words), items (ids) and, with cut, `clean`."""
    out = whole_rows(docs)
    row = out.schema["row"].dataType.simpleString()
    schema = f"row {row_type(out)}, n_words bigint, hits {SPAN}, items array<string>" if row else ""
    waiting = parts(benchmark, window, part_bytes)
    part = next(waiting, None)
    while True:
        sent = docs.sparkSession.sparkContext.broadcast(part) if part is not None else None
        part = next(waiting, None)  # two at a time in the driver, one in the tasks
        last = cut and part is None
        out = out.mapInArrow(marker(sent, block_bytes, text, last), schema + (", clean string" if last else ""))
        if part is None:
            return out
        out = stored(out, "hits")
        sent.destroy()


def row_type(frame: DataFrame) -> str:
    """The type of the column `row`, with quoted names."""
    fields = frame.schema["row"].dataType.fields
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields) + ">"


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with the removal spans cut out of their texts; n_chars, where there is one, follows the text."""
    marked = mark(docs, benchmark, cut=True, **options)
    text = options.get("text", "text")
    new = F.coalesce(F.col("clean"), F.col(f"row.`{text}`"))
    of = {text: new} | ({"n_chars": F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("bigint"))} if "n_chars" in docs.columns else {})
    return marked.select(*[of.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(marked: DataFrame) -> DataFrame:
    """The row per document of the contract."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )

