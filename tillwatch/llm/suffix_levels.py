"""Substring dedup by bytes: a logarithmic family of suffix arrays.

Passages reach a shard by the anchors of their windows (see passages.py). A shard keeps levels of geometrically growing size. A
new batch of passages gets a sparse suffix array: the suffixes that start at anchors, in order, with the texts before the anchors
in an order of their own (reversed prefixes), and the common lengths of neighbours in both. The batch is scanned against itself
and, merged in order, against the part of each level that has its anchors. A window that starts o bytes before the anchor recurs
where two passages agree on o bytes before and W - o bytes after it: in both orders such passages stand together, between places
where the common length falls below. Then levels of equal size are merged, which keeps every passage in log(n) merges.

`LevelIndex` keeps the family as written tables, so that batches of documents can come one after the other: a batch becomes a level,
sorted by anchor; its passages are scanned together with those of all levels that share an anchor; levels of about equal size are
merged. Documents of earlier batches get new spans where a later one repeats them, so after any number of batches the spans are
those of one run over all. A batch that is added again replaces itself.

Defined results: a null text is empty; texts shorter than a window lose nothing; of equal strings all are removed, the first one
too, also where they overlap in one document; repeated rows are each other's copies; empty tables give empty results. Removed
bytes may split a character, so what is left is binary.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passages import Grid, Piece, placed, recurring, settled, texts_of, without_recurring, without_spans

GRID = Grid(words=False, window=200, gram=32, block_bytes=3 << 19)
BATCH = 1024


def common(rows: list[bytes], width: int) -> np.ndarray:
    """Common length of each row with the one before it (the first: 0)."""
    matrix = np.zeros((len(rows), width), dtype=np.uint8)
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
    line = np.repeat(np.arange(len(rows)), lengths)
    matrix[line, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    equal = matrix[1:] == matrix[:-1]
    same = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
    return np.concatenate([[0], np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))])


class Family:
    """The levels of one shard."""

    def __init__(self, pieces: list[Piece], window: int, gram: int):
        self.pieces, self.window, self.gram = pieces, window, gram
        self.after = [p.body[p.lead : p.lead + window] for p in pieces]
        self.before = [p.body[: p.lead][::-1] for p in pieces]
        self.lead = np.array([p.lead for p in pieces], dtype=np.int64)
        self.n = np.array([p.n for p in pieces], dtype=np.int64)
        self.copies = np.array([p.copies for p in pieces], dtype=np.int64)
        self.recurs = np.zeros((len(pieces), window - gram + 1), dtype=bool)  # by bytes before the anchor
        self.levels: list[list[int]] = []

    def sorted_suffixes(self, members: list[int]) -> list[int]:
        return sorted(members, key=self.after.__getitem__)

    def add(self, batch: list[int]) -> None:
        order = self.sorted_suffixes(batch)
        self.scan(order)
        anchors = {self.after[k][: self.gram] for k in order}
        for level in self.levels:
            near = [k for k in level if self.after[k][: self.gram] in anchors]
            if near:
                self.scan(self.sorted_suffixes(near + order))
        self.levels.append(order)
        while len(self.levels) > 1 and len(self.levels[-1]) >= len(self.levels[-2]):
            upper = self.levels.pop()
            self.levels[-1] = self.sorted_suffixes(self.levels[-1] + upper)  # two sorted runs: a linear merge

    def scan(self, order: list[int]) -> None:
        """Marks the windows that two of the passages, given in the order of their suffixes, have in common."""
        # Passages that are alone with their anchor, and have no copies, can't match anything here.
        groups = [list(g) for _, g in groupby(order, key=lambda k: self.after[k][: self.gram])]
        order = [k for g in groups if len(g) > 1 or self.copies[g[0]] > 1 for k in g]
        if not order:
            return
        rows = np.array(order)
        after = common([self.after[k] for k in order], self.window)
        by_before = sorted(range(len(order)), key=lambda i: self.before[order[i]])
        before = common([self.before[order[i]] for i in by_before], self.window)
        by_before = np.array(by_before)
        lead, low, copies = self.lead[rows], self.lead[rows] - self.n[rows] + 1, self.copies[rows]
        left = np.empty(len(rows), dtype=np.int64)
        for o in range(int(low.min()), int(lead.max()) + 1):
            has = np.flatnonzero((low <= o) & (o <= lead))
            if not len(has):
                continue
            right = np.cumsum(after < self.window - o)
            left[by_before] = np.cumsum(before < o)
            key = right[has] * np.int64(len(rows) + 1) + left[has]
            by = np.argsort(key, kind="stable")
            ranked = key[by]
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            group = np.cumsum(new) - 1
            total = np.add.reduceat(copies[has][by], np.flatnonzero(new))
            self.recurs[rows[has[by]], o] |= total[group] > 1

    def spans(self) -> list[list[tuple[int, int]]]:
        """The bytes that recurring windows cover, from each passage's start."""
        out = []
        for k, p in enumerate(self.pieces):
            starts = np.flatnonzero(self.recurs[k, p.lead - p.n + 1 : p.lead + 1][::-1])  # window i starts lead - i before the anchor
            if not len(starts):
                out.append([])
                continue
            edge = np.flatnonzero(np.diff(starts) > self.window)
            firsts, lasts = starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)]
            out.append([(int(a), int(b) + self.window) for a, b in zip(firsts, lasts, strict=True)])
        return out


def finder(window: int, gram: int, batch: int = BATCH):
    def find(pieces: list[Piece]) -> list[list[tuple[int, int]]]:
        family = Family(pieces, window, gram)
        for first in range(0, len(pieces), batch):
            family.add(list(range(first, min(first + batch, len(pieces)))))
        return family.spans()

    return find


def without_repeats(docs: DataFrame, grid: Grid = GRID, **columns) -> DataFrame:
    return without_recurring(docs, grid, finder(grid.window, grid.gram), **columns)


LEVELS = "batch bigint, level int, folder string, size bigint"


class LevelIndex:
    """Suffix levels in a folder: texts and spans by batch, and the levels that the last row of the log for each batch number names."""

    def __init__(self, spark: SparkSession, root: str, grid: Grid = GRID):
        self.spark, self.root, self.grid = spark, root.rstrip("/"), grid

    def levels(self, before: int | None = None) -> list[tuple[str, int]]:
        """(folder, size) of the levels after the last batch, or before the given one; largest first."""
        log = self.spark.read.schema(LEVELS).json(f"{self.root}/log")
        log = log if before is None else log.where(F.col("batch") < before)
        rows = log.join(log.agg(F.max("batch").alias("last")), F.col("batch") == F.col("last")).dropDuplicates(["level"]).orderBy("level").collect()
        return [(r["folder"], r["size"]) for r in rows]

    def add(self, docs: DataFrame, batch: int, text: str = "text", ident: str = "doc_id") -> None:
        """Scan a batch against itself and all levels, then take it in as a level. Batches are numbered from 0."""
        texts_of(docs, text, ident).write.mode("overwrite").parquet(f"{self.root}/texts/batch={batch}")
        texts = self.spark.read.parquet(f"{self.root}/texts/batch={batch}")
        fresh = self._written(placed(texts, self.grid), f"{self.root}/levels/batch={batch}-new")
        levels = self.levels(batch) if batch else []
        places = fresh
        if levels:
            mine = fresh.select("anchor").distinct()
            places = fresh.unionByName(self.spark.read.parquet(*[f for f, _ in levels]).join(mine, "anchor", "left_semi"))
            texts = self.spark.read.parquet(*[f"{self.root}/texts/batch={k}" for k in range(batch + 1)])
        spans = settled(recurring(places), texts, self.grid, finder(self.grid.window, self.grid.gram))
        spans.write.mode("overwrite").parquet(f"{self.root}/spans/batch={batch}")
        levels = [*levels, (f"{self.root}/levels/batch={batch}-new", fresh.count())]
        while len(levels) > 1 and levels[-1][1] * 2 > levels[-2][1]:
            (low, a), (high, b) = levels.pop(), levels.pop()
            folder = f"{self.root}/levels/batch={batch}-{len(levels)}"
            self._written(self.spark.read.parquet(high, low), folder)
            levels.append((folder, a + b))
        rows = [(batch, k, folder, size) for k, (folder, size) in enumerate(levels)]
        self.spark.createDataFrame(rows, LEVELS).coalesce(1).write.mode("append").json(f"{self.root}/log")

    def _written(self, places: DataFrame, folder: str) -> DataFrame:
        places.repartitionByRange("anchor", "seg").sortWithinPartitions("anchor", "seg").write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(places.schema).parquet(folder)

    def spans(self) -> DataFrame:
        """(id, th, spans) of all texts that have any."""
        last = self.spark.read.schema(LEVELS).json(f"{self.root}/log").agg(F.max("batch")).first()[0]
        every = self.spark.read.parquet(*[f"{self.root}/spans/batch={k}" for k in range(last + 1)])
        return every.select("id", "th", F.explode("spans").alias("s")).groupBy("id", "th").agg(F.collect_set("s").alias("spans"))

    def without_repeats(self, docs: DataFrame, text: str = "text", ident: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
        """Documents of any batch, without the bytes that recur in any of them."""
        return without_spans(docs, self.spans(), self.grid, text, ident, carry)
