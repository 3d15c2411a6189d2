"""Substring dedup by words: recurring passages are confirmed, compiled into Aho-Corasick automata, and located in the stream.

Passages reach a shard by the anchors of their windows (see passages.py), so a shard sees every occurrence of the windows it
decides on, from all documents. There, windows of 35 words are counted exactly, by their words. Runs of recurring windows become
phrases: windows side by side that cover the run. The shard's phrases are compiled into one automaton over word numbers, and all
passages of the shard stream through it; each occurrence marks its words.

Defined results: null texts have no words; a text shorter than a window loses nothing; of equal windows all are removed, the
first one too, also within one document; repeated rows are each other's copies; empty tables give empty results.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame

from .common import merged
from .passages import Grid, Piece, without_recurring

GRID = Grid(words=True, window=35, gram=8, block_bytes=2 << 20)


def finder(window: int):
    def find(pieces: list[Piece]) -> list[list[tuple[int, int]]]:
        numbers: dict[bytes, int] = {}
        texts = [tuple(numbers.setdefault(w, len(numbers) + 1) for w in p.body.split(b" ")) for p in pieces]
        times: dict[tuple, int] = {}
        for p, words in zip(pieces, texts, strict=True):
            for k in range(p.n):
                key = words[k : k + window]
                times[key] = times.get(key, 0) + p.copies
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        some = False
        for p, words in zip(pieces, texts, strict=True):
            k = 0
            while k < p.n:
                if times[words[k : k + window]] < 2:
                    k += 1
                    continue
                last = k
                while last + 1 < p.n and times[words[last + 1 : last + 1 + window]] > 1:
                    last += 1
                for at in [*range(k, last, window), last]:
                    automaton.add_word(words[at : at + window])
                    some = True
                k = last + 1
        if not some:
            return [[] for _ in pieces]
        automaton.make_automaton()
        return [merged([(end + 1 - size, end + 1) for end, size in automaton.iter(words)]) for words in texts]

    return find


def without_repeats(docs: DataFrame, grid: Grid = GRID, **columns) -> DataFrame:
    return without_recurring(docs, grid, finder(grid.window), **columns)
