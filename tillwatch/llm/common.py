"""Helpers of this subpackage: shared tables, whole rows, and numpy over the buffers of Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir, else a folder of the warehouse; on a cluster never a machine's own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("on a cluster set spark.checkpoint.dir to a shared folder")
    return f"{warehouse}/_steps"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = session(df)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(docs: DataFrame, **columns) -> DataFrame:
    """docs as one struct column `row`, so that no column of the input can clash, and the given columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def partitions_for(spark: SparkSession, size: float, each: float) -> int:
    """Partitions of about `each` bytes, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / each) + 1)


# ---- numpy over text ----


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:  # one very long text shall not stay in the worker's memory
            _POWERS[base] = have
    return have[:n]


class Ranges:
    """Hashes of any range of a symbol sequence, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * powers(BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k symbols in a row."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each value starts (one more entry for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    starts = np.frombuffer(offsets, dtype=kind)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column, or the field of that name in the struct column `row`."""
    return batch.column(column) if column in batch.schema.names else batch.column("row").field(column)


def blocks(batches, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a block has about `limit` bytes of the column (one longer text is a block of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = text_buffers(text_of(batch, column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def find_words(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs of the bytes that `inside` (256 flags) marks; none spans two texts.

    Gives first byte, end byte and, for each text, the number of its first word (one more entry for the end)."""
    flags = inside[raw]
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = flags[:-1]
    edges = starts[:-1][starts[:-1] < len(raw)]
    before[edges] = False
    first = np.flatnonzero(flags & ~before)
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = flags[1:]
    ends = starts[1:][starts[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(flags & ~after) + 1
    return first, end, np.searchsorted(first, starts)


def word_flags(pattern_excludes: bytes) -> np.ndarray:
    flags = np.ones(256, dtype=bool)
    flags[list(pattern_excludes)] = False
    return flags


#: `[^\x20\x09-\x0D]+`: what bytes.split() gives.
SPACED = word_flags(b"\x20\x09\x0a\x0b\x0c\x0d")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = word_flags(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges as a sorted list without overlaps or touching neighbours."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
