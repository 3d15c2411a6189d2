"""SimHash near-duplicates: segment popcounts as a grid, range join under the Manhattan distance, exact verification.

A fingerprint of 64 bits is mapped to the bit counts of its 16 segments of four bits (all in one long, a nibble each). The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints. The grid range join within 2 lets
every fingerprint visit the cells at most 1 away from its own: two vectors within 2 share one of them. Only fingerprints in
cells with another one go on. They are verified exactly through the fingerprint halfway: two fingerprints differ in at most 2
bits if and only if both are at most one bit away from a common one, and that one lies in a cell they share. A group around such
a halfway point has at most 65 distinct members, all within 2 bits of each other, so its links form a star.
All of it grows with the number of distinct fingerprints (33 visits and at most 65 halfway points each); no pairs within a cell
are made, so a group of any number of near copies costs no more per document than others. Equal fingerprints are one node.

Defined results: a null or blank text has fingerprint zero; fewer words than a shingle make one shingle; repeated rows and null
ids are linked like others (a component without any id has a null id); an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, stored, text_of
from .components import components
from .decontaminate import row_type

SEED = 42
SEGMENTS, BITS = 16, 4
_COLUMNS = np.arange(8) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words_each: int) -> int:
    """Bit set where over half of the shingle hashes (repeats count) have it; as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(words_each, len(words))
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]), dtype=np.uint8)
    n = len(starts)
    counts = np.bincount((hashes.reshape(n, 8) + _COLUMNS).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(2 * counts.ravel() > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs as `row` (its columns, or those of carry) with fp."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    if carry is None:
        rows = rows.select("row")  # its text is in the row

    def run(batches):
        for batch in blocks(batches, 4 << 20, text if carry is None else "text"):
            texts = text_of(batch, text if carry is None else "text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([fingerprint(t, words_each) for t in texts], pa.int64())], ["row", "fp"])

    return rows.mapInArrow(run, f"row {row_type(rows)}, fp bigint")


def cell(fp: Column) -> Column:
    """The bit counts of the 16 segments, one nibble each."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(1, BITS)), fp.bitwiseAND(ones))


def visits(nodes: DataFrame) -> DataFrame:
    """(cell, fp, way): the cells at most 1 from a fingerprint's own. way: 0 own, s + 1 one bit more in segment s, -(s + 1) one less."""
    own = F.col("own")
    ways = [F.struct(own.alias("cell"), F.lit(0).alias("way"))]
    for s in range(SEGMENTS):
        count = F.shiftrightunsigned(own, BITS * s).bitwiseAND(15)
        one = F.lit(1 << (BITS * s)).cast("long")
        ways.append(F.when(count < BITS, F.struct((own + one).alias("cell"), F.lit(s + 1).alias("way"))))
        ways.append(F.when(count > 0, F.struct((own - one).alias("cell"), F.lit(-s - 1).alias("way"))))
    return (
        nodes.select("fp", cell(F.col("fp")).alias("own")).select("fp", F.explode(F.array(*ways)).alias("v"))
        .where("v IS NOT NULL").select("v.cell", "fp", "v.way")
    )


def halfway(way: Column, fp: Column) -> Column:
    """The fingerprints at most one bit from fp that lie in the visited cell."""
    bits = F.sequence((F.abs(way) - 1) * BITS, F.abs(way) * BITS - 1)
    flip = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    fits = lambda b: (fp.bitwiseAND(flip(b)) == 0) == (way > 0)
    return F.when(way == 0, F.array(fp)).otherwise(F.transform(F.filter(bits, fits), lambda b: fp.bitwiseXOR(flip(b))))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in at most 2 bits; stars around the smallest of each halfway group."""
    seen = visits(nodes)
    shared = seen.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("cell")
    met = seen.join(shared, "cell", "left_semi").select("fp", F.explode(halfway(F.col("way"), F.col("fp"))).alias("z"))
    groups = met.groupBy("z").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members")).where("size(members) > 1")
    return groups.select("a", F.explode("members").alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, words_each: int = 3, text: str = "text", carry: list[str] | None = None, id_column: str = "doc_id") -> DataFrame:
    """Each row (struct `row`) with fp, rid (a number of its own), component_id (smallest id) and first (rid of the row to keep)."""
    marked = stored(fingerprints(docs, words_each, text, carry).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    ident = F.col(f"row.`{id_column}`")
    nodes = stored(marked.groupBy("fp").agg(F.min(ident).alias("least"), F.min(F.struct(ident.isNull(), ident, "rid")).alias("best")), "nodes")
    labels = components(links(nodes)).select(F.col("node").alias("fp"), "label")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("best").alias("best"))
    of = named.select("fp", "label").join(heads, "label").select("fp", "component_id", F.col("best.rid").alias("first"))
    return marked.join(of, "fp")


def keep_one(docs: DataFrame, words_each: int = 3, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs with one row of each class of near copies, the one with the smallest id: shingles and bits as in `classes`."""
    return classes(docs, words_each, text, None, id_column).where("rid = first").select("row.*")
