"""Bounded samples of labelled rows to fit a classifier on, and the split that holds rows out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of 2^20 shares of a hash.
SHARES = 1 << 20


def held_out(ident: str) -> Column:
    """crc32(id as text) mod 4 is 2; a null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(f"`{ident}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(rows: DataFrame, rows_each: int, most_rows: int, most_bytes: int) -> pa.Table:
    """(label, text) of rows(id, label, text): of every label up to rows_each texts, at most most_rows texts and most_bytes in all.

    Only this sample and one row per label (the most_rows most frequent ones, should there be more) reach the driver. Each label has an equal part
    of both bounds, and what a label leaves of its rows goes to more frequent ones. Texts are chosen by a hash of the id and never
    cut; those longer than a label's part of the bytes come last, and one of them, the shortest, is taken if a label has no others."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_rows).collect()[::-1]
    if not sizes:
        return pa.table({"label": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    part, left, shares = most_bytes // len(sizes), most_rows, []
    for k, r in enumerate(sizes):  # the least frequent first
        wanted = min(r["n"], rows_each, left // (len(sizes) - k))
        left -= wanted
        shares.append((r["label"], wanted, min(1.0, (2 * wanted + 20) / r["n"])))
    quota = rows.sparkSession.createDataFrame(shares, "q_label string, wanted bigint, share double")
    hashed = rows.select("id", "label", "text", F.octet_length("text").cast("bigint").alias("size"), F.pmod(F.xxhash64("id"), F.lit(SHARES)).alias("place"))
    # at most most_rows rows of a label and two numbers: sent to the rows, which are not shuffled before they are few
    some = hashed.join(F.broadcast(quota), F.col("label") == F.col("q_label")).where(F.col("place") < F.col("share") * SHARES)
    order = f"PARTITION BY label ORDER BY size > {part}, if(size > {part}, size, 0), place, id, text"
    ranked = some.selectExpr("*", f"row_number() OVER ({order}) AS rank", f"sum(size) OVER ({order} ROWS UNBOUNDED PRECEDING) AS bytes")
    few = ranked.where((F.col("rank") <= F.col("wanted")) & ((F.col("rank") == 1) | (F.col("bytes") <= part))).select("id", "label", "text")
    return few.toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("text", "ascending")]).select(["label", "text"])
