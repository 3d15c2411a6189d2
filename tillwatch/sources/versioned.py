"""A keyed table in fixed buckets, merged bucket by bucket, with a manifest that is written last.

Rows lie in folders `data/version=V/bucket=B` by a hash of the key. The manifest is an append-only table of small JSON files, a row
(version, bucket, folder, rows) for each bucket that a commit wrote; the newest row of a bucket names its folder. A merge reads
and writes only the buckets that its source touches, files of other buckets stay as they are, and nothing can be seen before the
manifest's file is there: a merge that fails leaves the table unchanged, and one that runs again under the same version writes
the same folders and rows. Old folders stay readable for a reader of an older version (`as_of`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillwatch.operators import cleaning

MANIFEST = "version bigint, bucket int, folder string, rows bigint"


class BucketedTable:
    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    # ---- reading ----------------------------------------------------------------
    def manifest(self, as_of: int | None = None) -> list[tuple[int, int, str, int]]:
        """(version, bucket, folder, rows) of the newest commit of each bucket: at most one row per bucket."""
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest")
        if as_of is not None:
            rows = rows.where(f"version <= {as_of}")
        newest = rows.groupBy("bucket").agg(F.expr("max(struct(version, folder, rows)) AS m"))
        return [(r["m"]["version"], r["bucket"], r["m"]["folder"], r["m"]["rows"]) for r in newest.orderBy("bucket").collect()]

    def version(self) -> int:
        return max((v for v, *_ in self.manifest()), default=0)

    def read(self, as_of: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table, or those buckets of it, after the last commit or after version `as_of`."""
        found = [folder for _, b, folder, _ in self.manifest(as_of) if buckets is None or b in buckets]
        schema = self._schema()
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _schema(self) -> str:
        return self.spark.read.text(f"{self.root}/schema").first()["value"]

    # ---- writing ----------------------------------------------------------------
    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.selectExpr(f"CAST(pmod(xxhash64({self.key}), {self.buckets}) AS INT) AS bucket", "*")

    def _commit(self, rows: DataFrame, version: int, touched: set[int]) -> None:
        """Write the buckets, count what was written, then append the manifest."""
        data = f"{self.root}/data/version={version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = {r["bucket"]: r["rows"] for r in self.spark.read.parquet(data).groupBy("bucket").agg(F.expr("count(*) AS rows")).collect()}
        entries = [(version, b, f"{data}/bucket={b}", written[b]) for b in sorted(touched & set(written))]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def create(self, df: DataFrame) -> None:
        """Start the table with version 0."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        self.spark.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schema")
        if df.isEmpty():  # a manifest without rows still makes the table readable
            self.spark.createDataFrame([], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest")
            return
        self._commit(self._bucketed(df), 0, set(range(self.buckets)))

    def merge(self, source: DataFrame, version: int) -> set[int]:
        """Insert new keys and replace the given columns of known ones; gives the touched buckets.

        Versions are given by the caller (a batch number), so a merge that is run again does not count twice."""
        fresh = self._bucketed(source)
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # at most `buckets` small numbers
        if touched:
            before = self.read(as_of=version - 1, buckets=touched)
            self._commit(self._bucketed(cleaning.upsert(before, source, self.key)), version, touched)
        return touched
