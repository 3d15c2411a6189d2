"""File stream that runs the import job per micro-batch. There is no event time in this data, so no watermark."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillwatch.sources.config import names
from tillwatch.sources.sinks import import_dataset
from tillwatch.sources.versioned import BucketedTable


def ingest_stream(spark: SparkSession, dataset: str, folder: str, root: str, others: Callable[[], dict[str, DataFrame]],
                  products: Callable[[], DataFrame] | None = None, start: DataFrame | None = None,
                  table: BucketedTable | None = None) -> StreamingQuery:
    """Merge every arriving CSV file of one dataset.

    With a bucketed table, batch n is its version n + 1 and rewrites the buckets it touches only. Otherwise batch n reads the table version of the last successful batch and writes its own
    folder, so a batch that is run again after a failure gives the same result.
    """
    schema = ", ".join(f"`{c}` string" for c in names(dataset, "columns"))
    versions = f"{root}/{dataset}"

    def path(batch: int) -> str:
        return f"{versions}/batch={batch}"

    def latest(before: int) -> DataFrame | None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        for batch in range(before - 1, -1, -1):
            done = fs_path(f"{path(batch)}/_SUCCESS")
            if done.getFileSystem(conf).exists(done):
                return spark.read.parquet(path(batch))
        return start

    def run(batch: DataFrame, batch_id: int) -> None:
        target = table if table is not None else latest(batch_id)
        if target is None:
            raise ValueError("the first batch needs a start table")
        import_dataset(dataset, batch, others(), target, products() if products else None, path(batch_id),
                       f"{root}/import_log", f"batch-{batch_id}", datetime.datetime.now(), run_id=f"{dataset}-{batch_id}", version=batch_id + 1)

    return (
        spark.readStream.schema(schema).option("header", True).csv(folder).writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/_stream/{dataset}").trigger(availableNow=True).start()
    )
