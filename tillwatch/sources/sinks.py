"""Sinks and the import job: validate, clean, type, merge, log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tillwatch.operators import cleaning, quality
from tillwatch.operators.templates import observed, order_by
from tillwatch.sources.config import DATASETS, LOAD_ORDER
from tillwatch.sources.versioned import BucketedTable

LOG_SCHEMA = ("run_id string, dataset_name string, source_file_name string, total_rows bigint, successful_rows bigint, failed_rows bigint, "
              "import_status string, error_message string, imported_at timestamp_ntz, duplicate_rows bigint")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a table; facts can be laid out by month so that later readers prune."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


class RefreshError(RuntimeError):
    """A refresh that was not made current; `log` has a row per dataset."""

    def __init__(self, message: str, log: DataFrame):
        super().__init__(message)
        self.log = log


def full_refresh(tables: dict[str, DataFrame], root: str, version: str, at, counted: Callable[[DataFrame], int] = DataFrame.count) -> DataFrame:
    """Replace all tables, parents first, and make the new version current; gives a log row per dataset.

    Each table is written into the folder of the new version. The rows that went into the write are observed on the way and
    compared with the rows the files hold (`counted`, from their footers). Only if all agree is `current` switched, which is the
    last write: after any failure or mismatch readers stay on the old version, the dataset at fault is logged as Failed, those
    before it as Rolled Back, those behind it not at all, and RefreshError carries the log.
    """
    spark = next(iter(tables.values())).sparkSession
    done: list[tuple[str, int]] = []

    def log(status: str, *more: DataFrame) -> DataFrame:
        good = [log_row(spark, name, f"{name}.parquet", n, n if status == "Success" else 0, status, at, run_id=version) for name, n in done]
        rows = [*good, *more]
        whole = rows[0]
        for row in rows[1:]:
            whole = whole.unionByName(row)
        append_log(whole, f"{root}/refresh_log")
        return whole

    for name in LOAD_ORDER:
        if name not in tables:
            continue
        sent, n = Observation(), 0
        try:
            write_table(tables[name].observe(sent, F.count(F.lit(1)).alias("n")), f"{root}/{version}/{name}")
            (n,) = observed(sent, "n")
            held = counted(spark.read.parquet(f"{root}/{version}/{name}"))
            if held != n:
                raise ValueError(f"{name}: {n} rows were sent, {held} are there")
        except Exception as problem:
            rows = log("Rolled Back", log_row(spark, name, f"{name}.parquet", n, 0, "Failed", at, str(problem), run_id=version))
            raise RefreshError(f"refresh {version} stopped at {name}", rows) from problem
        done.append((name, n))
    whole = log("Success")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return whole


def current_version(spark: SparkSession, root: str) -> str:
    return spark.read.schema("version string").json(f"{root}/current").first()["version"]


def log_row(spark: SparkSession, dataset: str, source: str, total: int, good: int, status: str, at, error: str | None = None,
            duplicates: int = 0, run_id: str | None = None) -> DataFrame:
    """One log row; exact duplicates are neither successful nor failed. The run is named by its time unless it has a name."""
    return spark.createDataFrame(
        [(run_id or at.strftime("%Y%m%dT%H%M%S%f"), dataset, source, total, good, total - good - duplicates, status, error[:1000] if error else None, at, duplicates)], LOG_SCHEMA)


def append_log(row: DataFrame, path: str) -> None:
    """Add rows; a run that is repeated replaces its own rows and no others, so a file name may come again in a later run."""
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "dataset_name", "source_file_name").parquet(path)


def import_dataset(dataset: str, raw: DataFrame, others: dict[str, DataFrame], target: DataFrame | BucketedTable, products: DataFrame | None,
                   target_path: str, log_path: str, source_name: str, at, quarantine_path: str | None = None, run_id: str | None = None,
                   version: int | None = None) -> str:
    """Validate against the other datasets, clean, type and merge one dataset; returns the status.

    With a BucketedTable as target the rows are merged into its touched buckets, as `version`. With a DataFrame the merged table goes
    to `target_path`, a new folder, never over the table being read. Nothing is lost: all violations of a
    refused file and all rows that cannot be cleaned or typed are written under `quarantine_path` (by default next to the
    target). Any error leaves a `Failed` log row; errors other than an empty file or wrong columns are raised again.
    """
    spark = raw.sparkSession
    refused = quarantine_path or f"{target_path.rstrip('/')}-quarantine"
    status, total, good, duplicates, error = "Failed", 0, 0, 0, None
    try:
        seen = Observation()
        found = quality.violations(quality.with_overrides(others, {dataset: raw}), only=dataset)
        found.write.mode("overwrite").parquet(f"{refused}/violations")
        counted_rows = Observation()
        raw = raw.observe(counted_rows, F.count(F.lit(1)).alias("n"))
        stored = spark.read.schema(found.schema).parquet(f"{refused}/violations")
        # as many rows as there are rules for the dataset
        bad = order_by(stored, "rule", "column_name").collect()
        cleaned = cleaning.clean(dataset, raw, products)
        unusable = cleaning.quarantined(cleaned).observe(seen, F.count(F.lit(1)).alias("n"))
        unusable.write.mode("overwrite").parquet(f"{refused}/cleaning")
        (total,) = observed(counted_rows, "n")
        if total == 0:
            raise ValueError("the file has no rows")
        if bad:
            status = "Rejected"
            raise ValueError("; ".join(f"{r['rule']} in {r['column_name']}: {r['violations']}" for r in bad))
        kept, wrong = Observation(), Observation()
        typed = cleaning.typed(dataset, cleaning.accepted(cleaned))
        typed.where("problem IS NOT NULL").observe(wrong, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{refused}/typing")
        rows = typed.where("problem IS NULL").drop("problem").observe(kept, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{refused}/accepted")
        fresh = spark.read.schema(rows.schema).parquet(f"{refused}/accepted")
        if isinstance(target, BucketedTable):
            target.merge(fresh, target.version() + 1 if version is None else version)
        else:
            cleaning.upsert(target, fresh, DATASETS[dataset]["key"]).write.mode("overwrite").parquet(target_path)
        (unclean,), (untyped,), (good,) = (observed(x, "n") for x in (seen, wrong, kept))
        rejected = unclean + untyped
        duplicates = total - good - rejected
        status = "Success" if rejected == 0 else "Partial"
        error = f"{rejected} rows in quarantine" if rejected else None
    except Exception as problem:
        status = status if status == "Rejected" else "Failed"
        error = str(problem)
        append_log(log_row(spark, dataset, source_name, total, 0, status, at, error, run_id=run_id), log_path)
        if not isinstance(problem, ValueError):
            raise
        return status
    append_log(log_row(spark, dataset, source_name, total, good, status, at, error, duplicates, run_id), log_path)
    return status


def import_history(logs: DataFrame, limit: int, offset: int = 0, dataset_name: str | None = None, import_status: str | None = None) -> DataFrame:
    """Newest imports first, filters ignoring case and outer blanks."""
    from tillwatch.operators.monitoring import matches

    rows = logs.where(matches(dataset_name=dataset_name, import_status=import_status))
    return order_by(rows, "imported_at DESC", "import_id DESC").offset(offset).limit(limit)


def import_counts(logs: DataFrame, **filters: str | None) -> DataFrame:
    from tillwatch.operators.monitoring import match_counts

    return match_counts(logs, **filters).withColumnsRenamed(
        {"total_findings": "total_records", "matching_findings": "matching_records"})


def latest_imports(logs: DataFrame) -> DataFrame:
    """Last import of each dataset, as one aggregate with map-side combine."""
    fields = [c for c in logs.columns if c not in ("dataset_name", "imported_at", "import_id")]
    return logs.groupBy("dataset_name").agg(F.expr(
        f"max(struct(imported_at, import_id, {', '.join(fields)})) AS last")).select("dataset_name", "last.*")
