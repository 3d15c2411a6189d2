"""The file stream merges arriving files, refuses bad ones and logs both."""

from __future__ import annotations

from tillwatch.sources.config import names
from tillwatch.streaming.ingest import ingest_stream


def test_vendor_files(spark, tmp_path):
    columns = names("vendors", "columns")
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, rows):
        (folder / name).write_text("\n".join([",".join(columns), *[",".join(r) for r in rows]]) + "\n")

    def vendor(key, rating):
        return [key, "Name " + key, "c", "p", "city", "state", "north", "3", rating, "30 days", "active"]

    start = spark.createDataFrame([("V1", "old")], "vendor_id string, vendor_name string").selectExpr(
        *[c if c in ("vendor_id", "vendor_name") else "CAST(NULL AS BIGINT) AS average_delivery_days" if c == "average_delivery_days"
          else "CAST(NULL AS DECIMAL(14,2)) AS rating" if c == "rating" else f"CAST(NULL AS STRING) AS {c}" for c in columns])
    root = str(tmp_path / "out")
    put("a.csv", [vendor("v1", "4.5"), vendor("v2", "3")])
    ingest_stream(spark, "vendors", str(folder), root, dict, start=start).awaitTermination(120)
    put("b.csv", [vendor("v3", "-1")])
    ingest_stream(spark, "vendors", str(folder), root, dict, start=start).awaitTermination(120)
    table = {r["vendor_id"]: (r["vendor_name"], float(r["rating"]), r["region"]) for r in spark.read.parquet(f"{root}/vendors/batch=0").collect()}
    assert table == {"V1": ("Name v1", 4.5, "North"), "V2": ("Name v2", 3.0, "North")}
    log = {r["source_file_name"]: (r["import_status"], r["total_rows"], r["successful_rows"]) for r in spark.read.parquet(f"{root}/import_log").collect()}
    assert log == {"batch-0": ("Success", 2, 2), "batch-1": ("Rejected", 1, 0)}
