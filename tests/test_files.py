"""Files in and out: raw CSV as text, headers, clean datasets by month, reports."""

from __future__ import annotations

import glob

import pytest

from tillwatch.operators import cleaning, quality
from tillwatch.sources import sinks


def test_raw_csv_is_read_as_text(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Sale ID, Unit  Price ,note\n007,1.50,"two\twords, one cell"\n,NA,\n')
    raw = cleaning.read_raw(spark, str(tmp_path / "in.csv"), ["Sale ID", " Unit  Price ", "note"])
    assert raw.columns == ["sale_id", "unit_price", "note"] and set(dict(raw.dtypes).values()) == {"string"}
    assert [tuple(r) for r in raw.collect()] == [("007", "1.50", "two\twords, one cell"), (None, "NA", None)]


def test_columns_in_another_order_are_refused(spark, tmp_path):
    (tmp_path / "in.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception):
        cleaning.read_raw(spark, str(tmp_path / "in.csv"), ["a", "b"]).collect()


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  Store ID ", "TOTAL\tSales", "date"])
    assert cleaning.normalise_headers(df).columns == ["store_id", "total_sales", "date"]


def test_clean_datasets_are_replaced_and_laid_out_by_month(spark, tmp_path):
    path = str(tmp_path / "sales")
    first = spark.createDataFrame([("a", "2001-01"), ("b", "2001-02")], "sale_id string, month string")
    sinks.write_table(first, path, ("month",))
    sinks.write_table(first.where("sale_id = 'b'"), path, ("month",))
    back = spark.read.parquet(path)
    assert [tuple(r) for r in back.collect()] == [("b", "2001-02")] and glob.glob(f"{path}/month=2001-02/part-*") and not glob.glob(f"{path}/month=2001-01")
    plan = back.where("month = '2001-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_reports_are_csv_with_a_header(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_csv(spark.createDataFrame([("a, b", None, 1.5), ('say "x"', "y", None)], "name string, note string, amount double").coalesce(1), path)
    (file,) = glob.glob(f"{path}/part-*.csv")
    with open(file) as lines:
        assert lines.readline() == "name,note,amount\n"
    back = spark.read.option("header", True).option("escape", "\\").schema("name string, note string, amount double").csv(path)
    assert sorted(tuple(r) for r in back.collect()) == [("a, b", None, 1.5), ('say "x"', "y", None)]


def test_absent_columns_and_datasets_are_warnings(spark):
    stock = spark.createDataFrame([("I1", "S1", "P1", "5", "9")], "inventory_id string, store_id string, product_id string, current_stock string, reorder_level string")
    stores = spark.createDataFrame([("S2",)], "store_id string")
    verdicts = {r["dataset"]: r for r in quality.dataset_verdicts({"inventory": stock, "stores": stores}).collect()}
    row = verdicts["inventory"]
    # missing: date, vendor_id (required); S1 is no store
    assert (row["row_count"], row["column_count"], row["error_count"], row["warning_count"], row["is_valid"]) == (1, 5, 3, 2, False)
    assert verdicts["sales"]["warning_count"] == 1 and verdicts["sales"]["is_valid"] and len(verdicts) == 9


def test_samples_stop_at_ten_and_five(spark):
    children = spark.createDataFrame([(f"V{k:02d}", f"x{k}") for k in range(30) for _ in range(3)], "vendor_id string, unit_price string")
    parents = spark.createDataFrame([(f"V{k:02d}",) for k in range(5)], "vendor_id string")
    found = quality.violation_samples({"products": children, "vendors": parents}).collect()
    assert [(r["position"], r["value"]) for r in sorted(found, key=lambda r: (r["rule"], r["position"])) if r["rule"] == "unknown reference"] == [(k + 1, f"V{k + 5:02d}") for k in range(10)]
    assert sorted(r["value"] for r in found if r["rule"] == "not numeric") == ["x0", "x1", "x10", "x11", "x12"]
