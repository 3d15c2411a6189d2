"""Every threshold at its edge, on tiny literal tables."""

from __future__ import annotations

import pytest

from tillwatch.operators import complaints, inventory, issues, sales, vendor_finance
from tillwatch.operators.templates import latest_finance

AT = {"detected_at": "2026-07-01 00:00:00"}


def sold(spark, rows):
    return spark.createDataFrame(rows, "store_id string, product_id string, category string, region string, date string, total double").selectExpr(
        "store_id", "concat('Store ', store_id) AS store_name", "region", "product_id", "concat('Product ', product_id) AS product_name",
        "category", "CAST(date AS DATE) AS date", "CAST(total AS DECIMAL(14,2)) AS total_sales")


def test_store_decline_edges(spark):
    rows = []
    for store, before, now in (("A", 100.0, 80.0), ("B", 100.0, 80.01), ("C", 100.0, 60.0), ("D", 0.0, 0.0), ("E", 50.0, None)):
        rows.append((store, "P", "c", "r", "2026-05-10", before))
        if now is not None:
            rows.append((store, "P", "c", "r", "2026-06-10", now))
    rows += [("G", "P", "c", "r", "2026-03-01", 10.0), ("G", "P", "c", "r", "2026-06-01", 1.0)]
    found = {r["entity_id"]: r for r in sales.store_sales_decline(sold(spark, rows), **AT).collect()}
    assert set(found) == {"A", "C", "D", "G"}
    assert found["A"]["severity"] == "Medium" and found["A"]["sales_change_percent"] == -20.0
    assert found["C"]["severity"] == "High"
    assert found["G"]["previous_month"] == "2026-03"
    assert found["A"]["finding_id"] == "STORE-DECLINE-A-2026-06"
    assert found["A"]["evidence"] == "Current Month Sales: ₹80.00; Previous Month Sales: ₹100.00; Sales Decline: 20.00%; Region: r"


def test_product_decline_needs_previous_sales(spark):
    rows = [("A", p, "c", "r", d, v) for p, b in (("P1", 49999.99), ("P2", 50000.0)) for d, v in (("2026-05-01", b), ("2026-06-01", 100.0))]
    assert [r["entity_id"] for r in sales.product_sales_decline(sold(spark, rows), **AT).collect()] == ["P2"]


def test_underperformance_needs_two_products(spark):
    rows = [("A", "P1", "x", "r", "2026-06-01", 60.0), ("A", "P2", "x", "r", "2026-06-01", 140.0), ("A", "P3", "y", "r", "2026-06-01", 1.0)]
    found = sales.product_underperformance(sold(spark, rows), **AT).collect()
    assert [(r["entity_id"], r["severity"], r["benchmark_value"]) for r in found] == [("P1", "Medium", 100.0)]


def test_blank_regions_are_left_out(spark):
    rows = [("A", "P", "c", r, d, v) for r in (" ", None, "West Side") for d, v in (("2026-05-01", 10.0), ("2026-06-01", 1.0))]
    assert [r["entity_id"] for r in sales.regional_sales_decline(sold(spark, rows), **AT).collect()] == ["WEST-SIDE"]


def cases(spark, rows):
    return spark.createDataFrame(rows, "complaint_id string, store_id string, product_id string, date string, severity string, status string").selectExpr(
        "complaint_id", "store_id", "store_id AS store_name", "'r' AS region", "product_id", "product_id AS product_name", "CAST(date AS DATE) AS date",
        "severity", "status", "'Late Delivery' AS complaint_type", "'E1' AS assigned_employee_id", "CAST(NULL AS INT) AS resolution_time_days")


def test_outlier_exactly_at_the_multiple(spark):
    counts = {"A": 3, "B": 2, "C": 1}
    rows = [(f"{s}{i}", s, "P", "2026-06-01", "Low", "Closed") for s, n in counts.items() for i in range(n)]
    found = complaints.high_complaint_stores(cases(spark, rows), **AT).collect()
    # no High case anywhere: 0 >= 1.5 * 0 holds for every store, as in the rule
    assert {r["entity_id"] for r in found} == {"A", "B", "C"}
    rows.append(("H", "A", "P", "2026-06-01", "High", "Open"))
    found = {r["entity_id"]: r["severity"] for r in complaints.high_complaint_stores(cases(spark, rows), **AT).collect()}
    assert found == {"A": "High"}


def test_ageing_edges(spark):
    rows = [(f"C{d}", "A", "P", f"2026-06-{d:02d}", "High", "Open") for d in (24, 23, 17, 16)] + [("L", "A", "P", "2026-06-30", "Low", "Closed")]
    found = {r["complaint_id"]: r["severity"] for r in complaints.unresolved_complaint_ageing(cases(spark, rows), **AT).collect()}
    assert found == {"C23": "Medium", "C17": "Medium", "C16": "High"}
    assert complaints.open_high_severity_complaints(cases(spark, rows), **AT).count() == 4


@pytest.mark.parametrize("ratio, kinds", [
    (25, {"Low Stock": "High", "Stockout Risk": "High"}), (50, {"Low Stock": "Medium", "Stockout Risk": "Medium"}),
    (51, {"Low Stock": "Medium"})])
def test_stock_rules(spark, ratio, kinds):
    row = spark.createDataFrame([("I", "2026-06-30", "A", "P", ratio, 100, "Low Stock", "No", None)],
                                "inventory_id string, date string, store_id string, product_id string, current_stock int, reorder_level int, stock_status string, is_perishable string, expiry_date string")
    found = inventory.inventory_findings(with_snapshot(row), **AT).collect()
    assert {r["analysis_type"]: r["severity"] for r in found} == kinds


def with_snapshot(df):
    return df.selectExpr(
        "inventory_id", "CAST(date AS DATE) AS date", "store_id", "'s' AS store_name", "product_id", "'p' AS product_name", "'V' AS vendor_id",
        "'v' AS vendor_name", "current_stock", "reorder_level", "stock_status", "'Yes' AS reorder_required", "is_perishable",
        "CAST(expiry_date AS DATE) AS expiry_date", "0 AS related_complaints", "0 AS high_severity_complaints",
        "datediff(CAST(expiry_date AS DATE), CAST(date AS DATE)) AS days_to_expiry",
        "try_divide(CAST(current_stock AS DOUBLE), CAST(reorder_level AS DOUBLE)) AS stock_ratio")


def test_expiry_edges_and_zero_reorder(spark):
    days = {"X": "2026-06-29", "N0": "2026-06-30", "N7": "2026-07-07", "N8": "2026-07-08", "N30": "2026-07-30", "N31": "2026-07-31"}
    rows = [(k, "2026-06-30", "A", k, 5, 10, "Normal", "yes ", d) for k, d in days.items()] + [
        ("Z", "2026-06-30", "A", "Z", 0, 10, "Normal", "Yes", "2026-06-29"), ("R0", "2026-06-30", "A", "R0", 5, 0, "Low Stock", "No", None)]
    df = spark.createDataFrame(rows, "inventory_id string, date string, store_id string, product_id string, current_stock int, reorder_level int, stock_status string, is_perishable string, expiry_date string")
    found = {(r["product_id"], r["analysis_type"]): r["severity"] for r in inventory.inventory_findings(with_snapshot(df), **AT).collect()}
    assert found == {("X", "Expired Inventory"): "High", ("N0", "Near Expiry Stock"): "High", ("N7", "Near Expiry Stock"): "High",
                     ("N8", "Near Expiry Stock"): "Medium", ("N30", "Near Expiry Stock"): "Medium", ("R0", "Low Stock"): "High"}


def test_latest_finance_and_margins(spark):
    rows = [("F1", "2026-06", "A", 100.0, 10.0, 69.99, " high risk "), ("F0", "2026-06", "A", 100.0, 5.0, 40.0, "Low Risk"),
            ("F2", "2026-05", "A", 100.0, -5.0, 40.0, "Low Risk"), ("F3", "2026-06", "B", 100.0, 5.0, 70.0, "HIGH RISK"), ("F4", "2026-06", "C", 0.0, 0.0, 80.0, "Low Risk")]
    finance = spark.createDataFrame(rows, "finance_id string, month string, store_id string, total_revenue double, operating_profit double, target_achievement_percent double, risk_status string").selectExpr(
        "finance_id", "month", "store_id", "store_id AS store_name", "CAST(total_revenue AS DECIMAL(14,2)) AS total_revenue",
        "CAST(operating_profit AS DECIMAL(14,2)) AS operating_profit", "CAST(target_achievement_percent AS DECIMAL(8,2)) AS target_achievement_percent", "risk_status")
    assert {r["finance_id"] for r in latest_finance(finance).collect()} == {"F0", "F3", "F4"}
    found = {(r["store_id"], r["analysis_type"]): r["severity"] for r in vendor_finance.finance_findings(vendor_finance.finance_snapshot(finance), **AT).collect()}
    assert found == {("A", "Low Operating Profit"): "Medium", ("A", "Low Target Achievement"): "High", ("B", "Low Operating Profit"): "Medium",
                     ("B", "High Financial Risk"): "High", ("C", "Low Operating Profit"): "High"}


def findings(spark, rows):
    df = spark.createDataFrame(rows, "finding_id string, analysis_type string, business_area string, severity string, store_id string, source_module string")
    names = [c for c in issues.COMMON if c not in df.columns]
    return df.selectExpr(*df.columns, *[f"'{'e' if c == 'evidence' else ''}' AS {c}" for c in names], "'r' AS source_report",
                         "struct(1 AS module, 1 AS severity, '' AS area, analysis_type AS type, 0D AS first, 0D AS second, finding_id AS finding_id) AS arrival")


@pytest.mark.parametrize("rows, score, level", [
    ([("Category Sales Decline", "Sales", "Low")], 15.0, "Low"),
    ([("Category Sales Decline", "Sales", "Medium")], 50.0, "Low"),
    ([("Category Sales Decline", "Sales", "High")], 70.0, "Medium"),
    ([("Store Sales Decline", "Sales", "High"), ("High Financial Risk", "Finance", "High")], 100.0, "High"),
    ([("Low Target Achievement", "Sales", "Medium"), ("Low Target Achievement", "Finance", "Medium")], 58.0, "Low"),
])
def test_priority_score(spark, rows, score, level):
    df = findings(spark, [(f"F{i}", t, a, s, "S1", "sales") for i, (t, a, s) in enumerate(rows)])
    issue = issues.consolidate(issues.with_issue_key(df)).collect()
    assert len(issue) == 1 and issue[0]["issue_id"] == "ISSUE-STORE-PERFORMANCE-RISK-S1"
    assert (issue[0]["priority_score"], issue[0]["priority_level"]) == (score, level)
    assert issue[0]["finding_count"] == len(rows)
