"""Ad-hoc analytical queries: trends, rankings, lists and store summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwatch.operators.inventory import complaint_totals
from tillwatch.operators.templates import aggregates, first_rows, latest_finance, order_by


def money(x: str) -> str:
    return f"CAST(round(sum({x}), 2) AS DOUBLE)"


TOTALS = {"total_sales": money("total_sales"), "total_profit": money("profit"), "transaction_count": "count(*)"}
CASES = {"complaint_count": "count(*)", "high_severity_complaints": "count_if(severity = 'High')"}


def grouped(df: DataFrame, keys: list[str], named: dict[str, str]) -> DataFrame:
    return df.groupBy(*[F.expr(k) for k in keys]).agg(*aggregates(named))


def monthly_sales_trend(sales: DataFrame) -> DataFrame:
    months = grouped(sales, ["trunc(date, 'month') AS month_start"], TOTALS)
    return order_by(months, "month_start").selectExpr("date_format(month_start, 'yyyy-MM') AS month", *TOTALS)


def store_performance(sales: DataFrame) -> DataFrame:
    return order_by(grouped(sales, ["store_id", "store_name"], TOTALS), "total_sales DESC", "store_id")


def region_performance(sales: DataFrame) -> DataFrame:
    return order_by(grouped(sales, ["region"], TOTALS), "total_sales DESC", "region")


def top_products_by_sales(sales: DataFrame, limit: int = 10) -> DataFrame:
    named = {"total_sales": money("total_sales"), "total_profit": money("profit"),
             "quantity_sold": "sum(quantity_sold)"}
    return first_rows(grouped(sales, ["product_id", "product_name"], named), limit, "total_sales DESC, product_id")


def reorder_list(inventory: DataFrame, products: DataFrame) -> DataFrame:
    rows = inventory.where("stock_status IN ('Low Stock', 'Reorder Soon')").join(
        products.select("product_id", "is_perishable"), "product_id")
    return order_by(rows, "CASE stock_status WHEN 'Low Stock' THEN 1 ELSE 2 END", "current_stock",
                    "inventory_id").selectExpr(
        "inventory_id", "store_id", "store_name", "product_id", "product_name", "current_stock",
        "reorder_level", "stock_status", "reorder_required", "is_perishable", "expiry_date",
        "datediff(expiry_date, date) AS days_to_expiry")


def stock_status_summary(inventory: DataFrame) -> DataFrame:
    named = {"inventory_records": "count(*)", "total_current_stock": "sum(current_stock)"}
    return order_by(grouped(inventory, ["stock_status"], named), "inventory_records DESC", "stock_status")


def complaints_by_store(complaints: DataFrame) -> DataFrame:
    return order_by(grouped(complaints, ["store_id", "store_name"], CASES), "complaint_count DESC", "store_id")


def top_products_by_complaints(complaints: DataFrame, limit: int = 10) -> DataFrame:
    return first_rows(grouped(complaints, ["product_id", "product_name"], CASES), limit,
                      "complaint_count DESC, product_id")


def complaints_by_severity(complaints: DataFrame) -> DataFrame:
    return grouped(complaints, ["severity"], {"complaint_count": "count(*)"})


def delivery_performance(deliveries: DataFrame) -> DataFrame:
    named = {
        "delivery_count": "count(*)",
        "average_delay_days": "CAST(format_number(avg(delay_days), '0.00') AS DOUBLE)",
        "maximum_delay_days": "max(delay_days)",
        "average_quality_rating": "CAST(format_number(CAST(sum(quality_rating) AS DOUBLE) / count(quality_rating), '0.00') AS DOUBLE)",
        "total_purchase_value": money("purchase_value"),
    }
    return order_by(grouped(deliveries, ["vendor_id", "vendor_name"], named), "average_delay_days DESC", "vendor_id")


def high_risk_finance(finance: DataFrame) -> DataFrame:
    rows = finance.where("risk_status = 'High Risk'").select(
        "finance_id", "month", "store_id", "store_name", "monthly_sales_target", "total_revenue",
        "operating_profit", "target_achievement_percent", "risk_status")
    return order_by(rows, "month DESC", "target_achievement_percent", "finance_id")


def store_finance_summary(finance: DataFrame) -> DataFrame:
    named = {
        "total_revenue": money("total_revenue"), "total_operating_profit": money("operating_profit"),
        "average_target_achievement": "CAST(format_number(CAST(sum(target_achievement_percent) AS DOUBLE) / count(*), '0.00') AS DOUBLE)",
    }
    return order_by(grouped(finance, ["store_id", "store_name"], named), "total_revenue DESC", "store_id")


def store_monthly_view(finance: DataFrame, complaints: DataFrame, inventory: DataFrame, store_id: str) -> DataFrame:
    """One store by month with its complaint and stock counts, each aggregated before the join."""
    this = F.col("store_id") == store_id
    cases = grouped(complaints.where(this), ["store_id"], {"complaint_count": "count(*)"})
    stock = grouped(inventory.where(this), ["store_id"], {
        "low_stock_items": "count_if(stock_status = 'Low Stock')",
        "reorder_soon_items": "count_if(stock_status = 'Reorder Soon')"})
    rows = finance.where(this).join(cases, "store_id", "left").join(stock, "store_id", "left")
    return order_by(rows, "month").select(
        "month", "store_id", "store_name", "total_revenue", "operating_profit",
        "target_achievement_percent", "risk_status", "complaint_count", "low_stock_items",
        "reorder_soon_items")


def low_stock_complaints(inventory: DataFrame, complaints: DataFrame) -> DataFrame:
    counts = complaint_totals(complaints).select("store_id", "product_id", "related_complaints", "high_severity_complaints")
    rows = inventory.where("stock_status = 'Low Stock'").join(counts, ["store_id", "product_id"], "left")
    return order_by(rows.selectExpr(
        "store_id", "store_name", "product_id", "product_name", "current_stock", "reorder_level",
        "stock_status", "coalesce(related_complaints, 0) AS related_complaints",
        "coalesce(high_severity_complaints, 0) AS related_high_severity_complaints",
    ), "related_high_severity_complaints DESC", "related_complaints DESC", "current_stock", "product_id")


def overstock_list(inventory: DataFrame) -> DataFrame:
    return order_by(inventory.where("stock_status = 'Overstock'").select(
        "inventory_id", "store_id", "store_name", "product_id", "product_name", "current_stock",
        "reorder_level", "stock_status"), "current_stock DESC", "inventory_id")


def store_health(stores: DataFrame, sales: DataFrame, complaints: DataFrame, inventory: DataFrame,
                 finance: DataFrame) -> DataFrame:
    """All stores with sales, complaint, stock and latest finance figures (all pre-aggregated)."""
    sold = grouped(sales, ["store_id"], {k: TOTALS[k] for k in ("total_sales", "total_profit")})
    stock = grouped(inventory, ["store_id"], {
        "low_stock_items": "count_if(stock_status = 'Low Stock')",
        "reorder_soon_items": "count_if(stock_status = 'Reorder Soon')",
        "overstock_items": "count_if(stock_status = 'Overstock')"})
    latest = latest_finance(finance).selectExpr(
        "store_id", "month AS latest_finance_month", "target_achievement_percent", "operating_profit", "risk_status")
    joined = stores.select("store_id", "store_name")
    for part in (sold, grouped(complaints, ["store_id"], CASES), stock, latest):
        joined = joined.join(part, "store_id", "left")
    return order_by(joined, "target_achievement_percent", "complaint_count DESC", "store_id")


def sales_decline_history(sales: DataFrame) -> DataFrame:
    """Every month of every store that fell by more than 20% against the month before."""
    monthly = grouped(sales, ["store_id", "store_name", "trunc(date, 'month') AS month_start"],
                      {"sales": "sum(total_sales)"})
    over = "OVER (PARTITION BY store_id ORDER BY month_start)"
    rows = monthly.selectExpr("*", f"lag(sales) {over} AS previous").where(
        "previous IS NOT NULL AND sales * 100 < previous * 80")
    return order_by(rows.selectExpr(
        "store_id", "store_name", "date_format(month_start, 'yyyy-MM') AS month",
        "CAST(round(previous, 2) AS DOUBLE) AS previous_month_sales",
        "CAST(round(sales, 2) AS DOUBLE) AS current_month_sales",
        "CAST(format_number((CAST(previous AS DOUBLE) - CAST(sales AS DOUBLE)) / CAST(previous AS DOUBLE) * 100, '0.00') AS DOUBLE) "
        "AS sales_decline_percent",
    ), "month DESC", "sales_decline_percent DESC", "store_id")


def expiring_soon(inventory: DataFrame, products: DataFrame, days: int = 30) -> DataFrame:
    rows = inventory.join(products.where("is_perishable = 'Yes'").select("product_id"), "product_id").where(
        f"expiry_date IS NOT NULL AND datediff(expiry_date, date) BETWEEN 0 AND {days}")
    return order_by(rows.selectExpr(
        "inventory_id", "date AS inventory_date", "store_id", "store_name", "product_id", "product_name",
        "current_stock", "expiry_date", "datediff(expiry_date, date) AS days_to_expiry",
    ), "days_to_expiry", "current_stock DESC", "inventory_id")


def open_high_complaints(complaints: DataFrame) -> DataFrame:
    rows = complaints.where("severity = 'High' AND status IN ('Open', 'In Progress')").select(
        "complaint_id", "date", "store_id", "store_name", "product_id", "product_name", "complaint_type",
        "complaint_description", "severity", "status", "assigned_employee_id", "resolution_time_days")
    return order_by(rows, "date", "resolution_time_days DESC", "complaint_id")


def store_targets(finance: DataFrame) -> DataFrame:
    return order_by(latest_finance(finance).select(
        "store_id", "store_name", "month", "monthly_sales_target", "total_revenue",
        "target_achievement_percent", "operating_profit", "risk_status"), "store_id")


def basic_sales_kpis(sales: DataFrame) -> DataFrame:
    return sales.agg(*aggregates({
        "total_sales": money("total_sales"), "total_profit": money("profit"),
        "transaction_count": "count(*)", "total_quantity": "sum(quantity_sold)",
        "average_order_value": "CAST(format_number(CAST(sum(total_sales) AS DOUBLE) / count(*), '0.00') AS DOUBLE)",
        "average_discount_percent": "CAST(format_number(CAST(sum(discount_percent) AS DOUBLE) / count(*), '0.00') AS DOUBLE)",
    }))


def dataset_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    parts = [
        df.agg(*aggregates({"row_count": "count(*)"})).selectExpr(
            f"'{name}' AS table_name", "row_count", f"CAST({len(df.columns)} AS BIGINT) AS column_count")
        for name, df in tables.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return order_by(dataset_overview(tables).select("table_name", "row_count"), "table_name")


def stock_attention(inventory: DataFrame) -> DataFrame:
    rank = "CASE stock_status WHEN 'Low Stock' THEN 1 WHEN 'Reorder Soon' THEN 2 ELSE 3 END"
    rows = inventory.where("stock_status IN ('Low Stock', 'Reorder Soon', 'Overstock')").select(
        "inventory_id", "store_id", "store_name", "product_id", "product_name", "current_stock",
        "reorder_level", "stock_status", "reorder_required", "expiry_date")
    return order_by(rows, rank, "current_stock", "inventory_id")
