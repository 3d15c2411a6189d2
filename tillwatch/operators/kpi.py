"""KPIs: each measure is one aggregate, the table is their rows put side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwatch.functions.text import count_text, currency0, lit, percent, round2, say, zero
from tillwatch.operators.findings import stamp
from tillwatch.operators.templates import (
    aggregates, first_rows, latest_finance, monthly_totals, order_by, with_previous,
)


def sales_summary(sales: DataFrame) -> DataFrame:
    return sales.agg(*aggregates({
        "total_sales": "coalesce(CAST(sum(total_sales) AS DOUBLE), 0D)",
        "transaction_count": "count(*)",
        "total_quantity_sold": "coalesce(sum(quantity_sold), 0)",
        "average_order_value": "coalesce(try_divide(CAST(sum(total_sales) AS DOUBLE), CAST(count(*) AS DOUBLE)), 0D)",
    }))


def finance_summary(finance: DataFrame) -> DataFrame:
    return finance.agg(*aggregates({
        "total_revenue": "coalesce(CAST(sum(total_revenue) AS DOUBLE), 0D)",
        "total_operating_profit": "coalesce(CAST(sum(operating_profit) AS DOUBLE), 0D)",
    }))


def latest_sales_growth(sales: DataFrame) -> DataFrame:
    """Last month of the whole series next to the month before it; windows over months only."""
    monthly = monthly_totals(sales, ["'all' AS series"], {"monthly_sales": "sum(total_sales)"})
    history = with_previous(monthly, ["series"], ["monthly_sales"])
    return first_rows(history, 1, "month_start DESC").selectExpr(
        "month", "CAST(monthly_sales AS DOUBLE) AS monthly_sales", "previous_month",
        "CAST(previous_monthly_sales AS DOUBLE) AS previous_month_sales",
        "CASE WHEN previous_monthly_sales > 0 THEN (CAST(monthly_sales AS DOUBLE) - CAST(previous_monthly_sales AS DOUBLE)) "
        "/ CAST(previous_monthly_sales AS DOUBLE) * 100 ELSE 0D END AS growth_percent",
    )


def latest_target_achievement(finance: DataFrame) -> DataFrame:
    return order_by(latest_finance(finance).select(
        "store_id", "store_name", "month", "monthly_sales_target", "total_revenue",
        "operating_profit", "target_achievement_percent", "risk_status",
    ), "target_achievement_percent", "store_id")


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.agg(*aggregates({
        "low_stock_count": "count_if(stock_status = 'Low Stock')",
        "overstock_count": "count_if(stock_status = 'Overstock')",
    }))


def complaint_counts(complaints: DataFrame) -> DataFrame:
    return complaints.agg(*aggregates({
        "high_severity_complaint_count": "count_if(severity = 'High')",
        "open_complaint_count": "count_if(status IN ('Open', 'In Progress'))",
    }))


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.agg(*aggregates({
        "delayed_delivery_count": "count_if(delay_days > 0)",
        "on_time_delivery_rate": "coalesce(try_divide(count_if(delay_days <= 0) * 100D, CAST(count(*) AS DOUBLE)), 0D)",
    }))


# fixed values: key, name, expression, format, unit, period ("all" = whole history), description
KPIS = (
    ("total_sales", "Total Sales", "sales.total_sales", currency0, "INR", "all",
     "Total value of all completed sales transactions."),
    ("total_revenue", "Total Revenue", "finance.total_revenue", currency0, "INR", "all",
     "Total revenue recorded in the finance reporting table."),
    ("sales_growth", "Sales Growth", "growth.growth_percent", percent, "Percent", "growth",
     "Month-on-month change in total sales for the latest month."),
    ("store_target_achievement", "Store Target Achievement", "targets.achievement", percent, "Percent", "target",
     "Weighted target achievement across all stores in the latest available finance month."),
    ("average_order_value", "Average Order Value", "sales.average_order_value", currency0, "INR", "all",
     "Average sales value per transaction."),
    ("total_operating_profit", "Total Operating Profit", "finance.total_operating_profit", currency0, "INR", "all",
     "Total operating profit after operating expenses."),
    ("low_stock_count", "Low-Stock Count", "stock.low_stock_count", count_text, "Records", "stock",
     "Number of inventory records marked as Low Stock."),
    ("overstock_count", "Overstock Count", "stock.overstock_count", count_text, "Records", "stock",
     "Number of inventory records marked as Overstock."),
    ("high_severity_complaint_count", "High-Severity Complaint Count", "cases.high_severity_complaint_count",
     count_text, "Complaints", "all", "Total complaints classified as High severity."),
    ("open_complaint_count", "Open Complaint Count", "cases.open_complaint_count", count_text, "Complaints", "all",
     "Complaints that remain Open or In Progress."),
    ("vendor_delay_count", "Vendor Delay Count", "supply.delayed_delivery_count", count_text, "Deliveries", "all",
     "Number of vendor deliveries received after the scheduled delivery date."),
    ("vendor_on_time_delivery_rate", "Vendor On-Time Delivery Rate", "supply.on_time_delivery_rate", percent,
     "Percent", "all", "Percentage of deliveries received on or before the scheduled delivery date."),
)


def kpi_table(sales: DataFrame, finance: DataFrame, inventory: DataFrame, complaints: DataFrame,
              deliveries: DataFrame, period: str | None = None,
              calculated_at: str | None = None) -> DataFrame:
    """Twelve KPI rows; every summary is a one-row scalar subquery. The period is that of the sales unless one is given."""
    def one(df: DataFrame):
        return df.selectExpr(f"struct({', '.join(df.columns)})").scalar()

    targets = latest_finance(finance).agg(*aggregates({
        "achievement": "coalesce(try_divide(CAST(sum(total_revenue) AS DOUBLE) * 100, CAST(sum(monthly_sales_target) AS DOUBLE)), 0D)",
        "month": "min(struct(target_achievement_percent, store_id, month)).month",
    }))
    row = sales.sparkSession.range(1).select(
        one(sales_summary(sales)).alias("sales"), one(finance_summary(finance)).alias("finance"),
        one(latest_sales_growth(sales)).alias("growth"), one(targets).alias("targets"),
        one(inventory_counts(inventory)).alias("stock"), one(complaint_counts(complaints)).alias("cases"),
        one(delivery_counts(deliveries)).alias("supply"),
        one(sales.agg(*aggregates({"low": "min(date)", "high": "max(date)"}))).alias("span"),
    )
    periods = {
        "all": lit(period) if period else "concat(date_format(span.low, 'yyyy-MM'), ' to ', date_format(span.high, 'yyyy-MM'))",
        "growth": say("{now} compared with {before}", now="growth.month",
                      before="coalesce(growth.previous_month, 'None')"),
        "target": say("Latest finance month: {m}", m="targets.month"),
        "stock": "'Latest inventory snapshot'",
    }
    structs = [
        f"named_struct('kpi_key', {lit(key)}, 'kpi_name', {lit(name)}, 'value', {round2(zero(x))}, "
        f"'display_value', {shown(zero(x)) if shown is percent else shown(x)}, 'unit', {lit(unit)}, "
        f"'reference_period', {periods[when]}, 'description', {lit(text)}, 'calculated_at', {stamp(calculated_at)})"
        for key, name, x, shown, unit, when, text in KPIS
    ]
    return row.selectExpr(f"inline(array({', '.join(structs)}))")
