"""SQL cross-checks of the KPI and report queries."""

from __future__ import annotations

from tillwatch.oracle.detectors import COUNTS, DETECTED, LATEST_FINANCE
from tillwatch.oracle.views import inr, pct, r2, with_views


def money(x: str) -> str:
    return f"CAST(round(sum({x}), 2) AS DOUBLE)"


SUMS = f"{money('total_sales')} AS total_sales, {money('profit')} AS total_profit"
TOTALS = f"{SUMS}, count(*) AS transaction_count"
CASES = "count(*) AS complaint_count, count(*) FILTER (severity = 'High') AS high_severity_complaints"
GROWTH = ("SELECT month, CAST(s AS DOUBLE) AS monthly_sales, lag(month) OVER (ORDER BY month) AS previous_month, "
          "CAST(lag(s) OVER (ORDER BY month) AS DOUBLE) AS previous_month_sales, "
          "(CAST(s AS DOUBLE) - previous_month_sales) / previous_month_sales * 100 AS growth_percent "
          "FROM (SELECT strftime(date, '%Y-%m') AS month, sum(total_sales) AS s FROM sales GROUP BY 1) ORDER BY month DESC LIMIT 1")
ON_TIME = "count(*) FILTER (delay_days <= 0) * 100.0::DOUBLE / count(*)"
COUNT_STATUS = ("count(*) FILTER (stock_status = 'Low Stock') AS low_stock_items, "
                "count(*) FILTER (stock_status = 'Reorder Soon') AS reorder_soon_items")


def kpi(key: str, name: str, value: str, shown: str, unit: str, period: str, text: str, source: str) -> str:
    return (f"SELECT '{key}' AS kpi_key, '{name}' AS kpi_name, {r2('v')} AS value, {shown} AS display_value, "
            f"'{unit}' AS unit, {period} AS reference_period, '{text}' AS description, '{DETECTED}' AS calculated_at "
            f"FROM (SELECT {value} AS v, * FROM ({source}))")


ALL = "(SELECT strftime(min(date), '%Y-%m') || ' to ' || strftime(max(date), '%Y-%m') FROM sales)"
COUNT = "format('{:,}', v)"
SALES_ONE = "SELECT CAST(sum(total_sales) AS DOUBLE) AS s, count(*) AS n FROM sales"
FINANCE_ONE = "SELECT CAST(sum(total_revenue) AS DOUBLE) AS r, CAST(sum(operating_profit) AS DOUBLE) AS p FROM finance"
TARGET_ONE = (f"SELECT CAST(sum(total_revenue) AS DOUBLE) * 100 / CAST(sum(monthly_sales_target) AS DOUBLE) AS a, "
              f"(SELECT month FROM ({LATEST_FINANCE}) ORDER BY target_achievement_percent, store_id LIMIT 1) AS m FROM ({LATEST_FINANCE})")
KPI_TABLE = " UNION ALL ".join([
    kpi("total_sales", "Total Sales", "s", inr("v"), "INR", ALL, "Total value of all completed sales transactions.", SALES_ONE),
    kpi("total_revenue", "Total Revenue", "r", inr("v"), "INR", ALL, "Total revenue recorded in the finance reporting table.", FINANCE_ONE),
    kpi("sales_growth", "Sales Growth", "growth_percent", pct("v"), "Percent", "month || ' compared with ' || previous_month",
        "Month-on-month change in total sales for the latest month.", GROWTH),
    kpi("store_target_achievement", "Store Target Achievement", "a", pct("v"), "Percent", "'Latest finance month: ' || m",
        "Weighted target achievement across all stores in the latest available finance month.", TARGET_ONE),
    kpi("average_order_value", "Average Order Value", "s / n", inr("v"), "INR", ALL, "Average sales value per transaction.", SALES_ONE),
    kpi("total_operating_profit", "Total Operating Profit", "p", inr("v"), "INR", ALL, "Total operating profit after operating expenses.", FINANCE_ONE),
    kpi("low_stock_count", "Low-Stock Count", "c", COUNT, "Records", "'Latest inventory snapshot'",
        "Number of inventory records marked as Low Stock.", "SELECT count(*) AS c FROM inventory WHERE stock_status = 'Low Stock'"),
    kpi("overstock_count", "Overstock Count", "c", COUNT, "Records", "'Latest inventory snapshot'",
        "Number of inventory records marked as Overstock.", "SELECT count(*) AS c FROM inventory WHERE stock_status = 'Overstock'"),
    kpi("high_severity_complaint_count", "High-Severity Complaint Count", "c", COUNT, "Complaints", ALL,
        "Total complaints classified as High severity.", "SELECT count(*) AS c FROM complaints WHERE severity = 'High'"),
    kpi("open_complaint_count", "Open Complaint Count", "c", COUNT, "Complaints", ALL,
        "Complaints that remain Open or In Progress.", "SELECT count(*) AS c FROM complaints WHERE status IN ('Open', 'In Progress')"),
    kpi("vendor_delay_count", "Vendor Delay Count", "c", COUNT, "Deliveries", ALL,
        "Number of vendor deliveries received after the scheduled delivery date.", "SELECT count(*) AS c FROM vendor_deliveries WHERE delay_days > 0"),
    kpi("vendor_on_time_delivery_rate", "Vendor On-Time Delivery Rate", "c", pct("v"), "Percent", ALL,
        "Percentage of deliveries received on or before the scheduled delivery date.", f"SELECT {ON_TIME} AS c FROM vendor_deliveries"),
])
COUNTED = {"vendors": 4, "employees": 6, "stores": 7, "products": 10, "sales": 16, "inventory": 13,
           "complaints": 15, "finance": 13, "vendor_deliveries": 17}
OVERVIEW = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({n} AS BIGINT) AS column_count FROM {t}" for t, n in COUNTED.items())
INVENTORY_ROW = "inventory_id, store_id, store_name, product_id, product_name, current_stock, reorder_level, stock_status"

ORACLE: dict[str, str] = {
    "sales_summary": with_views(["sales"], "SELECT CAST(sum(total_sales) AS DOUBLE) AS total_sales, count(*) AS transaction_count, CAST(sum(quantity_sold) AS BIGINT) AS total_quantity_sold, CAST(sum(total_sales) AS DOUBLE) / count(*) AS average_order_value FROM sales"),
    "finance_summary": with_views(["finance"], "SELECT CAST(sum(total_revenue) AS DOUBLE) AS total_revenue, CAST(sum(operating_profit) AS DOUBLE) AS total_operating_profit FROM finance"),
    "latest_sales_growth": with_views(["sales"], GROWTH),
    "latest_target_achievement": with_views(["finance"], f"SELECT store_id, store_name, month, monthly_sales_target, total_revenue, operating_profit, target_achievement_percent, risk_status FROM ({LATEST_FINANCE})"),
    "inventory_counts": with_views(["inventory"], "SELECT count(*) FILTER (stock_status = 'Low Stock') AS low_stock_count, count(*) FILTER (stock_status = 'Overstock') AS overstock_count FROM inventory"),
    "complaint_counts": with_views(["complaints"], "SELECT count(*) FILTER (severity = 'High') AS high_severity_complaint_count, count(*) FILTER (status IN ('Open', 'In Progress')) AS open_complaint_count FROM complaints"),
    "delivery_counts": with_views(["vendor_deliveries"], f"SELECT count(*) FILTER (delay_days > 0) AS delayed_delivery_count, {ON_TIME} AS on_time_delivery_rate FROM vendor_deliveries"),
    "kpi_table": with_views(["finance", "inventory", "complaints", "vendor_deliveries"], KPI_TABLE),
    "monthly_sales_trend": with_views(["sales"], f"SELECT strftime(date, '%Y-%m') AS month, {TOTALS} FROM sales GROUP BY 1"),
    "store_performance": with_views(["sales"], f"SELECT store_id, store_name, {TOTALS} FROM sales GROUP BY 1, 2"),
    "region_performance": with_views(["sales"], f"SELECT region, {TOTALS} FROM sales GROUP BY 1"),
    "top_products_by_sales": with_views(["sales"], f"SELECT product_id, product_name, {SUMS}, CAST(sum(quantity_sold) AS BIGINT) AS quantity_sold FROM sales GROUP BY 1, 2 ORDER BY total_sales DESC, product_id LIMIT 10"),
    "reorder_list": with_views(["inventory", "products"], "SELECT i.inventory_id, i.store_id, i.store_name, product_id, i.product_name, current_stock, i.reorder_level, stock_status, reorder_required, is_perishable, expiry_date, CAST(date_diff('day', date, expiry_date) AS INTEGER) AS days_to_expiry FROM inventory i JOIN products USING (product_id) WHERE stock_status IN ('Low Stock', 'Reorder Soon')"),
    "stock_status_summary": with_views(["inventory"], "SELECT stock_status, count(*) AS inventory_records, CAST(sum(current_stock) AS BIGINT) AS total_current_stock FROM inventory GROUP BY 1"),
    "complaints_by_store": with_views(["complaints"], f"SELECT store_id, store_name, {CASES} FROM complaints GROUP BY 1, 2"),
    "top_products_by_complaints": with_views(["complaints"], f"SELECT product_id, product_name, {CASES} FROM complaints GROUP BY 1, 2 ORDER BY complaint_count DESC, product_id LIMIT 10"),
    "complaints_by_severity": with_views(["complaints"], "SELECT severity, count(*) AS complaint_count FROM complaints GROUP BY 1"),
    "delivery_performance": with_views(["vendor_deliveries"], f"SELECT vendor_id, vendor_name, count(*) AS delivery_count, {r2('avg(delay_days)')} AS average_delay_days, max(delay_days) AS maximum_delay_days, {r2('CAST(sum(quality_rating) AS DOUBLE) / count(*)')} AS average_quality_rating, {money('purchase_value')} AS total_purchase_value FROM vendor_deliveries GROUP BY 1, 2"),
    "high_risk_finance": with_views(["finance"], "SELECT finance_id, month, store_id, store_name, monthly_sales_target, total_revenue, operating_profit, target_achievement_percent, risk_status FROM finance WHERE risk_status = 'High Risk'"),
    "store_finance_summary": with_views(["finance"], f"SELECT store_id, store_name, {money('total_revenue')} AS total_revenue, {money('operating_profit')} AS total_operating_profit, {r2('CAST(sum(target_achievement_percent) AS DOUBLE) / count(*)')} AS average_target_achievement FROM finance GROUP BY 1, 2"),
    "store_monthly_view": with_views(["finance", "complaints", "inventory"], f"SELECT month, store_id, store_name, total_revenue, operating_profit, target_achievement_percent, risk_status, complaint_count, low_stock_items, reorder_soon_items FROM finance LEFT JOIN (SELECT store_id, count(*) AS complaint_count FROM complaints GROUP BY 1) USING (store_id) LEFT JOIN (SELECT store_id, {COUNT_STATUS} FROM inventory GROUP BY 1) USING (store_id) WHERE store_id = 'S003'"),
    "low_stock_complaints": with_views(["inventory", "complaints"], f"SELECT store_id, store_name, product_id, product_name, current_stock, reorder_level, stock_status, coalesce(related_complaints, 0) AS related_complaints, coalesce(high_severity_complaints, 0) AS related_high_severity_complaints FROM inventory LEFT JOIN ({COUNTS}) USING (store_id, product_id) WHERE stock_status = 'Low Stock'"),
    "overstock_list": with_views(["inventory"], f"SELECT {INVENTORY_ROW} FROM inventory WHERE stock_status = 'Overstock'"),
    "store_health": with_views(["finance", "complaints", "inventory"], f"SELECT store_id, store_name, total_sales, total_profit, complaint_count, high_severity_complaints, low_stock_items, reorder_soon_items, overstock_items, latest_finance_month, target_achievement_percent, operating_profit, risk_status FROM (SELECT store_id, store_name FROM stores) LEFT JOIN (SELECT store_id, {SUMS} FROM sales GROUP BY 1) USING (store_id) LEFT JOIN (SELECT store_id, {CASES} FROM complaints GROUP BY 1) USING (store_id) LEFT JOIN (SELECT store_id, {COUNT_STATUS}, count(*) FILTER (stock_status = 'Overstock') AS overstock_items FROM inventory GROUP BY 1) USING (store_id) LEFT JOIN (SELECT store_id, month AS latest_finance_month, target_achievement_percent, operating_profit, risk_status FROM ({LATEST_FINANCE})) USING (store_id)"),
    "sales_decline_history": with_views(["sales"], f"SELECT store_id, store_name, month, CAST(round(p, 2) AS DOUBLE) AS previous_month_sales, CAST(round(s, 2) AS DOUBLE) AS current_month_sales, {r2('(CAST(p AS DOUBLE) - CAST(s AS DOUBLE)) / CAST(p AS DOUBLE) * 100')} AS sales_decline_percent FROM (SELECT *, lag(s) OVER (PARTITION BY store_id ORDER BY month) AS p FROM (SELECT store_id, store_name, strftime(date, '%Y-%m') AS month, sum(total_sales) AS s FROM sales GROUP BY 1, 2, 3)) WHERE p IS NOT NULL AND s < p * 0.80"),
    "expiring_soon": with_views(["inventory", "products"], "SELECT i.inventory_id, date AS inventory_date, i.store_id, i.store_name, product_id, i.product_name, current_stock, expiry_date, CAST(date_diff('day', date, expiry_date) AS INTEGER) AS days_to_expiry FROM inventory i JOIN products USING (product_id) WHERE is_perishable = 'Yes' AND expiry_date IS NOT NULL AND date_diff('day', date, expiry_date) BETWEEN 0 AND 30"),
    "open_high_complaints": with_views(["complaints"], "SELECT complaint_id, date, store_id, store_name, product_id, product_name, complaint_type, complaint_description, severity, status, assigned_employee_id, resolution_time_days FROM complaints WHERE severity = 'High' AND status IN ('Open', 'In Progress')"),
    "store_targets": with_views(["finance"], f"SELECT store_id, store_name, month, monthly_sales_target, total_revenue, target_achievement_percent, operating_profit, risk_status FROM ({LATEST_FINANCE})"),
    "basic_sales_kpis": with_views(["sales"], f"SELECT {TOTALS}, CAST(sum(quantity_sold) AS BIGINT) AS total_quantity, {r2('CAST(sum(total_sales) AS DOUBLE) / count(*)')} AS average_order_value, {r2('CAST(sum(discount_percent) AS DOUBLE) / count(*)')} AS average_discount_percent FROM sales"),
    "dataset_overview": with_views(list(COUNTED), OVERVIEW),
    "row_counts": with_views(list(COUNTED), f"SELECT table_name, row_count FROM ({OVERVIEW})"),
    "stock_attention": with_views(["inventory"], f"SELECT {INVENTORY_ROW}, reorder_required, expiry_date FROM inventory WHERE stock_status <> 'Normal'"),
}
