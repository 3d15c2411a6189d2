"""Registered KPI and report queries."""

from __future__ import annotations

from tillwatch.operators import kpi, reports
from tillwatch.plans.catalog import query
from tillwatch.plans.detectors import DETECTED_AT
from tillwatch.sources.business import Business

MONEY = ("total_sales", "profit")
CASE = ("severity", "status")
DELIVERY = ("vendor_id", "vendor_name", "delay_days", "received_quantity", "ordered_quantity", "quality_rating")


@query()
def sales_summary(b: Business):
    return kpi.sales_summary(b.sales("total_sales", "quantity_sold"))


@query()
def finance_summary(b: Business):
    return kpi.finance_summary(b.finance())


@query()
def latest_sales_growth(b: Business):
    return kpi.latest_sales_growth(b.sales("date", "total_sales"))


@query()
def latest_target_achievement(b: Business):
    return kpi.latest_target_achievement(b.finance())


@query()
def inventory_counts(b: Business):
    return kpi.inventory_counts(b.inventory())


@query()
def complaint_counts(b: Business):
    return kpi.complaint_counts(b.complaints(*CASE))


@query()
def delivery_counts(b: Business):
    return kpi.delivery_counts(b.deliveries("delay_days"))


@query()
def kpi_table(b: Business):
    return kpi.kpi_table(
        b.sales("date", "total_sales", "quantity_sold"), b.finance(), b.inventory(),
        b.complaints(*CASE), b.deliveries("delay_days"),
        calculated_at=DETECTED_AT)


@query()
def monthly_sales_trend(b: Business):
    return reports.monthly_sales_trend(b.sales("date", *MONEY))


@query()
def store_performance(b: Business):
    return reports.store_performance(b.sales("store_id", "store_name", *MONEY))


@query()
def region_performance(b: Business):
    return reports.region_performance(b.sales("region", *MONEY))


@query()
def top_products_by_sales(b: Business):
    return reports.top_products_by_sales(b.sales("product_id", "product_name", "quantity_sold", *MONEY))


@query()
def reorder_list(b: Business):
    return reports.reorder_list(b.inventory(), b.products())


@query()
def stock_status_summary(b: Business):
    return reports.stock_status_summary(b.inventory())


@query()
def complaints_by_store(b: Business):
    return reports.complaints_by_store(b.complaints("store_id", "store_name", "severity"))


@query()
def top_products_by_complaints(b: Business):
    return reports.top_products_by_complaints(b.complaints("product_id", "product_name", "severity"))


@query()
def complaints_by_severity(b: Business):
    return reports.complaints_by_severity(b.complaints("severity"))


@query()
def delivery_performance(b: Business):
    return reports.delivery_performance(b.deliveries(
        "vendor_id", "vendor_name", "delay_days", "quality_rating", "purchase_value"))


@query()
def high_risk_finance(b: Business):
    return reports.high_risk_finance(b.finance())


@query()
def store_finance_summary(b: Business):
    return reports.store_finance_summary(b.finance())


@query()
def store_monthly_view(b: Business):
    return reports.store_monthly_view(
        b.finance(), b.complaints("store_id", "store_name"), b.inventory(), "S003")


@query()
def low_stock_complaints(b: Business):
    return reports.low_stock_complaints(
        b.inventory(), b.complaints("store_id", "product_id", "severity", "status", "complaint_type"))


@query()
def overstock_list(b: Business):
    return reports.overstock_list(b.inventory())


@query()
def store_health(b: Business):
    return reports.store_health(
        b.stores(), b.sales("store_id", *MONEY), b.complaints("store_id", "severity"), b.inventory(), b.finance())


@query()
def sales_decline_history(b: Business):
    return reports.sales_decline_history(b.sales("store_id", "store_name", "date", "total_sales"))


@query()
def expiring_soon(b: Business):
    return reports.expiring_soon(b.inventory(), b.products())


@query()
def open_high_complaints(b: Business):
    return reports.open_high_complaints(b.complaints())


@query()
def store_targets(b: Business):
    return reports.store_targets(b.finance())


@query()
def basic_sales_kpis(b: Business):
    return reports.basic_sales_kpis(b.sales("quantity_sold", "discount_percent", *MONEY))


def all_tables(b: Business):
    return {
        "vendors": b.vendors(), "employees": b.employees(), "stores": b.stores().drop("store_number"),
        "products": b.products().drop("product_number"), "sales": b.sales(), "inventory": b.inventory(),
        "complaints": b.complaints(), "finance": b.finance(), "vendor_deliveries": b.deliveries(),
    }


@query()
def dataset_overview(b: Business):
    return reports.dataset_overview(all_tables(b))


@query()
def row_counts(b: Business):
    return reports.row_counts(all_tables(b))


@query()
def stock_attention(b: Business):
    return reports.stock_attention(b.inventory())
