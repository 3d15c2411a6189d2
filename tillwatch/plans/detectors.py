"""Registered detector queries over the given tables."""

from __future__ import annotations

from dataclasses import replace

from tillwatch.operators import combined, complaints, inventory, sales, vendor_finance
from tillwatch.operators.templates import latest_finance
from tillwatch.plans.catalog import query
from tillwatch.sources.business import Business
from tillwatch.thresholds import DEFAULTS

DETECTED_AT = "2001-08-01 06:00:00"
AT = {"detected_at": DETECTED_AT}
STORE_SALES = ("store_id", "store_name", "region", "date", "total_sales")
PRODUCT_SALES = ("product_id", "product_name", "category", "date", "total_sales")
RULE_SALES = ("store_id", "store_name", "region", "product_id", "product_name", "category", "date", "total_sales")


def loaded(b: Business, name: str):
    """A business table written once, for queries in which several rules read it."""
    from tillwatch.plans.stages import Stages

    return Stages(b).table(name)


@query()
def store_sales_decline(b: Business):
    return sales.store_sales_decline(b.sales(*STORE_SALES), **AT)


@query()
def product_sales_decline(b: Business):
    return sales.product_sales_decline(b.sales(*PRODUCT_SALES), **AT)


@query()
def category_sales_decline(b: Business):
    return sales.category_sales_decline(b.sales("category", "date", "total_sales"), **AT)


@query()
def regional_sales_decline(b: Business):
    return sales.regional_sales_decline(b.sales("region", "date", "total_sales"), **AT)


@query()
def low_target_achievement(b: Business):
    return sales.low_target_achievement(b.finance(), b.stores(), **AT)


@query()
def product_underperformance(b: Business):
    """Only the last month counts, so only its orders are joined."""
    return sales.product_underperformance(b.sales(*PRODUCT_SALES, last_month=True), **AT)


@query()
def sales_findings(b: Business):
    return sales.order_findings(
        sales.sales_findings(loaded(b, "sales"), loaded(b, "finance"), b.stores(), summed=True, **AT))


def inventory_snapshot_of(b: Business):
    counts = b.complaints("store_id", "product_id", "severity", "status", "complaint_type")
    return inventory.snapshot(b.inventory(), b.products(), b.vendors(), counts)


@query()
def inventory_snapshot(b: Business):
    return inventory_snapshot_of(b).select(
        "inventory_id", "date", "store_id", "store_name", "product_id", "product_name", "vendor_id",
        "vendor_name", "current_stock", "reorder_level", "stock_status", "reorder_required",
        "is_perishable", "expiry_date", "days_to_expiry", "related_complaints",
        "high_severity_complaints", "stock_ratio")


for _name, _rule in (
    ("low_stock", "Low Stock"), ("reorder_soon", "Reorder Soon"), ("overstock", "Overstock"),
    ("stockout_risk", "Stockout Risk"), ("near_expiry", "Near Expiry Stock"),
    ("expired_inventory", "Expired Inventory"),
):
    query(_name)(lambda b, rule=_rule: inventory.inventory_findings(
        inventory_snapshot_of(b), only=(rule,), **AT))


@query()
def inventory_findings(b: Business):
    return inventory.order_findings(inventory.inventory_findings(inventory_snapshot_of(b), **AT))


@query("latest_finance")
def latest_finance_query(b: Business):
    return latest_finance(b.finance())


def vendor_snapshot_of(b: Business):
    return vendor_finance.vendor_snapshot(b.deliveries(
        "vendor_id", "vendor_name", "delay_days", "received_quantity", "ordered_quantity", "quality_rating"))


@query()
def vendor_snapshot(b: Business):
    return vendor_snapshot_of(b)


for _name, _rule in (
    ("repeated_vendor_delays", "Repeated Vendor Delays"),
    ("partial_deliveries", "Partial Vendor Deliveries"),
    ("low_vendor_quality", "Low Vendor Quality Rating"),
    ("low_on_time_rate", "Low On-Time Delivery Rate"),
):
    query(_name)(lambda b, rule=_rule: vendor_finance.vendor_findings(
        vendor_snapshot_of(b), only=(rule,), **AT))


@query()
def operating_margin(b: Business):
    return vendor_finance.finance_snapshot(b.finance()).select(
        "store_id", "month", "total_revenue", "operating_profit", "operating_profit_margin_percent")


for _name, _rule in (
    ("low_operating_profit", "Low Operating Profit"), ("loss_making_stores", "Loss-Making Store"),
    ("low_target_finance", "Low Target Achievement"), ("high_financial_risk", "High Financial Risk"),
):
    query(_name)(lambda b, rule=_rule: vendor_finance.finance_findings(
        vendor_finance.finance_snapshot(b.finance()), only=(rule,), **AT))


@query()
def vendor_findings(b: Business):
    return vendor_finance.order_findings(vendor_finance.vendor_findings(vendor_snapshot_of(b), **AT))


@query()
def finance_findings(b: Business):
    return vendor_finance.order_findings(
        vendor_finance.finance_findings(vendor_finance.finance_snapshot(b.finance()), **AT))


@query()
def vendor_finance_findings(b: Business):
    return vendor_finance.order_findings(
        vendor_finance.vendor_finance_findings(b.deliveries(
            "vendor_id", "vendor_name", "delay_days", "received_quantity", "ordered_quantity",
            "quality_rating"), b.finance(), **AT))


@query()
def high_complaint_products(b: Business):
    return complaints.high_complaint_products(
        b.complaints("product_id", "product_name", "severity", "status"), **AT)


@query()
def high_complaint_stores(b: Business):
    return complaints.high_complaint_stores(
        b.complaints("store_id", "store_name", "region", "severity", "status"),
        replace(DEFAULTS, complaint_outlier_multiplier=1.1), **AT)


@query()
def repeated_complaint_category(b: Business):
    return complaints.repeated_complaint_categories(
        b.complaints("complaint_type", "severity", "status"),
        replace(DEFAULTS, complaint_category_multiplier=1.01), **AT)


@query()
def open_high_severity_complaints(b: Business):
    return complaints.open_high_severity_complaints(b.complaints(), **AT)


@query()
def monthly_complaint_growth(b: Business):
    return complaints.monthly_complaint_growth(
        b.complaints("store_id", "store_name", "region", "date", "severity", "status"), **AT)


@query()
def complaint_growth_last_full_month(b: Business):
    """The same rule as of the last month that is complete."""
    return complaints.monthly_complaint_growth(
        b.complaints("store_id", "store_name", "region", "date", "severity", "status"), as_of_month="2001-07", **AT)


@query()
def unresolved_complaint_ageing(b: Business):
    return complaints.unresolved_complaint_ageing(b.complaints(), **AT)


@query()
def complaint_findings(b: Business):
    return complaints.order_findings(complaints.complaint_findings(loaded(b, "complaints"), **AT))


@query()
def combined_financial_risk(b: Business):
    return combined.financial_risk(b.finance(), **AT)


@query()
def combined_sales_decline(b: Business):
    return combined.sales_decline(b.sales("store_id", "store_name", "date", "total_sales"), **AT)


@query()
def combined_critical_inventory(b: Business):
    return combined.critical_inventory(inventory_snapshot_of(b), **AT)


@query()
def combined_complaint_hotspots(b: Business):
    return combined.complaint_hotspots(
        b.complaints("store_id", "store_name", "severity", "status"),
        replace(DEFAULTS, complaint_outlier_multiplier=1.1), **AT)


@query()
def combined_vendor_risk(b: Business):
    return combined.vendor_risk(b.deliveries(
        "vendor_id", "vendor_name", "delay_days", "received_quantity", "ordered_quantity",
        "quality_rating"), **AT)


def _combined(b: Business):
    return combined.combined_issues(
        loaded(b, "finance"), loaded(b, "sales"), loaded(b, "inventory_snapshot"), loaded(b, "complaints"),
        b.deliveries("vendor_id", "vendor_name", "delay_days", "received_quantity",
                     "ordered_quantity", "quality_rating"), **AT)


@query()
def combined_issues(b: Business):
    return combined.order_issues(_combined(b))


@query()
def combined_priority_summary(b: Business):
    return combined.priority_summary(_combined(b))
