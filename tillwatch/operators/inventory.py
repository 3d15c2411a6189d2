"""Inventory rules over one snapshot: each row is scanned once and yields all rules that fire."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import clean_text, fixed, say, severity_rank
from tillwatch.operators import findings as fd
from tillwatch.operators.templates import aggregates, order_by
from tillwatch.thresholds import DEFAULTS, Thresholds

COUNTS = {
    "related_complaints": "count(*)",
    "high_severity_complaints": "count_if(severity = 'High')",
    "unresolved_complaints": "count_if(status IN ('Open', 'In Progress'))",
    "out_of_stock_complaints": "count_if(complaint_type = 'Out of Stock')",
}


def complaint_totals(complaints: DataFrame) -> DataFrame:
    """Complaint counts per store and product, aggregated before any join."""
    return complaints.groupBy("store_id", "product_id").agg(*aggregates(COUNTS))


def snapshot(inventory: DataFrame, products: DataFrame, vendors: DataFrame,
             complaints: DataFrame) -> DataFrame:
    joined = (
        inventory.join(products.select("product_id", "is_perishable"), "product_id")
        .join(vendors.select("vendor_id", "vendor_name"), "vendor_id", "left")
        .join(complaint_totals(complaints), ["store_id", "product_id"], "left")
    )
    kept = [c for c in joined.columns if c not in COUNTS]
    return joined.selectExpr(
        *kept, *[f"coalesce({c}, 0) AS {c}" for c in COUNTS],
        "datediff(expiry_date, date) AS days_to_expiry",
        "try_divide(CAST(current_stock AS DOUBLE), CAST(reorder_level AS DOUBLE)) AS stock_ratio",
    )


def _rules(t: Thresholds) -> dict[str, str]:
    shown = "coalesce(stock_ratio, 0D)"
    perishable = "lower(trim(is_perishable)) = 'yes' AND expiry_date IS NOT NULL AND current_stock > 0"
    crowded = f"related_complaints >= {t.inventory_complaints}"
    texts = dict(
        stock=fixed("current_stock", 0), reorder=fixed("reorder_level", 0), ratio=fixed(f"{shown} * 100"),
        required=clean_text("reorder_required"), vendor=clean_text("vendor_name"),
        status=clean_text("stock_status"), expired="-days_to_expiry",
    )
    level = "Current Stock: {stock}; Reorder Level: {reorder}; Stock Ratio: {ratio}%; "
    dates = "Inventory Date: {date}; Expiry Date: {expiry_date}; "
    return {
        "Low Stock": fd.rule(
            "stock_status = 'Low Stock'", "Low Stock",
            f"CASE WHEN {shown} <= {t.severe_stock_ratio} THEN 'High' ELSE 'Medium' END",
            say("{product_name} is marked as Low Stock at {store_name}."),
            say(level + "Reorder Required: {required}; Related Complaints: {related_complaints}", **texts)),
        "Reorder Soon": fd.rule(
            "stock_status = 'Reorder Soon'", "Reorder Soon", "'Low'",
            say("{product_name} is approaching its reorder level at {store_name}."),
            say(level + "Vendor: {vendor}", **texts)),
        "Overstock": fd.rule(
            "stock_status = 'Overstock'", "Overstock",
            f"CASE WHEN {shown} >= {t.severe_overstock_ratio} THEN 'Medium' ELSE 'Low' END",
            say("{product_name} has excess stock at {store_name}."),
            say(level + "Stock Status: {status}", **texts)),
        "Stockout Risk": fd.rule(
            f"stock_status = 'Low Stock' AND (stock_ratio <= {t.stockout_ratio} OR {crowded})", "Stockout Risk",
            f"CASE WHEN {shown} <= {t.severe_stock_ratio} OR ({crowded} AND high_severity_complaints "
            f">= {t.inventory_high_complaints}) THEN 'High' ELSE 'Medium' END",
            say("{product_name} has a stockout risk at {store_name} because stock is critically low and "
                "may affect customer availability."),
            say(level + "Related Complaints: {related_complaints}; High-Severity Complaints: "
                "{high_severity_complaints}; Vendor: {vendor}", **texts)),
        "Near Expiry Stock": fd.rule(
            f"{perishable} AND days_to_expiry BETWEEN 0 AND {t.near_expiry_days}", "Near Expiry Stock",
            f"CASE WHEN days_to_expiry <= {t.urgent_expiry_days} THEN 'High' ELSE 'Medium' END",
            say("{product_name} has stock nearing expiry at {store_name}."),
            say(dates + "Days to Expiry: {days_to_expiry}; Current Stock: {stock}; Perishable: Yes", **texts)),
        "Expired Inventory": fd.rule(
            f"{perishable} AND days_to_expiry < 0", "Expired Inventory", "'High'",
            say("{product_name} has expired inventory at {store_name}."),
            say(dates + "Days Expired: {expired}; Current Stock: {stock}; Perishable: Yes", **texts)),
    }


RULES = ("Low Stock", "Reorder Soon", "Overstock", "Stockout Risk", "Near Expiry Stock", "Expired Inventory")


def inventory_findings(snap: DataFrame, t: Thresholds = DEFAULTS, detected_at: str | None = None,
                       only: tuple[str, ...] = RULES) -> DataFrame:
    """Findings of the chosen rules from one pass over the snapshot (unordered)."""
    rules = _rules(t)
    return fd.record(
        fd.apply_rules(snap, *[rules[name] for name in only]), fd.INVENTORY, detected_at,
        finding_id=say("{kind}-{store_id}-{product_id}-{date}", kind="replace(upper(analysis_type), ' ', '-')"),
        business_area="'Operations'", entity_type="'Store Product'",
        entity_id=say("{store_id}-{product_id}"), inventory_date="date",
        stock_ratio="coalesce(stock_ratio, 0D)", current_stock="coalesce(current_stock, 0)",
        reorder_level="coalesce(reorder_level, 0)",
        **fd.columns("analysis_type", "severity", "store_id", "store_name", "product_id", "product_name",
                     "vendor_id", "vendor_name", "expiry_date", "days_to_expiry", "stock_status",
                     "reorder_required", "related_complaints", "high_severity_complaints", "summary",
                     "evidence"),
    )


def order_findings(findings: DataFrame) -> DataFrame:
    return order_by(findings, severity_rank(), "analysis_type", "stock_ratio", "days_to_expiry", "finding_id")
