"""First-generation combined issue detector: five rules with continuous scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import clean_text, fixed, grouped, level, round2, say, zero
from tillwatch.operators.findings import stamp
from tillwatch.operators.templates import (
    COMPLAINT_COUNTS, aggregates, at_least_average, average_of, decline_percent, exact,
    latest_finance, month_over_month, monthly_totals, order_by, ratio_to_average, with_averages,
)
from tillwatch.operators.vendor_finance import vendor_snapshot
from tillwatch.thresholds import DEFAULTS, Thresholds

SCORE_COLUMNS = (
    "impact_score", "urgency_score", "financial_risk_score", "customer_impact_score",
    "operational_risk_score", "confidence_score",
)


def _issue(rows: DataFrame, score: str, t: Thresholds, detected_at: str | None, *, issue_id: str,
           issue_type: str, business_area: str, entity_type: str, entity_id: str, title: str,
           description: str, evidence: str) -> DataFrame:
    return rows.selectExpr("*", f"{score} AS score").selectExpr(
        f"{issue_id} AS issue_id", f"'{issue_type}' AS issue_type", f"'{business_area}' AS business_area",
        f"{level('score', t)} AS priority", f"{round2('score')} AS priority_score",
        f"'{entity_type}' AS entity_type", f"{entity_id} AS entity_id", f"{title} AS issue_title",
        f"{description} AS issue_description", f"{evidence} AS evidence", "'New' AS status",
        "'Rule-Based Analytics Engine' AS detection_source", f"{stamp(detected_at)} AS detected_at",
    )


def financial_risk(finance: DataFrame, t: Thresholds = DEFAULTS, detected_at: str | None = None) -> DataFrame:
    low = f"target_achievement_percent < {exact(t.low_target_percent)}"
    rows = latest_finance(finance).where(f"risk_status = 'High Risk' OR {low} OR operating_profit < 0")
    target, profit = zero("target_achievement_percent"), zero("operating_profit")
    return _issue(
        rows, f"least(82D + CASE WHEN {target} < {t.low_target_percent} THEN 8D ELSE 0D END "
              f"+ CASE WHEN {profit} < 0 THEN 10D ELSE 0D END, 100D)", t, detected_at,
        issue_id=say("FIN-{store_id}-{month}"), issue_type="Financial Risk", business_area="Finance",
        entity_type="Store", entity_id="store_id", title=say("High financial risk at {store_name}"),
        description=say("{store_name} has a high financial risk in {month}. The store achieved only {pct}% "
                        "of its monthly sales target.", pct=fixed(target)),
        evidence=say("Revenue: {revenue}; Operating Profit: {profit}; Target Achievement: {pct}%; Risk Status: {risk_status}",
                     revenue=grouped(zero("total_revenue")), profit=grouped(profit), pct=fixed(target)),
    )


def sales_decline(sales: DataFrame, t: Thresholds = DEFAULTS, as_of_month: str | None = None,
                  detected_at: str | None = None) -> DataFrame:
    monthly = monthly_totals(sales, ["store_id", "store_name"], {"sales": "sum(total_sales)"}, (), as_of_month)
    rows = month_over_month(monthly, ["store_id"], ["sales"]).where(
        "sales * 100 < previous_sales * 70"
    ).selectExpr("*", f"{decline_percent('sales', 'previous_sales')} AS decline")
    texts = dict(pct=fixed("decline"), now=grouped("sales"), before=grouped("previous_sales"))
    return _issue(
        rows, "least(70D + decline * 0.70D, 95D)", t, detected_at, issue_id=say("SALES-{store_id}-{month}"),
        issue_type="Sales Decline", business_area="Sales", entity_type="Store", entity_id="store_id",
        title=say("Major sales decline at {store_name}"),
        description=say("{store_name} recorded a {pct}% sales decline in {month} compared with the previous month.", **texts),
        evidence=say("Current Month Sales: {now}; Previous Month Sales: {before}; Sales Decline: {pct}%", **texts),
    )


def critical_inventory(snapshot: DataFrame, t: Thresholds = DEFAULTS,
                       detected_at: str | None = None) -> DataFrame:
    rows = snapshot.selectExpr("*", "coalesce(stock_ratio, 1D) AS ratio").where(
        f"stock_status = 'Low Stock' AND (ratio <= {t.stockout_ratio} OR (related_complaints >= "
        f"{t.inventory_complaints} AND high_severity_complaints >= {t.inventory_high_complaints}))")
    score = ("least(45D + greatest(0D, (0.80D - ratio) * 20) + least(related_complaints * 0.20D, 12D) "
             "+ least(high_severity_complaints * 0.75D, 12D) "
             f"+ CASE WHEN ratio <= {t.severe_stock_ratio} THEN 7D ELSE 0D END, 90D)")
    return _issue(
        rows, score, t, detected_at, issue_id=say("INV-{store_id}-{product_id}-{date}"),
        issue_type="Inventory Stock Risk", business_area="Operations", entity_type="Store Product",
        entity_id=say("{store_id}-{product_id}"),
        title=say("Low-stock risk: {product_name} at {store_name}"),
        description=say("{product_name} has a low-stock operational risk at {store_name}. The issue may affect "
                        "customer service because the product is linked with customer complaints."),
        evidence=say("Current Stock: {stock}; Reorder Level: {reorder}; Stock Ratio: {pct}%; Related Complaints: "
                     "{related_complaints}; High-Severity Complaints: {high_severity_complaints}",
                     stock=fixed("current_stock", 0), reorder=fixed("reorder_level", 0), pct=fixed("ratio * 100")),
    )


def complaint_hotspots(complaints: DataFrame, t: Thresholds = DEFAULTS,
                       detected_at: str | None = None, company: str = "") -> DataFrame:
    """`company` is the name shown in the description, in front of 'store'."""
    measures = ["total_complaints", "high_severity_complaints", "unresolved_complaints"]
    summary = complaints.groupBy("store_id", "store_name").agg(*aggregates(COMPLAINT_COUNTS))
    rows = with_averages(summary, measures).where(
        " OR ".join(at_least_average(m, t.complaint_outlier_multiplier) for m in measures))
    parts = [f"least(greatest({ratio_to_average(m)} - 1, 0D) * {weight}, {cap}D)"
             for m, weight, cap in zip(measures, (20, 15, 10), (15, 10, 5))]
    return _issue(
        rows, f"least(65D + {' + '.join(parts)}, 95D)", t, detected_at, issue_id=say("COMP-{store_id}"),
        issue_type="Customer Complaint Hotspot", business_area="Customer Support", entity_type="Store",
        entity_id="store_id", title=say("Customer complaint hotspot at {store_name}"),
        description=say("{store_name} has a significantly higher complaint burden than the average "
                        f"{company + ' ' if company else ''}store."),
        evidence=say("Total Complaints: {total_complaints}; High-Severity Complaints: {high_severity_complaints}; "
                     "Open or In-Progress Complaints: {unresolved_complaints}; Average Store Complaints: {average}",
                     average=fixed(average_of("total_complaints"))),
    )


def vendor_risk(deliveries: DataFrame, t: Thresholds = DEFAULTS, detected_at: str | None = None) -> DataFrame:
    delay, longest, quality = zero("average_delay_days"), zero("maximum_delay_days"), zero("average_quality_rating")
    rows = vendor_snapshot(deliveries).where(
        f"average_delay_days >= {t.vendor_average_delay} OR delayed_deliveries >= {t.vendor_delayed_deliveries} "
        f"OR average_quality_rating < {t.vendor_low_quality}")
    score = (f"least(55D + least({delay} * 4, 20D) + least({longest} * 1.5D, 15D) + least(delayed_deliveries * 2D, 10D) "
             f"+ CASE WHEN {quality} < {t.vendor_low_quality} THEN 8D ELSE 0D END, 100D)")
    return _issue(
        rows, score, t, detected_at, issue_id=say("VENDOR-{vendor_id}"), issue_type="Vendor Performance Risk",
        business_area="Procurement", entity_type="Vendor", entity_id="vendor_id",
        title=say("Vendor delivery risk: {vendor_name}"),
        description=say("{vendor_name} shows delivery-performance risk due to recurring delays and/or "
                        "below-expected quality ratings."),
        evidence=say("Delivery Count: {delivery_count}; Average Delay: {delay} days; Maximum Delay: {longest} days; "
                     "Delayed Deliveries: {delayed_deliveries}; Average Quality Rating: {quality}",
                     delay=fixed(delay), longest=fixed(longest, 0), quality=fixed(quality)),
    )


def combined_issues(finance: DataFrame, sales: DataFrame, snapshot: DataFrame, complaints: DataFrame,
                    deliveries: DataFrame, t: Thresholds = DEFAULTS,
                    detected_at: str | None = None) -> DataFrame:
    return (
        financial_risk(finance, t, detected_at)
        .unionByName(sales_decline(sales, t, None, detected_at))
        .unionByName(critical_inventory(snapshot, t, detected_at))
        .unionByName(complaint_hotspots(complaints, t, detected_at))
        .unionByName(vendor_risk(deliveries, t, detected_at))
    )


def order_issues(issues: DataFrame) -> DataFrame:
    rank = "CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
    return order_by(issues, rank, "priority_score DESC", "issue_id")


def priority_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("priority").agg(*aggregates({"issue_count": "count(*)"}))


def issue_record(issues: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Extended record: sub-scores stay NULL unless the input has them; texts are normalised."""
    scores = [f"CAST({c if c in issues.columns else 'NULL'} AS DOUBLE) AS {c}" for c in SCORE_COLUMNS]
    return issues.selectExpr(
        *[f"{clean_text(source)} AS {name}" for name, source in (
            ("issue_id", "issue_id"), ("issue_type", "issue_type"), ("department", "business_area"),
            ("title", "issue_title"), ("description", "issue_description"))],
        f"{level('priority_score', t)} AS priority", f"{round2(zero('priority_score'))} AS priority_score",
        *scores,
        "CASE WHEN entity_type LIKE 'Store%' THEN split_part(entity_id, '-', 1) END AS affected_store_id",
        "CASE WHEN entity_type = 'Store Product' THEN split_part(entity_id, '-', 2) END AS affected_product_id",
        *[f"{clean_text(c)} AS {c}" for c in ("entity_type", "entity_id", "evidence", "status", "detection_source")],
        "substring(detected_at, 1, 10) AS detected_date", "detected_at",
    )
