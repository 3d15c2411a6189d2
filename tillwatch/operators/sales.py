"""Sales rules: declines by store, product, category and region, low targets, weak products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillwatch.functions.text import (
    clean_text, currency, currency0, fixed, safe_identifier, say, severity_rank, zero,
)
from tillwatch.operators import findings as fd
from tillwatch.operators.templates import (
    decline_percent, exact, latest_date_month, latest_finance, latest_month, month_over_month, monthly_totals, order_by,
)
from tillwatch.thresholds import DEFAULTS, Thresholds

SALES_SUM = {"sales": "sum(total_sales)"}


def _declines(monthly: DataFrame, key: str, percent: float, latest: Column | None = None) -> DataFrame:
    """Latest month at or below (100 - percent)% of the previous month with data."""
    return month_over_month(monthly, [key], ["sales"], latest).where(
        f"previous_sales IS NOT NULL AND sales * 100 <= previous_sales * {exact(100 - percent)}"
    ).selectExpr("*", f"{decline_percent('sales', 'previous_sales')} AS decline")


def _decline_record(rows: DataFrame, t: Thresholds, detected_at: str | None, subject: str,
                    more_evidence: str, **values: str) -> DataFrame:
    texts = dict(decline=fixed("decline"), now=currency0("sales"), before=currency0("previous_sales"),
                 subject=subject, more=more_evidence)
    return fd.record(
        rows, fd.SALES, detected_at, business_area="'Sales'",
        severity=f"CASE WHEN decline >= {t.severe_decline_percent} THEN 'High' ELSE 'Medium' END",
        month="month", previous_month="previous_month", current_sales="sales",
        previous_sales="previous_sales", sales_change_percent="-decline",
        summary=say("{subject} recorded a {decline}% sales decline in {month} compared with {previous_month}.", **texts),
        evidence=say("Current Month Sales: {now}; Previous Month Sales: {before}; Sales Decline: {decline}%{more}", **texts),
        **values,
    )


def store_sales_decline(sales: DataFrame, t: Thresholds = DEFAULTS, as_of_month: str | None = None,
                        detected_at: str | None = None) -> DataFrame:
    monthly = monthly_totals(sales, ["store_id"], SALES_SUM, ["store_name", "region"], as_of_month)
    return _decline_record(
        _declines(monthly, "store_id", t.store_decline_percent), t, detected_at, "store_name",
        say("; Region: {x}", x=clean_text("region")),
        finding_id=say("STORE-DECLINE-{store_id}-{month}"), analysis_type="'Store Sales Decline'",
        entity_type="'Store'", entity_id="store_id", entity_name="store_name",
        **fd.columns("store_id", "store_name", "region"),
    )


def product_sales_decline(sales: DataFrame, t: Thresholds = DEFAULTS, as_of_month: str | None = None,
                          detected_at: str | None = None, latest: Column | None = None) -> DataFrame:
    monthly = monthly_totals(sales, ["product_id"], SALES_SUM, ["product_name", "category"], as_of_month)
    rows = _declines(monthly, "product_id", t.product_decline_percent, latest).where(
        f"previous_sales >= {exact(t.min_previous_product_sales)}"
    )
    return _decline_record(
        rows, t, detected_at, "product_name", say("; Category: {x}", x=clean_text("category")),
        finding_id=say("PRODUCT-DECLINE-{product_id}-{month}"),
        analysis_type="'Product Sales Decline'", entity_type="'Product'", entity_id="product_id",
        entity_name="product_name", **fd.columns("product_id", "product_name", "category"),
    )


def _named_decline(rows: DataFrame, column: str, kind: str, title: str, t: Thresholds,
                   detected_at: str | None) -> DataFrame:
    slug = safe_identifier(column)
    return _decline_record(
        rows, t, detected_at, say(f"The {{{column}}} {column}"), "''",
        finding_id=say(f"{kind.upper()}-DECLINE-{{slug}}-{{month}}", slug=slug),
        analysis_type=f"'{title}'", entity_type=f"'{kind}'", entity_id=slug, entity_name=column,
        **fd.columns(column),
    )


def category_sales_decline(sales: DataFrame, t: Thresholds = DEFAULTS, as_of_month: str | None = None,
                           detected_at: str | None = None) -> DataFrame:
    monthly = monthly_totals(sales, ["category"], SALES_SUM, [], as_of_month)
    rows = _declines(monthly, "category", t.category_decline_percent)
    return _named_decline(rows, "category", "Category", "Category Sales Decline", t, detected_at)


def regional_sales_decline(sales: DataFrame, t: Thresholds = DEFAULTS, as_of_month: str | None = None,
                           detected_at: str | None = None) -> DataFrame:
    named = sales.where("region IS NOT NULL AND trim(region) <> ''")
    monthly = monthly_totals(named, ["region"], SALES_SUM, [], as_of_month)
    rows = _declines(monthly, "region", t.region_decline_percent)
    return _named_decline(rows, "region", "Region", "Regional Sales Decline", t, detected_at)


def low_target_achievement(finance: DataFrame, stores: DataFrame, t: Thresholds = DEFAULTS,
                           detected_at: str | None = None) -> DataFrame:
    rows = latest_finance(finance).drop("region").where(
        f"target_achievement_percent < {exact(t.low_target_percent)}"
    ).join(stores.select("store_id", "region"), "store_id", "left")
    return fd.record(
        rows, fd.SALES, detected_at, finding_id=say("LOW-TARGET-{store_id}-{month}"),
        analysis_type="'Low Target Achievement'", business_area="'Sales'",
        severity=f"CASE WHEN target_achievement_percent < {exact(t.severe_target_percent)} THEN 'High' ELSE 'Medium' END",
        entity_type="'Store'", entity_id="store_id", entity_name="store_name",
        current_sales=zero("total_revenue"), benchmark_value=zero("monthly_sales_target"),
        benchmark_label="'Monthly Sales Target'",
        summary=say("{store_name} achieved only {pct}% of its sales target in {month}.",
                    pct=fixed("target_achievement_percent")),
        evidence=say("Monthly Target: {target}; Revenue: {revenue}; Operating Profit: {profit}; Risk Status: {risk}",
                     target=currency0("monthly_sales_target"), revenue=currency0("total_revenue"),
                     profit=currency("operating_profit"), risk=clean_text("risk_status")),
        **fd.columns("store_id", "store_name", "region", "month", "target_achievement_percent"),
    )


def product_underperformance(sales: DataFrame, t: Thresholds = DEFAULTS,
                             as_of_month: str | None = None,
                             detected_at: str | None = None, latest: Column | None = None) -> DataFrame:
    """Latest-month product sales against the average of the products in the same category."""
    monthly = monthly_totals(sales, ["product_id", "category"], SALES_SUM, ["product_name"], as_of_month)
    last = monthly.where(F.col("month_start") == (latest_month(monthly) if latest is None else latest))
    per_category = last.groupBy("category").agg(
        F.expr("sum(sales) AS category_sales"), F.expr("count(*) AS product_count"))
    rows = last.join(per_category, "category").where(
        "product_count >= 2 AND sales * CAST(product_count AS DECIMAL(12,0)) "
        f"<= category_sales * {exact(t.product_to_category_ratio)}"
    ).selectExpr(
        "*", "CAST(category_sales AS DOUBLE) / product_count AS average",
        "coalesce(try_divide(CAST(sales AS DOUBLE), CAST(category_sales AS DOUBLE) / product_count), 0D) AS performance",
        "date_format(month_start, 'yyyy-MM') AS month",
    )
    return fd.record(
        rows, fd.SALES, detected_at, finding_id=say("PRODUCT-UNDERPERFORMANCE-{product_id}-{month}"),
        analysis_type="'Product Underperformance'", business_area="'Sales'",
        severity=f"CASE WHEN performance < {t.severe_product_ratio} THEN 'High' ELSE 'Medium' END",
        entity_type="'Product'", entity_id="product_id", entity_name="product_name",
        current_sales="sales", benchmark_value="average",
        benchmark_label="'Latest Category Average Sales'",
        summary=say("{product_name} achieved only {pct}% of the latest-month average sales for the {category} category.",
                    pct=fixed("performance * 100")),
        evidence=say("Product Sales: {sales}; Category Average Sales: {average}; Product Count in Category: {product_count}",
                     sales=currency0("sales"), average=currency0("average")),
        **fd.columns("product_id", "product_name", "category", "month"),
    )


def order_findings(findings: DataFrame) -> DataFrame:
    return order_by(findings, severity_rank(), "analysis_type", "sales_change_percent",
                    "target_achievement_percent", "finding_id")


def sales_findings(sales: DataFrame, finance: DataFrame, stores: DataFrame,
                   t: Thresholds = DEFAULTS, as_of_month: str | None = None,
                   detected_at: str | None = None, summed: bool = False) -> DataFrame:
    """All six sales rules in one relation (unordered; see order_findings).

    Sales that are `summed` by store, product and month are dealt by product once: no aggregate or window of the two product rules
    deals them again. Single lines are added up before they are dealt, as one product may have any number of them."""
    dealt = sales.select("product_id", "product_name", "category", "date", "total_sales").repartition("product_id") if summed else sales
    latest = latest_date_month(sales, as_of_month) if summed else None
    return (
        store_sales_decline(sales, t, as_of_month, detected_at)
        .unionByName(product_sales_decline(dealt, t, as_of_month, detected_at, latest))
        .unionByName(low_target_achievement(finance, stores, t, detected_at))
        .unionByName(product_underperformance(dealt, t, as_of_month, detected_at, latest))
        .unionByName(category_sales_decline(sales, t, as_of_month, detected_at))
        .unionByName(regional_sales_decline(sales, t, as_of_month, detected_at))
    )
