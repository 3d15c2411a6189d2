"""Rule-based root causes, set-wise: contexts are aggregated once and joined to all issues.

A context keyed by month also carries its last month under the key 'latest', so
an issue without a period is an ordinary equi-join too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwatch.functions.text import (
    clean_text, currency0, entity_code, fixed, lit, round2, say, severity_rank, zero,
)
from tillwatch.operators.issues import ACTIVE
from tillwatch.operators.templates import (
    COMPLAINT_COUNTS, aggregates, first_per_key, merge_labels,
)
from tillwatch.operators.vendor_finance import DELIVERY_METRICS

STOCK_COUNTS = {
    "low_stock_items": "count_if(stock_status = 'Low Stock')",
    "reorder_soon_items": "count_if(stock_status = 'Reorder Soon')",
    "overstock_items": "count_if(stock_status = 'Overstock')",
}


def _by_period(history: DataFrame, keys: str) -> DataFrame:
    """Add `period`: every row under its month, the last one also under 'latest'."""
    last = f"max(month) OVER (PARTITION BY {keys})"
    return history.selectExpr("*", f"{last} AS last_month").selectExpr(
        "*", "explode(array_compact(array(month, if(month = last_month, 'latest', NULL)))) AS period"
    ).drop("last_month")


# ---- contexts -----------------------------------------------------------------
def store_finance_context(finance: DataFrame) -> DataFrame:
    over = "OVER (PARTITION BY store_id ORDER BY month)"
    return _by_period(finance.selectExpr(
        "store_id", "store_name", "month", "total_revenue", "operating_expense", "operating_profit",
        "target_achievement_percent", "risk_status", f"lag(month) {over} AS previous_month",
        f"lag(total_revenue) {over} AS previous_revenue",
        f"lag(operating_profit) {over} AS previous_operating_profit"), "store_id")


def _monthly(sales: DataFrame, keys: list[str]) -> DataFrame:
    return sales.groupBy(*keys, F.expr("trunc(date, 'month') AS month_start")).agg(
        *aggregates({"monthly_sales": "sum(total_sales)", "monthly_profit": "sum(profit)"})
    ).selectExpr(*keys, "date_format(month_start, 'yyyy-MM') AS month", "monthly_sales", "monthly_profit")


def _with_lag(monthly: DataFrame, keys: str) -> DataFrame:
    over = f"OVER (PARTITION BY {keys} ORDER BY month)"
    return monthly.selectExpr("*", f"lag(month) {over} AS previous_month", f"lag(monthly_sales) {over} AS previous_sales")


def store_sales_context(sales: DataFrame) -> DataFrame:
    return _by_period(_with_lag(_monthly(sales, ["store_id", "store_name"]), "store_id"), "store_id")


def store_category_decline(sales: DataFrame) -> DataFrame:
    """Category with the smallest difference to the month before, per store and month."""
    monthly = _monthly(sales, ["store_id", "category"]).select("store_id", "category", "month", "monthly_sales")
    pairs = _with_lag(_monthly(sales, ["store_id"]), "store_id").where("previous_month IS NOT NULL").select(
        "store_id", F.col("month").alias("pair_month"), F.col("previous_month").alias("pair_before"))
    now = monthly.join(pairs, F.expr("month = pair_month") & (monthly.store_id == pairs.store_id)).select(
        monthly.store_id, "pair_month", "category", F.col("monthly_sales").alias("now"), F.lit(None).alias("before"))
    before = monthly.join(pairs, F.expr("month = pair_before") & (monthly.store_id == pairs.store_id)).select(
        monthly.store_id, "pair_month", "category", F.lit(None).alias("now"), F.col("monthly_sales").alias("before"))
    summed = now.unionByName(before).groupBy("store_id", "pair_month", "category").agg(
        *aggregates({"current_sales": "coalesce(sum(now), 0)", "previous_sales": "coalesce(sum(before), 0)"}))
    return first_per_key(summed, "store_id, pair_month", "current_sales - previous_sales, category").withColumnRenamed(
        "pair_month", "month")


def store_inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("store_id").agg(*aggregates(STOCK_COUNTS))


def store_complaint_counts(complaints: DataFrame) -> DataFrame:
    """Counts per store and month, and over all months under the key 'all'."""
    monthly = complaints.groupBy("store_id", F.expr("trunc(date, 'month') AS month_start")).agg(*aggregates(COMPLAINT_COUNTS))
    named = monthly.selectExpr("store_id", "date_format(month_start, 'yyyy-MM') AS period", *COMPLAINT_COUNTS)
    whole = named.groupBy("store_id").agg(*aggregates({c: f"sum({c})" for c in COMPLAINT_COUNTS}))
    return named.unionByName(whole.selectExpr("store_id", "'all' AS period", *COMPLAINT_COUNTS))


def inventory_product_context(snapshot: DataFrame) -> DataFrame:
    return first_per_key(snapshot, "store_id, product_id", "date DESC, inventory_id")


def vendor_delivery_context(deliveries: DataFrame) -> DataFrame:
    """The delivery metrics by vendor, added up by name first: a greatest text among all deliveries would have them sorted."""
    named = deliveries.groupBy("vendor_id", "vendor_name").agg(*aggregates({
        "deliveries": "count(*)", "delayed_deliveries": DELIVERY_METRICS["delayed_deliveries"], "partial_deliveries": DELIVERY_METRICS["partial_deliveries"],
        "delay": "sum(delay_days)", "dated": "count(delay_days)", "longest": "max(delay_days)", "rating": "sum(quality_rating)", "rated": "count(quality_rating)",
        "on_time": "count_if(delay_days <= 0)"}))
    return named.groupBy("vendor_id").agg(*aggregates({
        "vendor_name": "max(vendor_name)", "delivery_count": "sum(deliveries)", "delayed_deliveries": "sum(delayed_deliveries)",
        "partial_deliveries": "sum(partial_deliveries)", "average_delay_days": "try_divide(CAST(sum(delay) AS DOUBLE), CAST(sum(dated) AS DOUBLE))",
        "maximum_delay_days": "max(longest)", "average_quality_rating": "try_divide(CAST(sum(rating) AS DOUBLE), CAST(sum(rated) AS DOUBLE))",
        "on_time_delivery_rate": "sum(on_time) * 100D / sum(deliveries)"}))


def vendor_affected_stores(deliveries: DataFrame, keep: int = 3) -> DataFrame:
    per_store = deliveries.groupBy("vendor_id", "store_name").agg(*aggregates({
        "delivery_count": "count(*)", "average_delay_days": "avg(delay_days)", "maximum_delay_days": "max(delay_days)"}))
    return per_store.selectExpr(
        "*", "row_number() OVER (PARTITION BY vendor_id ORDER BY average_delay_days DESC, maximum_delay_days DESC, store_name) AS position"
    ).where(f"position <= {keep}")


def store_complaint_types(complaints: DataFrame, keep: int = 3) -> DataFrame:
    counted = complaints.groupBy("store_id", "complaint_type").agg(*aggregates({
        "complaint_count": "count(*)", **{c: COMPLAINT_COUNTS[c] for c in ("high_severity_complaints", "unresolved_complaints")}}))
    return counted.selectExpr(
        "*", "row_number() OVER (PARTITION BY store_id ORDER BY complaint_count DESC, high_severity_complaints DESC, complaint_type) AS position"
    ).where(f"position <= {keep}")


def store_complaint_products(complaints: DataFrame, keep: int = 3) -> DataFrame:
    counted = merge_labels(complaints, ["store_id", "product_id"], ["product_name"], {
        "complaint_count": "count(*)", "high_severity_complaints": COMPLAINT_COUNTS["high_severity_complaints"]})
    return counted.selectExpr(
        "*", "row_number() OVER (PARTITION BY store_id ORDER BY complaint_count DESC, high_severity_complaints DESC, product_id) AS position"
    ).where(f"position <= {keep}")


PRODUCT_CASES = {**COMPLAINT_COUNTS, "out_of_stock_complaints": "count_if(complaint_type = 'Out of Stock')"}


def product_complaint_context(complaints: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Counts per product and store, and over all stores under the key 'all'; only of `wanted` (product_id, store_key) if given."""
    if wanted is not None:
        complaints = complaints.join(wanted.select("product_id").distinct(), "product_id", "left_semi")
    per_store = merge_labels(complaints, ["product_id", "store_id"], ["product_name"], PRODUCT_CASES)
    whole = per_store.groupBy("product_id").agg(*aggregates(
        {"product_name": "max(product_name)", **{c: f"sum({c})" for c in PRODUCT_CASES}}))
    columns = ["product_id", "store_key", "product_name", *PRODUCT_CASES]
    counted = per_store.withColumnRenamed("store_id", "store_key").select(*columns).unionByName(
        whole.selectExpr("*", "'all' AS store_key").select(*columns))
    return counted if wanted is None else counted.join(wanted, ["product_id", "store_key"], "left_semi")


def product_sales_context(sales: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Month over month per product and store, and over all stores under the key 'all'; only of `wanted` (product_id, store_key) if given.

    The sales are dealt by product once, which serves every aggregate and window after it."""
    sums = {"monthly_sales": "sum(total_sales)", "monthly_profit": "sum(profit)"}
    if wanted is None:
        dealt = sales.selectExpr("*", "TRUE AS own", "TRUE AS everywhere").repartition("product_id")
    else:
        # as many entries as the product has stores with an issue
        stores = wanted.groupBy("product_id").agg(*aggregates({"stores": "collect_set(store_key)"}))
        dealt = sales.join(stores, "product_id").selectExpr(
            "*", "coalesce(array_contains(stores, store_id), FALSE) AS own", "array_contains(stores, 'all') AS everywhere").where("own OR everywhere")
    monthly = merge_labels(dealt, ["product_id", "store_id", "own", "everywhere", "trunc(date, 'month') AS month_start"],
                           ["product_name", "category"], sums, ["product_id", "store_id", "own", "everywhere", "month_start"])
    whole = monthly.where("everywhere").groupBy("product_id", "month_start").agg(*aggregates({
        "product_name": "max(product_name)", "category": "max(category)",
        "monthly_sales": "sum(monthly_sales)", "monthly_profit": "sum(monthly_profit)"})).selectExpr("*", "'all' AS store_key")

    def compared(rows: DataFrame) -> DataFrame:
        named = rows.selectExpr("product_id", "store_key", "product_name", "category", "date_format(month_start, 'yyyy-MM') AS month",
                                "monthly_sales", "monthly_profit")
        return _by_period(_with_lag(named, "product_id, store_key"), "product_id, store_key")

    return compared(monthly.where("own").withColumnRenamed("store_id", "store_key")).unionByName(compared(whole))


def complaint_category_context(complaints: DataFrame) -> DataFrame:
    return complaints.groupBy("complaint_type").agg(*aggregates({
        **COMPLAINT_COUNTS, "affected_store_count": "count(DISTINCT store_id)",
        "affected_product_count": "count(DISTINCT product_id)"}))


# ---- investigations -----------------------------------------------------------
def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"


def _change(now: str, before: str) -> str:
    n, b = f"CAST({now} AS DOUBLE)", f"CAST({before} AS DOUBLE)"
    return f"coalesce(CASE WHEN {b} > 0 THEN ({n} - {b}) / {b} * 100 END, 0D)"


def _investigation(joined: DataFrame, matched: str, category: str, summary: str, factors: list[str], evidence: str,
                   focus: str, no_match: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Issue columns plus the investigation texts; `no_match` texts where the context is missing."""
    found = f"array_compact(array({', '.join(factors)}))"
    body = {
        "root_cause_summary": lit(summary),
        "contributing_factors": f"CASE WHEN size({found}) = 0 THEN 'Available data did not identify a stronger contributing factor.' "
                                f"ELSE array_join({found}, ' ') END",
        "rca_evidence": evidence,
        "investigation_focus": lit(focus),
    }
    if no_match is not None:
        body = {name: f"CASE WHEN {matched} THEN {sql} ELSE {lit(text)} END"
                for (name, sql), text in zip(body.items(), no_match)}
    return joined.selectExpr("issue_id", f"{lit(category)} AS root_cause_category",
                             *[f"{sql} AS {name}" for name, sql in body.items()])


STOCK_RATIO = "CASE WHEN reorder_level > 0 THEN CAST(current_stock AS DOUBLE) / reorder_level * 100 ELSE 0D END"
STOCK_TEXT = dict(stock=fixed("current_stock", 0), reorder=fixed("reorder_level", 0), ratio=fixed(STOCK_RATIO))


def _prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.selectExpr(*[c if c in keys else f"{c} AS {prefix}{c}" for c in df.columns])


def store_performance(issues: DataFrame, finance: DataFrame, sales: DataFrame, categories: DataFrame,
                      stock: DataFrame, cases: DataFrame) -> DataFrame:
    on = ["store_id", "period"]
    joined = (
        issues.where("issue_type = 'Store Performance Risk'")
        .selectExpr("issue_id", "rca_store_id AS store_id", "rca_period", "coalesce(rca_period, 'latest') AS period")
        .join(_prefixed(finance, "f_", on), on, "left").join(_prefixed(sales, "s_", on), on, "left")
        .withColumns({"month": F.expr("coalesce(s_month, f_month, rca_period)"),
                      "case_period": F.expr("coalesce(f_month, rca_period, 'all')")})
        .join(_prefixed(categories, "c_", ["store_id", "month"]), ["store_id", "month"], "left")
        .join(stock, "store_id", "left")
        .join(cases.withColumnRenamed("period", "case_period"), ["store_id", "case_period"], "left")
    )
    margin = "CASE WHEN f_total_revenue > 0 THEN CAST(f_operating_profit AS DOUBLE) / CAST(f_total_revenue AS DOUBLE) * 100 ELSE 0D END"
    revenue_change = _change("f_total_revenue", "f_previous_revenue")
    decline, category_decline = f"(-{_change('s_monthly_sales', 's_previous_sales')})", f"(-{_change('c_current_sales', 'c_previous_sales')})"
    has_finance, has_sales = "f_month IS NOT NULL", "s_month IS NOT NULL"
    selected = "coalesce(f_month, rca_period)"
    factors = [
        _when(f"{has_finance} AND {zero('f_target_achievement_percent')} < 70", say(
            "Target achievement was only {p}% in {m}.", p=fixed(zero("f_target_achievement_percent")), m=selected)),
        _when(f"{has_finance} AND {revenue_change} < 0", say(
            "Revenue declined by {p}% from {m}.", p=fixed(f"abs({revenue_change})"), m="coalesce(f_previous_month, 'the previous period')")),
        _when(f"{has_finance} AND {margin} < 10", say("Operating profit margin was only {p}%.", p=fixed(margin))),
        _when(f"{has_finance} AND f_operating_expense > 0", say("Operating expenses were {x}.", x=currency0("f_operating_expense"))),
        _when(f"{has_sales} AND {decline} > 0", say(
            "Store sales declined by {p}% compared with {m}.", p=fixed(decline), m="coalesce(s_previous_month, 'the previous period')")),
        _when(f"{has_sales} AND c_category IS NOT NULL AND {category_decline} > 0", say(
            "{c} was the largest declining category, falling by {p}%.", c=clean_text("c_category"), p=fixed(category_decline))),
        _when("low_stock_items > 0 OR reorder_soon_items > 0", say(
            "The store has {low_stock_items} Low Stock and {reorder_soon_items} Reorder Soon inventory records.")),
        _when("total_complaints > 0", say(
            "{total_complaints} complaints were recorded in {m}, including {high_severity_complaints} High-severity cases.",
            m=f"coalesce({selected}, 'the selected period')")),
    ]
    parts = [
        _when(has_finance, say("Revenue: {r}; Operating Profit: {p}; Target Achievement: {t}%; Risk Status: {k}.",
                               r=currency0("f_total_revenue"), p=currency0("f_operating_profit"),
                               t=fixed(zero("f_target_achievement_percent")), k=clean_text("f_risk_status"))),
        _when(has_sales, say("Store Sales: {x} for {m}.", x=currency0("s_monthly_sales"), m="s_month")),
    ]
    evidence = f"coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), 'Store-level finance and sales context was not available.')"
    return _investigation(
        joined, "TRUE", "Multi-Factor Store Performance Deterioration",
        "Likely multi-factor deterioration involving sales, financial, inventory, and customer-experience conditions.",
        factors, evidence,
        "Review declining categories, local sales execution, inventory availability, customer complaints, discounting "
        "practices, and operating-cost drivers.")


def product_availability(issues: DataFrame, stock: DataFrame, vendors: DataFrame) -> DataFrame:
    joined = (
        issues.where("issue_type = 'Product Availability Risk'")
        .selectExpr("issue_id", "rca_store_id AS store_id", "rca_product_id AS product_id")
        .join(stock, ["store_id", "product_id"], "left")
        .join(_prefixed(vendors, "v_", ["vendor_id"]), "vendor_id", "left")
    )
    delay, longest, on_time = zero("v_average_delay_days"), zero("v_maximum_delay_days"), zero("v_on_time_delivery_rate")
    supplied = "v_delivery_count IS NOT NULL"
    factors = [
        say("Current stock is {stock} units against a reorder level of {reorder} units ({ratio}% of the reorder level).", **STOCK_TEXT),
        _when("related_complaints > 0", say("The product is linked to {related_complaints} complaints, including "
                                            "{high_severity_complaints} High-severity cases.")),
        _when("unresolved_complaints > 0", say("{unresolved_complaints} related complaints remain Open or In Progress.")),
        _when("out_of_stock_complaints > 0", say("{out_of_stock_complaints} related complaints are categorized as Out of Stock.")),
        _when(f"{supplied} AND ({delay} >= 3 OR v_delayed_deliveries >= 2)", say(
            "Supplier {s} has an average delay of {d} days across {v_delayed_deliveries} delayed deliveries.",
            s=clean_text("vendor_name"), d=fixed(delay))),
        _when(f"{supplied} AND {longest} >= 10", say("The supplier's maximum observed delay is {d} days.", d=fixed(longest, 0))),
        _when(f"{supplied} AND v_partial_deliveries > 0", say("The supplier has {v_partial_deliveries} partial deliveries.")),
        _when(f"{supplied} AND {on_time} < 70", say("Supplier on-time delivery rate is only {p}%.", p=fixed(on_time))),
    ]
    return _investigation(
        joined, "inventory_id IS NOT NULL", "Inventory Replenishment and Supply Risk",
        "Likely inventory replenishment failure because available stock is materially below the operational reorder requirement.",
        factors,
        say("Store: {a}; Product: {b}; Stock Status: {c}; Current Stock: {stock}; Reorder Level: {reorder}; Related Complaints: {related_complaints}.",
            a=clean_text("store_name"), b=clean_text("product_name"), c=clean_text("stock_status"), **STOCK_TEXT),
        "Review the latest purchase order, vendor delivery status, sales velocity, stock-transfer availability, and "
        "replenishment approval process.",
        ("The issue could not be matched to a current inventory record.",
         "Verify the store-product combination and refresh the inventory snapshot.",
         "No matching inventory record was returned.",
         "Verify the store-product key, recent stock movement, and replenishment records."))


def vendor_performance(issues: DataFrame, vendors: DataFrame, affected: DataFrame) -> DataFrame:
    worst = affected.where("position = 1").selectExpr(
        "vendor_id", "store_name AS worst_store", "average_delay_days AS worst_delay")
    joined = issues.where("issue_type = 'Vendor Performance Risk'").selectExpr(
        "issue_id", "rca_vendor_id AS vendor_id").join(vendors, "vendor_id", "left").join(worst, "vendor_id", "left")
    delay, longest = zero("average_delay_days"), zero("maximum_delay_days")
    quality, on_time = zero("average_quality_rating"), zero("on_time_delivery_rate")
    texts = dict(delay=fixed(delay), longest=fixed(longest, 0), on_time=fixed(on_time), quality=fixed(quality))
    factors = [
        _when(f"{delay} > 0", say("Average delivery delay is {delay} days.", **texts)),
        _when(f"{longest} > 0", say("Maximum observed delivery delay is {longest} days.", **texts)),
        _when("delayed_deliveries > 0", say("{delayed_deliveries} deliveries were delayed.")),
        _when("partial_deliveries > 0", say("{partial_deliveries} deliveries were partial.")),
        _when(f"{on_time} < 70", say("On-time delivery rate is only {on_time}%.", **texts)),
        _when(f"{quality} < 4", say("Average quality rating is {quality} out of 5.", **texts)),
        _when("worst_store IS NOT NULL", say("The most affected store is {s}, where the average delay is {d} days.",
                                             s=clean_text("worst_store"), d=fixed(zero("worst_delay")))),
    ]
    return _investigation(
        joined, "delivery_count IS NOT NULL", "Vendor Reliability and Fulfilment Risk",
        "Likely supplier reliability issue involving delayed, incomplete, or inconsistent deliveries.", factors,
        say("Vendor: {v}; Delivery Count: {delivery_count}; Average Delay: {delay} days; Maximum Delay: {longest} days; "
            "On-Time Delivery Rate: {on_time}%; Average Quality Rating: {quality}.", v=clean_text("vendor_name"), **texts),
        "Review service-level agreement compliance, purchase-order planning, supplier capacity, product quality checks, "
        "and backup supplier availability.",
        ("The vendor issue could not be matched to delivery records.",
         "Verify the vendor ID and current vendor-delivery records.",
         "No matching vendor-delivery record was returned.",
         "Validate the vendor key and inspect recent delivery records."))


def complaint_backlog(issues: DataFrame, cases: DataFrame, types: DataFrame, products: DataFrame, stock: DataFrame) -> DataFrame:
    joined = (
        issues.where("issue_type = 'Complaint Resolution Backlog'").selectExpr("issue_id", "rca_store_id AS store_id")
        .join(cases.where("period = 'all'"), "store_id", "left")
        .join(types.where("position = 1").selectExpr("store_id", "complaint_type AS top_type", "complaint_count AS type_cases"), "store_id", "left")
        .join(products.where("position = 1").selectExpr("store_id", "product_name AS top_product", "complaint_count AS product_cases"), "store_id", "left")
        .join(stock, "store_id", "left")
    )
    counts = {c: f"coalesce({c}, 0)" for c in COMPLAINT_COUNTS}
    factors = [
        _when("unresolved_complaints > 0", say("{unresolved_complaints} complaints are Open or In Progress.")),
        _when("high_severity_complaints > 0", say("{high_severity_complaints} complaints are High severity.")),
        _when("type_cases IS NOT NULL", say("The largest complaint category is {x} with {type_cases} cases.", x=clean_text("top_type"))),
        _when("product_cases IS NOT NULL", say("The most frequently complained-about product is {x} with {product_cases} cases.", x=clean_text("top_product"))),
        _when("low_stock_items > 0 OR reorder_soon_items > 0", say(
            "The store has {low_stock_items} Low Stock and {reorder_soon_items} Reorder Soon records, which may be contributing "
            "to service-related complaints.")),
    ]
    return _investigation(
        joined, "store_id <> ''", "Customer Support Resolution and Escalation Backlog",
        "Likely delay in complaint resolution, escalation handling, or support-capacity management.", factors,
        say("Total Complaints: {total_complaints}; High-Severity Complaints: {high_severity_complaints}; "
            "Open or In-Progress Complaints: {unresolved_complaints}.", **counts),
        "Review backlog ownership, ageing cases, frontline escalation, main complaint categories, and store-manager resolution workflow.",
        ("The complaint backlog issue could not be matched to complaint records.",
         "Verify the store ID and reload complaint data.", "No complaint summary was returned.",
         "Verify the store key and current complaint records."))


def product_complaints(issues: DataFrame, cases: DataFrame, stock: DataFrame) -> DataFrame:
    joined = (
        issues.where("issue_type = 'Product Complaint Risk'").selectExpr(
            "issue_id", "rca_product_id AS product_id", "rca_store_id AS store_id",
            "if(rca_store_id <> '', rca_store_id, 'all') AS store_key")
        .join(cases, ["product_id", "store_key"], "left")
        .join(stock.select("store_id", "product_id", "inventory_id", "current_stock", "reorder_level"), ["store_id", "product_id"], "left")
    )
    counts = {c: f"coalesce({c}, 0)" for c in PRODUCT_CASES}
    factors = [
        say("The product has {total_complaints} complaints, including {high_severity_complaints} High-severity cases.", **counts),
        _when("unresolved_complaints > 0", say("{unresolved_complaints} product-related complaints remain Open or In Progress.")),
        _when("out_of_stock_complaints > 0", say("{out_of_stock_complaints} cases are categorized as Out of Stock.")),
        _when(f"inventory_id IS NOT NULL AND {STOCK_RATIO} < 80", say("At the affected store, stock is only {ratio}% of the reorder level.", **STOCK_TEXT)),
    ]
    return _investigation(
        joined, "product_id <> ''", "Product Quality, Availability, or Service Experience Risk",
        "Likely recurring product-level customer-experience issue requiring quality, availability, and fulfilment review.", factors,
        say("Product: {p}; Total Complaints: {total_complaints}; High-Severity Complaints: {high_severity_complaints}; "
            "Unresolved Complaints: {unresolved_complaints}.", p=clean_text("product_name"), **counts),
        "Review product quality, packaging, store availability, fulfilment process, and recurring customer complaint categories.",
        ("The product complaint issue could not be matched to complaint records.",
         "Verify the product ID and refresh complaint data.", "No product complaint context was returned.",
         "Validate product mapping, complaint classification, and availability records."))


SOLD_KEYS = "if(rca_store_id <> '', rca_store_id, 'all') AS store_key"


def sold_products(wanted: DataFrame) -> DataFrame:
    """(product_id, store_key) of the issues whose investigation looks at product sales."""
    return wanted.where("issue_type IN ('Product Sales Performance Risk', 'Inventory Overstock Risk')").selectExpr(
        "rca_product_id AS product_id", SOLD_KEYS).distinct()


def complaint_products(wanted: DataFrame) -> DataFrame:
    """(product_id, store_key) of the issues whose investigation looks at a product's complaints."""
    return wanted.where("issue_type = 'Product Complaint Risk'").selectExpr("rca_product_id AS product_id", SOLD_KEYS).distinct()


def product_sales(issues: DataFrame, sales: DataFrame, stock: DataFrame) -> DataFrame:
    joined = (
        issues.where("issue_type = 'Product Sales Performance Risk'").selectExpr(
            "issue_id", "rca_product_id AS product_id", "rca_store_id AS store_id", "coalesce(rca_period, 'latest') AS period", SOLD_KEYS)
        .join(sales, ["product_id", "store_key", "period"], "left")
        .join(stock.select("store_id", "product_id", "inventory_id", "current_stock", "reorder_level"), ["store_id", "product_id"], "left")
    )
    change = _change("monthly_sales", "previous_sales")
    factors = [
        _when(f"{change} < 0", say("Product sales declined by {p}% in {month} compared with {m}.", p=fixed(f"abs({change})"),
                                   m="coalesce(previous_month, 'the prior period')")),
        _when(f"inventory_id IS NOT NULL AND {STOCK_RATIO} < 80", say("Stock availability is constrained at {ratio}% of reorder level.", **STOCK_TEXT)),
    ]
    return _investigation(
        joined, "month IS NOT NULL", "Product Demand and Commercial Performance Risk",
        "Likely weakness in product demand, pricing, assortment, local commercial execution, or availability.", factors,
        say("Product: {p}; Category: {c}; Current Sales: {now}; Previous Sales: {before}.", p=clean_text("product_name"),
            c=clean_text("category"), now=currency0("monthly_sales"), before=currency0("previous_sales")),
        "Review pricing, promotions, assortment visibility, local demand, competitor activity, and product availability.",
        ("The product sales issue could not be matched to transaction history.",
         "Verify the product ID, period label, and sales data refresh.", "No matching product sales history was returned.",
         "Review product mapping, pricing, distribution, and sales data."))


def inventory_overstock(issues: DataFrame, stock: DataFrame, sales: DataFrame) -> DataFrame:
    history = _prefixed(sales, "h_", ["product_id", "store_key", "period"])
    joined = (
        issues.where("issue_type = 'Inventory Overstock Risk'").selectExpr(
            "issue_id", "rca_store_id AS store_id", "rca_product_id AS product_id", "coalesce(rca_period, 'latest') AS period", SOLD_KEYS)
        .join(stock, ["store_id", "product_id"], "left").join(history, ["product_id", "store_key", "period"], "left")
    )
    change = _change("h_monthly_sales", "h_previous_sales")
    factors = [
        say("Current stock is {stock} units against a reorder level of {reorder} units ({ratio}% of reorder level).", **STOCK_TEXT),
        _when(f"h_month IS NOT NULL AND {change} <= 0", say(
            "Product sales changed by {p}% versus the previous period, suggesting inventory may be outpacing demand.", p=fixed(change))),
    ]
    return _investigation(
        joined, "inventory_id IS NOT NULL", "Inventory Planning and Demand Forecast Risk",
        "Likely mismatch between replenishment planning and actual product demand.", factors,
        say("Store: {a}; Product: {b}; Stock Status: {c}; Current Stock: {stock}; Reorder Level: {reorder}.",
            a=clean_text("store_name"), b=clean_text("product_name"), c=clean_text("stock_status"), **STOCK_TEXT),
        "Review demand forecast accuracy, replenishment quantity, product velocity, transfer opportunities, and promotion or markdown options.",
        ("The overstock issue could not be matched to a current inventory record.",
         "Verify the store-product mapping and inventory snapshot.", "No matching inventory record was returned.",
         "Review inventory snapshot, replenishment quantity, and demand plan."))


def repeated_category(issues: DataFrame, categories: DataFrame) -> DataFrame:
    joined = issues.where("issue_type = 'Repeated Complaint Category Risk'").selectExpr(
        "issue_id", f"{clean_text('entity_id')} AS complaint_type").join(categories, "complaint_type", "left")
    counts = {c: f"coalesce({c}, 0)" for c in (*COMPLAINT_COUNTS, "affected_store_count", "affected_product_count")}
    factors = [
        say("{complaint_type} appears in {total_complaints} complaints across {affected_store_count} stores and "
            "{affected_product_count} products.", **counts),
        _when("high_severity_complaints > 0", say("{high_severity_complaints} cases are High severity.")),
        _when("unresolved_complaints > 0", say("{unresolved_complaints} cases are Open or In Progress.")),
    ]
    return _investigation(
        joined, "complaint_type <> ''", "Recurring Process or Product Failure Pattern",
        "Likely recurring process, product-condition, or service-delivery failure pattern.", factors,
        say("Complaint Category: {complaint_type}; Total Cases: {total_complaints}; High-Severity Cases: "
            "{high_severity_complaints}; Unresolved Cases: {unresolved_complaints}.", **counts),
        "Review the end-to-end process associated with this complaint category, including product handling, fulfilment, and "
        "service steps across affected stores.",
        ("The repeated complaint category could not be matched to complaint records.",
         "Verify the complaint-category label and current complaint data.", "No complaint-category summary was returned.",
         "Review complaint classification and recurring process failures."))


SPECIAL = ("Store Performance Risk", "Product Availability Risk", "Vendor Performance Risk", "Complaint Resolution Backlog",
           "Product Complaint Risk", "Product Sales Performance Risk", "Inventory Overstock Risk",
           "Repeated Complaint Category Risk")


def generic(issues: DataFrame, evidence_stats: DataFrame) -> DataFrame:
    names = ", ".join(lit(s) for s in SPECIAL)
    joined = issues.where(f"issue_type NOT IN ({names})").join(evidence_stats, "issue_id", "left")
    factor = ("CASE WHEN size(types) > 0 THEN concat('Supporting analysis types: ', array_join(slice(types, 1, 5), ', ')) "
              "ELSE 'No detailed evidence type was available.' END")
    return _investigation(
        joined, "TRUE", "Cross-Functional Business Risk",
        "Likely cross-functional risk requiring management review of the available supporting evidence.", [factor],
        clean_text("evidence_summary"),
        "Review linked evidence, entity-level records, and relevant operational owners before confirming a root cause.")


def evidence_stats(evidence: DataFrame) -> DataFrame:
    """Evidence count, High count and analysis types in arrival order, per issue."""
    kinds = evidence.groupBy("issue_id", "analysis_type").agg(*aggregates({
        "n": "count(*)", "high": "count_if(severity = 'High')", "arrival": "min(arrival)"}))
    return kinds.groupBy("issue_id").agg(*aggregates({
        "evidence_count": "sum(n)", "high_count": "sum(high)",
        "types": "transform(array_sort(collect_list(struct(arrival, analysis_type))), x -> x.analysis_type)"}))


def investigated_issues(issues: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Active issues with the keys the investigations look up; limited to a selection when given."""
    rows = issues.where(ACTIVE)
    if selection is not None:
        rows = rows.join(selection.select("issue_id", "executive_rank", "executive_score"), "issue_id")
    else:
        rows = rows.selectExpr("*", "CAST(NULL AS INT) AS executive_rank", "CAST(NULL AS DOUBLE) AS executive_score")
    return rows.selectExpr(
        "*", f"{entity_code('store_id', 'Store', 'S')} AS rca_store_id",
        f"{entity_code('product_id', 'Product', 'P')} AS rca_product_id",
        f"{entity_code('vendor_id', 'Vendor', 'V')} AS rca_vendor_id",
        r"nullif(regexp_extract(period_label, '\\d{4}-\\d{2}', 0), '') AS rca_period")


def analyses(issues: DataFrame, evidence: DataFrame, contexts: dict[str, DataFrame], generated_at: str,
             selection: DataFrame | None = None) -> DataFrame:
    """One root-cause record per issue; the nine investigations are unioned and joined back."""
    wanted = investigated_issues(issues, selection)
    if selection is not None:
        evidence = evidence.join(selection.select("issue_id"), "issue_id", "left_semi")
    stats = evidence_stats(evidence)
    c = contexts
    found = (
        store_performance(wanted, c["finance"], c["store_sales"], c["categories"], c["stock_counts"], c["store_cases"])
        .unionByName(product_availability(wanted, c["stock"], c["vendors"]))
        .unionByName(vendor_performance(wanted, c["vendors"], c["affected_stores"]))
        .unionByName(complaint_backlog(wanted, c["store_cases"], c["case_types"], c["case_products"], c["stock_counts"]))
        .unionByName(product_complaints(wanted, c["product_cases"], c["stock"]))
        .unionByName(product_sales(wanted, c["product_sales"], c["stock"]))
        .unionByName(inventory_overstock(wanted, c["stock"], c["product_sales"]))
        .unionByName(repeated_category(wanted, c["case_categories"]))
        .unionByName(generic(wanted, stats))
    )
    extra = ("CASE root_cause_category WHEN 'Inventory Replenishment and Supply Risk' THEN 5D "
             "WHEN 'Vendor Reliability and Fulfilment Risk' THEN 4D "
             "WHEN 'Multi-Factor Store Performance Deterioration' THEN 3D ELSE 0D END")
    confidence = (f"least(52D + least(evidence_count, 6) * 3D + least(size(types), 5) * 4D + least(high_count, 4) * 2D + {extra}, 92D)")
    return wanted.join(found, "issue_id").join(stats, "issue_id", "left").selectExpr(
        say("RCA-{issue_id}") + " AS analysis_id", "executive_rank", "issue_id", "title", "issue_type", "business_area",
        "priority_level", "priority_score", "executive_score", "entity_type", "entity_id", "rca_store_id AS store_id",
        "rca_product_id AS product_id", "rca_vendor_id AS vendor_id", "coalesce(rca_period, '') AS period_label",
        "root_cause_category", "root_cause_summary",
        say("Assessment for '{title}': {contributing_factors} This is an evidence-based likely-cause assessment and requires "
            "human review before an action is approved.") + " AS root_cause_explanation",
        "contributing_factors", "rca_evidence AS evidence_summary", "investigation_focus",
        f"{round2(confidence)} AS confidence_score", "coalesce(evidence_count, 0) AS evidence_count",
        "coalesce(array_join(types, ', '), '') AS evidence_types",
        "'Rule-Based Database and Evidence Analysis' AS analysis_method", "'Generated' AS analysis_status",
        "'Pending Review' AS review_status", f"{lit(generated_at)} AS generated_at")


def supporting_evidence(evidence: DataFrame, keep: int = 12) -> DataFrame:
    """JSON array of the strongest evidence rows of each issue."""
    fields = ("source_finding_id", "source_module", "analysis_type", "business_area", "severity", "summary", "evidence", "detected_at")
    ranked = evidence.selectExpr(
        "*", f"row_number() OVER (PARTITION BY issue_id ORDER BY {severity_rank()}, analysis_type, detected_at DESC NULLS LAST, arrival) AS position"
    ).where(f"position <= {keep}")
    return ranked.groupBy("issue_id").agg(*aggregates({
        "evidence_rows": "count(*)",
        "supporting_evidence": f"to_json(transform(array_sort(collect_list(struct(position, {', '.join(fields)}))), "
                               f"x -> struct({', '.join(f'x.{f} AS {f}' for f in fields)})))"}))


def merge_analyses(stored: DataFrame, fresh: DataFrame, run_at: str) -> DataFrame:
    """Upsert by issue: only pending or rejected analyses are replaced, with the version raised."""
    now = f"TIMESTAMP_NTZ '{run_at}'"
    facts = ("root_cause_category", "root_cause_summary", "root_cause_explanation", "confidence_score", "evidence_count")
    old = stored.selectExpr("issue_id", "struct(*) AS old")
    new = fresh.selectExpr("issue_id", f"struct({', '.join(facts)}) AS new")
    replace = "(new IS NOT NULL AND (old IS NULL OR old.review_status IN ('Pending Review', 'Rejected')))"
    return old.join(new, "issue_id", "full_outer").selectExpr(
        "issue_id", *[f"if({replace}, new.{f}, old.{f}) AS {f}" for f in facts],
        f"if({replace}, 'Generated', old.analysis_status) AS analysis_status",
        # the status of a replaced analysis stays what it was, as in the keyed update
        "coalesce(old.review_status, 'Pending Review') AS review_status",
        f"CASE WHEN old IS NULL THEN 1 WHEN {replace} THEN old.analysis_version + 1 ELSE old.analysis_version END AS analysis_version",
        f"if({replace}, {now}, old.generated_at) AS generated_at")


def mark_root_causes(issues: DataFrame, analysed: DataFrame) -> DataFrame:
    """Issue root_cause_status after a run: Accepted and Edited stay, analysed ones become Generated."""
    done = analysed.selectExpr("issue_id", "TRUE AS analysed").distinct()
    kept = [c for c in issues.columns if c != "root_cause_status"]
    return issues.join(done, "issue_id", "left").selectExpr(
        *kept, "CASE WHEN analysed AND root_cause_status NOT IN ('Accepted', 'Edited') THEN 'Generated' "
               "ELSE root_cause_status END AS root_cause_status")


def confidence_summary(analysed: DataFrame) -> DataFrame:
    return analysed.agg(*aggregates({
        "average": f"coalesce({round2('avg(confidence_score)')}, 0D)",
        "minimum": f"coalesce({round2('min(confidence_score)')}, 0D)",
        "maximum": f"coalesce({round2('max(confidence_score)')}, 0D)"}))


def split_factors(analysed: DataFrame, keep: int = 8) -> DataFrame:
    """Distinct sentences of the contributing factors, in order."""
    sentences = rf"filter(transform(split({clean_text('contributing_factors')}, '(?<=[.!?])\\s+'), x -> trim(x)), x -> x <> '')"
    return analysed.selectExpr("issue_id", f"slice(array_distinct({sentences}), 1, {keep}) AS factors")
