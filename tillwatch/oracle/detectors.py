"""SQL spelling of every detector, for the cross-check in another engine."""

from __future__ import annotations

from tillwatch.operators import findings as fd
from tillwatch.oracle.views import f0, f2, inr, pct, r2, sev, slug, with_views

DETECTED = "2001-08-01 06:00:00"


def shaped(family: dict[str, str], source: str, **exprs: str) -> str:
    exprs.setdefault("status", "'Open'")
    exprs["detected_at"] = f"'{DETECTED}'"
    out = []
    for name, kind in family.items():
        e = exprs.get(name)
        if kind == "t":
            e = "''" if e is None else f"coalesce(CAST({e} AS VARCHAR), '')"
        elif kind == "d":
            e = "CAST(NULL AS DOUBLE)" if e is None else r2(e)
        else:
            e = "CAST(NULL AS BIGINT)" if e is None else f"CAST({e} AS BIGINT)"
        out.append(f"{e} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({source})"


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


# ---- sales -----------------------------------------------------------------
def monthly(keys: str, labels: str = "", where: str = "TRUE", table: str = "sales",
            measures: str = "sum(total_sales) AS sales") -> str:
    labels = "".join(f", max({x}) AS {x}" for x in labels.split(",") if x)
    return (f"SELECT {keys}, strftime(date, '%Y-%m') AS month, {measures}{labels} "
            f"FROM {table} WHERE {where} GROUP BY {keys}, strftime(date, '%Y-%m')")


def mom(key: str, monthly_sql: str, condition: str, value: str = "sales") -> str:
    return (f"SELECT *, CASE WHEN previous_{value} > 0 THEN (CAST(previous_{value} AS DOUBLE) - CAST({value} AS DOUBLE))"
            f" / CAST(previous_{value} AS DOUBLE) * 100 ELSE 0 END AS decline FROM ("
            f"SELECT *, lag(month) OVER w AS previous_month, lag({value}) OVER w AS previous_{value},"
            f" max(month) OVER () AS last_month FROM ({monthly_sql}) WINDOW w AS (PARTITION BY {key} ORDER BY month))"
            f" WHERE month = last_month AND previous_{value} IS NOT NULL AND {condition}")


DECLINE_SEVERITY = "CASE WHEN decline >= 40 THEN 'High' ELSE 'Medium' END"
DECLINE_VALUES = dict(
    month="month", previous_month="previous_month", current_sales="sales",
    previous_sales="previous_sales", sales_change_percent="-decline", severity=DECLINE_SEVERITY,
    business_area="'Sales'",
)


def decline_summary(subject: str) -> str:
    return (f"{subject} || ' recorded a ' || {f2('decline')} || '% sales decline in ' || month || "
            f"' compared with ' || previous_month || '.'")


def decline_evidence(more: str = "''") -> str:
    return (f"'Current Month Sales: ' || {inr('sales')} || '; Previous Month Sales: ' || {inr('previous_sales')}"
            f" || '; Sales Decline: ' || {f2('decline')} || '%' || {more}")


STORE_DECLINE = shaped(
    fd.SALES, mom("store_id", monthly("store_id", "store_name,region"), "sales <= previous_sales * 0.80"),
    finding_id="'STORE-DECLINE-' || store_id || '-' || month", analysis_type="'Store Sales Decline'",
    entity_type="'Store'", entity_id="store_id", entity_name="store_name",
    **same("store_id", "store_name", "region"), summary=decline_summary("store_name"),
    evidence=decline_evidence("'; Region: ' || region"), **DECLINE_VALUES)
PRODUCT_DECLINE = shaped(
    fd.SALES, mom("product_id", monthly("product_id", "product_name,category"),
                  "sales <= previous_sales * 0.70 AND previous_sales >= 50000"),
    finding_id="'PRODUCT-DECLINE-' || product_id || '-' || month", analysis_type="'Product Sales Decline'",
    entity_type="'Product'", entity_id="product_id", entity_name="product_name",
    **same("product_id", "product_name", "category"), summary=decline_summary("product_name"),
    evidence=decline_evidence("'; Category: ' || category"), **DECLINE_VALUES)


def named_decline(column: str, kind: str, type_name: str, where: str) -> str:
    return shaped(
        fd.SALES, mom(column, monthly(column, "", where), "sales <= previous_sales * 0.80"),
        finding_id=f"'{kind.upper()}-DECLINE-' || {slug(column)} || '-' || month",
        analysis_type=f"'{type_name}'", entity_type=f"'{kind}'", entity_id=slug(column),
        entity_name=column, **{column: column},
        summary=decline_summary(f"'The ' || {column} || ' {column}'"), evidence=decline_evidence(),
        **DECLINE_VALUES)


def category_decline(where: str = "TRUE") -> str:
    return named_decline("category", "Category", "Category Sales Decline", where)


def regional_decline(where: str = "trim(region) <> ''") -> str:
    return named_decline("region", "Region", "Regional Sales Decline", where)


LATEST_FINANCE = ("SELECT * FROM finance QUALIFY row_number() OVER "
                  "(PARTITION BY store_id ORDER BY month DESC, finance_id) = 1")
LOW_TARGET_SALES = shaped(
    fd.SALES, f"SELECT f.* EXCLUDE (region), s.region FROM ({LATEST_FINANCE}) f LEFT JOIN stores s USING (store_id) "
              "WHERE target_achievement_percent < 70",
    finding_id="'LOW-TARGET-' || store_id || '-' || month", analysis_type="'Low Target Achievement'",
    business_area="'Sales'", severity="CASE WHEN target_achievement_percent < 50 THEN 'High' ELSE 'Medium' END",
    entity_type="'Store'", entity_id="store_id", entity_name="store_name",
    **same("store_id", "store_name", "region", "month", "target_achievement_percent"),
    current_sales="total_revenue", benchmark_value="monthly_sales_target",
    benchmark_label="'Monthly Sales Target'",
    summary=f"store_name || ' achieved only ' || {f2('target_achievement_percent')} || '% of its sales target in ' || month || '.'",
    evidence=f"'Monthly Target: ' || {inr('monthly_sales_target')} || '; Revenue: ' || {inr('total_revenue')} || "
             f"'; Operating Profit: ' || {inr('operating_profit')} || '; Risk Status: ' || risk_status")
UNDERPERFORMANCE = shaped(
    fd.SALES, "SELECT *, CAST(sales AS DOUBLE) / average AS performance FROM (SELECT *, "
              "CAST(sum(sales) OVER c AS DOUBLE) / count(*) OVER c AS average, sum(sales) OVER c AS total, "
              "count(*) OVER c AS product_count FROM (SELECT product_id, category, max(product_name) AS product_name, "
              "strftime(date, '%Y-%m') AS month, sum(total_sales) AS sales FROM sales "
              "WHERE strftime(date, '%Y-%m') = (SELECT max(strftime(date, '%Y-%m')) FROM sales) "
              "GROUP BY product_id, category, month) WINDOW c AS (PARTITION BY category)) "
              "WHERE product_count >= 2 AND sales * product_count <= total * 0.60",
    finding_id="'PRODUCT-UNDERPERFORMANCE-' || product_id || '-' || month",
    analysis_type="'Product Underperformance'", business_area="'Sales'",
    severity="CASE WHEN performance < 0.40 THEN 'High' ELSE 'Medium' END", entity_type="'Product'",
    entity_id="product_id", entity_name="product_name",
    **same("product_id", "product_name", "category", "month"), current_sales="sales",
    benchmark_value="average", benchmark_label="'Latest Category Average Sales'",
    summary=f"product_name || ' achieved only ' || {f2('performance * 100')} || '% of the latest-month average sales for the ' || category || ' category.'",
    evidence=f"'Product Sales: ' || {inr('sales')} || '; Category Average Sales: ' || {inr('average')} || "
             f"'; Product Count in Category: ' || product_count")


def union(*selects: str) -> str:
    return " UNION ALL ".join(f"({s})" for s in selects)


SALES_ALL = union(STORE_DECLINE, PRODUCT_DECLINE, LOW_TARGET_SALES, UNDERPERFORMANCE,
                  category_decline(), regional_decline())

# ---- inventory ---------------------------------------------------------------
COUNTS = ("SELECT store_id, product_id, count(*) AS related_complaints, "
          "count(*) FILTER (severity = 'High') AS high_severity_complaints, "
          "count(*) FILTER (status IN ('Open', 'In Progress')) AS unresolved_complaints, "
          "count(*) FILTER (complaint_type = 'Out of Stock') AS out_of_stock_complaints "
          "FROM complaints GROUP BY store_id, product_id")
SNAPSHOT = ("SELECT i.*, p.is_perishable, v.vendor_name, coalesce(related_complaints, 0) AS related_complaints, "
            "coalesce(high_severity_complaints, 0) AS high_severity_complaints, "
            "coalesce(unresolved_complaints, 0) AS unresolved_complaints, "
            "coalesce(out_of_stock_complaints, 0) AS out_of_stock_complaints, "
            "date_diff('day', i.date, i.expiry_date) AS days_to_expiry, "
            "CAST(current_stock AS DOUBLE) / nullif(i.reorder_level, 0) AS stock_ratio "
            "FROM inventory i JOIN products p USING (product_id) LEFT JOIN vendors v ON i.vendor_id = v.vendor_id "
            f"LEFT JOIN ({COUNTS}) c ON i.store_id = c.store_id AND i.product_id = c.product_id")
STOCK = f"'Current Stock: ' || {f0('current_stock')}"
LEVEL = (f"{STOCK} || '; Reorder Level: ' || {f0('reorder_level')} || '; Stock Ratio: ' || "
         f"{f2('coalesce(stock_ratio, 0) * 100')} || '%'")
DATES = "'Inventory Date: ' || date || '; Expiry Date: ' || expiry_date"
PERISHABLE = "lower(trim(is_perishable)) = 'yes' AND expiry_date IS NOT NULL AND current_stock > 0"
INVENTORY_RULES = {
    "Low Stock": ("stock_status = 'Low Stock'", "CASE WHEN coalesce(stock_ratio, 0) <= 0.25 THEN 'High' ELSE 'Medium' END",
                  "product_name || ' is marked as Low Stock at ' || store_name || '.'",
                  f"{LEVEL} || '; Reorder Required: ' || reorder_required || '; Related Complaints: ' || related_complaints"),
    "Reorder Soon": ("stock_status = 'Reorder Soon'", "'Low'",
                     "product_name || ' is approaching its reorder level at ' || store_name || '.'",
                     f"{LEVEL} || '; Vendor: ' || coalesce(vendor_name, '')"),
    "Overstock": ("stock_status = 'Overstock'", "CASE WHEN coalesce(stock_ratio, 0) >= 5 THEN 'Medium' ELSE 'Low' END",
                  "product_name || ' has excess stock at ' || store_name || '.'",
                  f"{LEVEL} || '; Stock Status: ' || stock_status"),
    "Stockout Risk": ("stock_status = 'Low Stock' AND (stock_ratio <= 0.5 OR related_complaints >= 20)",
                      "CASE WHEN coalesce(stock_ratio, 0) <= 0.25 OR (related_complaints >= 20 AND high_severity_complaints >= 5) THEN 'High' ELSE 'Medium' END",
                      "product_name || ' has a stockout risk at ' || store_name || ' because stock is critically low and may affect customer availability.'",
                      f"{LEVEL} || '; Related Complaints: ' || related_complaints || '; High-Severity Complaints: ' || high_severity_complaints || '; Vendor: ' || coalesce(vendor_name, '')"),
    "Near Expiry Stock": (f"{PERISHABLE} AND days_to_expiry BETWEEN 0 AND 30", "CASE WHEN days_to_expiry <= 7 THEN 'High' ELSE 'Medium' END",
                          "product_name || ' has stock nearing expiry at ' || store_name || '.'",
                          f"{DATES} || '; Days to Expiry: ' || days_to_expiry || '; ' || {STOCK} || '; Perishable: Yes'"),
    "Expired Inventory": (f"{PERISHABLE} AND days_to_expiry < 0", "'High'",
                          "product_name || ' has expired inventory at ' || store_name || '.'",
                          f"{DATES} || '; Days Expired: ' || abs(days_to_expiry) || '; ' || {STOCK} || '; Perishable: Yes'"),
}


def inventory_rule(name: str) -> str:
    where, severity, summary, evidence = INVENTORY_RULES[name]
    return shaped(
        fd.INVENTORY, f"SELECT * FROM ({SNAPSHOT}) WHERE {where}",
        finding_id=f"'{name.upper().replace(' ', '-')}-' || store_id || '-' || product_id || '-' || date",
        analysis_type=f"'{name}'", business_area="'Operations'", severity=severity,
        entity_type="'Store Product'", entity_id="store_id || '-' || product_id", inventory_date="date",
        stock_ratio="coalesce(stock_ratio, 0)", summary=summary, evidence=evidence,
        **same("store_id", "store_name", "product_id", "product_name", "vendor_id", "vendor_name",
               "expiry_date", "days_to_expiry", "current_stock", "reorder_level", "stock_status",
               "reorder_required", "related_complaints", "high_severity_complaints"))


INVENTORY_ALL = union(*[inventory_rule(n) for n in INVENTORY_RULES])

# ---- complaints --------------------------------------------------------------
CASE_COUNTS = ("count(*) AS total_complaints, count(*) FILTER (severity = 'High') AS high_severity_complaints, "
               "count(*) FILTER (status IN ('Open', 'In Progress')) AS unresolved_complaints")


def outlier(key: str, labels: str, k: float) -> str:
    labels = "".join(f", max({x}) AS {x}" for x in labels.split(",") if x)
    return (f"SELECT *, CASE WHEN total_complaints / average >= 2 OR (average_high > 0 AND "
            f"high_severity_complaints / average_high >= 2) THEN 'High' ELSE 'Medium' END AS outlier_severity FROM ("
            f"SELECT *, count(*) OVER () AS n, sum(total_complaints) OVER () AS t, sum(high_severity_complaints) OVER () AS h, "
            f"CAST(t AS DOUBLE) / n AS average, CAST(h AS DOUBLE) / n AS average_high "
            f"FROM (SELECT {key}, {CASE_COUNTS}{labels} FROM complaints GROUP BY {key})) "
            f"WHERE total_complaints * n >= t * {k} OR high_severity_complaints * n >= h * {k}")


VOLUME = dict(business_area="'Customer Support'", severity="outlier_severity", benchmark_value="average",
              **same("total_complaints", "high_severity_complaints", "unresolved_complaints"))


def volume_evidence(label: str, more: str = "''") -> str:
    return ("'Total Complaints: ' || total_complaints || '; High-Severity Complaints: ' || high_severity_complaints || "
            f"'; Open or In-Progress Complaints: ' || unresolved_complaints || '; {label}: ' || {f2('average')} || {more}")


COMPLAINT_PRODUCTS = shaped(
    fd.COMPLAINTS, outlier("product_id", "product_name", 1.5),
    finding_id="'HIGH-COMPLAINT-PRODUCT-' || product_id", analysis_type="'High Complaint Product'",
    entity_type="'Product'", entity_id="product_id", entity_name="product_name",
    **same("product_id", "product_name"), benchmark_label="'Average Complaints per Product'",
    summary="product_name || ' has an unusually high complaint volume compared with other products.'",
    evidence=volume_evidence("Average Complaints per Product"), **VOLUME)


def complaint_stores(k: float) -> str:
    return shaped(
        fd.COMPLAINTS, outlier("store_id", "store_name,region", k),
        finding_id="'HIGH-COMPLAINT-STORE-' || store_id", analysis_type="'High Complaint Store'",
        entity_type="'Store'", entity_id="store_id", entity_name="store_name",
        **same("store_id", "store_name", "region"), benchmark_label="'Average Complaints per Store'",
        summary="store_name || ' has an unusually high complaint burden compared with other stores.'",
        evidence=volume_evidence("Average Complaints per Store", "'; Region: ' || region"), **VOLUME)


def complaint_categories(k: float) -> str:
    return shaped(
        fd.COMPLAINTS, outlier("complaint_type", "", k),
        finding_id=f"'REPEATED-COMPLAINT-CATEGORY-' || {slug('complaint_type')}",
        analysis_type="'Repeated Complaint Category'", entity_type="'Complaint Category'",
        entity_id=slug("complaint_type"), entity_name="complaint_type", **same("complaint_type"),
        benchmark_label="'Average Complaints per Category'",
        summary="complaint_type || ' is a repeatedly occurring complaint category.'",
        evidence=volume_evidence("Average Complaints per Category"), **VOLUME)


AGED = ("SELECT *, date_diff('day', date, (SELECT max(date) FROM complaints)) AS age FROM complaints "
        "WHERE status IN ('Open', 'In Progress')")
CASE = dict(
    business_area="'Customer Support'", severity="CASE WHEN age >= 14 THEN 'High' ELSE 'Medium' END",
    entity_type="'Complaint'", entity_id="complaint_id", entity_name="complaint_type",
    complaint_severity="severity", complaint_status="status", complaint_date="date",
    complaint_age_days="age",
    **same("store_id", "store_name", "product_id", "product_name", "region", "complaint_id", "complaint_type"))
AGE_TEXT = "'Complaint Date: ' || date || '; Age Against Latest Dataset Date: ' || age || ' days; '"
OPEN_HIGH = shaped(
    fd.COMPLAINTS, f"SELECT * FROM ({AGED}) WHERE severity = 'High'",
    finding_id="'OPEN-HIGH-COMPLAINT-' || complaint_id", analysis_type="'Open High-Severity Complaint'",
    summary="'A High-severity ' || complaint_type || ' complaint for ' || product_name || ' at ' || store_name || ' remains ' || status || '.'",
    evidence=f"{AGE_TEXT} || 'Status: ' || status || '; Assigned Employee: ' || assigned_employee_id || '; Recorded Resolution Time: ' || coalesce(resolution_time_days, 0) || ' days'",
    **CASE)
AGEING = shaped(
    fd.COMPLAINTS, f"SELECT * FROM ({AGED}) WHERE age >= 7",
    finding_id="'UNRESOLVED-AGEING-' || complaint_id", analysis_type="'Unresolved Complaint Ageing'",
    summary="'A ' || severity || '-severity complaint for ' || product_name || ' at ' || store_name || ' has remained ' || status || ' for ' || age || ' days relative to the latest dataset date.'",
    evidence=f"{AGE_TEXT} || 'Complaint Severity: ' || severity || '; Status: ' || status || '; Assigned Employee: ' || assigned_employee_id",
    **CASE)
GROWTH = shaped(
    fd.COMPLAINTS,
    "SELECT *, CAST(total_complaints - previous_total_complaints AS DOUBLE) / previous_total_complaints * 100 AS growth FROM ("
    + mom("store_id", monthly("store_id", "store_name,region", table="complaints", measures=CASE_COUNTS),
          "previous_total_complaints > 0 AND total_complaints >= previous_total_complaints * 1.2", "total_complaints") + ")",
    finding_id="'COMPLAINT-GROWTH-' || store_id || '-' || month", analysis_type="'Monthly Complaint Growth'",
    business_area="'Customer Support'", severity="CASE WHEN growth >= 40 THEN 'High' ELSE 'Medium' END",
    entity_type="'Store'", entity_id="store_id", entity_name="store_name",
    **same("store_id", "store_name", "region", "total_complaints", "high_severity_complaints", "unresolved_complaints"),
    monthly_growth_percent="growth", benchmark_value="previous_total_complaints",
    benchmark_label="'Previous Month Complaints (' || previous_month || ')'",
    summary=f"store_name || ' recorded a ' || {f2('growth')} || '% increase in complaints in ' || month || ' compared with ' || previous_month || '.'",
    evidence="'Current Month Complaints: ' || total_complaints || '; Previous Month Complaints: ' || previous_total_complaints || '; High-Severity Complaints: ' || high_severity_complaints || '; Open or In-Progress Complaints: ' || unresolved_complaints")
COMPLAINTS_ALL = union(COMPLAINT_PRODUCTS, complaint_stores(1.5), complaint_categories(1.25),
                       OPEN_HIGH, GROWTH, AGEING)

# ---- vendors and finance -------------------------------------------------------
VENDOR_METRICS = ("count(*) AS delivery_count, count(*) FILTER (delay_days > 0) AS delayed_deliveries, "
                  "count(*) FILTER (received_quantity < ordered_quantity) AS partial_deliveries, "
                  "avg(delay_days) AS average_delay_days, max(delay_days) AS maximum_delay_days, "
                  "CAST(sum(quality_rating) AS DOUBLE) / count(quality_rating) AS average_quality_rating, "
                  "count(*) FILTER (delay_days <= 0) * 100.0::DOUBLE / count(*) AS on_time_delivery_rate")
VENDOR_SNAPSHOT = f"SELECT vendor_id, vendor_name, {VENDOR_METRICS} FROM vendor_deliveries GROUP BY vendor_id, vendor_name"
FINANCE_SNAPSHOT = (f"SELECT *, CASE WHEN total_revenue > 0 THEN CAST(operating_profit AS DOUBLE) * 100 / CAST(total_revenue AS DOUBLE) "
                    f"ELSE 0 END AS operating_profit_margin_percent FROM ({LATEST_FINANCE})")
DELAY = f"'Average Delay: ' || {f2('average_delay_days')} || ' days'"
VENDOR_RULES = {
    "Repeated Vendor Delays": ("average_delay_days >= 5 OR delayed_deliveries >= 3", "VENDOR-DELAY-",
        "CASE WHEN average_delay_days >= 10 OR maximum_delay_days >= 15 OR on_time_delivery_rate < 50 THEN 'High' ELSE 'Medium' END",
        "vendor_name || ' has repeated delivery delays that may disrupt inventory replenishment.'",
        f"'Delivery Count: ' || delivery_count || '; Delayed Deliveries: ' || delayed_deliveries || '; ' || {DELAY} || '; Maximum Delay: ' || {f0('maximum_delay_days')} || ' days; On-Time Delivery Rate: ' || {pct('on_time_delivery_rate')}"),
    "Partial Vendor Deliveries": ("partial_deliveries >= 2", "PARTIAL-DELIVERY-",
        "CASE WHEN partial_deliveries >= 3 THEN 'High' ELSE 'Medium' END",
        "vendor_name || ' has repeated partial deliveries, which may create inventory availability risk.'",
        f"'Delivery Count: ' || delivery_count || '; Partial Deliveries: ' || partial_deliveries || '; Delayed Deliveries: ' || delayed_deliveries || '; ' || {DELAY}"),
    "Low Vendor Quality Rating": ("average_quality_rating < 3.5", "LOW-VENDOR-QUALITY-",
        "CASE WHEN average_quality_rating < 3 THEN 'High' ELSE 'Medium' END",
        "vendor_name || ' has a below-threshold average quality rating.'",
        f"'Average Quality Rating: ' || {f2('average_quality_rating')} || ' out of 5; Delivery Count: ' || delivery_count || '; Partial Deliveries: ' || partial_deliveries || '; ' || {DELAY}"),
    "Low On-Time Delivery Rate": ("on_time_delivery_rate < 70", "LOW-ON-TIME-RATE-",
        "CASE WHEN on_time_delivery_rate < 50 THEN 'High' ELSE 'Medium' END",
        "vendor_name || ' has a low on-time delivery rate.'",
        f"'On-Time Delivery Rate: ' || {pct('on_time_delivery_rate')} || '; Delayed Deliveries: ' || delayed_deliveries || '; Delivery Count: ' || delivery_count || '; ' || {DELAY}"),
}
MONEY = f"'Revenue: ' || {inr('total_revenue')} || '; Operating Profit: ' || {inr('operating_profit')}"
MARGIN = f"'; Operating Profit Margin: ' || {pct('operating_profit_margin_percent')}"
TARGET = f"'; Target Achievement: ' || {pct('target_achievement_percent')}"
RISK = "'; Risk Status: ' || risk_status"
FINANCE_RULES = {
    "Low Operating Profit": ("operating_profit >= 0 AND operating_profit_margin_percent < 10", "LOW-PROFIT-",
        "CASE WHEN operating_profit_margin_percent < 5 THEN 'High' ELSE 'Medium' END",
        "store_name || ' has a low operating-profit margin in ' || month || '.'", f"{MONEY} || {MARGIN} || {TARGET}"),
    "Loss-Making Store": ("operating_profit < 0", "LOSS-MAKING-", "'High'",
        "store_name || ' recorded an operating loss in ' || month || '.'", f"{MONEY} || {MARGIN} || {RISK}"),
    "Low Target Achievement": ("target_achievement_percent < 70", "LOW-TARGET-",
        "CASE WHEN target_achievement_percent < 50 THEN 'High' ELSE 'Medium' END",
        f"store_name || ' achieved only ' || {f2('target_achievement_percent')} || '% of its target in ' || month || '.'",
        f"{MONEY} || {TARGET} || {RISK}"),
    "High Financial Risk": ("lower(trim(risk_status)) = 'high risk'", "HIGH-FINANCIAL-RISK-", "'High'",
        "store_name || ' is classified as High Risk in the finance report for ' || month || '.'",
        f"{MONEY} || {MARGIN} || {TARGET} || {RISK}"),
}


def vendor_rule(name: str) -> str:
    where, prefix, severity, summary, evidence = VENDOR_RULES[name]
    return shaped(
        fd.VENDOR_FINANCE, f"SELECT * FROM ({VENDOR_SNAPSHOT}) WHERE {where}",
        finding_id=f"'{prefix}' || vendor_id", analysis_type=f"'{name}'", business_area="'Procurement'",
        severity=severity, entity_type="'Vendor'", entity_id="vendor_id", entity_name="vendor_name",
        summary=summary, evidence=evidence,
        **same("vendor_id", "vendor_name", "delivery_count", "delayed_deliveries", "partial_deliveries",
               "average_delay_days", "maximum_delay_days", "average_quality_rating", "on_time_delivery_rate"))


def finance_rule(name: str) -> str:
    where, prefix, severity, summary, evidence = FINANCE_RULES[name]
    return shaped(
        fd.VENDOR_FINANCE, f"SELECT * FROM ({FINANCE_SNAPSHOT}) WHERE {where}",
        finding_id=f"'{prefix}' || store_id || '-' || month", analysis_type=f"'{name}'",
        business_area="'Finance'", severity=severity, entity_type="'Store'", entity_id="store_id",
        entity_name="store_name", summary=summary, evidence=evidence,
        **same("store_id", "store_name", "month", "total_revenue", "operating_profit",
               "operating_profit_margin_percent", "target_achievement_percent", "risk_status"))


VENDOR_ALL = union(*[vendor_rule(n) for n in VENDOR_RULES])
FINANCE_ALL = union(*[finance_rule(n) for n in FINANCE_RULES])

# ---- combined first-generation detector ------------------------------------------
def legacy(source: str, score: str, issue_id: str, issue_type: str, area: str, entity_type: str,
           entity_id: str, title: str, description: str, evidence: str) -> str:
    return (f"SELECT {issue_id} AS issue_id, '{issue_type}' AS issue_type, '{area}' AS business_area, "
            f"CASE WHEN score >= 85 THEN 'High' WHEN score >= 65 THEN 'Medium' ELSE 'Low' END AS priority, "
            f"{r2('score')} AS priority_score, '{entity_type}' AS entity_type, {entity_id} AS entity_id, "
            f"{title} AS issue_title, {description} AS issue_description, {evidence} AS evidence, "
            f"'New' AS status, 'Rule-Based Analytics Engine' AS detection_source, '{DETECTED}' AS detected_at "
            f"FROM (SELECT *, {score} AS score FROM ({source}))")


def n2(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


LEGACY_FINANCE = legacy(
    f"SELECT * FROM ({LATEST_FINANCE}) WHERE risk_status = 'High Risk' OR target_achievement_percent < 70 OR operating_profit < 0",
    "least(82.0::DOUBLE + CASE WHEN target_achievement_percent < 70 THEN 8 ELSE 0 END + CASE WHEN operating_profit < 0 THEN 10 ELSE 0 END, 100)",
    "'FIN-' || store_id || '-' || month", "Financial Risk", "Finance", "Store", "store_id",
    "'High financial risk at ' || store_name",
    f"store_name || ' has a high financial risk in ' || month || '. The store achieved only ' || {f2('target_achievement_percent')} || '% of its monthly sales target.'",
    f"'Revenue: ' || {n2('total_revenue')} || '; Operating Profit: ' || {n2('operating_profit')} || '; Target Achievement: ' || {f2('target_achievement_percent')} || '%; Risk Status: ' || risk_status")
LEGACY_SALES = legacy(
    mom("store_id", monthly("store_id, store_name"), "sales < previous_sales * 0.70"),
    "least(70 + decline * 0.70::DOUBLE, 95)", "'SALES-' || store_id || '-' || month", "Sales Decline", "Sales",
    "Store", "store_id", "'Major sales decline at ' || store_name",
    f"store_name || ' recorded a ' || {f2('decline')} || '% sales decline in ' || month || ' compared with the previous month.'",
    f"'Current Month Sales: ' || {n2('sales')} || '; Previous Month Sales: ' || {n2('previous_sales')} || '; Sales Decline: ' || {f2('decline')} || '%'")
LEGACY_INVENTORY = legacy(
    f"SELECT *, coalesce(stock_ratio, 1) AS ratio FROM ({SNAPSHOT}) WHERE stock_status = 'Low Stock' AND "
    "(ratio <= 0.5 OR (related_complaints >= 20 AND high_severity_complaints >= 5))",
    "least(45 + greatest(0, (0.80::DOUBLE - ratio) * 20) + least(related_complaints * 0.20::DOUBLE, 12) + "
    "least(high_severity_complaints * 0.75::DOUBLE, 12) + CASE WHEN ratio <= 0.25 THEN 7 ELSE 0 END, 90)",
    "'INV-' || store_id || '-' || product_id || '-' || date", "Inventory Stock Risk", "Operations", "Store Product",
    "store_id || '-' || product_id", "'Low-stock risk: ' || product_name || ' at ' || store_name",
    "product_name || ' has a low-stock operational risk at ' || store_name || '. The issue may affect customer service because the product is linked with customer complaints.'",
    f"{STOCK} || '; Reorder Level: ' || {f0('reorder_level')} || '; Stock Ratio: ' || {f2('ratio * 100')} || '%; Related Complaints: ' || related_complaints || '; High-Severity Complaints: ' || high_severity_complaints")


def legacy_hotspots(k: float) -> str:
    return legacy(
        f"SELECT *, CAST(t AS DOUBLE) / n AS average, CAST(h AS DOUBLE) / n AS average_high, CAST(u AS DOUBLE) / n AS average_open FROM ("
        f"SELECT *, count(*) OVER () AS n, sum(total_complaints) OVER () AS t, sum(high_severity_complaints) OVER () AS h, "
        f"sum(unresolved_complaints) OVER () AS u FROM (SELECT store_id, store_name, {CASE_COUNTS} FROM complaints GROUP BY store_id, store_name)) "
        f"WHERE total_complaints * n >= t * {k} OR high_severity_complaints * n >= h * {k} OR unresolved_complaints * n >= u * {k}",
        "least(65 + least(greatest(total_complaints / average - 1, 0) * 20, 15) + least(greatest(CASE WHEN average_high > 0 THEN high_severity_complaints / average_high ELSE 0 END - 1, 0) * 15, 10) + "
        "least(greatest(CASE WHEN average_open > 0 THEN unresolved_complaints / average_open ELSE 0 END - 1, 0) * 10, 5), 95)",
        "'COMP-' || store_id", "Customer Complaint Hotspot", "Customer Support", "Store", "store_id",
        "'Customer complaint hotspot at ' || store_name",
        "store_name || ' has a significantly higher complaint burden than the average store.'",
        f"'Total Complaints: ' || total_complaints || '; High-Severity Complaints: ' || high_severity_complaints || '; Open or In-Progress Complaints: ' || unresolved_complaints || '; Average Store Complaints: ' || {f2('average')}")


LEGACY_VENDOR = legacy(
    f"SELECT * FROM ({VENDOR_SNAPSHOT}) WHERE average_delay_days >= 5 OR delayed_deliveries >= 3 OR average_quality_rating < 3.5",
    "least(55 + least(average_delay_days * 4, 20) + least(maximum_delay_days * 1.5::DOUBLE, 15) + least(delayed_deliveries * 2, 10) + "
    "CASE WHEN average_quality_rating < 3.5 THEN 8 ELSE 0 END, 100)",
    "'VENDOR-' || vendor_id", "Vendor Performance Risk", "Procurement", "Vendor", "vendor_id",
    "'Vendor delivery risk: ' || vendor_name",
    "vendor_name || ' shows delivery-performance risk due to recurring delays and/or below-expected quality ratings.'",
    f"'Delivery Count: ' || delivery_count || '; Average Delay: ' || {f2('average_delay_days')} || ' days; Maximum Delay: ' || {f0('maximum_delay_days')} || ' days; Delayed Deliveries: ' || delayed_deliveries || '; Average Quality Rating: ' || {f2('average_quality_rating')}")
LEGACY_ALL = union(LEGACY_FINANCE, LEGACY_SALES, LEGACY_INVENTORY, legacy_hotspots(1.5), LEGACY_VENDOR)

INV_VIEWS = ["inventory", "products", "vendors", "complaints"]
SLIM = "finding_id, analysis_type, severity, entity_id"

ORACLE: dict[str, str] = {
    "store_sales_decline": with_views(["sales"], STORE_DECLINE),
    "product_sales_decline": with_views(["sales"], PRODUCT_DECLINE),
    "category_sales_decline": with_views(["sales"], category_decline("TRUE")),
    "regional_sales_decline": with_views(["sales"], regional_decline("trim(region) <> ''")),
    "low_target_achievement": with_views(["finance"], LOW_TARGET_SALES),
    "product_underperformance": with_views(["sales"], UNDERPERFORMANCE),
    "sales_findings": with_views(["finance"], SALES_ALL),
    "inventory_snapshot": with_views(INV_VIEWS, "SELECT inventory_id, date, store_id, store_name, product_id, product_name, vendor_id, vendor_name, current_stock, reorder_level, stock_status, reorder_required, is_perishable, expiry_date, CAST(days_to_expiry AS INTEGER) AS days_to_expiry, related_complaints, high_severity_complaints, stock_ratio FROM (" + SNAPSHOT + ")"),
    "low_stock": with_views(INV_VIEWS, inventory_rule("Low Stock")),
    "reorder_soon": with_views(INV_VIEWS, inventory_rule("Reorder Soon")),
    "overstock": with_views(INV_VIEWS, inventory_rule("Overstock")),
    "stockout_risk": with_views(INV_VIEWS, inventory_rule("Stockout Risk")),
    "near_expiry": with_views(INV_VIEWS, inventory_rule("Near Expiry Stock")),
    "expired_inventory": with_views(INV_VIEWS, inventory_rule("Expired Inventory")),
    "inventory_findings": with_views(INV_VIEWS, INVENTORY_ALL),
    "latest_finance": with_views(["finance"], LATEST_FINANCE),
    "vendor_snapshot": with_views(["vendor_deliveries"], VENDOR_SNAPSHOT),
    "repeated_vendor_delays": with_views(["vendor_deliveries"], vendor_rule("Repeated Vendor Delays")),
    "partial_deliveries": with_views(["vendor_deliveries"], vendor_rule("Partial Vendor Deliveries")),
    "low_vendor_quality": with_views(["vendor_deliveries"], vendor_rule("Low Vendor Quality Rating")),
    "low_on_time_rate": with_views(["vendor_deliveries"], vendor_rule("Low On-Time Delivery Rate")),
    "operating_margin": with_views(["finance"], f"SELECT store_id, month, total_revenue, operating_profit, operating_profit_margin_percent FROM ({FINANCE_SNAPSHOT})"),
    "low_operating_profit": with_views(["finance"], finance_rule("Low Operating Profit")),
    "loss_making_stores": with_views(["finance"], finance_rule("Loss-Making Store")),
    "low_target_finance": with_views(["finance"], finance_rule("Low Target Achievement")),
    "high_financial_risk": with_views(["finance"], finance_rule("High Financial Risk")),
    "vendor_findings": with_views(["vendor_deliveries"], VENDOR_ALL),
    "finance_findings": with_views(["finance"], FINANCE_ALL),
    "vendor_finance_findings": with_views(["vendor_deliveries", "finance"], union(VENDOR_ALL, FINANCE_ALL)),
    "high_complaint_products": with_views(["complaints"], COMPLAINT_PRODUCTS),
    "high_complaint_stores": with_views(["complaints"], complaint_stores(1.1)),
    "repeated_complaint_category": with_views(["complaints"], complaint_categories(1.01)),
    "open_high_severity_complaints": with_views(["complaints"], OPEN_HIGH),
    "monthly_complaint_growth": with_views(["complaints"], GROWTH),
    "complaint_growth_last_full_month": with_views(["complaints"], GROWTH.replace("FROM complaints", "FROM (SELECT * FROM complaints WHERE date < DATE '2001-08-01')")),
    "unresolved_complaint_ageing": with_views(["complaints"], AGEING),
    "complaint_findings": with_views(["complaints"], COMPLAINTS_ALL),
    "combined_financial_risk": with_views(["finance"], LEGACY_FINANCE),
    "combined_sales_decline": with_views(["sales"], LEGACY_SALES),
    "combined_critical_inventory": with_views(INV_VIEWS, LEGACY_INVENTORY),
    "combined_complaint_hotspots": with_views(["complaints"], legacy_hotspots(1.1)),
    "combined_vendor_risk": with_views(["vendor_deliveries"], LEGACY_VENDOR),
    "combined_issues": with_views(["finance", *INV_VIEWS, "vendor_deliveries"], LEGACY_ALL),
    "combined_priority_summary": with_views(["finance", *INV_VIEWS, "vendor_deliveries"], f"SELECT priority, count(*) AS issue_count FROM ({LEGACY_ALL}) GROUP BY priority"),
}
