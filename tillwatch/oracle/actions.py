"""SQL cross-checks of root causes, recommendations, workflow and brief."""

from __future__ import annotations

from tillwatch.oracle.detectors import VENDOR_METRICS, COUNTS
from tillwatch.oracle.issues import EVIDENCE, FINALISTS, FULL, ISSUES, PICKS, PREVIOUS, check
from tillwatch.oracle.reports import KPI_TABLE
from tillwatch.oracle.views import d, f0, f2, inr, r2, sev, with_views
from tillwatch.operators.recommend import TEMPLATES

CASES = ("count(*) AS total_complaints, count(*) FILTER (severity = 'High') AS high_severity_complaints, "
         "count(*) FILTER (status IN ('Open', 'In Progress')) AS unresolved_complaints")
OUT = "count(*) FILTER (complaint_type = 'Out of Stock') AS out_of_stock_complaints"


def periods(history: str, keys: str) -> str:
    """Rows under their month and the last one also under 'latest'."""
    return (f"SELECT *, month AS period FROM ({history}) UNION ALL SELECT *, 'latest' FROM ({history}) "
            f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY month DESC) = 1")


FINANCE = periods("SELECT store_id, store_name, month, total_revenue, operating_expense, operating_profit, target_achievement_percent, risk_status, "
                  "lag(month) OVER w AS previous_month, lag(total_revenue) OVER w AS previous_revenue, lag(operating_profit) OVER w AS previous_operating_profit "
                  "FROM finance WINDOW w AS (PARTITION BY store_id ORDER BY month)", "store_id")
MONTH = "strftime(date, '%Y-%m')"
STORE_SALES = periods(f"SELECT *, lag(month) OVER w AS previous_month, lag(monthly_sales) OVER w AS previous_sales FROM (SELECT store_id, store_name, {MONTH} AS month, "
                      "sum(total_sales) AS monthly_sales, sum(profit) AS monthly_profit FROM sales GROUP BY ALL) WINDOW w AS (PARTITION BY store_id ORDER BY month)", "store_id")
CATEGORY = (f"SELECT store_id, p.month, category, sum(CASE WHEN {MONTH} = p.month THEN total_sales ELSE 0 END) AS current_sales, "
            f"sum(CASE WHEN {MONTH} = p.before THEN total_sales ELSE 0 END) AS previous_sales FROM sales JOIN (SELECT store_id, month, "
            f"lag(month) OVER (PARTITION BY store_id ORDER BY month) AS before FROM (SELECT DISTINCT store_id, {MONTH} AS month FROM sales)) p USING (store_id) "
            f"WHERE p.before IS NOT NULL AND {MONTH} IN (p.month, p.before) GROUP BY store_id, p.month, category "
            "QUALIFY row_number() OVER (PARTITION BY store_id, p.month ORDER BY current_sales - previous_sales, category) = 1")
STOCK_COUNTS = ("SELECT store_id, count(*) FILTER (stock_status = 'Low Stock') AS low_stock_items, count(*) FILTER (stock_status = 'Reorder Soon') AS reorder_soon_items, "
                "count(*) FILTER (stock_status = 'Overstock') AS overstock_items FROM inventory GROUP BY store_id")
STORE_CASES = (f"SELECT store_id, {MONTH} AS period, {CASES} FROM complaints GROUP BY ALL UNION ALL SELECT store_id, 'all', {CASES} FROM complaints GROUP BY ALL")
VENDORS = f"SELECT vendor_id, max(vendor_name) AS vendor_name, {VENDOR_METRICS} FROM vendor_deliveries GROUP BY vendor_id"


def ranked(select: str, group: str, table: str, partition: str, order: str) -> str:
    return (f"SELECT *, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS INTEGER) AS position FROM (SELECT {select} FROM {table} GROUP BY {group}) "
            "QUALIFY position <= 3")


AFFECTED = ranked("vendor_id, store_name, count(*) AS delivery_count, avg(delay_days) AS average_delay_days, max(delay_days) AS maximum_delay_days",
                  "vendor_id, store_name", "vendor_deliveries", "vendor_id", "average_delay_days DESC, maximum_delay_days DESC, store_name")
TYPES = ranked("store_id, complaint_type, count(*) AS complaint_count, count(*) FILTER (severity = 'High') AS high_severity_complaints, "
               "count(*) FILTER (status IN ('Open', 'In Progress')) AS unresolved_complaints", "store_id, complaint_type", "complaints", "store_id",
               "complaint_count DESC, high_severity_complaints DESC, complaint_type")
PRODUCTS = ranked("store_id, product_id, max(product_name) AS product_name, count(*) AS complaint_count, count(*) FILTER (severity = 'High') AS high_severity_complaints",
                  "store_id, product_id", "complaints", "store_id", "complaint_count DESC, high_severity_complaints DESC, product_id")
PRODUCT_CASES = (f"SELECT product_id, store_id AS store_key, max(product_name) AS product_name, {CASES}, {OUT} FROM complaints GROUP BY product_id, store_id "
                 f"UNION ALL SELECT product_id, 'all', max(product_name), {CASES}, {OUT} FROM complaints GROUP BY product_id")
BOTH = (f"SELECT product_id, store_id AS store_key, max(product_name) AS product_name, max(category) AS category, {MONTH} AS month, sum(total_sales) AS monthly_sales, "
        f"sum(profit) AS monthly_profit FROM sales GROUP BY product_id, store_id, {MONTH} UNION ALL SELECT product_id, 'all', max(product_name), max(category), {MONTH}, "
        f"sum(total_sales), sum(profit) FROM sales GROUP BY product_id, {MONTH}")
PRODUCT_SALES = periods(f"SELECT *, lag(month) OVER w AS previous_month, lag(monthly_sales) OVER w AS previous_sales FROM ({BOTH}) "
                        "WINDOW w AS (PARTITION BY product_id, store_key ORDER BY month)", "product_id, store_key")
CATEGORIES = f"SELECT complaint_type, {CASES}, count(DISTINCT store_id) AS affected_store_count, count(DISTINCT product_id) AS affected_product_count FROM complaints GROUP BY complaint_type"
STOCK = ("SELECT i.*, v.vendor_name, coalesce(related_complaints, 0) AS related_complaints, coalesce(c.high_severity_complaints, 0) AS high_severity_complaints, "
         "coalesce(c.unresolved_complaints, 0) AS unresolved_complaints, coalesce(out_of_stock_complaints, 0) AS out_of_stock_complaints "
         f"FROM inventory i LEFT JOIN vendors v ON i.vendor_id = v.vendor_id LEFT JOIN ({COUNTS}) c ON i.store_id = c.store_id AND i.product_id = c.product_id")


def change(now: str, before: str) -> str:
    return f"coalesce(CASE WHEN {before} > 0 THEN ({d(now)} - {d(before)}) / {d(before)} * 100 END, 0)"


def factors(*parts: str) -> str:
    return f"coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), 'Available data did not identify a stronger contributing factor.')"


def when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"


NONE = "Available data did not identify a stronger contributing factor."
RATIO = "(CAST(current_stock AS DOUBLE) / reorder_level * 100)"
MARGIN = "CASE WHEN f.total_revenue > 0 THEN CAST(f.operating_profit AS DOUBLE) / CAST(f.total_revenue AS DOUBLE) * 100 ELSE 0 END"
REV, DEC, CAT = change("f.total_revenue", "f.previous_revenue"), f"-({change('s.monthly_sales', 's.previous_sales')})", f"-({change('c.current_sales', 'c.previous_sales')})"
PER = "coalesce(nullif(i.period_label, ''), 'latest')"
STORE_RCA = f"""SELECT issue_id, {factors(
    when("f.target_achievement_percent < 70", f"'Target achievement was only ' || {f2('f.target_achievement_percent')} || '% in ' || f.month || '.'"),
    when(f"{REV} < 0", f"'Revenue declined by ' || {f2(f'abs({REV})')} || '% from ' || coalesce(f.previous_month, 'the previous period') || '.'"),
    when(f"f.month IS NOT NULL AND {MARGIN} < 10", f"'Operating profit margin was only ' || {f2(MARGIN)} || '%.'"),
    when("f.operating_expense > 0", f"'Operating expenses were ' || {inr('f.operating_expense')} || '.'"),
    when(f"{DEC} > 0", f"'Store sales declined by ' || {f2(DEC)} || '% compared with ' || coalesce(s.previous_month, 'the previous period') || '.'"),
    when(f"{CAT} > 0", f"c.category || ' was the largest declining category, falling by ' || {f2(CAT)} || '%.'"),
    when("low_stock_items > 0 OR reorder_soon_items > 0", "'The store has ' || low_stock_items || ' Low Stock and ' || reorder_soon_items || ' Reorder Soon inventory records.'"),
    when("total_complaints > 0", "total_complaints || ' complaints were recorded in ' || coalesce(f.month, nullif(i.period_label, ''), 'the selected period') || ', including ' || high_severity_complaints || ' High-severity cases.'"))} AS contributing_factors,
 coalesce(nullif(concat_ws(' ', CASE WHEN f.month IS NOT NULL THEN 'Revenue: ' || {inr('f.total_revenue')} || '; Operating Profit: ' || {inr('f.operating_profit')} || '; Target Achievement: ' || {f2('f.target_achievement_percent')} || '%; Risk Status: ' || f.risk_status || '.' END,
  CASE WHEN s.month IS NOT NULL THEN 'Store Sales: ' || {inr('s.monthly_sales')} || ' for ' || s.month || '.' END), ''), 'Store-level finance and sales context was not available.') AS evidence_summary
FROM issues i LEFT JOIN c_finance f ON f.store_id = i.store_id AND f.period = {PER} LEFT JOIN c_sales s ON s.store_id = i.store_id AND s.period = {PER}
 LEFT JOIN c_category c ON c.store_id = i.store_id AND c.month = coalesce(s.month, f.month, nullif(i.period_label, ''))
 LEFT JOIN c_stock k ON k.store_id = i.store_id LEFT JOIN c_cases n ON n.store_id = i.store_id AND n.period = coalesce(f.month, nullif(i.period_label, ''), 'all')
WHERE i.issue_type = 'Store Performance Risk'"""
STOCK_LINE = f"'Current stock is ' || {f0('current_stock')} || ' units against a reorder level of ' || {f0('reorder_level')} || ' units (' || {f2(RATIO)}"
STOCK_RCA = f"""SELECT issue_id, {factors(
    f"{STOCK_LINE} || '% of the reorder level).'",
    when("related_complaints > 0", "'The product is linked to ' || related_complaints || ' complaints, including ' || high_severity_complaints || ' High-severity cases.'"),
    when("unresolved_complaints > 0", "unresolved_complaints || ' related complaints remain Open or In Progress.'"),
    when("out_of_stock_complaints > 0", "out_of_stock_complaints || ' related complaints are categorized as Out of Stock.'"),
    when("average_delay_days >= 3 OR delayed_deliveries >= 2", f"'Supplier ' || coalesce(k.vendor_name, '') || ' has an average delay of ' || {f2('average_delay_days')} || ' days across ' || delayed_deliveries || ' delayed deliveries.'"),
    when("maximum_delay_days >= 10", f"'The supplier''s maximum observed delay is ' || {f0('maximum_delay_days')} || ' days.'"),
    when("partial_deliveries > 0", "'The supplier has ' || partial_deliveries || ' partial deliveries.'"),
    when("on_time_delivery_rate < 70", f"'Supplier on-time delivery rate is only ' || {f2('on_time_delivery_rate')} || '%.'"))},
 'Store: ' || k.store_name || '; Product: ' || k.product_name || '; Stock Status: ' || stock_status || '; Current Stock: ' || {f0('current_stock')} || '; Reorder Level: ' || {f0('reorder_level')} || '; Related Complaints: ' || related_complaints || '.'
FROM issues i JOIN c_product_stock k ON k.store_id = i.store_id AND k.product_id = i.product_id LEFT JOIN c_vendors v ON v.vendor_id = k.vendor_id
WHERE i.issue_type = 'Product Availability Risk'"""
VENDOR_RCA = f"""SELECT issue_id, {factors(
    when("v.average_delay_days > 0", f"'Average delivery delay is ' || {f2('v.average_delay_days')} || ' days.'"),
    when("v.maximum_delay_days > 0", f"'Maximum observed delivery delay is ' || {f0('v.maximum_delay_days')} || ' days.'"),
    when("delayed_deliveries > 0", "delayed_deliveries || ' deliveries were delayed.'"),
    when("partial_deliveries > 0", "partial_deliveries || ' deliveries were partial.'"),
    when("on_time_delivery_rate < 70", f"'On-time delivery rate is only ' || {f2('on_time_delivery_rate')} || '%.'"),
    when("average_quality_rating < 4", f"'Average quality rating is ' || {f2('average_quality_rating')} || ' out of 5.'"),
    f"'The most affected store is ' || a.store_name || ', where the average delay is ' || {f2('a.average_delay_days')} || ' days.'")},
 'Vendor: ' || vendor_name || '; Delivery Count: ' || v.delivery_count || '; Average Delay: ' || {f2('v.average_delay_days')} || ' days; Maximum Delay: ' || {f0('v.maximum_delay_days')} || ' days; On-Time Delivery Rate: ' || {f2('on_time_delivery_rate')} || '%; Average Quality Rating: ' || {f2('average_quality_rating')} || '.'
FROM issues i JOIN c_vendors v USING (vendor_id) JOIN c_affected a ON a.vendor_id = i.vendor_id AND a.position = 1 WHERE i.issue_type = 'Vendor Performance Risk'"""
BACKLOG_RCA = f"""SELECT issue_id, {factors(
    when("n.unresolved_complaints > 0", "n.unresolved_complaints || ' complaints are Open or In Progress.'"),
    when("n.high_severity_complaints > 0", "n.high_severity_complaints || ' complaints are High severity.'"),
    "'The largest complaint category is ' || t.complaint_type || ' with ' || t.complaint_count || ' cases.'",
    "'The most frequently complained-about product is ' || p.product_name || ' with ' || p.complaint_count || ' cases.'",
    when("low_stock_items > 0 OR reorder_soon_items > 0", "'The store has ' || low_stock_items || ' Low Stock and ' || reorder_soon_items || ' Reorder Soon records, which may be contributing to service-related complaints.'"))},
 'Total Complaints: ' || n.total_complaints || '; High-Severity Complaints: ' || n.high_severity_complaints || '; Open or In-Progress Complaints: ' || n.unresolved_complaints || '.'
FROM issues i JOIN c_cases n ON n.store_id = i.store_id AND n.period = 'all' LEFT JOIN c_types t ON t.store_id = i.store_id AND t.position = 1
 LEFT JOIN c_products p ON p.store_id = i.store_id AND p.position = 1 LEFT JOIN c_stock k ON k.store_id = i.store_id WHERE i.issue_type = 'Complaint Resolution Backlog'"""
PRODUCT_CASE_RCA = f"""SELECT issue_id, {factors(
    "'The product has ' || total_complaints || ' complaints, including ' || high_severity_complaints || ' High-severity cases.'",
    when("unresolved_complaints > 0", "unresolved_complaints || ' product-related complaints remain Open or In Progress.'"),
    when("out_of_stock_complaints > 0", "out_of_stock_complaints || ' cases are categorized as Out of Stock.'"))},
 'Product: ' || product_name || '; Total Complaints: ' || total_complaints || '; High-Severity Complaints: ' || high_severity_complaints || '; Unresolved Complaints: ' || unresolved_complaints || '.'
FROM issues i JOIN c_product_cases p ON p.product_id = i.product_id AND store_key = 'all' WHERE i.issue_type = 'Product Complaint Risk'"""
PCH = change("monthly_sales", "previous_sales")
PRODUCT_SALES_RCA = f"""SELECT issue_id, coalesce(nullif({factors(
    when(f"{PCH} < 0", f"'Product sales declined by ' || {f2(f'abs({PCH})')} || '% in ' || month || ' compared with ' || coalesce(previous_month, 'the prior period') || '.'"))}, ''), '{NONE}'),
 'Product: ' || product_name || '; Category: ' || category || '; Current Sales: ' || {inr('monthly_sales')} || '; Previous Sales: ' || {inr('coalesce(previous_sales, 0)')} || '.'
FROM issues i JOIN c_product_sales p ON p.product_id = i.product_id AND store_key = 'all' AND p.period = {PER} WHERE i.issue_type = 'Product Sales Performance Risk'"""
OVERSTOCK_RCA = f"""SELECT issue_id, {factors(
    f"{STOCK_LINE} || '% of reorder level).'",
    when(f"month IS NOT NULL AND {PCH} <= 0", f"'Product sales changed by ' || {f2(PCH)} || '% versus the previous period, suggesting inventory may be outpacing demand.'"))},
 'Store: ' || k.store_name || '; Product: ' || k.product_name || '; Stock Status: ' || stock_status || '; Current Stock: ' || {f0('current_stock')} || '; Reorder Level: ' || {f0('reorder_level')} || '.'
FROM issues i JOIN c_product_stock k ON k.store_id = i.store_id AND k.product_id = i.product_id
 LEFT JOIN c_product_sales p ON p.product_id = i.product_id AND p.store_key = i.store_id AND p.period = 'latest' WHERE i.issue_type = 'Inventory Overstock Risk'"""
CATEGORY_RCA = f"""SELECT issue_id, {factors(
    "complaint_type || ' appears in ' || total_complaints || ' complaints across ' || affected_store_count || ' stores and ' || affected_product_count || ' products.'",
    when("high_severity_complaints > 0", "high_severity_complaints || ' cases are High severity.'"),
    when("unresolved_complaints > 0", "unresolved_complaints || ' cases are Open or In Progress.'"))},
 'Complaint Category: ' || complaint_type || '; Total Cases: ' || total_complaints || '; High-Severity Cases: ' || high_severity_complaints || '; Unresolved Cases: ' || unresolved_complaints || '.'
FROM issues i JOIN c_categories c ON c.complaint_type = i.entity_id WHERE i.issue_type = 'Repeated Complaint Category Risk'"""
RCA_TEXT = " UNION ALL ".join([STORE_RCA, STOCK_RCA, VENDOR_RCA, BACKLOG_RCA, PRODUCT_CASE_RCA, PRODUCT_SALES_RCA, OVERSTOCK_RCA, CATEGORY_RCA])
# issue type -> category, summary, focus, confidence bonus
RULES = {
    "Store Performance Risk": ("Multi-Factor Store Performance Deterioration", "Likely multi-factor deterioration involving sales, financial, inventory, and customer-experience conditions.",
        "Review declining categories, local sales execution, inventory availability, customer complaints, discounting practices, and operating-cost drivers.", 3),
    "Product Availability Risk": ("Inventory Replenishment and Supply Risk", "Likely inventory replenishment failure because available stock is materially below the operational reorder requirement.",
        "Review the latest purchase order, vendor delivery status, sales velocity, stock-transfer availability, and replenishment approval process.", 5),
    "Vendor Performance Risk": ("Vendor Reliability and Fulfilment Risk", "Likely supplier reliability issue involving delayed, incomplete, or inconsistent deliveries.",
        "Review service-level agreement compliance, purchase-order planning, supplier capacity, product quality checks, and backup supplier availability.", 4),
    "Complaint Resolution Backlog": ("Customer Support Resolution and Escalation Backlog", "Likely delay in complaint resolution, escalation handling, or support-capacity management.",
        "Review backlog ownership, ageing cases, frontline escalation, main complaint categories, and store-manager resolution workflow.", 0),
    "Product Complaint Risk": ("Product Quality, Availability, or Service Experience Risk", "Likely recurring product-level customer-experience issue requiring quality, availability, and fulfilment review.",
        "Review product quality, packaging, store availability, fulfilment process, and recurring customer complaint categories.", 0),
    "Product Sales Performance Risk": ("Product Demand and Commercial Performance Risk", "Likely weakness in product demand, pricing, assortment, local commercial execution, or availability.",
        "Review pricing, promotions, assortment visibility, local demand, competitor activity, and product availability.", 0),
    "Inventory Overstock Risk": ("Inventory Planning and Demand Forecast Risk", "Likely mismatch between replenishment planning and actual product demand.",
        "Review demand forecast accuracy, replenishment quantity, product velocity, transfer opportunities, and promotion or markdown options.", 0),
    "Repeated Complaint Category Risk": ("Recurring Process or Product Failure Pattern", "Likely recurring process, product-condition, or service-delivery failure pattern.",
        "Review the end-to-end process associated with this complaint category, including product handling, fulfilment, and service steps across affected stores.", 0),
}
RULE_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}', '{s}', '{f}', {b})" for k, (c, s, f, b) in RULES.items()) + ") v(issue_type, root_cause_category, root_cause_summary, investigation_focus, extra)"
STATS = ("SELECT issue_id, CAST(sum(n) AS BIGINT) AS evidence_count, CAST(sum(h) AS BIGINT) AS high_count, list(analysis_type ORDER BY s) AS types FROM (SELECT issue_id, analysis_type, count(*) AS n, "
         "count(*) FILTER (severity = 'High') AS h, min(seq) AS s FROM evidence GROUP BY ALL) GROUP BY issue_id")
CAUSES = f"""SELECT 'RCA-' || issue_id AS analysis_id, issue_id, title, issue_type, business_area, priority_level, priority_score, entity_type, entity_id,
 store_id, product_id, vendor_id, period_label, root_cause_category, root_cause_summary,
 'Assessment for ''' || title || ''': ' || contributing_factors || ' This is an evidence-based likely-cause assessment and requires human review before an action is approved.' AS root_cause_explanation,
 contributing_factors, t.evidence_summary AS evidence_summary, investigation_focus,
 {r2('least(52 + least(evidence_count, 6) * 3 + least(len(types), 5) * 4 + least(high_count, 4) * 2 + extra, 92)')} AS confidence_score,
 evidence_count, array_to_string(types, ', ') AS evidence_types, 'Rule-Based Database and Evidence Analysis' AS analysis_method,
 'Generated' AS analysis_status, 'Pending Review' AS review_status, '2001-08-01 06:00:00' AS generated_at
FROM (SELECT * EXCLUDE (evidence_summary) FROM issues) JOIN rules USING (issue_type) JOIN texts t USING (issue_id) JOIN stats USING (issue_id)"""
LIGHT = {**ISSUES, "evidence": EVIDENCE["evidence"], "rules": RULE_ROWS, "stats": STATS}
CONTEXT = {"c_finance": FINANCE, "c_sales": STORE_SALES, "c_category": CATEGORY, "c_stock": STOCK_COUNTS, "c_cases": STORE_CASES, "c_vendors": VENDORS,
           "c_affected": AFFECTED, "c_types": TYPES, "c_products": PRODUCTS, "c_product_cases": PRODUCT_CASES, "c_product_sales": PRODUCT_SALES,
           "c_categories": CATEGORIES, "c_product_stock": STOCK}
DEEP = {**LIGHT, **CONTEXT, "texts": RCA_TEXT, "causes": CAUSES}
# state after review, and what follows from it: needs no root-cause texts
REVIEWED = (f"SELECT issue_id, root_cause_category, root_cause_summary, {r2('least(52 + least(evidence_count, 6) * 3 + least(len(types), 5) * 4 + least(high_count, 4) * 2 + extra, 92)')} AS confidence_score, "
            "evidence_count, CASE evidence_count % 5 WHEN 0 THEN 'Accepted' WHEN 2 THEN 'Edited' WHEN 3 THEN 'Rejected' ELSE 'Pending Review' END AS review_status "
            "FROM issues JOIN rules USING (issue_type) JOIN stats USING (issue_id)")
RECOMMEND_CONTEXT = ("SELECT i.issue_id, title AS issue_title, issue_type, business_area, priority_level, priority_score, root_cause_category, root_cause_summary, "
                     "confidence_score AS root_cause_confidence_score, evidence_count AS root_cause_evidence_count, review_status AS root_cause_review_status "
                     "FROM issues i JOIN reviewed USING (issue_id) WHERE review_status <> 'Rejected'")
TEMPLATE_ROWS = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (kind, action, owner)) + f", {days}, " + ", ".join(
        "'" + x.replace("'", "''") + "'" for x in (impact, " ".join(f"{i}. {step}" for i, step in enumerate(steps, 1)))) + ")"
    for _, kind, action, owner, days, impact, steps in TEMPLATES) + ") v(issue_type, action, owner, days, impact, steps)"
RECOMMENDATIONS = f"""SELECT 'REC-' || issue_id AS recommendation_id, issue_id, issue_title, issue_type, business_area, priority_level, priority_score, root_cause_category, root_cause_summary,
 root_cause_confidence_score, action || ': ' || issue_title AS recommendation_title, 'Reason for action: ' || root_cause_summary || ' Recommended action steps: ' || steps AS recommendation_text,
 owner AS suggested_owner_role, DATE '2001-08-01' + CASE priority_level WHEN 'High' THEN greatest(1, days - 2) WHEN 'Medium' THEN days ELSE days + 5 END AS suggested_deadline,
 impact AS expected_impact, {r2("greatest(50, least(root_cause_confidence_score * 0.70::DOUBLE + priority_score * 0.20::DOUBLE + least(root_cause_evidence_count * 12.5::DOUBLE, 100) * 0.10::DOUBLE + CASE root_cause_review_status WHEN 'Accepted' THEN 3 WHEN 'Edited' THEN 2 ELSE 0 END, 95))")} AS confidence_score,
 'Pending Review' AS status, '2001-08-01 06:00:00' AS generated_at FROM recommend_context JOIN templates USING (issue_type)"""
STORED = ("SELECT * REPLACE (CASE (length(issue_title) + length(issue_id)) % 5 WHEN 0 THEN 'Pending Review' WHEN 1 THEN 'Edited' WHEN 2 THEN 'Accepted' WHEN 3 THEN 'Rejected' "
          "ELSE 'Converted to Task' END AS status) FROM recommendations")
TASKS = ("SELECT 'TASK-' || recommendation_id AS task_id, issue_id, recommendation_id, recommendation_title AS title, recommendation_text AS description, suggested_owner_role AS assigned_role, "
         "suggested_deadline AS due_date, priority_level, CASE length(issue_id) % 5 WHEN 0 THEN 'Unassigned' WHEN 1 THEN 'To Do' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'Blocked' ELSE 'Completed' END AS status "
         "FROM stored WHERE status = 'Converted to Task' OR (status = 'Accepted' AND length(issue_id) % 3 = 0)")
STATE = {**LIGHT, "reviewed": REVIEWED, "recommend_context": RECOMMEND_CONTEXT, "templates": TEMPLATE_ROWS, "recommendations": RECOMMENDATIONS, "stored": STORED, "tasks": TASKS}
WITH_PREVIOUS = {**STATE, "previous": PREVIOUS}
EVENTS = ("SELECT recommendation_id, seq AS event_seq, CASE (seq + CAST(round(priority_score) AS INTEGER) % 3) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END AS action "
          "FROM stored, (VALUES (1), (2), (3)) v(seq)")
# each state is carried from event to event, the plain way
REVIEW = f"""WITH RECURSIVE walk AS (SELECT recommendation_id, 0 AS event_seq, '' AS action, '' AS outcome, '' AS target_status, status AS state FROM stored
 UNION ALL SELECT w.recommendation_id, e.event_seq, e.action, CASE WHEN state IN ('Pending Review', 'Edited') THEN 'success' ELSE 'conflict' END,
  CASE e.action WHEN 'accept' THEN 'Accepted' WHEN 'reject' THEN 'Rejected' ELSE 'Edited' END,
  CASE WHEN state NOT IN ('Pending Review', 'Edited') THEN state WHEN e.action = 'accept' THEN 'Accepted' WHEN e.action = 'reject' THEN 'Rejected' ELSE 'Edited' END
 FROM walk w JOIN ({EVENTS}) e ON e.recommendation_id = w.recommendation_id AND e.event_seq = w.event_seq + 1)"""
LEGAL = ("(state = 'Unassigned' AND t = 'To Do') OR (state = 'To Do' AND t IN ('In Progress', 'Blocked')) OR (state = 'In Progress' AND t IN ('To Do', 'Blocked', 'Completed')) "
         "OR (state = 'Blocked' AND t IN ('To Do', 'In Progress'))")
TASK_EVENTS = ("SELECT task_id, seq, CASE seq WHEN 1 THEN 'To Do' WHEN 2 THEN 'In Progress' WHEN 3 THEN (['Blocked', 'Completed', 'In Progress', 'To Do', 'Unassigned'])[length(task_id) % 5 + 1] "
               "ELSE 'Completed' END AS t FROM tasks, (VALUES (1), (2), (3), (4)) v(seq)")
MOVES = f"""WITH RECURSIVE walk AS (SELECT task_id, 0 AS event_seq, '' AS old_status, '' AS target_status, '' AS outcome, status AS state FROM tasks
 UNION ALL SELECT w.task_id, e.seq, state, t, CASE WHEN state = t THEN 'no_change' WHEN {LEGAL} THEN 'success' ELSE 'invalid_transition' END, CASE WHEN {LEGAL} THEN t ELSE state END
 FROM walk w JOIN ({TASK_EVENTS}) e ON e.task_id = w.task_id AND e.seq = w.event_seq + 1)"""
UNKNOWN = ("SELECT 'TASK-UNKNOWN-' || issue_id AS task_id, CAST(seq AS BIGINT) AS event_seq, NULL AS old_status, CASE seq WHEN 1 THEN 'To Do' WHEN 2 THEN 'In Progress' WHEN 3 THEN "
           "(['Blocked', 'Completed', 'In Progress', 'To Do', 'Unassigned'])[length('TASK-UNKNOWN-' || issue_id) % 5 + 1] ELSE 'Completed' END AS target_status, 'not_found' AS outcome "
           "FROM issues, (VALUES (1), (2), (3), (4)) v(seq) WHERE issue_type = 'Store Performance Risk'")
LEVEL = sev("priority_level")
TASK_RANK = "CASE t.status WHEN 'Blocked' THEN 1 WHEN 'In Progress' THEN 2 WHEN 'To Do' THEN 3 WHEN 'Unassigned' THEN 4 ELSE 5 END"
CONVERTED = ("SELECT r.*, t.task_id AS existing_task_id, CASE WHEN t.task_id IS NOT NULL THEN 'already_converted' WHEN r.status <> 'Accepted' THEN 'invalid_status' ELSE 'success' END AS outcome "
             "FROM stored r LEFT JOIN tasks t USING (recommendation_id)")
NEW = f"SELECT * FROM ({CONVERTED}) WHERE outcome = 'success'"
REFRESH = ("SELECT recommendation_id, issue_id, recommendation_title, suggested_deadline, confidence_score, status, generated_at FROM stored WHERE status IN ('Accepted', 'Edited', 'Converted to Task') "
           "OR issue_type = 'Inventory Overstock Risk' UNION ALL SELECT recommendation_id, issue_id, recommendation_title, suggested_deadline, confidence_score, status, '2001-08-08 06:00:00' "
           "FROM recommendations WHERE issue_type <> 'Inventory Overstock Risk' AND issue_id NOT IN (SELECT issue_id FROM stored WHERE status IN ('Accepted', 'Edited', 'Converted to Task'))")
COUNTED = ("SELECT (SELECT count(*) FROM previous WHERE status = 'Open') AS open_issue_count, (SELECT count(*) FROM previous WHERE status = 'Open' AND priority_level = 'High') AS high_priority_open_issue_count, "
           "(SELECT count(*) FROM previous WHERE status = 'In Progress') AS in_progress_issue_count, (SELECT count(*) FROM tasks) AS total_tasks, (SELECT count(*) FROM tasks WHERE status <> 'Completed') AS active_task_count, "
           "(SELECT count(*) FROM tasks WHERE status = 'Blocked') AS blocked_task_count, (SELECT count(*) FROM tasks WHERE status <> 'Completed' AND due_date < DATE '2001-08-08') AS overdue_task_count, "
           "(SELECT count(*) FROM stored WHERE status IN ('Pending Review', 'Edited')) AS recommendations_needing_review, (SELECT display_value FROM kpis WHERE kpi_key = 'sales_growth') AS sales_growth, "
           "(SELECT display_value FROM kpis WHERE kpi_key = 'store_target_achievement') AS target_achievement, (SELECT display_value FROM kpis WHERE kpi_key = 'total_operating_profit') AS operating_profit")
BRIEF = (f"SELECT *, coalesce(nullif(concat_ws(' | ', CASE WHEN high_priority_open_issue_count > 0 THEN 'Review ' || high_priority_open_issue_count || ' high-priority open business issues.' END, "
         "CASE WHEN recommendations_needing_review > 0 THEN 'Complete management review for ' || recommendations_needing_review || ' recommendations.' END, "
         "CASE WHEN blocked_task_count > 0 THEN 'Resolve blockers affecting ' || blocked_task_count || ' tasks.' END, CASE WHEN overdue_task_count > 0 THEN 'Address ' || overdue_task_count || ' overdue tasks.' END), ''), "
         "'No immediate critical workflow action was detected.') AS management_attention, 'The current operating snapshot contains ' || open_issue_count || ' open business issues, including ' || high_priority_open_issue_count || "
         "' high-priority issues. ' || recommendations_needing_review || ' recommendations are awaiting management review. There are ' || active_task_count || ' active tasks, including ' || blocked_task_count || ' blocked and ' || "
         "overdue_task_count || ' overdue tasks. Key performance indicators show that sales growth is ' || sales_growth || ', target achievement is ' || target_achievement || ', operating profit is ' || operating_profit || '.' AS summary_text "
         f"FROM ({COUNTED})")
BRIEF_CTE = {**WITH_PREVIOUS, "kpis": KPI_TABLE, "brief": BRIEF}
OLD_CAUSES = "issue_type <> 'Vendor Performance Risk'"


def context(name: str, views: list[str], columns: str = "*") -> str:
    return with_views(views, f"SELECT {columns} FROM ({CONTEXT[name]})")


SELECTION = {k: v for k, v in {**FULL, "finalists": FINALISTS, "picks": PICKS}.items() if k in ("scored", "profiles", "finalists", "picks")}
SIZE = "length(issue_id)"
UNGROUNDED_CAUSES = """SELECT issue_id AS key, 'confidence_score changed' AS deviation, CAST(confidence_score + 1 AS VARCHAR) AS detail FROM causes WHERE evidence_count % 7 = 0
 UNION ALL SELECT issue_id, 'root_cause_category changed', 'A guess' FROM causes WHERE evidence_count % 11 = 0
 UNION ALL SELECT issue_id, 'unsupported factor', 'Nobody was looking.' FROM causes WHERE evidence_count % 5 = 0
 UNION ALL SELECT issue_id, 'unsupported evidence', 'FINDING-UNKNOWN' FROM causes WHERE evidence_count % 3 = 0
 UNION ALL SELECT issue_id, 'unknown id', 'FIN-X99-1' FROM causes WHERE evidence_count % 2 = 0
 UNION ALL SELECT issue_id, 'unknown number', '98,765.43' FROM causes WHERE evidence_count % 2 = 0"""
UNGROUNDED_RECOMMENDATIONS = f"""SELECT issue_id AS key, 'missing item' AS deviation, issue_id AS detail FROM recommendations WHERE {SIZE} % 9 = 0
 UNION ALL SELECT 'ISSUE-UNKNOWN', 'unknown item', 'ISSUE-UNKNOWN' FROM (SELECT 1 FROM recommendations LIMIT 1)
 UNION ALL SELECT issue_id, 'suggested_owner_role changed', 'Nobody' FROM recommendations WHERE {SIZE} % 9 <> 0 AND {SIZE} % 6 = 0
 UNION ALL SELECT issue_id, 'suggested_deadline changed', CAST(suggested_deadline + 1 AS VARCHAR) FROM recommendations WHERE {SIZE} % 9 <> 0 AND {SIZE} % 4 = 0
 UNION ALL SELECT issue_id, 'unsupported action', 'Do something else.' FROM recommendations WHERE {SIZE} % 5 = 0"""
# ---- the brief's references: five lists, numbered within their kind -----------------------------------
KPI_ORDER = ("total_sales", "total_revenue", "sales_growth", "store_target_achievement", "average_order_value", "total_operating_profit", "low_stock_count",
             "overstock_count", "high_severity_complaint_count", "open_complaint_count", "vendor_delay_count", "vendor_on_time_delivery_rate")
POINTS = ("SELECT unnest(p) AS text, generate_subscripts(p, 1) AS n FROM (SELECT CASE WHEN len(q) > 0 THEN q ELSE ['No immediate critical workflow action was detected.'] END AS p FROM (SELECT list_filter(["
          "CASE WHEN high_priority_open_issue_count > 0 THEN 'Review ' || high_priority_open_issue_count || ' high-priority open business issues.' END, "
          "CASE WHEN recommendations_needing_review > 0 THEN 'Complete management review for ' || recommendations_needing_review || ' recommendations.' END, "
          "CASE WHEN blocked_task_count > 0 THEN 'Resolve blockers affecting ' || blocked_task_count || ' tasks.' END, "
          "CASE WHEN overdue_task_count > 0 THEN 'Address ' || overdue_task_count || ' overdue tasks.' END], lambda x: x IS NOT NULL) AS q FROM brief))")
TOP_OPEN = f"SELECT issue_id, title, priority_score FROM previous WHERE status = 'Open' ORDER BY {LEVEL}, priority_score DESC, issue_id LIMIT 10"
TOP_RECOMMENDED = f"SELECT recommendation_id, recommendation_title, priority_score FROM stored ORDER BY {LEVEL}, priority_score DESC, confidence_score DESC, recommendation_id LIMIT 10"
SHOWN = (f"SELECT task_id, title, min(place) AS place FROM (SELECT * FROM (SELECT task_id, title, (1, CAST(due_date AS VARCHAR)) AS place FROM tasks "
         "WHERE due_date < DATE '2001-08-08' AND status <> 'Completed' ORDER BY due_date, task_id LIMIT 10) UNION ALL SELECT * FROM (SELECT task_id, title, "
         f"(2, ({TASK_RANK}) || ({sev('t.priority_level')}) || coalesce(CAST(due_date AS VARCHAR), '')) AS place FROM tasks t "
         f"ORDER BY {TASK_RANK}, {sev('t.priority_level')}, due_date, task_id LIMIT 10)) GROUP BY task_id, title")


def reference(kind: str, prefix: str, ident: str, summary: str, order: str, source: str) -> str:
    return (f"SELECT '{kind}' AS source_type, 'BRIEF-{prefix}:' || ({ident}) AS evidence_id, {ident} AS source_identifier, {summary} AS summary, "
            f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position FROM ({source})")


SLUG = "trim(regexp_replace({0}, '[^A-Za-z0-9_.:-]+', '-', 'g'), '-')"
TIDY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
REFERENCES = " UNION ALL ".join([
    reference("KPI", "KPI", "kpi_key", "kpi_name || ': ' || display_value", f"list_position([{', '.join(repr(k) for k in KPI_ORDER)}], kpi_key)", "SELECT * FROM kpis"),
    reference("Issue", "ISSUE", SLUG.format("issue_id"), TIDY.format("title"), "priority_score DESC, issue_id", TOP_OPEN),
    reference("Recommendation", "RECOMMENDATION", SLUG.format("recommendation_id"), TIDY.format("recommendation_title"), "priority_score DESC, recommendation_id", TOP_RECOMMENDED),
    reference("Task", "TASK", SLUG.format("task_id"), TIDY.format("title"), "place, task_id", SHOWN),
    f"SELECT 'Management Attention', 'BRIEF-ATTENTION:' || lpad(CAST(n AS VARCHAR), 3, '0'), 'ATTENTION-' || lpad(CAST(n AS VARCHAR), 3, '0'), text, CAST(n AS INTEGER) FROM ({POINTS})",
])
BRIEF_REFERENCES = {**BRIEF_CTE, "refs": REFERENCES}
LINKS = """SELECT attention_id, attention_text, evidence_id, place FROM (
 SELECT source_identifier AS attention_id, summary AS attention_text, evidence_id, (0, 0) AS place FROM refs WHERE source_type = 'Management Attention'
 UNION ALL SELECT a.source_identifier, a.summary, r.evidence_id, (CASE r.source_type WHEN 'Issue' THEN 1 WHEN 'Recommendation' THEN 2 WHEN 'Task' THEN 3 ELSE 4 END, r.position)
 FROM refs a JOIN refs r ON a.source_type = 'Management Attention' AND ((r.source_type = 'Issue' AND regexp_matches(lower(a.summary), 'issue|priority'))
  OR (r.source_type = 'Recommendation' AND lower(a.summary) LIKE '%recommendation%') OR (r.source_type = 'Task' AND regexp_matches(lower(a.summary), 'task|blocked|overdue'))
  OR (r.source_type = 'KPI' AND lower(a.summary) LIKE '%kpi%')))
 QUALIFY row_number() OVER (PARTITION BY attention_id ORDER BY place, evidence_id) <= 20"""
UNGROUNDED_BRIEF = """SELECT 'blocked_task_count' AS key, 'amount changed' AS deviation, CAST(blocked_task_count + 1 AS VARCHAR) AS detail FROM brief
 UNION ALL SELECT 'ATTENTION-001', 'point changed', 'Something else.'
 UNION ALL SELECT source_identifier, 'unsupported evidence', 'BRIEF-TASK:UNKNOWN' FROM refs WHERE source_type = 'Management Attention'
 UNION ALL SELECT 'summary', 'unknown number', '424242'"""
ORACLE: dict[str, str] = {
    "ungrounded_causes": check(UNGROUNDED_CAUSES, DEEP),
    "ungrounded_recommendations": check(UNGROUNDED_RECOMMENDATIONS, STATE),
    "ungrounded_brief": check(UNGROUNDED_BRIEF, BRIEF_REFERENCES),
    "brief_references": check("SELECT * FROM refs", BRIEF_REFERENCES),
    "attention_links": check(f"SELECT attention_id, attention_text, string_agg(evidence_id, ', ' ORDER BY place, evidence_id) AS evidence_ids FROM ({LINKS}) GROUP BY ALL", BRIEF_REFERENCES),
    "latest_brief": check("SELECT 'BRIEF-2001-08-08' AS brief_id, DATE '2001-08-08' AS brief_date, 'Daily Executive Brief' AS brief_type, summary_text, 'Draft' AS status, '2001-08-08 06:00:00' AS run_at FROM brief", BRIEF_CTE),
    "task_details": check("SELECT t.task_id, TRUE AS found, t.title, t.status, t.due_date, i.title AS issue_title, i.status AS issue_status, i.summary AS issue_summary, s.recommendation_title, s.status AS recommendation_status, s.expected_impact, r.root_cause_category, r.root_cause_summary FROM tasks t JOIN issues i USING (issue_id) LEFT JOIN stored s ON s.recommendation_id = t.recommendation_id LEFT JOIN reviewed r ON r.issue_id = t.issue_id WHERE t.priority_level = 'High' "
        "UNION ALL SELECT 'TASK-UNKNOWN-' || issue_id, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM issues WHERE issue_type = 'Store Performance Risk'", STATE),
    "store_finance_context": context("c_finance", ["finance"]),
    "store_sales_context": context("c_sales", ["sales"]),
    "store_category_decline": context("c_category", ["sales"]),
    "store_inventory_counts": context("c_stock", ["inventory"]),
    "store_complaint_counts": context("c_cases", ["complaints"]),
    "vendor_delivery_context": context("c_vendors", ["vendor_deliveries"]),
    "vendor_affected_stores": context("c_affected", ["vendor_deliveries"]),
    "store_complaint_types": context("c_types", ["complaints"]),
    "store_complaint_products": context("c_products", ["complaints"]),
    "product_complaint_context": context("c_product_cases", ["complaints"]),
    "product_sales_context": context("c_product_sales", ["sales"]),
    "complaint_category_context": context("c_categories", ["complaints"]),
    "inventory_product_context": context("c_product_stock", ["inventory", "vendors", "complaints"], "store_id, product_id, inventory_id, vendor_name, current_stock, reorder_level, stock_status, related_complaints, high_severity_complaints, unresolved_complaints, out_of_stock_complaints"),
    "root_causes": check("SELECT * FROM causes", DEEP),
    "executive_root_causes": check("SELECT c.*, executive_rank, executive_score FROM causes c JOIN picks USING (issue_id)", {**DEEP, **SELECTION}),
    "executive_recommendations": check("SELECT r.*, executive_rank, executive_score FROM recommendations r JOIN picks USING (issue_id)", {**STATE, **SELECTION}),
    "supporting_evidence": check(f"SELECT issue_id, count(*) AS evidence_rows, '[' || string_agg(CAST(json_object('source_finding_id', source_finding_id, 'source_module', source_module, 'analysis_type', analysis_type, 'business_area', business_area, 'severity', severity, 'summary', summary, 'evidence', evidence, 'detected_at', detected_at) AS VARCHAR), ',' ORDER BY p) || ']' AS supporting_evidence FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY {sev()}, analysis_type, detected_at DESC, seq) AS p FROM evidence QUALIFY p <= 12) GROUP BY issue_id", EVIDENCE),
    "root_cause_upsert": check(f"SELECT issue_id, root_cause_category, root_cause_summary, root_cause_explanation, confidence_score, evidence_count, 'Generated' AS analysis_status, CASE WHEN {OLD_CAUSES} THEN r.review_status ELSE 'Pending Review' END AS review_status, CASE WHEN {OLD_CAUSES} AND r.review_status IN ('Pending Review', 'Rejected') THEN 2 ELSE 1 END AS analysis_version, CASE WHEN {OLD_CAUSES} AND r.review_status IN ('Accepted', 'Edited') THEN TIMESTAMP '2001-07-01 06:00:00' ELSE TIMESTAMP '2001-08-01 06:00:00' END AS generated_at FROM (SELECT * EXCLUDE (review_status, analysis_status, generated_at) FROM causes) JOIN (SELECT issue_id, review_status FROM reviewed) r USING (issue_id)", {**DEEP, "reviewed": REVIEWED}),
    "issue_root_cause_status": check("SELECT issue_type, 'Generated' AS root_cause_status, count(*) AS issue_count FROM issues GROUP BY issue_type", ISSUES),
    "confidence_summary": check(f"SELECT {r2('avg(confidence_score)')} AS average, min(confidence_score) AS minimum, max(confidence_score) AS maximum FROM reviewed", {**LIGHT, "reviewed": REVIEWED}),
    "contributing_factors": check("SELECT issue_id, CAST(len(f) AS INTEGER) AS factor_count, array_to_string(f, ' | ') AS factors FROM (SELECT issue_id, regexp_split_to_array(regexp_replace(contributing_factors, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:8] AS f FROM texts)", DEEP),
    "recommendation_context": check("SELECT * FROM recommend_context", STATE),
    "recommendations": check("SELECT * FROM recommendations", STATE),
    "recommendation_refresh": check(REFRESH, STATE),
    "action_steps": check("SELECT recommendation_id, CAST(4 AS INTEGER) AS step_count, regexp_replace(regexp_replace(regexp_extract(recommendation_text, 'Recommended action steps: (.*)$', 1), '^1\\. ', ''), ' [2-4]\\. ', ' | ', 'g') AS steps FROM recommendations", STATE),
    "issue_list": check(f"SELECT issue_id, title, priority_level, priority_score, status FROM previous WHERE priority_level = 'High' AND status = 'Open' ORDER BY priority_score DESC, issue_id LIMIT 50 OFFSET 1", {**ISSUES, "previous": PREVIOUS}),
    "issue_details": check(f"SELECT issue_id, title, count(source_finding_id) OVER (PARTITION BY issue_id) AS evidence_count, CASE WHEN source_finding_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY issue_id ORDER BY {sev('e.severity')}, detected_at DESC, source_finding_id) AS INTEGER) END AS position, source_finding_id, root_cause_category, review_status FROM issues JOIN reviewed USING (issue_id) LEFT JOIN (SELECT issue_id, source_finding_id, severity, detected_at FROM evidence) e USING (issue_id) WHERE priority_level = 'High'", {**LIGHT, "reviewed": REVIEWED}),
    "recommendation_list": check(f"SELECT recommendation_id, issue_title, priority_level, priority_score, confidence_score, status FROM stored WHERE status = 'Accepted' ORDER BY {LEVEL}, priority_score DESC, confidence_score DESC, recommendation_id LIMIT 50 OFFSET 1", STATE),
    "recommendation_details": check("SELECT s.recommendation_id, s.issue_id, s.recommendation_title, s.suggested_owner_role, s.suggested_deadline, s.confidence_score, s.status, i.title AS issue_title, i.status AS issue_status, i.summary AS issue_summary, r.root_cause_category, r.confidence_score AS root_cause_confidence, r.review_status FROM stored s JOIN issues i USING (issue_id) LEFT JOIN reviewed r USING (issue_id)", STATE),
    "task_list": check(f"SELECT t.task_id, i.title AS issue_title, t.title AS recommendation_title, assigned_role, due_date, t.priority_level, t.status FROM tasks t JOIN issues i USING (issue_id) WHERE t.priority_level = 'High' ORDER BY {TASK_RANK}, due_date, task_id LIMIT 50 OFFSET 1", STATE),
    "review_outcomes": check(f"SELECT * FROM ({REVIEW} SELECT recommendation_id, event_seq, action, outcome, target_status FROM walk WHERE event_seq > 0)", STATE),
    "reviewed_recommendations": check(f"SELECT * FROM ({REVIEW} SELECT recommendation_id, state AS status FROM walk WHERE event_seq = 3)", STATE),
    "task_conversions": check(f"SELECT recommendation_id, status AS current_status, existing_task_id, outcome FROM ({CONVERTED}) UNION ALL SELECT 'REC-UNKNOWN-' || issue_id, NULL, NULL, 'not_found' FROM issues WHERE issue_type = 'Store Performance Risk'", STATE),
    "created_tasks": check(f"SELECT 'TASK-' || recommendation_id AS task_id, issue_id, recommendation_id, recommendation_title AS title, recommendation_text AS description, CAST(NULL AS VARCHAR) AS assigned_to, suggested_owner_role AS assigned_role, suggested_deadline AS due_date, priority_level, 'To Do' AS status FROM ({NEW})", STATE),
    "conversion_audit": check(f"SELECT 'Recommendation' AS entity_type, recommendation_id AS entity_id, 'Converted to Task' AS action_type, 'API User' AS actor_name, CAST(json_object('status', status) AS VARCHAR) AS old_value, CAST(json_object('status', 'Converted to Task', 'task_id', 'TASK-' || recommendation_id) AS VARCHAR) AS new_value FROM ({NEW}) UNION ALL SELECT 'Task', 'TASK-' || recommendation_id, 'Created from Recommendation', 'API User', NULL, CAST(json_object('task_id', 'TASK-' || recommendation_id, 'recommendation_id', recommendation_id, 'status', 'To Do', 'title', recommendation_title) AS VARCHAR) FROM ({NEW})", STATE),
    "task_transitions": check(f"SELECT * FROM ({MOVES} SELECT task_id, CAST(event_seq AS BIGINT) AS event_seq, old_status, target_status, outcome FROM walk WHERE event_seq > 0) UNION ALL {UNKNOWN}", STATE),
    "moved_tasks": check(f"SELECT * FROM ({MOVES} SELECT task_id, state AS status FROM walk WHERE event_seq = 4)", STATE),
    "transition_audit": check(f"SELECT * FROM ({MOVES} SELECT 'Task' AS entity_type, task_id AS entity_id, 'Status Updated' AS action_type, 'API User' AS actor_name, CAST(json_object('status', old_status) AS VARCHAR) AS old_value, CAST(json_object('status', target_status) AS VARCHAR) AS new_value FROM walk WHERE outcome = 'success')", STATE),
    "task_assignments": check("SELECT task_id, CASE WHEN status = 'Completed' THEN 'completed' ELSE 'success' END AS outcome, 'Employee ' || length(title) AS assigned_to, CASE WHEN length(task_id) % 2 = 0 THEN 'Store Manager' ELSE assigned_role END AS assigned_role, CAST(json_object('assigned_to', NULL, 'assigned_role', tasks.assigned_role) AS VARCHAR) AS old_value, CAST(json_object('assigned_to', 'Employee ' || length(title), 'assigned_role', CASE WHEN length(task_id) % 2 = 0 THEN 'Store Manager' ELSE tasks.assigned_role END) AS VARCHAR) AS new_value FROM tasks", STATE),
    "recommendation_status_counts": check("SELECT s AS status, count(stored.status) AS item_count FROM (VALUES ('Pending Review'), ('Edited'), ('Accepted'), ('Rejected'), ('Converted to Task')) v(s) LEFT JOIN stored ON stored.status = s GROUP BY s", STATE),
    "task_status_counts": check("SELECT s AS status, count(tasks.status) AS item_count FROM (VALUES ('Unassigned'), ('To Do'), ('In Progress'), ('Blocked'), ('Completed')) v(s) LEFT JOIN tasks ON tasks.status = s GROUP BY s", STATE),
    "overdue_tasks": check("SELECT task_id, title, due_date, status FROM tasks WHERE due_date < DATE '2001-08-08' AND status <> 'Completed'", STATE),
    "top_open_issues": check("SELECT p.issue_id, p.title, p.issue_type, p.business_area, p.priority_level, p.priority_score, p.status, p.summary, coalesce(n, 0) AS evidence_count, root_cause_category, root_cause_summary, confidence_score, review_status FROM previous p LEFT JOIN (SELECT issue_id, count(*) AS n FROM evidence GROUP BY issue_id) e USING (issue_id) LEFT JOIN reviewed r USING (issue_id) WHERE p.status = 'Open' ORDER BY " + sev("p.priority_level") + ", p.priority_score DESC, p.issue_id LIMIT 10", WITH_PREVIOUS),
    "brief_summary": check("SELECT * FROM brief", BRIEF_CTE),
    "daily_brief": check("SELECT CASE WHEN n = 0 THEN 'BRIEF-OLD-0' ELSE 'BRIEF-OLD-1' END AS brief_id, CASE WHEN n = 0 THEN DATE '2001-08-08' ELSE DATE '2001-08-07' END AS brief_date, 'Daily Executive Brief' AS brief_type, CASE WHEN n = 0 THEN summary_text ELSE 'earlier text' END AS summary_text, 'Draft' AS status, CASE WHEN n = 0 THEN 'updated' ELSE 'kept' END AS action, CASE WHEN n = 0 THEN open_issue_count END AS open_issue_count, CASE WHEN n = 0 THEN (SELECT display_value FROM kpis WHERE kpi_key = 'total_sales') END AS first_kpi, CASE WHEN n = 0 THEN (SELECT count(*) FROM tasks WHERE status = 'Completed') END AS completed_tasks, CASE WHEN n = 0 THEN (SELECT issue_id FROM previous WHERE status = 'Open' ORDER BY priority_score DESC, issue_id LIMIT 1) END AS first_issue FROM brief, (VALUES (0), (1)) v(n)", BRIEF_CTE),
}
