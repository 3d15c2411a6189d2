"""SQL cross-checks of consolidation, priorities, evidence scores and monitoring."""

from __future__ import annotations

from tillwatch.oracle.detectors import COMPLAINTS_ALL, FINANCE_ALL, INVENTORY_ALL, SALES_ALL, VENDOR_ALL, union
from tillwatch.oracle.views import f2, r2, sev, with_views

COMMON = ("finding_id", "analysis_type", "business_area", "severity", "entity_type", "entity_id", "entity_name",
          "store_id", "store_name", "product_id", "product_name", "vendor_id", "vendor_name", "complaint_type",
          "month", "summary", "evidence", "status", "detected_at")
ABSENT = {"sales": ("vendor_id", "vendor_name", "complaint_type"),
          "inventory": ("entity_name", "complaint_type", "month"),
          "complaints": ("vendor_id", "vendor_name", "month"),
          "vendor_finance": ("product_id", "product_name", "complaint_type")}
FAMILIES = {"sales": (SALES_ALL, "sales_analysis.csv", "''", "sales_change_percent", "target_achievement_percent"),
            "inventory": (INVENTORY_ALL, "inventory_analysis.csv", "''", "stock_ratio", "CAST(days_to_expiry AS DOUBLE)"),
            "complaints": (COMPLAINTS_ALL, "complaint_analysis.csv", "''", "-CAST(complaint_age_days AS DOUBLE)", "-CAST(total_complaints AS DOUBLE)"),
            "vendor_finance": (union(VENDOR_ALL, FINANCE_ALL), "vendor_finance_analysis.csv", "business_area", "-average_delay_days", "target_achievement_percent")}
VIEWS = ["finance", "inventory", "products", "vendors", "complaints", "vendor_deliveries"]


def family(module: str, position: int) -> str:
    sql, report, area, first, second = FAMILIES[module]
    columns = ", ".join(f"'' AS {c}" if c in ABSENT[module] else c for c in COMMON)
    return (f"SELECT {columns}, '{module}' AS source_module, '{report}' AS source_report, {position} AS o1, {sev()} AS o2, "
            f"{area} AS o3, coalesce({first}, 'Infinity'::DOUBLE) AS o4, coalesce({second}, 'Infinity'::DOUBLE) AS o5 FROM ({sql})")


STORE = "CASE WHEN store_id <> '' THEN store_id ELSE entity_id END"
STORE_PRODUCT = "CASE WHEN trim(store_id || '-' || product_id, '-') <> '' THEN trim(store_id || '-' || product_id, '-') ELSE entity_id END"
ROUTED = f"""
SELECT *, row_number() OVER (ORDER BY o1, o2, o3, analysis_type, o4, o5, finding_id) AS seq,
 CASE business_area
  WHEN 'Operations' THEN CASE WHEN analysis_type = 'Overstock' THEN 'Inventory Overstock Risk' ELSE 'Product Availability Risk' END
  WHEN 'Sales' THEN CASE WHEN analysis_type IN ('Product Sales Decline', 'Product Underperformance') AND product_id <> ''
     THEN 'Product Sales Performance Risk' ELSE 'Store Performance Risk' END
  WHEN 'Finance' THEN 'Store Performance Risk'
  WHEN 'Customer Support' THEN CASE WHEN analysis_type = 'High Complaint Product' THEN 'Product Complaint Risk'
     WHEN analysis_type = 'Repeated Complaint Category' THEN 'Repeated Complaint Category Risk'
     WHEN analysis_type IN ('High Complaint Store', 'Monthly Complaint Growth') THEN 'Store Performance Risk'
     ELSE 'Complaint Resolution Backlog' END
  WHEN 'Procurement' THEN 'Vendor Performance Risk' ELSE 'General Business Risk' END AS issue_type,
 CASE issue_type WHEN 'Inventory Overstock Risk' THEN {STORE_PRODUCT} WHEN 'Product Availability Risk' THEN {STORE_PRODUCT}
  WHEN 'Product Sales Performance Risk' THEN product_id WHEN 'Store Performance Risk' THEN {STORE}
  WHEN 'Complaint Resolution Backlog' THEN {STORE}
  WHEN 'Product Complaint Risk' THEN CASE WHEN product_id <> '' THEN product_id ELSE entity_id END
  WHEN 'Repeated Complaint Category Risk' THEN CASE WHEN complaint_type <> '' THEN complaint_type ELSE entity_id END
  WHEN 'Vendor Performance Risk' THEN CASE WHEN vendor_id <> '' THEN vendor_id ELSE entity_id END
  ELSE entity_id END AS issue_group_id,
 'ISSUE-' || trim(regexp_replace(upper(issue_type), '[^A-Z0-9]+', '-', 'g'), '-') || '-'
  || trim(regexp_replace(upper(issue_group_id), '[^A-Z0-9]+', '-', 'g'), '-') AS issue_id
FROM ({union(*[family(m, i + 1) for i, m in enumerate(FAMILIES)])})"""

BONUS = ("CASE WHEN analysis_type IN ('Stockout Risk', 'Expired Inventory', 'High Financial Risk', 'Loss-Making Store') THEN 30 "
         "WHEN analysis_type IN ('Near Expiry Stock', 'Store Sales Decline', 'Repeated Vendor Delays') THEN 25 "
         "WHEN analysis_type IN ('High Complaint Store', 'Low On-Time Delivery Rate', 'Low Vendor Quality Rating') THEN 20 "
         "WHEN analysis_type IN ('Monthly Complaint Growth', 'Open High-Severity Complaint', 'Unresolved Complaint Ageing', "
         "'Partial Vendor Deliveries', 'Low Target Achievement', 'Low Operating Profit') THEN 15 ELSE 0 END")
FIRSTS = ", ".join(f"coalesce(arg_min({c}, seq) FILTER ({c} <> ''), '') AS f_{c}" for c in (
    "store_name", "product_name", "vendor_name", "complaint_type", "store_id", "product_id", "vendor_id"))


def issues(source: str = "findings", where: str = "TRUE") -> str:
    """One statement per issue list; `source` is the routed findings relation."""
    f = f"(SELECT * FROM {source} WHERE {where})"
    key = "issue_type, issue_group_id, issue_id"
    return f"""
SELECT issue_id,
 CASE issue_type WHEN 'Store Performance Risk' THEN 'Store performance risk at ' || coalesce(nullif(f_store_name, ''), issue_group_id)
  WHEN 'Product Availability Risk' THEN 'Product availability risk: ' || f_product_name || ' at ' || f_store_name
  WHEN 'Inventory Overstock Risk' THEN 'Overstock risk: ' || f_product_name || ' at ' || f_store_name
  WHEN 'Complaint Resolution Backlog' THEN 'Complaint resolution backlog at ' || f_store_name
  WHEN 'Product Complaint Risk' THEN 'High complaint risk for ' || f_product_name
  WHEN 'Repeated Complaint Category Risk' THEN 'Repeated complaint category: ' || f_complaint_type
  WHEN 'Vendor Performance Risk' THEN 'Vendor performance risk: ' || f_vendor_name
  WHEN 'Product Sales Performance Risk' THEN 'Product sales performance risk: ' || f_product_name END AS title,
 issue_type, CASE WHEN len(areas) > 1 THEN 'Cross-Functional' ELSE areas[1] END AS business_area,
 {r2('least(greatest(CASE highest WHEN 3 THEN 55 WHEN 2 THEN 35 ELSE 15 END + least(greatest(high_finding_count - 1, 0) * 10, 20) + least((len(areas) - 1) * 7, 14) + least(finding_count - 1, 8) + bonus, CASE highest WHEN 3 THEN 70 WHEN 2 THEN 50 ELSE 0 END), 100)')} AS priority_score,
 CASE WHEN priority_score >= 85 THEN 'High' WHEN priority_score >= 65 THEN 'Medium' ELSE 'Low' END AS priority_level,
 'Highest Severity: ' || CASE highest WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END || '; Strongest Signal: ' || strongest
  || '; Supporting Findings: ' || finding_count || '; Business Areas: ' || array_to_string(areas, ', ') AS priority_reason,
 'Open' AS status,
 CASE WHEN issue_type IN ('Store Performance Risk', 'Complaint Resolution Backlog') THEN 'Store'
  WHEN issue_type IN ('Product Availability Risk', 'Inventory Overstock Risk') THEN 'Store Product'
  WHEN issue_type IN ('Product Complaint Risk', 'Product Sales Performance Risk') THEN 'Product'
  WHEN issue_type = 'Vendor Performance Risk' THEN 'Vendor' ELSE 'Complaint Category' END AS entity_type,
 CASE entity_type WHEN 'Store' THEN f_store_id WHEN 'Store Product' THEN f_store_id || '-' || f_product_id WHEN 'Product' THEN f_product_id
  WHEN 'Vendor' THEN f_vendor_id ELSE f_complaint_type END AS entity_id,
 CASE WHEN entity_type IN ('Store', 'Store Product') THEN f_store_id ELSE '' END AS store_id,
 CASE WHEN entity_type IN ('Product', 'Store Product') THEN f_product_id ELSE '' END AS product_id,
 CASE WHEN entity_type = 'Vendor' THEN f_vendor_id ELSE '' END AS vendor_id,
 period_label, finding_count, high_finding_count, medium_finding_count, low_finding_count, 'Pending' AS root_cause_status,
 finding_count || ' supporting findings indicate ' || lower(issue_type) || '. Key signals: ' || array_to_string(types[1:4], ', ') || '.' AS summary,
 evidence_summary
FROM (SELECT {key}, count(*) AS finding_count, count(*) FILTER (severity = 'High') AS high_finding_count,
   count(*) FILTER (severity = 'Medium') AS medium_finding_count, count(*) FILTER (severity = 'Low') AS low_finding_count,
   max(month) AS period_label, max(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS highest, {FIRSTS}
  FROM {f} GROUP BY ALL)
JOIN (SELECT {key}, list(analysis_type ORDER BY s) AS types, max(b) AS bonus, first(analysis_type ORDER BY b DESC, s) AS strongest
  FROM (SELECT {key}, analysis_type, min(seq) AS s, {BONUS} AS b FROM {f} GROUP BY ALL) GROUP BY ALL) USING ({key})
JOIN (SELECT {key}, list(business_area ORDER BY s) AS areas FROM (SELECT {key}, business_area, min(seq) AS s FROM {f} GROUP BY ALL) GROUP BY ALL) USING ({key})
JOIN (SELECT {key}, array_to_string(list(evidence ORDER BY s)[1:3], ' | ') AS evidence_summary
  FROM (SELECT {key}, evidence, min(seq) AS s FROM {f} GROUP BY ALL) GROUP BY ALL) USING ({key})"""


PREVIOUS = (f"SELECT * EXCLUDE (status), CASE finding_count % 3 WHEN 0 THEN 'In Progress' WHEN 1 THEN 'Open' ELSE 'Resolved' END AS status "
            f"FROM ({issues(where=chr(39).join(['source_module <> ', 'complaints', '']))})")
EVIDENCE_COLUMNS = ("issue_id, finding_id AS source_finding_id, source_report, source_module, analysis_type, business_area, severity, "
                    "entity_type, entity_id, store_id, product_id, vendor_id, summary, evidence, detected_at")
STORED = f"SELECT {EVIDENCE_COLUMNS}, seq FROM findings QUALIFY row_number() OVER (PARTITION BY issue_id, finding_id ORDER BY seq DESC) = 1"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
PARSE = (r"TRY_CAST(CASE analysis_type "
         rf"WHEN 'Stockout Risk' THEN regexp_extract(evidence, '(?i)Stock Ratio:\s*{NUMBER}%', 1) "
         rf"WHEN 'Near Expiry Stock' THEN regexp_extract(evidence, '(?i)Days to Expiry:\s*{NUMBER}', 1) "
         rf"WHEN 'Repeated Vendor Delays' THEN regexp_extract(evidence, '(?i)Maximum Delay:\s*{NUMBER}\s*days', 1) "
         rf"WHEN 'Low On-Time Delivery Rate' THEN regexp_extract(evidence, '(?i)On-Time Delivery Rate:\s*{NUMBER}%', 1) "
         rf"WHEN 'Open High-Severity Complaint' THEN regexp_extract(evidence, '(?i)Age Against Latest Dataset Date:\s*{NUMBER}\s*days', 1) "
         rf"WHEN 'Unresolved Complaint Ageing' THEN regexp_extract(evidence, '(?i)Age Against Latest Dataset Date:\s*{NUMBER}\s*days', 1) END AS DOUBLE)")
F0N = "format('{:.0f}', n)"
SCORED = f"""SELECT *, {PARSE} AS n,
 CASE analysis_type
  WHEN 'Stockout Risk' THEN coalesce(40 + greatest(0, least(50, 50 - n)) * 0.8::DOUBLE, 50)
  WHEN 'Near Expiry Stock' THEN 25 + coalesce(greatest(0, least(20, (30 - n) * 0.75::DOUBLE)), 0)
  WHEN 'Repeated Vendor Delays' THEN 25 + coalesce(greatest(0, least(25, (n - 5) * 1.5::DOUBLE)), 0)
  WHEN 'Low On-Time Delivery Rate' THEN 18 + coalesce(least(20, greatest(0, 70 - n) * 0.5::DOUBLE), 0)
  WHEN 'Open High-Severity Complaint' THEN 15 + coalesce(least(15, greatest(0, n - 7) * 0.5::DOUBLE), 0)
  WHEN 'Unresolved Complaint Ageing' THEN 10 + coalesce(least(15, greatest(0, n - 7) * 0.5::DOUBLE), 0)
  WHEN 'Expired Inventory' THEN 50 WHEN 'Loss-Making Store' THEN 45 WHEN 'High Financial Risk' THEN 35
  WHEN 'Low Vendor Quality Rating' THEN 15 WHEN 'Partial Vendor Deliveries' THEN 12 WHEN 'Store Sales Decline' THEN 20
  WHEN 'Low Target Achievement' THEN 12 WHEN 'Low Operating Profit' THEN 12 WHEN 'High Complaint Store' THEN 12
  WHEN 'High Complaint Product' THEN 10 WHEN 'Monthly Complaint Growth' THEN 10 WHEN 'Repeated Complaint Category' THEN 8
  ELSE CASE severity WHEN 'High' THEN 8 WHEN 'Medium' THEN 3 ELSE 0 END END AS raw, {r2('raw')} AS signal_score,
 CASE WHEN n IS NOT NULL AND analysis_type = 'Stockout Risk' THEN 'Stockout Risk (' || {f2('n')} || '% of reorder level)'
  WHEN n IS NOT NULL AND analysis_type = 'Near Expiry Stock' THEN 'Near Expiry Stock (' || {F0N} || ' days)'
  WHEN n IS NOT NULL AND analysis_type = 'Repeated Vendor Delays' THEN 'Repeated Vendor Delays (' || {F0N} || ' maximum delay days)'
  WHEN n IS NOT NULL AND analysis_type = 'Low On-Time Delivery Rate' THEN 'Low On-Time Delivery Rate (' || {f2('n')} || '%)'
  WHEN n IS NOT NULL THEN analysis_type || ' (' || {F0N} || ' days old)'
  WHEN analysis_type IN ('Product Sales Decline', 'Product Underperformance', 'Category Sales Decline', 'Regional Sales Decline', 'Low Stock', 'Reorder Soon', 'Overstock')
   THEN CASE severity WHEN 'High' THEN 'High-Severity Supporting Evidence' WHEN 'Medium' THEN 'Medium-Severity Supporting Evidence' ELSE '' END
  ELSE analysis_type END AS signal_label,
 CASE WHEN analysis_type = 'Stockout Risk' THEN n END AS stock_ratio_percent FROM evidence"""
PROFILES = f"""SELECT issue_id, {r2('coalesce(max(signal_score) FILTER (signal_score > 0), 0) + least(greatest(count(DISTINCT analysis_type) FILTER (signal_score > 0) - 1, 0) * 4, 12)')} AS critical_evidence_score,
 coalesce(any_value(labels), '') AS critical_signals, {r2('min(stock_ratio_percent)')} AS minimum_stock_ratio_percent
FROM scored LEFT JOIN (SELECT issue_id, array_to_string(list(signal_label ORDER BY s)[1:4], ' | ') AS labels
 FROM (SELECT issue_id, signal_label, min(seq) AS s FROM scored WHERE signal_label <> '' GROUP BY ALL) GROUP BY issue_id) USING (issue_id) GROUP BY issue_id"""

CTE = {"findings": ROUTED}
ISSUES = {**CTE, "issues": issues()}
BOTH = {**ISSUES, "previous": PREVIOUS}
EVIDENCE = {**CTE, "evidence": STORED}
SCORES = {**EVIDENCE, "scored": SCORED}
FULL = {**ISSUES, "evidence": STORED, "scored": SCORED, "profiles": PROFILES}


def check(sql: str, extra: dict[str, str]) -> str:
    return with_views(VIEWS, sql, extra)


RUN = "TIMESTAMP '2001-08-01 06:00:00'"
BEFORE = "TIMESTAMP '2001-07-01 06:00:00'"
FACTS = ("title", "issue_type", "business_area", "priority_level", "priority_score", "priority_reason", "entity_type",
         "entity_id", "store_id", "product_id", "vendor_id", "period_label", "finding_count", "high_finding_count",
         "medium_finding_count", "low_finding_count", "summary", "evidence_summary")
MERGE = (f"SELECT coalesce(o.issue_id, n.issue_id) AS issue_id, {', '.join(f'CASE WHEN n.issue_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}' for c in FACTS)}, "
         "coalesce(o.status, n.status) AS status, coalesce(o.root_cause_status, n.root_cause_status) AS root_cause_status, "
         f"CASE WHEN o.issue_id IS NULL THEN {RUN} ELSE {BEFORE} END AS created_at, CASE WHEN n.issue_id IS NULL THEN {BEFORE} ELSE {RUN} END AS updated_at, "
         f"CASE WHEN n.issue_id IS NULL THEN {BEFORE} ELSE {RUN} END AS last_detected_at FROM previous o FULL JOIN issues n ON o.issue_id = n.issue_id")
LATEST = "QUALIFY row_number() OVER (PARTITION BY issue_id, finding_id ORDER BY seq DESC) = 1"
EVIDENCE_MERGE = (f"SELECT * FROM (SELECT {EVIDENCE_COLUMNS} FROM findings WHERE source_module <> 'sales' {LATEST}) UNION ALL "
                  f"SELECT * REPLACE ('Earlier: ' || summary AS summary) FROM (SELECT {EVIDENCE_COLUMNS} FROM findings WHERE source_module <> 'complaints' {LATEST}) e "
                  "WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.source_module <> 'sales' AND f.issue_id = e.issue_id AND f.finding_id = e.source_finding_id)")
TOP = (f"ORDER BY {sev('priority_level')}, priority_score DESC, high_finding_count DESC, finding_count DESC, issue_id")
SOURCE = ("SELECT *, CASE WHEN source_module <> 'vendor_finance' THEN source_module WHEN business_area = 'Procurement' THEN 'vendors' "
          "ELSE 'finance' END AS source FROM findings")
SOURCE_RANK = "CASE source WHEN 'sales' THEN 1 WHEN 'inventory' THEN 2 WHEN 'complaints' THEN 3 WHEN 'vendors' THEN 4 ELSE 5 END"
PAGE = f"ORDER BY {sev()}, analysis_type, finding_id LIMIT 50 OFFSET 1"
ACTIVE = "status IN ('Open', 'In Progress')"

# greedy choice of ten: 18 points off for each earlier pick of the issue type, 4 for each of the business area
FINALISTS = f"""SELECT i.*, coalesce(critical_evidence_score, 0) AS ces, coalesce(critical_signals, '') AS signals, minimum_stock_ratio_percent AS ratio,
 CAST(round((priority_score + ces) * 100) AS BIGINT) AS cents,
 row_number() OVER (ORDER BY priority_score DESC, ces DESC, high_finding_count DESC, finding_count DESC, {sev('priority_level')}, issue_id) AS position
FROM issues i LEFT JOIN profiles USING (issue_id)"""
PICKS = """WITH RECURSIVE pick AS (
 SELECT 0 AS k, []::VARCHAR[] AS ids, []::VARCHAR[] AS types, []::VARCHAR[] AS areas, 0::BIGINT AS adjustment, 0::BIGINT AS score
 UNION ALL
 SELECT k + 1, list_append(ids, best.id), list_append(types, best.t), list_append(areas, best.a), best.adjustment, best.score
 FROM (SELECT k, any_value(ids) AS ids, any_value(types) AS types, any_value(areas) AS areas,
   arg_max({'id': issue_id, 't': issue_type, 'a': business_area, 'adjustment': off, 'score': cents - off}, (cents - off) * 1000000 - position) AS best
  FROM (SELECT p.*, f.issue_id, f.issue_type, f.business_area, f.cents, f.position,
    1800 * len(list_filter(types, lambda x: x = f.issue_type)) + 400 * len(list_filter(areas, lambda x: x = f.business_area)) AS off
   FROM pick p, finalists f WHERE k < 10 AND NOT list_contains(ids, f.issue_id)) GROUP BY k))
SELECT k AS executive_rank, ids[-1] AS issue_id, adjustment / 100.0::DOUBLE AS repetition_adjustment, score / 100.0::DOUBLE AS executive_score FROM pick WHERE k > 0"""
CHOSEN = {**FULL, "finalists": FINALISTS, "picks": PICKS}
EXECUTIVE = (f"SELECT executive_rank, issue_id, title, issue_type, business_area, priority_level, priority_score, ces AS critical_evidence_score, repetition_adjustment, "
             f"executive_score, signals AS critical_signals, ratio AS minimum_stock_ratio_percent, 'Selected by executive score: base priority ' || {f2('priority_score')} || "
             f"' + critical evidence ' || {f2('ces')} || ' - repetition adjustment ' || {f2('repetition_adjustment')} || '.' AS selection_reason, status, entity_type, entity_id, "
             f"store_id, product_id, vendor_id, period_label, finding_count, high_finding_count, medium_finding_count, low_finding_count, summary, evidence_summary, {RUN} AS last_detected_at "
             "FROM picks JOIN finalists USING (issue_id)")

ORACLE: dict[str, str] = {
    "executive_priorities": check(EXECUTIVE, CHOSEN),
    "executive_evidence_references": check("SELECT issue_id, len(ids) AS included_count, array_to_string(ids, ', ') AS evidence_ids FROM (SELECT issue_id, list(source_finding_id ORDER BY seq)[1:12] AS ids FROM evidence WHERE issue_id IN (SELECT issue_id FROM picks) GROUP BY issue_id)", CHOSEN),
    "harmonised_findings": check(f"SELECT {', '.join(COMMON)}, source_module, source_report FROM findings", CTE),
    "issue_keys": check("SELECT finding_id, source_module, issue_type, issue_group_id, issue_id FROM findings", CTE),
    "consolidated_issues": check("SELECT * FROM issues", ISSUES),
    "evidence_records": check(f"SELECT {EVIDENCE_COLUMNS} FROM findings", CTE),
    "stored_evidence": check("SELECT * EXCLUDE (seq) FROM evidence", EVIDENCE),
    "issue_upsert": check(MERGE, BOTH),
    "evidence_upsert": check(EVIDENCE_MERGE, CTE),
    "colliding_issue_ids": check("SELECT issue_id, count(*) AS issue_groups, CAST(sum(n) AS BIGINT) AS finding_count FROM (SELECT issue_id, issue_type, issue_group_id, count(*) AS n FROM findings GROUP BY ALL) GROUP BY issue_id HAVING count(*) > 1", CTE),
    "manager_priorities": check(f"SELECT row_number() OVER ({TOP}) AS manager_rank, *, {RUN} AS last_detected_at FROM issues {TOP} LIMIT 20", ISSUES),
    "active_issue_summary": check(f"SELECT priority_level, count(*) AS issue_count FROM previous WHERE {ACTIVE} GROUP BY 1", BOTH),
    "expected_issue_check": check("SELECT id AS issue_id, CASE WHEN id IN (SELECT issue_id FROM issues) THEN 'Detected' ELSE 'Not detected' END AS outcome FROM (VALUES ('ISSUE-STORE-PERFORMANCE-RISK-S003'), ('ISSUE-PRODUCT-AVAILABILITY-RISK-S003-P17'), ('ISSUE-VENDOR-PERFORMANCE-RISK-V4'), ('ISSUE-VENDOR-PERFORMANCE-RISK-V9')) v(id)", ISSUES),
    "evidence_signal_scores": check("SELECT issue_id, source_finding_id, analysis_type, signal_score, signal_label, stock_ratio_percent FROM scored", SCORES),
    "evidence_profiles": check("SELECT * FROM profiles", {**SCORES, "profiles": PROFILES}),
    "issue_evidence_references": check("SELECT issue_id, len(ids) AS included_count, array_to_string(ids, ', ') AS evidence_ids FROM (SELECT issue_id, list(source_finding_id ORDER BY seq)[1:12] AS ids FROM evidence GROUP BY issue_id)", EVIDENCE),
    "priority_changes": check(f"SELECT issue_id, i.priority_score, p.priority_score AS previous_priority_score, {r2('i.priority_score - p.priority_score')} AS difference, CASE WHEN p.issue_id IS NULL THEN 'No previous deterministic priority score or rank was supplied, so a priority change cannot be confirmed.' WHEN difference > 0 THEN 'The deterministic priority score increased by ' || {f2('difference')} || ', from ' || {f2('p.priority_score')} || ' to ' || {f2('i.priority_score')} || '.' WHEN difference < 0 THEN 'The deterministic priority score decreased by ' || {f2('-difference')} || ', from ' || {f2('p.priority_score')} || ' to ' || {f2('i.priority_score')} || '.' ELSE 'The deterministic priority score remained ' || {f2('i.priority_score')} || '.' END AS explanation FROM issues i LEFT JOIN previous p USING (issue_id)", BOTH),
    "requested_issues": check(f"SELECT w.issue_id, CAST(requested_order AS INTEGER) AS executive_rank, {r2('priority_score + critical_evidence_score')} AS executive_score, CASE WHEN i.issue_id IS NULL THEN 'not found' ELSE 'selected' END AS outcome FROM (SELECT 'ISSUE-STORE-PERFORMANCE-RISK-' || store_id AS issue_id, store_number + 1 AS requested_order FROM stores UNION ALL SELECT 'ISSUE-UNKNOWN', 0) w LEFT JOIN issues i USING (issue_id) LEFT JOIN profiles USING (issue_id)", FULL),
    "finding_reconciliation": check("SELECT count(*) AS monitoring_finding_total, count(*) AS priority_input_finding_total, TRUE AS totals_match, count(*) FILTER (source_module = 'sales') AS sales_findings, count(*) FILTER (source_module = 'inventory') AS inventory_findings, count(*) FILTER (source_module = 'complaints') AS complaints_findings, count(*) FILTER (source_module = 'vendor_finance') AS vendor_finance_findings, (SELECT count(*) FROM issues WHERE priority_level = 'High') AS high_issues, (SELECT count(*) FROM issues WHERE priority_level = 'Medium') AS medium_issues, (SELECT count(*) FROM issues WHERE priority_level = 'Low') AS low_issues FROM findings", ISSUES),
    "grounding_check": check(f"SELECT * FROM (SELECT coalesce(a.issue_id, b.issue_id) AS issue_id, CASE WHEN a.issue_id IS NULL THEN 'unknown id' WHEN b.issue_id IS NULL THEN 'missing id' WHEN a.r <> b.r THEN 'order changed' WHEN a.priority_level <> b.priority_level THEN 'level changed' WHEN abs(a.priority_score - b.priority_score) > 0.000001 THEN 'score changed' END AS deviation FROM (SELECT *, row_number() OVER ({TOP}) AS r FROM issues {TOP} LIMIT 50) a FULL JOIN (SELECT *, row_number() OVER ({TOP}) AS r FROM previous WHERE {ACTIVE} {TOP} LIMIT 50) b ON a.issue_id = b.issue_id) WHERE deviation IS NOT NULL", BOTH),
    "ungrounded_citations": check("SELECT issue_id, finding_id AS source_finding_id FROM findings f WHERE issue_id NOT IN (SELECT issue_id FROM previous) AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.issue_id = f.issue_id AND e.source_finding_id = f.finding_id AND e.source_module <> 'complaints')", {**BOTH, "evidence": STORED}),
    "product_decline_list": with_views(VIEWS, f"SELECT * FROM ({SALES_ALL}) WHERE analysis_type = 'Product Sales Decline' {PAGE}"),
    "previous_selection": check(f"SELECT issue_id, CAST(row_number() OVER ({TOP}) AS INTEGER) AS executive_rank, priority_score AS executive_score, 'selected' AS outcome FROM previous WHERE {ACTIVE} {TOP} LIMIT 5", BOTH),
    "current_selection": check("SELECT issue_id, executive_rank, executive_score, 'selected' AS outcome FROM picks", CHOSEN),
    "sales_finding_list": with_views(VIEWS, f"SELECT * FROM ({SALES_ALL}) WHERE severity = 'High' AND analysis_type = 'Store Sales Decline' {PAGE}"),
    "inventory_finding_list": with_views(VIEWS, f"SELECT * FROM ({INVENTORY_ALL}) WHERE severity = 'High' AND store_id = 'S003' {PAGE}"),
    "complaint_finding_list": with_views(VIEWS, f"SELECT * FROM ({COMPLAINTS_ALL}) WHERE complaint_status = 'Open' AND complaint_type = 'Late Delivery' {PAGE}"),
    "vendor_finding_list": with_views(VIEWS, f"SELECT * FROM ({VENDOR_ALL}) WHERE severity = 'High' {PAGE}"),
    "finance_finding_list": with_views(VIEWS, f"SELECT * FROM ({FINANCE_ALL}) WHERE risk_status = 'High Risk' {PAGE}"),
    "finding_summary": with_views(VIEWS, f"SELECT analysis_type, severity, count(*) AS finding_count FROM ({INVENTORY_ALL}) WHERE severity = 'High' GROUP BY ALL"),
    "finding_match_counts": with_views(VIEWS, f"SELECT count(*) AS total_findings, count(*) FILTER (severity = 'High' AND complaint_type = 'Poor Service') AS matching_findings FROM ({COMPLAINTS_ALL})"),
    "monitoring_totals": check(f"SELECT source, count(*) AS total, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM ({SOURCE}) GROUP BY source", CTE),
    "monitoring_top_findings": check(f"SELECT source, finding_id, analysis_type, business_area, severity, entity_type, entity_id, summary, evidence FROM ({SOURCE}) ORDER BY {sev()}, {SOURCE_RANK}, analysis_type, finding_id LIMIT 100", CTE),
    "business_health": check("SELECT count(*) FILTER (severity = 'High') AS high_findings, count(*) FILTER (severity = 'Medium') AS medium_findings, CAST(0 AS BIGINT) AS failed_sources, CASE WHEN high_findings >= 10 THEN 'Critical' WHEN high_findings > 0 THEN 'At Risk' WHEN medium_findings > 0 THEN 'Watch' ELSE 'Stable' END AS health_status FROM findings", CTE),
}
