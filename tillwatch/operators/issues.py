"""Consolidation of findings into scored issues with evidence.

Lists in an issue follow the arrival order of its findings: module, then each
module's report order. That order is a struct column, so every "first" and
"unique in order" is an aggregate. Anything a hot issue could make long (its
evidence texts) is ranked and cut per issue before it is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import (
    clean_column_or_nan, clean_text, level, lit, round2, safe_identifier, say, severity_rank, text_list, text_or_nan,
)
from tillwatch.operators.templates import aggregates, first_per_key, first_rows, order_by
from tillwatch.thresholds import DEFAULTS, Thresholds

COMMON = (
    "finding_id", "analysis_type", "business_area", "severity", "entity_type", "entity_id",
    "entity_name", "store_id", "store_name", "product_id", "product_name", "vendor_id",
    "vendor_name", "complaint_type", "month", "summary", "evidence", "status", "detected_at",
)
# fixed values: module, report name, and the two report sort keys after severity and type
MODULES = {
    "sales": ("sales_analysis.csv", "sales_change_percent", "target_achievement_percent"),
    "inventory": ("inventory_analysis.csv", "stock_ratio", "CAST(days_to_expiry AS DOUBLE)"),
    "complaints": ("complaint_analysis.csv", "-CAST(complaint_age_days AS DOUBLE)", "-CAST(total_complaints AS DOUBLE)"),
    "vendor_finance": ("vendor_finance_analysis.csv", "-average_delay_days", "target_achievement_percent"),
}
# fixed values: score bonus of the strongest signal in an issue
CRITICAL_SIGNALS = {
    "Stockout Risk": 30.0, "Expired Inventory": 30.0, "Near Expiry Stock": 25.0,
    "High Financial Risk": 30.0, "Loss-Making Store": 30.0, "Store Sales Decline": 25.0,
    "High Complaint Store": 20.0, "Monthly Complaint Growth": 15.0,
    "Open High-Severity Complaint": 15.0, "Unresolved Complaint Ageing": 15.0,
    "Repeated Vendor Delays": 25.0, "Low On-Time Delivery Rate": 20.0,
    "Low Vendor Quality Rating": 20.0, "Partial Vendor Deliveries": 15.0,
    "Low Target Achievement": 15.0, "Low Operating Profit": 15.0,
}
ISSUE_KEY = ["issue_type", "issue_group_id"]
FIRST_VALUES = ("store_name", "product_name", "vendor_name", "complaint_type", "store_id",
                "product_id", "vendor_id", "entity_type", "entity_id")


def harmonise(findings: DataFrame, module: str) -> DataFrame:
    """Common columns of one finding family, with its source and arrival order."""
    report, first, second = MODULES[module]
    have = set(findings.columns)
    area = "business_area" if module == "vendor_finance" else "''"
    last = "CAST('Infinity' AS DOUBLE)"
    return findings.selectExpr(
        *[f"{c if c in have else 'CAST(NULL AS STRING)'} AS {c}" for c in COMMON],
        f"'{module}' AS source_module", f"'{report}' AS source_report",
        f"struct({list(MODULES).index(module) + 1} AS module, {severity_rank()} AS severity, {area} AS area, "
        f"analysis_type AS type, coalesce({first}, {last}) AS first, coalesce({second}, {last}) AS second, "
        "finding_id AS finding_id) AS arrival",
    )


def all_findings(families: dict[str, DataFrame]) -> DataFrame:
    parts = [harmonise(df, module) for module, df in families.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _or(first: str, other: str) -> str:
    return f"CASE WHEN {first} <> '' THEN {first} ELSE {other} END"


def with_issue_key(findings: DataFrame, recorded: bool = False) -> DataFrame:
    """Route every finding to the manager-facing issue it supports; the texts of `recorded` findings (findings.record) are clean but for 'nan'."""
    clean = text_or_nan if recorded else clean_column_or_nan
    cleaned = findings.selectExpr(
        *[c for c in findings.columns if c not in COMMON],
        *[f"{clean(c)} AS {c}" for c in COMMON])
    store_product = _or("trim(BOTH '-' FROM concat(store_id, '-', product_id))", "entity_id")
    store, vendor = _or("store_id", "entity_id"), _or("vendor_id", "entity_id")
    product_sales = "analysis_type IN ('Product Sales Decline', 'Product Underperformance') AND product_id <> ''"
    routes = [
        ("business_area = 'Operations' AND analysis_type = 'Overstock'", "Inventory Overstock Risk", store_product),
        ("business_area = 'Operations'", "Product Availability Risk", store_product),
        (f"business_area = 'Sales' AND {product_sales}", "Product Sales Performance Risk", "product_id"),
        ("business_area IN ('Sales', 'Finance')", "Store Performance Risk", store),
        ("business_area = 'Customer Support' AND analysis_type = 'High Complaint Product'",
         "Product Complaint Risk", _or("product_id", "entity_id")),
        ("business_area = 'Customer Support' AND analysis_type = 'Repeated Complaint Category'",
         "Repeated Complaint Category Risk", _or("complaint_type", "entity_id")),
        ("business_area = 'Customer Support' AND analysis_type IN ('High Complaint Store', 'Monthly Complaint Growth')",
         "Store Performance Risk", store),
        ("business_area = 'Customer Support'", "Complaint Resolution Backlog", store),
        ("business_area = 'Procurement'", "Vendor Performance Risk", vendor),
    ]
    kinds = " ".join(f"WHEN {c} THEN {lit(kind)}" for c, kind, _ in routes)
    groups = " ".join(f"WHEN {c} THEN {group}" for c, _, group in routes)
    routed = cleaned.selectExpr(
        "*", f"CASE {kinds} ELSE 'General Business Risk' END AS issue_type",
        f"CASE {groups} ELSE {_or('entity_id', 'analysis_type')} END AS issue_group_id")
    # of texts that are known here, so they are made while planning
    slugs = "CASE issue_type " + " ".join(f"WHEN {lit(kind)} THEN {safe_identifier(lit(kind))}" for _, kind, _ in routes) + (
        f" ELSE {safe_identifier(lit('General Business Risk'))} END")
    return routed.selectExpr(
        "*", say("ISSUE-{a}-{b}", a=slugs, b=safe_identifier("issue_group_id")) + " AS issue_id")


def _number_map(values: dict[str, float]) -> str:
    return "map(" + ", ".join(f"{lit(k)}, {v}D" for k, v in values.items()) + ")"


TITLES = (
    "CASE issue_type "
    f"WHEN 'Store Performance Risk' THEN {say('Store performance risk at {x}', x=_or('store_name', 'group_text'))} "
    f"WHEN 'Product Availability Risk' THEN {say('Product availability risk: {x} at {y}', x=_or('product_name', 'group_text'), y=_or('store_name', lit('store')))} "
    f"WHEN 'Inventory Overstock Risk' THEN {say('Overstock risk: {x} at {y}', x=_or('product_name', 'group_text'), y=_or('store_name', lit('store')))} "
    f"WHEN 'Complaint Resolution Backlog' THEN {say('Complaint resolution backlog at {x}', x=_or('store_name', 'group_text'))} "
    f"WHEN 'Product Complaint Risk' THEN {say('High complaint risk for {x}', x=_or('product_name', 'group_text'))} "
    f"WHEN 'Repeated Complaint Category Risk' THEN {say('Repeated complaint category: {x}', x=_or('complaint_type', 'group_text'))} "
    f"WHEN 'Vendor Performance Risk' THEN {say('Vendor performance risk: {x}', x=_or('vendor_name', 'group_text'))} "
    f"WHEN 'Product Sales Performance Risk' THEN {say('Product sales performance risk: {x}', x=_or('product_name', 'group_text'))} "
    f"ELSE {say('{issue_type}: {group_text}')} END"
)
STORE_TYPES = text_list(("Store Performance Risk", "Complaint Resolution Backlog"))
STOCK_TYPES = text_list(("Product Availability Risk", "Inventory Overstock Risk"))
PRODUCT_TYPES = text_list(("Product Complaint Risk", "Product Sales Performance Risk"))
ENTITY = {
    "entity_type": f"CASE WHEN issue_type IN ({STORE_TYPES}) THEN 'Store' WHEN issue_type IN ({STOCK_TYPES}) THEN 'Store Product' "
                   f"WHEN issue_type IN ({PRODUCT_TYPES}) THEN 'Product' WHEN issue_type = 'Vendor Performance Risk' THEN 'Vendor' "
                   "WHEN issue_type = 'Repeated Complaint Category Risk' THEN 'Complaint Category' ELSE first_entity_type END",
    "entity_id": f"CASE WHEN issue_type IN ({STORE_TYPES}) THEN store WHEN issue_type IN ({STOCK_TYPES}) "
                 "THEN concat_ws('-', nullif(store, ''), nullif(product, '')) "
                 f"WHEN issue_type IN ({PRODUCT_TYPES}) THEN product WHEN issue_type = 'Vendor Performance Risk' THEN vendor "
                 "WHEN issue_type = 'Repeated Complaint Category Risk' THEN complaint_type ELSE first_entity_id END",
    "store_id": f"CASE WHEN issue_type IN ({STORE_TYPES}, {STOCK_TYPES}, 'General Business Risk') THEN store ELSE '' END",
    "product_id": f"CASE WHEN issue_type IN ({STOCK_TYPES}, {PRODUCT_TYPES}, 'General Business Risk') THEN product ELSE '' END",
    "vendor_id": "CASE WHEN issue_type IN ('Vendor Performance Risk', 'General Business Risk') THEN vendor ELSE '' END",
}


def consolidate(keyed: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per issue with its score, level, reason and texts."""
    kinds = keyed.groupBy(*ISSUE_KEY, "issue_id", "analysis_type", "business_area", "severity").agg(*aggregates({
        "findings": "count(*)", "last_month": "max(month)", "arrival": "min(arrival)",
        **{f"first_{c}": f"min(struct(arrival, {c})) FILTER (WHERE {c} <> '')" for c in FIRST_VALUES},
    }))
    grouped = kinds.groupBy(*ISSUE_KEY, "issue_id").agg(*aggregates({
        "finding_count": "sum(findings)",
        "high_finding_count": "sum(if(severity = 'High', findings, 0))",
        "medium_finding_count": "sum(if(severity = 'Medium', findings, 0))",
        "low_finding_count": "sum(if(severity = 'Low', findings, 0))",
        "period_label": "coalesce(max(last_month), '')",
        # at most one entry per rule, area and severity
        "kinds": "array_sort(collect_list(struct(arrival, analysis_type, business_area, severity)))",
        **{f"first_{c}": f"coalesce(min(first_{c}).{c}, '')" for c in FIRST_VALUES},
    }))
    samples = first_per_key(
        keyed.where("evidence <> ''").groupBy("issue_id", *ISSUE_KEY, "evidence").agg(*aggregates({"arrival": "min(arrival)"})),
        ", ".join(ISSUE_KEY), "arrival", keep=3,
    ).groupBy(*ISSUE_KEY).agg(*aggregates({
        "evidence_summary": "concat_ws(' | ', transform(array_sort(collect_list(struct(arrival, evidence))), x -> x.evidence))"}))

    def distinct(name: str) -> str:
        return f"array_distinct(filter(transform(kinds, x -> x.{name}), v -> v <> ''))"

    bonus = f"coalesce(element_at({_number_map(CRITICAL_SIGNALS)}, x), 0D)"
    listed = grouped.join(samples, ISSUE_KEY, "left").selectExpr(
        *ISSUE_KEY, "issue_id", "finding_count", "high_finding_count", "medium_finding_count",
        "low_finding_count", "period_label", "coalesce(evidence_summary, '') AS evidence_summary",
        f"{distinct('analysis_type')} AS types", f"{distinct('business_area')} AS areas",
        f"{distinct('severity')} AS severities",
        "first_store_name AS store_name", "first_product_name AS product_name", "first_vendor_name AS vendor_name",
        "first_complaint_type AS complaint_type", "first_store_id AS store", "first_product_id AS product",
        "first_vendor_id AS vendor", "first_entity_type", "first_entity_id",
        f"{clean_text('issue_group_id')} AS group_text",
    ).selectExpr(
        "*", f"coalesce(array_max(transform(types, x -> {bonus})), 0D) AS signal_bonus",
        f"coalesce(array_max(transform(severities, s -> CASE s WHEN 'High' THEN {t.high_severity_points}D "
        f"WHEN 'Medium' THEN {t.medium_severity_points}D ELSE {t.low_severity_points}D END)), 0D) AS severity_points",
        "CASE WHEN array_contains(severities, 'High') THEN 'High' WHEN array_contains(severities, 'Medium') THEN 'Medium' "
        "ELSE 'Low' END AS highest",
    ).selectExpr(
        "*", f"filter(types, x -> {bonus} = signal_bonus)[0] AS strongest",
        f"severity_points + least(greatest(high_finding_count - 1, 0) * {t.additional_high_bonus}D, {t.max_additional_high_bonus}D) "
        f"+ least(greatest(size(areas) - 1, 0) * {t.cross_area_bonus}D, {t.max_cross_area_bonus}D) "
        f"+ least(greatest(finding_count - 1, 0) * {t.volume_bonus}D, {t.max_volume_bonus}D) + signal_bonus AS raw_score",
    ).selectExpr(
        "*", round2("least(greatest(raw_score, CASE highest WHEN 'High' THEN 70D WHEN 'Medium' THEN 50D ELSE 0D END), 100D)")
        + " AS priority_score")
    return listed.selectExpr(
        "issue_id", f"{TITLES} AS title", "issue_type",
        "CASE WHEN size(areas) > 1 THEN 'Cross-Functional' ELSE coalesce(get(areas, 0), 'General') END AS business_area",
        f"{level('priority_score', t)} AS priority_level", "priority_score",
        say("Highest Severity: {highest}; Strongest Signal: {s}; Supporting Findings: {finding_count}; Business Areas: {a}",
            s="coalesce(strongest, 'General business risk')", a="array_join(areas, ', ')") + " AS priority_reason",
        "'Open' AS status", *[f"{sql} AS {name}" for name, sql in ENTITY.items()], "period_label",
        "finding_count", "high_finding_count", "medium_finding_count", "low_finding_count",
        "'Pending' AS root_cause_status",
        say("{finding_count} supporting findings indicate {kind}. Key signals: {signals}.", kind="lower(issue_type)",
            signals="array_join(slice(types, 1, 4), ', ')") + " AS summary", "evidence_summary",
    )


def evidence_rows(keyed: DataFrame) -> DataFrame:
    """One row per finding, with the issue it supports (before key collisions are resolved)."""
    return keyed.selectExpr(
        "issue_id", "finding_id AS source_finding_id", "source_report", "source_module", "analysis_type",
        "business_area", "severity", "entity_type", "entity_id", "store_id", "product_id", "vendor_id",
        "summary", "evidence", "detected_at", "arrival")


EVIDENCE_HASH = "xxhash64(issue_id, source_finding_id) AS key_hash"


def repeated_evidence(rows: DataFrame) -> DataFrame:
    """(key_hash): hashes of (issue, finding id) that more than one row has; every key that repeats is among them."""
    return rows.selectExpr(EVIDENCE_HASH).groupBy("key_hash").agg(*aggregates({"n": "count(*)"})).where("n > 1").select("key_hash")


def stored_evidence(rows: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Evidence after the upsert by (issue, finding id): the last arrival wins.

    Where the repeated_evidence of the rows is at hand, only rows with such a key are dealt and ranked: texts of keys that come once stay where they are."""
    keys, last = "issue_id, source_finding_id", "arrival DESC"
    if repeated is None:
        return first_per_key(rows, keys, last)
    hashed = rows.selectExpr("*", EVIDENCE_HASH)
    once, more = (hashed.join(repeated, "key_hash", how).drop("key_hash") for how in ("left_anti", "left_semi"))
    return once.unionByName(first_per_key(more, keys, last))


def order_issues(issues: DataFrame) -> DataFrame:
    return order_by(issues, severity_rank("priority_level"), "priority_score DESC", "finding_count DESC", "issue_id")


PRESERVED = ("status", "root_cause_status", "created_at")


def merge_issues(stored: DataFrame, fresh: DataFrame, run_at: str) -> DataFrame:
    """Upsert by issue_id: new facts replace old ones, workflow columns of known issues stay.

    Where two groups share an id, one row of it counts on either side: that of the highest score, then of the last group."""
    now = f"TIMESTAMP_NTZ '{run_at}'"

    def one_each(df: DataFrame, name: str) -> DataFrame:
        order = ", ".join(c for c in ("priority_score", "issue_type", "issue_group_id") if c in df.columns) or "issue_id"
        return df.groupBy("issue_id").agg(*aggregates({name: f"max_by(struct({', '.join(df.columns)}), struct({order}))"}))

    incoming, old = one_each(fresh, "new"), one_each(stored, "old")
    merged = old.join(incoming, "issue_id", "full_outer")
    body = [
        f"coalesce(old.{c}, new.{c}) AS {c}" if c in PRESERVED else f"if(new IS NULL, old.{c}, new.{c}) AS {c}"
        for c in fresh.columns if c != "issue_id"
    ]
    return merged.selectExpr(
        "issue_id", *body, f"coalesce(old.created_at, {now}) AS created_at",
        f"if(new IS NULL, old.updated_at, {now}) AS updated_at",
        f"if(new IS NULL, old.last_detected_at, {now}) AS last_detected_at")


def merge_evidence(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by (issue_id, source_finding_id); within a run the last arrival wins."""
    keys = ["issue_id", "source_finding_id"]
    latest = stored_evidence(fresh).drop("arrival")
    kept = stored.select(*latest.columns).join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest)


def colliding_issue_ids(keyed: DataFrame) -> DataFrame:
    """Issue ids that more than one issue group maps to after slugging."""
    groups = keyed.groupBy("issue_id", *ISSUE_KEY).agg(*aggregates({"findings": "count(*)"}))
    return groups.groupBy("issue_id").agg(*aggregates({"issue_groups": "count(*)", "finding_count": "sum(findings)"})).where(
        "issue_groups > 1")


ACTIVE = "status IN ('Open', 'In Progress')"
MANAGER_ORDER = (f"{severity_rank('priority_level')}, priority_score DESC, high_finding_count DESC, "
                 "finding_count DESC, last_detected_at DESC, issue_id")


def manager_priorities(issues: DataFrame, limit: int = 20) -> DataFrame:
    active = issues.where(ACTIVE)
    return first_rows(active, limit, MANAGER_ORDER, rank="manager_rank")


def active_summary(issues: DataFrame) -> DataFrame:
    counted = issues.where(ACTIVE).groupBy("priority_level").agg(*aggregates({"issue_count": "count(*)"}))
    return order_by(counted, severity_rank("priority_level"))


def expected_issues(issues: DataFrame, expected: list[str]) -> DataFrame:
    """Are the expected issues there?"""
    wanted = issues.sparkSession.createDataFrame([(i,) for i in expected], "issue_id string")
    found = issues.select("issue_id").distinct().selectExpr("issue_id", "TRUE AS detected")
    return wanted.join(found, "issue_id", "left").selectExpr(
        "issue_id", "if(detected, 'Detected', 'Not detected') AS outcome")


def priority_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Explain the score change against the previous run."""
    before = previous.selectExpr("issue_id", "CAST(priority_score AS DOUBLE) AS previous_priority_score")
    two = lambda x: f"format_number({x}, '0.00')"
    texts = dict(diff=two("abs(difference)"), old=two("previous_priority_score"), new=two("priority_score"))
    return current.join(before, "issue_id", "left").selectExpr(
        "issue_id", "priority_score", "previous_priority_score",
        f"{round2('priority_score - previous_priority_score')} AS difference",
    ).selectExpr(
        "*", "CASE WHEN difference IS NULL THEN 'No previous deterministic priority score or rank was supplied, "
        "so a priority change cannot be confirmed.' "
        f"WHEN difference > 0 THEN {say('The deterministic priority score increased by {diff}, from {old} to {new}.', **texts)} "
        f"WHEN difference < 0 THEN {say('The deterministic priority score decreased by {diff}, from {old} to {new}.', **texts)} "
        f"ELSE {say('The deterministic priority score remained {new}.', **texts)} END AS explanation")


def reconciliation(monitored: DataFrame, findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Finding totals of two runs side by side, with counts by source and level."""
    total = monitored.selectExpr("count(*)").scalar()
    by_source = findings.groupBy("source_module").agg(*aggregates({"n": "count(*)"})).selectExpr(
        "map_from_entries(array_sort(collect_list(struct(source_module, n))))").scalar()
    by_level = issues.groupBy("priority_level").agg(*aggregates({"n": "count(*)"})).selectExpr(
        "map_from_entries(array_sort(collect_list(struct(priority_level, n))))").scalar()
    return findings.selectExpr("count(*) AS priority_input_finding_total").select(
        total.alias("monitoring_finding_total"), "priority_input_finding_total",
        by_source.alias("by_source"), by_level.alias("by_level"),
    ).selectExpr(
        "monitoring_finding_total", "priority_input_finding_total",
        "monitoring_finding_total = priority_input_finding_total AS totals_match",
        *[f"coalesce(by_source['{m}'], 0) AS {m}_findings" for m in MODULES],
        *[f"coalesce(by_level['{x}'], 0) AS {x.lower()}_issues" for x in ("High", "Medium", "Low")])


def grounding_check(reference: DataFrame, returned: DataFrame) -> DataFrame:
    """Compare returned ranked items with the deterministic ones; one row per deviation."""
    ref = reference.selectExpr("issue_id", "rank AS expected_rank", "priority_level AS expected_level",
                               "priority_score AS expected_score")
    got = returned.selectExpr("issue_id", "rank", "priority_level", "priority_score")
    return ref.join(got, "issue_id", "full_outer").selectExpr(
        "issue_id",
        "CASE WHEN expected_rank IS NULL THEN 'unknown id' WHEN rank IS NULL THEN 'missing id' "
        "WHEN rank <> expected_rank THEN 'order changed' WHEN priority_level <> coalesce(nullif(expected_level, ''), 'Unknown') THEN 'level changed' "
        "WHEN abs(priority_score - coalesce(expected_score, 0)) > 0.000001D THEN 'score changed' END AS deviation",
    ).where("deviation IS NOT NULL")


def ungrounded_citations(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited (issue_id, source_finding_id) pairs that the evidence does not hold."""
    return cited.join(evidence.select("issue_id", "source_finding_id"), ["issue_id", "source_finding_id"], "left_anti")
