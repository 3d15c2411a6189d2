"""Recommendations: one template per kind of issue, deadline by priority, confidence by evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import clean_text, lit, round2, say, zero
from tillwatch.operators.issues import ACTIVE

# fixed values, first match wins: root-cause category, issue type, title, owner, base days, expected impact, four steps
TEMPLATES = (
    ("Inventory Replenishment and Supply Risk", "Product Availability Risk", "Restore product availability",
     "Inventory Manager", 3,
     "Reduce stockout exposure, protect product sales, and prevent additional availability-related complaints.",
     ("Confirm the latest physical stock and pending purchase-order quantity for the affected product.",
      "Arrange an urgent stock transfer from a nearby store or expedite the existing vendor order.",
      "Review the reorder level and recent sales velocity to determine whether the replenishment setting is too low.",
      "Track stock daily until inventory returns to a safe operating level.")),
    ("Multi-Factor Store Performance Deterioration", "Store Performance Risk", "Launch store performance recovery plan",
     "Regional Operations Manager", 7,
     "Improve store sales, target achievement, operating performance, and customer experience.",
     ("Review the largest declining categories and products with the store manager.",
      "Identify whether low stock, customer complaints, pricing, promotions, or local execution are reducing sales.",
      "Create a short recovery plan with category-level sales targets and accountable owners.",
      "Review progress weekly against sales, profit, inventory, and complaint indicators.")),
    ("Vendor Reliability and Fulfilment Risk", "Vendor Performance Risk", "Correct vendor delivery performance",
     "Procurement Manager", 5,
     "Improve delivery reliability, reduce replenishment delays, and lower the risk of store-level stock shortages.",
     ("Review recent delayed and partial deliveries against the vendor service-level agreement.",
      "Request a corrective delivery plan with confirmed dispatch dates and quantity commitments.",
      "Identify products and stores currently exposed to the vendor's delivery risk.",
      "Prepare a backup supplier or alternative fulfilment route if performance does not improve.")),
    ("Customer Support Resolution and Escalation Backlog", "Complaint Resolution Backlog",
     "Clear complaint resolution backlog", "Customer Support Manager", 3,
     "Reduce unresolved and high-severity complaints, improve response time, and limit customer dissatisfaction.",
     ("Separate high-severity and aged complaints for immediate review and escalation.",
      "Assign a named owner and target resolution date to every open or in-progress complaint.",
      "Identify the leading complaint categories and address their operational causes with the relevant store team.",
      "Review backlog size and closure rate daily until the open-case level returns to normal.")),
    ("Product Quality, Availability, or Service Experience Risk", "Product Complaint Risk",
     "Investigate recurring product complaints", "Quality Assurance Manager", 5,
     "Reduce repeated product complaints and identify whether quality, packaging, availability, or fulfilment is responsible.",
     ("Review the product's main complaint categories and high-severity cases.",
      "Inspect current inventory, packaging, handling, and supplier-quality records.",
      "Separate availability complaints from product-quality and service complaints.",
      "Define a corrective action and track complaint volume after implementation.")),
    ("Product Demand and Commercial Performance Risk", "Product Sales Performance Risk",
     "Improve product sales performance", "Category Manager", 7,
     "Improve product revenue and identify whether demand, pricing, assortment, promotion, or availability is limiting performance.",
     ("Review recent product sales, margin, pricing, and promotion performance.",
      "Confirm whether stock availability is restricting sales.",
      "Compare product performance with category benchmarks and similar stores.",
      "Implement a targeted pricing, promotion, placement, or assortment action and measure the result.")),
    ("Inventory Planning and Demand Forecast Risk", "Inventory Overstock Risk", "Reduce excess inventory exposure",
     "Inventory Planning Manager", 7,
     "Release working capital, reduce storage pressure, and lower the risk of slow-moving or obsolete inventory.",
     ("Confirm current stock, recent sales velocity, and the latest replenishment orders.",
      "Pause or reduce additional replenishment until stock returns to the planned range.",
      "Evaluate stock transfer, promotion, bundling, or markdown options for excess quantity.",
      "Review the demand forecast and reorder parameters to prevent recurrence.")),
    ("Recurring Process or Product Failure Pattern", "Repeated Complaint Category Risk",
     "Correct recurring complaint pattern", "Customer Experience Manager", 7,
     "Reduce repeated complaints by correcting the shared process, product, fulfilment, or service failure.",
     ("Review the affected stores, products, and customer cases linked to the complaint category.",
      "Map the operational process where the repeated failure is most likely occurring.",
      "Assign a corrective action to the responsible department and define a measurable closure target.",
      "Track the complaint category after implementation to confirm that recurrence is declining.")),
)
GENERIC = ("Review and address business risk", "Business Operations Manager", 7,
           "Clarify the operational cause, assign accountability, and reduce the business exposure represented by the issue.",
           ("Review the issue evidence and root-cause assessment.",
            "Validate the findings with the relevant business owner.",
            "Define a corrective action, accountable owner, and deadline.",
            "Track the issue until the agreed success measure is achieved."))


def _template(title: str, owner: str, days: int, impact: str, steps: tuple[str, ...]) -> str:
    numbered = " ".join(f"{i}. {step}" for i, step in enumerate(steps, 1))
    return (f"named_struct('action', {lit(title)}, 'owner', {lit(owner)}, 'days', {days}, 'impact', {lit(impact)}, "
            f"'steps', {lit(numbered)})")


def template_expression() -> str:
    branches = " ".join(
        f"WHEN root_cause_category = {lit(category)} OR issue_type = {lit(kind)} THEN {_template(*rest)}"
        for category, kind, *rest in TEMPLATES)
    return f"CASE {branches} ELSE {_template(*GENERIC)} END"


def context(issues: DataFrame, analyses: DataFrame, priorities: DataFrame | None = None) -> DataFrame:
    """Active issues with a usable root cause, and their rank when a priority list is given."""
    causes = analyses.where("analysis_status IN ('Generated', 'Reviewed') AND review_status <> 'Rejected'").selectExpr(
        "issue_id", "root_cause_category", "root_cause_summary", "confidence_score AS root_cause_confidence_score",
        "evidence_count AS root_cause_evidence_count", "review_status AS root_cause_review_status")
    rows = issues.where(ACTIVE).selectExpr(
        "issue_id", "title AS issue_title", "issue_type", "business_area", "priority_level", "priority_score",
    ).join(causes, "issue_id")
    if priorities is not None:
        return rows.join(priorities.select("issue_id", "executive_rank", "executive_score"), "issue_id")
    return rows.selectExpr("*", "CAST(NULL AS INT) AS executive_rank", "CAST(NULL AS DOUBLE) AS executive_score")


def recommendations(rows: DataFrame, run_date: str, generated_at: str) -> DataFrame:
    raw = (f"{zero('root_cause_confidence_score')} * 0.70D + {zero('priority_score')} * 0.20D "
           "+ least(coalesce(root_cause_evidence_count, 0) * 12.5D, 100D) * 0.10D "
           "+ CASE root_cause_review_status WHEN 'Accepted' THEN 3D WHEN 'Edited' THEN 2D ELSE 0D END")
    days = "CASE priority_level WHEN 'High' THEN greatest(1, t.days - 2) WHEN 'Medium' THEN t.days ELSE t.days + 5 END"
    return rows.selectExpr("*", f"{template_expression()} AS t").selectExpr(
        say("REC-{issue_id}") + " AS recommendation_id", "executive_rank", "issue_id", "issue_title", "issue_type",
        "business_area", "priority_level", "priority_score", "executive_score", "root_cause_category",
        "root_cause_summary", "root_cause_confidence_score",
        say("{a}: {b}", a="t.action", b=clean_text("issue_title")) + " AS recommendation_title",
        say("Reason for action: {a} Recommended action steps: {b}", a=clean_text("root_cause_summary"), b="t.steps")
        + " AS recommendation_text",
        "t.owner AS suggested_owner_role", f"date_add(DATE '{run_date}', {days}) AS suggested_deadline",
        "t.impact AS expected_impact", f"{round2(f'greatest(50D, least({raw}, 95D))')} AS confidence_score",
        "'Pending Review' AS status", f"{lit(generated_at)} AS generated_at")


REVIEWED = "status IN ('Accepted', 'Edited', 'Converted to Task')"


def refresh(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keep reviewed recommendations; replace pending and rejected ones of regenerated issues."""
    columns = fresh.columns
    reviewed = stored.where(REVIEWED).select("issue_id").distinct()
    inserted = fresh.join(reviewed, "issue_id", "left_anti").select(*columns)
    regenerated = inserted.select("issue_id").distinct()
    # pending and rejected rows go only where the issue is regenerated; reviewed rows always stay
    untouched = stored.where(f"NOT ({REVIEWED})").join(regenerated, "issue_id", "left_anti")
    return stored.where(REVIEWED).select(*columns).unionByName(untouched.select(*columns)).unionByName(inserted)


def action_steps(rows: DataFrame, keep: int = 12) -> DataFrame:
    """Numbered steps of the recommendation text, distinct and in order."""
    marker = "Recommended action steps:"
    text = clean_text("recommendation_text")
    body = f"CASE WHEN locate({lit(marker)}, {text}) > 0 THEN trim(substring({text}, locate({lit(marker)}, {text}) + {len(marker)})) ELSE {text} END"
    split = rows.selectExpr("recommendation_id", f"{body} AS body").selectExpr(
        "*", r"body RLIKE '(^|\\s)\\d+\\.\\s+' AS numbered",
        r"split(regexp_replace(body, '(^|\\s)\\d+\\.\\s+', '\u0001'), '\u0001') AS parts")
    cleaned = "filter(transform(slice(parts, 2, greatest(size(parts) - 1, 0)), x -> trim(x)), x -> x <> '')"
    return split.selectExpr(
        "recommendation_id",
        f"CASE WHEN numbered THEN slice(array_distinct({cleaned}), 1, {keep}) WHEN body = '' THEN array() ELSE array(body) END AS steps")
