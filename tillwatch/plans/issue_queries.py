"""Registered queries over findings, issues and priorities."""

from __future__ import annotations

from tillwatch.operators import executive, issues, monitoring
from tillwatch.plans.catalog import query
from tillwatch.plans.stages import RUN_AT, Stages, own_folder
from tillwatch.sources.business import Business
from tillwatch.sources.runs import RunTable


@query()
def harmonised_findings(b: Business):
    return Stages(b).table("findings").select(*issues.COMMON, "source_module", "source_report")


@query()
def issue_keys(b: Business):
    return Stages(b).table("findings").select("finding_id", "source_module", "issue_type", "issue_group_id", "issue_id")


@query()
def consolidated_issues(b: Business):
    return issues.order_issues(Stages(b).table("issues").drop("last_detected_at"))


@query()
def evidence_records(b: Business):
    return issues.evidence_rows(Stages(b).table("findings")).drop("arrival")


@query()
def stored_evidence(b: Business):
    return Stages(b).table("evidence").drop("arrival", "signal_score", "signal_label", "stock_ratio_percent")


@query()
def issue_upsert(b: Business):
    s = Stages(b)
    return issues.merge_issues(s.table("previous_issues"), s.table("issues").drop("last_detected_at"), RUN_AT)


@query()
def evidence_upsert(b: Business):
    s = Stages(b)
    rows = issues.evidence_rows(s.table("findings"))
    earlier = issues.stored_evidence(rows.where("source_module <> 'complaints'")).drop("arrival").withColumn(
        "summary", executive.F.expr("concat('Earlier: ', summary)"))
    return issues.merge_evidence(earlier, rows.where("source_module <> 'sales'"))


@query()
def colliding_issue_ids(b: Business):
    return issues.colliding_issue_ids(Stages(b).table("findings"))


@query()
def manager_priorities(b: Business):
    return issues.manager_priorities(Stages(b).table("issues"), 20)


@query()
def active_issue_summary(b: Business):
    return issues.active_summary(Stages(b).table("previous_issues"))


@query()
def expected_issue_check(b: Business):
    return issues.expected_issues(Stages(b).table("issues"), [
        "ISSUE-STORE-PERFORMANCE-RISK-S003", "ISSUE-PRODUCT-AVAILABILITY-RISK-S003-P17",
        "ISSUE-VENDOR-PERFORMANCE-RISK-V4", "ISSUE-VENDOR-PERFORMANCE-RISK-V9"])


@query()
def evidence_signal_scores(b: Business):
    return Stages(b).table("evidence").select("issue_id", "source_finding_id", "analysis_type", "signal_score", "signal_label", "stock_ratio_percent")


@query()
def evidence_profiles(b: Business):
    return Stages(b).table("profiles")


@query()
def executive_priorities(b: Business):
    return executive.order_by(Stages(b).table("executive"), "executive_rank")


@query()
def executive_evidence_references(b: Business):
    s = Stages(b)
    return executive.evidence_references(s.table("executive"), s.table("evidence")).selectExpr(
        "issue_id", "included_count", "array_join(evidence_ids, ', ') AS evidence_ids")


@query()
def issue_evidence_references(b: Business):
    s = Stages(b)
    return executive.evidence_references(s.table("issues"), s.table("evidence")).selectExpr(
        "issue_id", "included_count", "array_join(evidence_ids, ', ') AS evidence_ids")


@query()
def priority_changes(b: Business):
    s = Stages(b)
    return issues.priority_changes(s.table("issues"), s.table("previous_issues"))


@query()
def requested_issues(b: Business):
    """Every store issue requested by id in store order, and one id nobody knows."""
    s = Stages(b)
    wanted = b.stores().selectExpr(
        "concat('ISSUE-STORE-PERFORMANCE-RISK-', store_id) AS issue_id", "store_number + 1 AS requested_order"
    ).unionByName(b.stores().where("store_id = 'S000'").selectExpr("'ISSUE-UNKNOWN' AS issue_id", "0 AS requested_order"))
    return executive.selection_reference(s.scored(), requested=wanted)


@query()
def previous_selection(b: Business):
    """The list of the last run before this one: not that of this run, and not one that came after it."""
    s = Stages(b)
    runs = RunTable(b.spark, own_folder(b.spark, "selections"))
    earlier = issues.manager_priorities(s.table("previous_issues"), 10).selectExpr("issue_id", "manager_rank AS executive_rank", "priority_score AS executive_score")
    runs.append(earlier.limit(0), "2001-06-01 06:00:00")
    runs.append(earlier, "2001-07-01 06:00:00")
    runs.append(s.table("executive").select("issue_id", "executive_rank", "executive_score"), RUN_AT)
    return executive.selection_of_run(s.scored(), runs, RUN_AT, limit=5)


@query()
def current_selection(b: Business):
    """No earlier run has a list, so the issues are ranked now."""
    s = Stages(b)
    runs = RunTable(b.spark, own_folder(b.spark, "selections"))
    runs.append(s.table("executive").select("issue_id", "executive_rank", "executive_score"), RUN_AT)
    return executive.selection_of_run(s.scored(), runs, RUN_AT)


@query()
def finding_reconciliation(b: Business):
    """What the rules find when they run anew, against the findings that the issues were made of."""
    s = Stages(b)
    monitored = None
    for family in s.families().values():
        ids = family.select("finding_id")
        monitored = ids if monitored is None else monitored.unionByName(ids)
    return issues.reconciliation(monitored, s.table("findings"), s.table("issues"))


@query()
def grounding_check(b: Business):
    """The manager list of this run against the same list as the earlier run scored it."""
    s = Stages(b)
    reference = issues.manager_priorities(s.table("issues"), 50).withColumnRenamed("manager_rank", "rank")
    returned = issues.manager_priorities(s.table("previous_issues"), 50).withColumnRenamed("manager_rank", "rank")
    return issues.grounding_check(reference, returned)


@query()
def ungrounded_citations(b: Business):
    """Citations of raw evidence rows under the issue ids of the earlier run."""
    s = Stages(b)
    cited = issues.evidence_rows(s.table("findings")).select("issue_id", "source_finding_id").join(
        s.table("previous_issues").select("issue_id"), "issue_id", "left_anti")
    allowed = s.table("evidence").where("source_module <> 'complaints'")
    return issues.ungrounded_citations(cited, allowed)


def _filtered(name: str, module: str, **filters: str):
    @query(name)
    def build(b: Business, module=module, filters=filters):
        families = Stages(b).families()
        return monitoring.finding_page(families[module], limit=50, offset=1, **filters)


_filtered("sales_finding_list", "sales", severity=" high ", analysis_type="store sales DECLINE")
_filtered("product_decline_list", "sales", analysis_type=" product SALES decline ")
_filtered("inventory_finding_list", "inventory", severity="High", store_id="s003")
_filtered("complaint_finding_list", "complaints", complaint_status="open", complaint_type="Late Delivery")
_filtered("vendor_finding_list", "vendor_finance", business_area="Procurement", severity="high")
_filtered("finance_finding_list", "vendor_finance", business_area="Finance", risk_status="high risk")


@query()
def finding_summary(b: Business):
    return monitoring.summary(Stages(b).families()["inventory"], severity="High")


@query()
def finding_match_counts(b: Business):
    return monitoring.match_counts(Stages(b).families()["complaints"], severity="high", complaint_type="poor service")


@query()
def monitoring_totals(b: Business):
    return monitoring.totals(monitoring.by_source(Stages(b).table("findings")))


@query()
def monitoring_top_findings(b: Business):
    return monitoring.top_findings(monitoring.by_source(Stages(b).table("findings")), 100)


@query()
def business_health(b: Business):
    return monitoring.health(monitoring.by_source(Stages(b).table("findings")), failed_sources=0)
