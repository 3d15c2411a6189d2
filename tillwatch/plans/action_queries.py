"""Registered queries over root causes, recommendations, workflow state and the brief."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwatch.operators import brief, grounding, kpi, recommend, rootcause, workflow
from tillwatch.operators.templates import order_by
from tillwatch.plans.catalog import query
from tillwatch.plans.detectors import DETECTED_AT
from tillwatch.plans.stages import RUN_AT, Stages, own_folder
from tillwatch.sources.business import Business
from tillwatch.sources.runs import RunTable

RUN_DATE = "2001-08-08"

for _name, _key in (
    ("store_finance_context", "finance"), ("store_sales_context", "store_sales"),
    ("store_category_decline", "categories"), ("store_inventory_counts", "stock_counts"),
    ("store_complaint_counts", "store_cases"), ("vendor_delivery_context", "vendors"),
    ("vendor_affected_stores", "affected_stores"), ("store_complaint_types", "case_types"),
    ("store_complaint_products", "case_products"), ("product_complaint_context", "product_cases"),
    ("product_sales_context", "product_sales"), ("complaint_category_context", "case_categories"),
):
    query(_name)(lambda b, key=_key: Stages(b).context(key))


@query()
def inventory_product_context(b: Business):
    return Stages(b).context("stock").select(
        "store_id", "product_id", "inventory_id", "vendor_name", "current_stock", "reorder_level", "stock_status",
        "related_complaints", "high_severity_complaints", "unresolved_complaints", "out_of_stock_complaints")


@query()
def root_causes(b: Business):
    return Stages(b).table("root_causes").drop("executive_rank", "executive_score")


@query()
def executive_root_causes(b: Business):
    s = Stages(b)
    return order_by(rootcause.analyses(
        s.table("issues"), s.table("evidence"), s.contexts(), RUN_AT, selection=s.table("executive")), "executive_rank")


@query()
def supporting_evidence(b: Business):
    return rootcause.supporting_evidence(Stages(b).table("evidence"))


@query()
def root_cause_upsert(b: Business):
    s = Stages(b)
    stored = s.table("reviewed_causes").where("issue_type <> 'Vendor Performance Risk'")
    return rootcause.merge_analyses(stored, s.table("root_causes"), RUN_AT)


@query()
def issue_root_cause_status(b: Business):
    s = Stages(b)
    return rootcause.mark_root_causes(s.table("issues"), s.table("root_causes")).groupBy(
        "issue_type", "root_cause_status").agg(F.expr("count(*) AS issue_count"))


@query()
def confidence_summary(b: Business):
    return rootcause.confidence_summary(Stages(b).table("root_causes"))


@query()
def contributing_factors(b: Business):
    return rootcause.split_factors(Stages(b).table("root_causes")).selectExpr(
        "issue_id", "size(factors) AS factor_count", "array_join(factors, ' | ') AS factors")


@query()
def recommendation_context(b: Business):
    s = Stages(b)
    return recommend.context(s.table("issues"), s.table("reviewed_causes")).drop("executive_rank", "executive_score")


@query()
def recommendations(b: Business):
    return Stages(b).table("recommendations").drop("executive_rank", "executive_score")


@query()
def executive_recommendations(b: Business):
    s = Stages(b)
    rows = recommend.context(s.table("issues"), s.table("reviewed_causes"), s.table("executive"))
    return order_by(recommend.recommendations(rows, "2001-08-01", RUN_AT), "executive_rank")


def fresh_recommendations(s: Stages) -> DataFrame:
    """This run proposes again for every issue but the overstock ones."""
    return s.table("recommendations").where("issue_type <> 'Inventory Overstock Risk'").withColumn(
        "generated_at", F.lit("2001-08-08 06:00:00"))


@query()
def recommendation_refresh(b: Business):
    s = Stages(b)
    return recommend.refresh(s.table("stored_recommendations"), fresh_recommendations(s)).select(
        "recommendation_id", "issue_id", "recommendation_title", "suggested_deadline", "confidence_score", "status", "generated_at")


@query()
def action_steps(b: Business):
    return recommend.action_steps(Stages(b).table("recommendations")).selectExpr(
        "recommendation_id", "size(steps) AS step_count", "array_join(steps, ' | ') AS steps")


# ---- workflow ----------------------------------------------------------------------
@query()
def issue_list(b: Business):
    return workflow.issue_list(Stages(b).table("previous_issues"), 50, 1, priority_level="High", status="Open").select(
        "issue_id", "title", "priority_level", "priority_score", "status")


@query()
def issue_details(b: Business):
    s = Stages(b)
    wanted = s.table("issues").where("priority_level = 'High'").select("issue_id")
    return workflow.issue_details(s.table("issues"), s.table("evidence"), s.table("reviewed_causes"), wanted).selectExpr(
        "issue_id", "title", "evidence_count", "position", "source_finding_id", "root_cause.root_cause_category AS root_cause_category", "root_cause.review_status AS review_status")


@query()
def recommendation_list(b: Business):
    s = Stages(b)
    return workflow.recommendation_list(s.table("stored_recommendations"), s.table("issues"), 50, 1, status="Accepted").select(
        "recommendation_id", "issue_title", "priority_level", "priority_score", "confidence_score", "status")


@query()
def recommendation_details(b: Business):
    s = Stages(b)
    return workflow.recommendation_details(s.table("stored_recommendations"), s.table("issues"), s.table("reviewed_causes"))


@query()
def task_list(b: Business):
    s = Stages(b)
    return workflow.task_list(s.table("tasks"), s.table("issues"), s.table("stored_recommendations"), 50, 1,
                              priority_level="High").select(
        "task_id", "issue_title", "recommendation_title", "assigned_role", "due_date", "priority_level", "status")


@query()
def task_details(b: Business):
    """Every high-priority task, and one id per store issue that nobody knows."""
    s = Stages(b)
    wanted = s.table("tasks").where("priority_level = 'High'").select("task_id").unionByName(
        s.table("issues").where("issue_type = 'Store Performance Risk'").selectExpr("concat('TASK-UNKNOWN-', issue_id) AS task_id"))
    return workflow.task_details(s.table("tasks"), s.table("issues"), s.table("stored_recommendations"), s.table("reviewed_causes"), wanted).select(
        "task_id", "found", "title", "status", "due_date", "issue_title", "issue_status", "issue_summary", "recommendation_title", "recommendation_status",
        "expected_impact", "root_cause_category", "root_cause_summary")


def review_events(s: Stages) -> DataFrame:
    """Three review actions per stored recommendation, the order depending on its score."""
    return s.table("stored_recommendations").selectExpr(
        "recommendation_id", "CAST(round(priority_score) AS INT) % 3 AS shift",
    ).selectExpr("recommendation_id", "explode(array(1, 2, 3)) AS event_seq", "shift").selectExpr(
        "recommendation_id", "event_seq", "CASE (event_seq + shift) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END AS action")


@query()
def review_outcomes(b: Business):
    s = Stages(b)
    return workflow.review(s.table("stored_recommendations"), review_events(s))


@query()
def reviewed_recommendations(b: Business):
    s = Stages(b)
    outcomes = workflow.review(s.table("stored_recommendations"), review_events(s))
    return workflow.reviewed_state(s.table("stored_recommendations"), outcomes).select("recommendation_id", "status")


def conversions(s: Stages) -> DataFrame:
    everything = s.table("stored_recommendations").select("recommendation_id").unionByName(
        s.table("issues").where("issue_type = 'Store Performance Risk'").selectExpr("concat('REC-UNKNOWN-', issue_id) AS recommendation_id"))
    return workflow.convert(s.table("stored_recommendations"), s.table("issues"), s.table("tasks"), everything)


@query()
def task_conversions(b: Business):
    return conversions(Stages(b)).select("recommendation_id", "current_status", "existing_task_id", "outcome")


@query()
def created_tasks(b: Business):
    return workflow.created_tasks(conversions(Stages(b)))


@query()
def conversion_audit(b: Business):
    return workflow.conversion_audit(conversions(Stages(b)))


def task_events(s: Stages) -> DataFrame:
    """Four status events per task: two forward, one arbitrary, one to Completed."""
    wanted = ("CASE event_seq WHEN 1 THEN 'To Do' WHEN 2 THEN 'In Progress' WHEN 3 THEN element_at(array('Blocked', 'Completed', "
              "'In Progress', 'To Do', 'Unassigned'), length(task_id) % 5 + 1) ELSE 'Completed' END")
    known = s.table("tasks").select("task_id").unionByName(
        s.table("issues").where("issue_type = 'Store Performance Risk'").selectExpr("concat('TASK-UNKNOWN-', issue_id) AS task_id"))
    return known.selectExpr("task_id", "explode(array(1L, 2L, 3L, 4L)) AS event_seq").selectExpr(
        "task_id", "event_seq", f"{wanted} AS target_status")


@query()
def task_transitions(b: Business):
    s = Stages(b)
    return workflow.transitions(s.table("tasks"), task_events(s), chunk=2)


@query()
def moved_tasks(b: Business):
    s = Stages(b)
    return workflow.moved_tasks(s.table("tasks"), workflow.transitions(s.table("tasks"), task_events(s))).select("task_id", "status")


@query()
def transition_audit(b: Business):
    s = Stages(b)
    return workflow.transition_audit(workflow.transitions(s.table("tasks"), task_events(s)))


@query()
def task_assignments(b: Business):
    s = Stages(b)
    requests = s.table("tasks").selectExpr(
        "task_id", "concat('Employee ', length(title)) AS assigned_to", "if(length(task_id) % 2 = 0, 'Store Manager', NULL) AS assigned_role")
    return workflow.assign(s.table("tasks"), requests)


@query()
def recommendation_status_counts(b: Business):
    return workflow.status_counts(Stages(b).table("stored_recommendations"), workflow.RECOMMENDATION_STATUSES)


@query()
def task_status_counts(b: Business):
    return workflow.status_counts(Stages(b).table("tasks"), workflow.TASK_STATUSES)


@query()
def overdue_tasks(b: Business):
    return workflow.overdue(Stages(b).table("tasks"), RUN_DATE).select("task_id", "title", "due_date", "status")


@query()
def top_open_issues(b: Business):
    s = Stages(b)
    return workflow.top_open_issues(s.table("previous_issues"), s.table("evidence"), s.table("reviewed_causes"))


def numbered_kpis(b: Business) -> DataFrame:
    s = Stages(b)
    table = kpi.kpi_table(
        s.facts().sales("date", "total_sales", "quantity_sold"), s.table("finance"), b.inventory(), s.table("complaints"),
        s.table("deliveries"), calculated_at=DETECTED_AT)
    order = ", ".join(f"'{k[0]}'" for k in kpi.KPIS)
    return table.selectExpr("*", f"array_position(array({order}), kpi_key) AS position")


def brief_parts(b: Business):
    """The KPIs and the one row of texts as stages: a brief reads both many times, and they are made of all lines, issues and tasks."""
    s = Stages(b)
    kpis = s.table("brief_kpis", lambda: numbered_kpis(b))
    texts = s.table("brief_texts", lambda: brief.attention_and_summary(brief.totals(
        s.table("previous_issues"), s.table("stored_recommendations"), s.table("tasks"), kpis, RUN_DATE)))
    return s, kpis, texts


@query()
def brief_summary(b: Business):
    _, _, texts = brief_parts(b)
    return texts.selectExpr(
        *[c for c in texts.columns if c != "management_attention"], "array_join(management_attention, ' | ') AS management_attention")


def daily_brief_of(b: Business) -> DataFrame:
    s, kpis, texts = brief_parts(b)
    top = workflow.top_open_issues(s.table("previous_issues"), s.table("evidence"), s.table("reviewed_causes"))
    return brief.payload(texts, kpis, top, s.table("stored_recommendations"), s.table("tasks"), RUN_DATE)


@query()
def daily_brief(b: Business):
    """Today's brief merged into the stored ones: one of today already, one of the day before."""
    fresh = daily_brief_of(b)
    stored = b.stores().where("store_number < 2").selectExpr(
        "concat('BRIEF-OLD-', store_number) AS brief_id", f"date_sub(DATE '{RUN_DATE}', store_number) AS brief_date",
        f"'{brief.BRIEF_TYPE}' AS brief_type", "'earlier text' AS summary_text", "'{}' AS brief_data", "'Draft' AS status")
    return brief.merge_brief(stored, fresh).selectExpr(
        "brief_id", "brief_date", "brief_type", "summary_text", "status", "action",
        "CAST(get_json_object(brief_data, '$.open_issue_count') AS BIGINT) AS open_issue_count",
        "get_json_object(brief_data, '$.kpis[0].display_value') AS first_kpi",
        "CAST(get_json_object(brief_data, '$.task_counts.Completed') AS BIGINT) AS completed_tasks",
        "get_json_object(brief_data, '$.top_open_issues[0].issue_id') AS first_issue")


@query()
def latest_brief(b: Business):
    """Briefs as two runs left them; the newest of the last run before the ninth of August."""
    runs = RunTable(b.spark, own_folder(b.spark, "briefs"))
    columns = ("brief_id", "brief_date", "brief_type", "summary_text", "status")
    earlier = b.stores().where("store_number < 3").selectExpr(
        "concat('BRIEF-OLD-', store_number) AS brief_id", f"date_sub(DATE '{RUN_DATE}', store_number) AS brief_date", f"'{brief.BRIEF_TYPE}' AS brief_type",
        "'earlier text' AS summary_text", "'Draft' AS status", "CAST('2001-08-07 05:00:00' AS TIMESTAMP_NTZ) AS created_at")
    today = daily_brief_of(b).select(*columns).withColumn("created_at", F.expr("CAST('2001-08-08 06:00:00' AS TIMESTAMP_NTZ)"))
    runs.append(earlier, "2001-08-07 06:00:00")
    runs.append(earlier.unionByName(today), "2001-08-08 06:00:00")
    runs.append(earlier.limit(0), "2001-08-09 06:00:00")
    return brief.latest(runs.as_of("2001-08-09 00:00:00")).select(*columns, "run_at")


# ---- grounding: texts as they came back, with changes that depend on the item ------------------------
def together(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(*grounding.COLUMNS)


@query()
def ungrounded_causes(b: Business):
    s = Stages(b)
    causes = s.table("root_causes")
    returned = causes.selectExpr(
        "issue_id", "if(evidence_count % 11 = 0, 'A guess', root_cause_category) AS root_cause_category", "concat(' ', root_cause_summary) AS root_cause_summary",
        "if(evidence_count % 7 = 0, confidence_score + 1, confidence_score + 0.0000001D) AS confidence_score")
    factors = s.table("factors", lambda: rootcause.split_factors(causes)).selectExpr("issue_id AS key", "explode(factors) AS value")
    cited = s.table("evidence").selectExpr("issue_id AS key", "source_finding_id AS value")
    extra = lambda every, value: causes.where(f"evidence_count % {every} = 0").selectExpr("issue_id AS key", f"'{value}' AS value")
    texts = causes.selectExpr("issue_id AS key", "concat(root_cause_explanation, if(evidence_count % 2 = 0, ' It cost 98,765.43 under FIN-X99-1.', '')) AS text")
    facts = causes.selectExpr("issue_id AS key", "concat_ws(' ', title, contributing_factors, evidence_summary) AS text")
    return together(
        grounding.changed_fields(causes, returned, "issue_id", ("root_cause_category", "root_cause_summary"), ("confidence_score",)),
        grounding.unsupported(factors.unionByName(extra(5, "Nobody was looking.")), factors, "factor"),
        grounding.unsupported(cited.unionByName(extra(3, "FINDING-UNKNOWN")), cited, "evidence"),
        grounding.unknown_mentions(texts, facts))


@query()
def ungrounded_recommendations(b: Business):
    s = Stages(b)
    made = s.table("recommendations")
    size = "length(issue_id)"
    returned = made.where(f"{size} % 9 <> 0").selectExpr(
        "issue_id", "recommendation_title", f"if({size} % 6 = 0, 'Nobody', suggested_owner_role) AS suggested_owner_role",
        f"if({size} % 4 = 0, date_add(suggested_deadline, 1), suggested_deadline) AS suggested_deadline", "expected_impact", "status", "confidence_score",
    ).unionByName(made.orderBy("issue_id").limit(1).selectExpr(
        "'ISSUE-UNKNOWN' AS issue_id", "recommendation_title", "suggested_owner_role", "suggested_deadline", "expected_impact", "status", "confidence_score"))
    steps = s.table("action_steps", lambda: recommend.action_steps(made)).join(made.select("recommendation_id", "issue_id"), "recommendation_id").selectExpr("issue_id AS key", "explode(steps) AS value")
    more = made.where(f"{size} % 5 = 0").selectExpr("issue_id AS key", "'Do something else.' AS value")
    return together(
        grounding.changed_fields(made, returned, "issue_id", ("recommendation_title", "suggested_owner_role", "suggested_deadline", "expected_impact", "status"), ("confidence_score",)),
        grounding.unsupported(steps.unionByName(more), steps, "action"))


@query()
def ungrounded_brief(b: Business):
    """A brief that miscounts blocked tasks, rewrites its first point, cites a task nobody knows, and speaks of a number of its own."""
    _, _, texts = brief_parts(b)
    names = ("open_issue_count", "high_priority_open_issue_count", "in_progress_issue_count", "total_tasks", "blocked_task_count", "overdue_task_count")
    listed = lambda shown: texts.selectExpr("inline(array(" + ", ".join(f"struct('{c}' AS item, {shown(c)} AS amount)" for c in names) + "))")
    refs = reference_rows(b)
    points = refs.where("source_type = 'Management Attention'").selectExpr("source_identifier AS item", "summary AS point", "position AS place")
    links = brief.attention_links(refs).selectExpr("attention_id AS key", "explode(evidence_ids) AS value")
    said = texts.selectExpr("'summary' AS key", "concat(summary_text, ' In all 424242 visits.') AS text")
    return together(
        grounding.changed_fields(listed(lambda c: c), listed(lambda c: f"{c} + {int(c == 'blocked_task_count')}"), "item", numbers=("amount",)),
        grounding.changed_fields(points, points.selectExpr("item", "if(place = 1, 'Something else.', point) AS point", "place"), "item", ("point",), order="place"),
        grounding.unsupported(links.unionByName(points.selectExpr("item AS key", "'BRIEF-TASK:UNKNOWN' AS value")), links, "evidence"),
        grounding.unknown_mentions(said, texts.selectExpr("'summary' AS key", "summary_text AS text")))


def reference_rows(b: Business) -> DataFrame:
    return Stages(b).table("brief_references", lambda: _references(b))


def _references(b: Business) -> DataFrame:
    s, kpis, texts = brief_parts(b)
    top = workflow.top_open_issues(s.table("previous_issues"), s.table("evidence"), s.table("reviewed_causes"))
    listed = workflow.recommendation_list(s.table("stored_recommendations"), s.table("issues"), 10)
    late = workflow.overdue(s.table("tasks"), RUN_DATE).limit(10).selectExpr("task_id", "title", "struct(1 AS list, CAST(due_date AS STRING) AS key) AS place")
    urgent = workflow.task_list(s.table("tasks"), s.table("issues"), s.table("stored_recommendations"), 10).selectExpr(
        "task_id", "title", f"struct(2 AS list, concat({workflow.TASK_RANK}, {workflow.LEVEL}, coalesce(due_date, '')) AS key) AS place")
    shown = late.unionByName(urgent).groupBy("task_id", "title").agg(F.expr("min(place) AS place"))
    return brief.references(kpis, top, listed, shown, texts)


@query()
def brief_references(b: Business):
    return reference_rows(b)


@query()
def attention_links(b: Business):
    return brief.attention_links(reference_rows(b)).selectExpr(
        "attention_id", "attention_text", "array_join(evidence_ids, ', ') AS evidence_ids")
