"""Review and task state as batch jobs: events are joined to the stored state, nothing is looped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwatch.functions.text import lit, say, severity_rank, text_list
from tillwatch.operators.issues import ACTIVE
from tillwatch.operators.templates import aggregates, order_by

# fixed values: statuses and legal moves
RECOMMENDATION_STATUSES = ("Pending Review", "Edited", "Accepted", "Rejected", "Converted to Task")
REVIEWABLE = ("Pending Review", "Edited")
TASK_STATUSES = ("Unassigned", "To Do", "In Progress", "Blocked", "Completed")
TRANSITIONS = {
    "Unassigned": ("To Do",),
    "To Do": ("In Progress", "Blocked"),
    "In Progress": ("To Do", "Blocked", "Completed"),
    "Blocked": ("To Do", "In Progress"),
    "Completed": (),
}
ACTOR = "API User"
LEVEL = severity_rank("priority_level")


def only(df: DataFrame, **equal: str | None) -> DataFrame:
    """Exact filters; a value of None adds no predicate."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(f"{column} = {lit(value)}")
    return df


def issue_list(issues: DataFrame, limit: int, offset: int = 0, **equal: str | None) -> DataFrame:
    return order_by(only(issues, **equal), LEVEL, "priority_score DESC", "last_detected_at DESC", "issue_id").offset(
        offset).limit(limit)


EVIDENCE_FIELDS = ("source_finding_id", "analysis_type", "severity", "summary", "evidence", "detected_at")


def issue_details(issues: DataFrame, evidence: DataFrame, analyses: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per evidence of each wanted issue, strongest first by `position`, with the issue, its evidence count and root cause.

    Issues without evidence keep one row. Evidence stays rows, so an issue may have any number of it."""
    ids = wanted.select("issue_id").distinct()
    chosen = issues.join(ids, "issue_id", "left_semi")
    rows = evidence.join(ids, "issue_id", "left_semi")
    counts = rows.groupBy("issue_id").agg(*aggregates({"evidence_count": "count(*)"}))
    listed = rows.selectExpr(
        "issue_id", *[f"{c} AS evidence_{c}" if c in ("severity", "summary") else c for c in EVIDENCE_FIELDS],
        f"row_number() OVER (PARTITION BY issue_id ORDER BY {severity_rank()}, detected_at DESC NULLS LAST, source_finding_id) AS position")
    cause = analyses.selectExpr("issue_id", "struct(root_cause_category, root_cause_summary, confidence_score, review_status) AS root_cause")
    kept = [c for c in issues.columns if c not in listed.columns or c == "issue_id"]
    return chosen.select(*kept).join(counts, "issue_id", "left").join(listed, "issue_id", "left").join(cause, "issue_id", "left").withColumn(
        "evidence_count", F.coalesce("evidence_count", F.lit(0)))


def recommendation_list(recommendations: DataFrame, issues: DataFrame, limit: int, offset: int = 0,
                        **equal: str | None) -> DataFrame:
    joined = recommendations.drop("priority_level", "priority_score", "business_area", "issue_title").join(
        issues.selectExpr("issue_id", "title AS issue_title", "business_area", "priority_level", "priority_score"), "issue_id")
    return order_by(only(joined, **equal), LEVEL, "priority_score DESC", "confidence_score DESC", "recommendation_id").offset(
        offset).limit(limit)


def recommendation_details(recommendations: DataFrame, issues: DataFrame, analyses: DataFrame) -> DataFrame:
    """Recommendation with its issue and, where there is one, its root cause."""
    return recommendations.select(
        "recommendation_id", "issue_id", "recommendation_title", "suggested_owner_role", "suggested_deadline",
        "confidence_score", "status").join(
        issues.selectExpr("issue_id", "title AS issue_title", "status AS issue_status", "summary AS issue_summary"), "issue_id").join(
        analyses.selectExpr("issue_id", "root_cause_category", "confidence_score AS root_cause_confidence", "review_status"),
        "issue_id", "left")


TASK_RANK = "CASE status " + " ".join(
    f"WHEN '{s}' THEN {i}" for i, s in enumerate(("Blocked", "In Progress", "To Do", "Unassigned", "Completed"), 1)) + " ELSE 6 END"


def task_list(tasks: DataFrame, issues: DataFrame, recommendations: DataFrame, limit: int, offset: int = 0,
              **equal: str | None) -> DataFrame:
    rows = only(tasks, **equal).join(
        issues.selectExpr("issue_id", "title AS issue_title"), "issue_id", "left").join(
        recommendations.select("recommendation_id", "recommendation_title"), "recommendation_id", "left")
    return order_by(rows, TASK_RANK, LEVEL, "due_date", "task_id").offset(offset).limit(limit)


def review(recommendations: DataFrame, events: DataFrame) -> DataFrame:
    """Outcome of each review event (accept, reject, edit), events of one recommendation in order.

    A recommendation leaves the reviewable states at its first accept or reject, so
    one minimum per recommendation decides every event; no event list is collected.
    """
    state = recommendations.selectExpr("recommendation_id", "status AS initial_status")
    first_final = events.where("action IN ('accept', 'reject')").groupBy("recommendation_id").agg(
        *aggregates({"final_seq": "min(event_seq)"}))
    reviewable = f"initial_status IN ({text_list(REVIEWABLE)})"
    target = "CASE action WHEN 'accept' THEN 'Accepted' WHEN 'reject' THEN 'Rejected' ELSE 'Edited' END"
    return events.join(state, "recommendation_id", "left").join(first_final, "recommendation_id", "left").selectExpr(
        "recommendation_id", "event_seq", "action",
        f"CASE WHEN initial_status IS NULL THEN 'not_found' WHEN {reviewable} AND event_seq <= coalesce(final_seq, event_seq) THEN 'success' "
        "ELSE 'conflict' END AS outcome", f"{target} AS target_status")


def reviewed_state(recommendations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Recommendations after the review batch: the last successful event decides."""
    last = outcomes.where("outcome = 'success'").groupBy("recommendation_id").agg(
        *aggregates({"new_status": "max(struct(event_seq, target_status)).target_status"}))
    kept = [c for c in recommendations.columns if c != "status"]
    return recommendations.join(last, "recommendation_id", "left").selectExpr(*kept, "coalesce(new_status, status) AS status")


def convert(recommendations: DataFrame, issues: DataFrame, tasks: DataFrame, requested: DataFrame) -> DataFrame:
    """Outcome of converting each requested recommendation; accepted ones carry the new task."""
    facts = recommendations.selectExpr("recommendation_id", "issue_id", "recommendation_title", "recommendation_text",
                                       "suggested_owner_role", "suggested_deadline", "status").join(
        issues.select("issue_id", "priority_level"), "issue_id")
    existing = tasks.selectExpr("recommendation_id", "task_id AS existing_task_id")
    return requested.select("recommendation_id").distinct().join(facts, "recommendation_id", "left").join(
        existing, "recommendation_id", "left").selectExpr(
        "recommendation_id", "issue_id", "recommendation_title", "recommendation_text", "suggested_owner_role",
        "suggested_deadline", "priority_level", "status AS current_status", "existing_task_id",
        "CASE WHEN issue_id IS NULL THEN 'not_found' WHEN existing_task_id IS NOT NULL THEN 'already_converted' "
        "WHEN status <> 'Accepted' THEN 'invalid_status' ELSE 'success' END AS outcome",
        say("TASK-{recommendation_id}") + " AS new_task_id")


def created_tasks(conversions: DataFrame) -> DataFrame:
    return conversions.where("outcome = 'success'").selectExpr(
        "new_task_id AS task_id", "issue_id", "recommendation_id", "recommendation_title AS title",
        "recommendation_text AS description", "CAST(NULL AS STRING) AS assigned_to", "suggested_owner_role AS assigned_role",
        "suggested_deadline AS due_date", "priority_level", "'To Do' AS status")


def conversion_audit(conversions: DataFrame) -> DataFrame:
    """Two audit rows per new task, with before and after values as JSON."""
    done = conversions.where("outcome = 'success'")
    first = done.selectExpr(
        "'Recommendation' AS entity_type", "recommendation_id AS entity_id", "'Converted to Task' AS action_type",
        f"'{ACTOR}' AS actor_name", "to_json(named_struct('status', current_status)) AS old_value",
        "to_json(named_struct('status', 'Converted to Task', 'task_id', new_task_id)) AS new_value")
    second = done.selectExpr(
        "'Task' AS entity_type", "new_task_id AS entity_id", "'Created from Recommendation' AS action_type",
        f"'{ACTOR}' AS actor_name", "CAST(NULL AS STRING) AS old_value",
        "to_json(named_struct('task_id', new_task_id, 'recommendation_id', recommendation_id, 'status', 'To Do', 'title', "
        "recommendation_title)) AS new_value")
    return first.unionByName(second)


# legal moves as one flat array: entry 5 * from + to is 1 when allowed
_MOVES = "array(" + ", ".join(
    "1" if b in TRANSITIONS[a] else "0" for a in TASK_STATUSES for b in TASK_STATUSES) + ")"
_INDEX = "CASE {x} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(TASK_STATUSES)) + " END"
_NAMES = "array(" + ", ".join(f"'{s}'" for s in TASK_STATUSES) + ")"
#: Events of a chunk, and chunks (or groups of them) that are chained in one row.
EVENTS_PER_CHUNK, FAN = 64, 64


def _chained(maps: DataFrame, fan: int) -> DataFrame:
    """(task_id, chunk, start_state): the state in which each chunk begins.

    maps(task_id, chunk, first_state, moves): moves is a chunk's map from start state to end state. A prefix composition: `fan`
    neighbouring maps at a time become one, level by level, until a task has one; then start states are handed down the same
    levels. No row holds more than `fan` maps, however many events a task has; chunk numbers may have gaps."""
    last = maps.selectExpr("max(chunk)").first()[0] or 0
    levels, height = [maps.selectExpr("task_id", "chunk AS node", "first_state", "moves")], 0
    joined = "aggregate(maps, array(0, 1, 2, 3, 4), (m, c) -> transform(m, s -> element_at(c.moves, s + 1)))"
    while last >= fan**height:
        gathered = levels[-1].groupBy("task_id", F.expr(f"node DIV {fan} AS above")).agg(*aggregates({
            "first_state": "min(first_state)", "maps": "array_sort(collect_list(struct(node, moves)))"}))
        levels.append(gathered.selectExpr("task_id", "above AS node", "first_state", "maps", f"{joined} AS moves"))
        height += 1
    # the top level has one node per task; every node hands its children the states they start in
    state = levels[-1].selectExpr("task_id", "node", "first_state AS start_state")
    hand_down = ("inline(transform(sequence(0, size(maps) - 1), i -> named_struct('node', maps[i].node, 'start_state', "
                 "aggregate(slice(maps, 1, i), start_state, (s, c) -> element_at(c.moves, s + 1)))))")
    for level in reversed(levels[1:]):
        state = level.select("task_id", "node", "maps").join(state, ["task_id", "node"]).selectExpr("task_id", hand_down)
    return state.withColumnRenamed("node", "chunk")


def transitions(tasks: DataFrame, events: DataFrame, chunk: int = EVENTS_PER_CHUNK, fan: int = FAN) -> DataFrame:
    """Outcome of each status event; event_seq is unique per task, not negative, and gives the order.

    Every chunk of a task's events is reduced to a map from start state to end
    state. The maps are composed in groups of `fan`, so a task with a third of all
    events is spread over as many rows as any others, at every step.
    """
    step = f"if(element_at({_MOVES}, s * 5 + e.target + 1) = 1, e.target, s)"
    coded = events.selectExpr(
        "task_id", "event_seq", "target_status", f"{_INDEX.format(x='target_status')} AS target",
        f"event_seq DIV {chunk} AS chunk").join(
        tasks.selectExpr("task_id", f"{_INDEX.format(x='status')} AS first_state"), "task_id", "left")
    legal = coded.where("first_state IS NOT NULL AND target IS NOT NULL")
    chunks = legal.groupBy("task_id", "chunk").agg(*aggregates({
        "first_state": "min(first_state)",
        "steps": "array_sort(collect_list(struct(event_seq, target, target_status)))"})).selectExpr(
        "*", f"aggregate(steps, array(0, 1, 2, 3, 4), (m, e) -> transform(m, s -> {step})) AS moves")
    chained = _chained(chunks.select("task_id", "chunk", "first_state", "moves"), fan)
    outcome = (f"CASE WHEN e.target = a.state THEN 'no_change' WHEN element_at({_MOVES}, a.state * 5 + e.target + 1) = 1 THEN 'success' "
               "ELSE 'invalid_transition' END")
    moved = f"if(element_at({_MOVES}, a.state * 5 + e.target + 1) = 1, e.target, a.state)"
    kind = "ARRAY<STRUCT<event_seq: BIGINT, old_status: STRING, target_status: STRING, outcome: STRING>>"
    # the log of one chunk: at most `chunk` events
    applied = chunks.select("task_id", "chunk", "steps").join(chained, ["task_id", "chunk"]).selectExpr(
        "task_id", f"inline(aggregate(steps, named_struct('state', start_state, 'log', CAST(array() AS {kind})), "
        f"(a, e) -> named_struct('state', {moved}, 'log', concat(a.log, array(named_struct('event_seq', e.event_seq, 'old_status', "
        f"element_at({_NAMES}, a.state + 1), 'target_status', e.target_status, 'outcome', {outcome}))))).log)")
    unknown = coded.where("first_state IS NULL OR target IS NULL").selectExpr(
        "task_id", "event_seq", "CAST(NULL AS STRING) AS old_status", "target_status",
        "if(first_state IS NULL, 'not_found', 'invalid_transition') AS outcome")
    return applied.unionByName(unknown)


def task_details(tasks: DataFrame, issues: DataFrame, recommendations: DataFrame, analyses: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted task once, with its issue, recommendation and root cause where there are any; unknown ids are `found` false."""
    ids = wanted.select("task_id").distinct()
    rows = tasks.join(ids, "task_id", "left_semi").join(
        issues.selectExpr("issue_id", "title AS issue_title", "status AS issue_status", "summary AS issue_summary"), "issue_id", "left").join(
        recommendations.selectExpr("recommendation_id", "recommendation_title", "status AS recommendation_status", "expected_impact"), "recommendation_id", "left").join(
        analyses.selectExpr("issue_id", "root_cause_category", "root_cause_summary"), "issue_id", "left")
    return ids.join(rows, "task_id", "left").withColumn("found", F.col("status").isNotNull())


def moved_tasks(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    last = outcomes.where("outcome = 'success'").groupBy("task_id").agg(
        *aggregates({"new_status": "max(struct(event_seq, target_status)).target_status"}))
    kept = [c for c in tasks.columns if c != "status"]
    return tasks.join(last, "task_id", "left").selectExpr(*kept, "coalesce(new_status, status) AS status")


def transition_audit(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'success'").selectExpr(
        "'Task' AS entity_type", "task_id AS entity_id", "'Status Updated' AS action_type", f"'{ACTOR}' AS actor_name",
        "to_json(named_struct('status', old_status)) AS old_value",
        "to_json(named_struct('status', target_status)) AS new_value")


def assign(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each assignment request (at most one per task), with the audit values."""
    asked = requests.selectExpr("task_id", "assigned_to AS new_assigned_to", "assigned_role AS asked_role")
    joined = asked.join(tasks.select("task_id", "assigned_to", "assigned_role", "status"), "task_id", "left")
    return joined.selectExpr(
        "task_id", "CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'Completed' THEN 'completed' ELSE 'success' END AS outcome",
        "new_assigned_to AS assigned_to", "coalesce(asked_role, assigned_role) AS assigned_role",
        "to_json(named_struct('assigned_to', assigned_to, 'assigned_role', assigned_role), map('ignoreNullFields', 'false')) AS old_value",
        "to_json(named_struct('assigned_to', new_assigned_to, 'assigned_role', coalesce(asked_role, assigned_role)), map('ignoreNullFields', 'false')) AS new_value")


def status_counts(df: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Zero-filled counts: one aggregate pass turned into one row per status."""
    pairs = ", ".join(f"struct('{s}' AS status, count_if(status = '{s}') AS item_count)" for s in statuses)
    return df.selectExpr(f"array({pairs}) AS counted").selectExpr("inline(counted)")


def overdue(tasks: DataFrame, run_date: str) -> DataFrame:
    """Unfinished tasks past their due date; the whole table is looked at."""
    return order_by(tasks.where(f"due_date < DATE '{run_date}' AND status <> 'Completed'"), "due_date", "task_id")


def task_totals(tasks: DataFrame, run_date: str) -> DataFrame:
    return tasks.agg(*aggregates({
        "total_tasks": "count(*)", "active_task_count": "count_if(status IN ('Unassigned', 'To Do', 'In Progress', 'Blocked'))",
        "blocked_task_count": "count_if(status = 'Blocked')",
        "overdue_task_count": f"count_if(due_date < DATE '{run_date}' AND status <> 'Completed')"}))


def issue_totals(issues: DataFrame) -> DataFrame:
    return issues.agg(*aggregates({
        "open_issue_count": "count_if(status = 'Open')",
        "high_priority_open_issue_count": "count_if(status = 'Open' AND priority_level = 'High')",
        "in_progress_issue_count": "count_if(status = 'In Progress')"}))


def top_open_issues(issues: DataFrame, evidence: DataFrame, analyses: DataFrame, limit: int = 10) -> DataFrame:
    """Most urgent open issues with evidence count and root cause, in one join each."""
    top = issue_list(issues.where(f"{ACTIVE} AND status = 'Open'"), limit)
    counts = evidence.join(top.select("issue_id"), "issue_id", "left_semi").groupBy("issue_id").agg(
        *aggregates({"evidence_count": "count(*)"}))
    causes = analyses.selectExpr("issue_id", "root_cause_category", "root_cause_summary", "confidence_score", "review_status")
    return order_by(top.join(counts, "issue_id", "left").join(causes, "issue_id", "left").selectExpr(
        "issue_id", "title", "issue_type", "business_area", "priority_level", "priority_score", "status", "summary",
        "coalesce(evidence_count, 0) AS evidence_count", "root_cause_category", "root_cause_summary", "confidence_score",
        "review_status"), LEVEL, "priority_score DESC", "issue_id")
