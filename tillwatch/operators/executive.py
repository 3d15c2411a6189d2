"""Evidence scores, evidence profiles and the diversity-penalised executive selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillwatch.functions.text import fixed, lit, round2, say, severity_rank
from tillwatch.operators.issues import ACTIVE, MANAGER_ORDER
from tillwatch.operators.templates import aggregates, first_per_key, order_by
from tillwatch.thresholds import DEFAULTS, Thresholds

# fixed values: base urgency of each signal
SIGNAL_SCORES = {
    "Stockout Risk": 40.0, "Expired Inventory": 50.0, "Near Expiry Stock": 25.0,
    "Loss-Making Store": 45.0, "High Financial Risk": 35.0, "Repeated Vendor Delays": 25.0,
    "Low On-Time Delivery Rate": 18.0, "Low Vendor Quality Rating": 15.0,
    "Partial Vendor Deliveries": 12.0, "Store Sales Decline": 20.0, "Low Target Achievement": 12.0,
    "Low Operating Profit": 12.0, "High Complaint Store": 12.0, "High Complaint Product": 10.0,
    "Monthly Complaint Growth": 10.0, "Open High-Severity Complaint": 15.0,
    "Unresolved Complaint Ageing": 10.0, "Repeated Complaint Category": 8.0,
}
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
# fixed values: signal, pattern in its evidence text, bonus on the parsed number, label
SIGNAL_RULES = (
    ("Near Expiry Stock", rf"Days to Expiry:\s*{NUMBER}",
     "greatest(0D, least(20D, (30D - n) * 0.75D))", "Near Expiry Stock ({n} days)", 0),
    ("Repeated Vendor Delays", rf"Maximum Delay:\s*{NUMBER}\s*days",
     "greatest(0D, least(25D, (n - 5D) * 1.5D))", "Repeated Vendor Delays ({n} maximum delay days)", 0),
    ("Low On-Time Delivery Rate", rf"On-Time Delivery Rate:\s*{NUMBER}%",
     "least(20D, greatest(0D, 70D - n) * 0.5D)", "Low On-Time Delivery Rate ({n}%)", 2),
    ("Open High-Severity Complaint", rf"Age Against Latest Dataset Date:\s*{NUMBER}\s*days",
     "least(15D, greatest(0D, n - 7D) * 0.5D)", "Open High-Severity Complaint ({n} days old)", 0),
    ("Unresolved Complaint Ageing", rf"Age Against Latest Dataset Date:\s*{NUMBER}\s*days",
     "least(15D, greatest(0D, n - 7D) * 0.5D)", "Unresolved Complaint Ageing ({n} days old)", 0),
)


def evidence_scores(evidence: DataFrame) -> DataFrame:
    """Urgency score, label and stock ratio of each evidence row, read from its text."""
    patterns = {"Stockout Risk": rf"Stock Ratio:\s*{NUMBER}%"} | {r[0]: r[1] for r in SIGNAL_RULES}
    # a pattern written out for each kind is compiled once; one chosen row by row is compiled whenever the kind changes
    extracted = "CASE analysis_type " + " ".join(
        f"WHEN {lit(kind)} THEN regexp_extract(evidence, {lit('(?i)' + text)}, 1)" for kind, text in patterns.items()) + " END"
    parsed = f"try_cast(nullif(replace({extracted}, ',', ''), '') AS DOUBLE)"
    base = "CASE analysis_type " + " ".join(f"WHEN {lit(k)} THEN {v}D" for k, v in SIGNAL_SCORES.items()) + " ELSE 0D END"
    score, label = [], []
    for kind, _, bonus, text, digits in SIGNAL_RULES:
        when = f"analysis_type = {lit(kind)} AND n IS NOT NULL"
        score.append(f"WHEN {when} THEN {round2(f'base + {bonus}')}")
        label.append(f"WHEN {when} THEN {say(text, n=fixed('n', digits))}")
    stockout = "analysis_type = 'Stockout Risk'"
    return evidence.selectExpr("*", f"{parsed} AS n", f"{base} AS base").selectExpr(
        *evidence.columns,
        f"CASE WHEN {stockout} AND n IS NULL THEN 50D "
        f"WHEN {stockout} THEN {round2('40D + greatest(0D, least(50D, 50D - n)) * 0.8D')} "
        f"{' '.join(score)} WHEN base > 0 THEN base WHEN severity = 'High' THEN 8D WHEN severity = 'Medium' THEN 3D "
        "ELSE 0D END AS signal_score",
        f"CASE WHEN {stockout} AND n IS NULL THEN 'Stockout Risk' "
        f"WHEN {stockout} THEN {say('Stockout Risk ({n}% of reorder level)', n=fixed('n'))} "
        f"{' '.join(label)} WHEN base > 0 THEN analysis_type WHEN severity = 'High' THEN 'High-Severity Supporting Evidence' "
        "WHEN severity = 'Medium' THEN 'Medium-Severity Supporting Evidence' ELSE '' END AS signal_label",
        f"CASE WHEN {stockout} THEN n END AS stock_ratio_percent",
    )


def evidence_profiles(scored: DataFrame) -> DataFrame:
    """Strongest signal plus a small bonus for distinct signals; first four labels in order."""
    labels = scored.groupBy("issue_id", "analysis_type", "signal_label").agg(*aggregates({
        "signal_score": "max(signal_score)", "ratio": "min(stock_ratio_percent)", "arrival": "min(arrival)"}))
    totals = labels.groupBy("issue_id").agg(*aggregates({
        "strongest": "coalesce(max(if(signal_score > 0, signal_score, NULL)), 0D)",
        # bounded by the number of rules
        "types": "size(collect_set(if(signal_score > 0 AND analysis_type <> '', analysis_type, NULL)))",
        "ratio": "min(ratio)"}))
    distinct_labels = labels.where("signal_label <> ''").groupBy("issue_id", "signal_label").agg(
        *aggregates({"arrival": "min(arrival)"}))
    shown = first_per_key(distinct_labels, "issue_id", "arrival, signal_label", keep=4).groupBy("issue_id").agg(*aggregates({
        "critical_signals": "concat_ws(' | ', transform(array_sort(collect_list(struct(arrival, signal_label))), x -> x.signal_label))"}))
    return totals.join(shown, "issue_id", "left").selectExpr(
        "issue_id", f"{round2('strongest + least(greatest(types - 1, 0) * 4D, 12D)')} AS critical_evidence_score",
        "coalesce(critical_signals, '') AS critical_signals", f"{round2('ratio')} AS minimum_stock_ratio_percent")


def scored_issues(issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """Active issues with their evidence profile."""
    return issues.where(ACTIVE).join(profiles, "issue_id", "left").withColumns({
        "critical_evidence_score": F.expr("coalesce(critical_evidence_score, 0D)"),
        "critical_signals": F.expr("coalesce(critical_signals, '')"),
        "priority_score": F.expr("coalesce(CAST(priority_score AS DOUBLE), 0D)"),
    })


def order_scored(issues: DataFrame) -> DataFrame:
    return order_by(issues, severity_rank("priority_level"), "priority_score DESC", "high_finding_count DESC",
                    "finding_count DESC", "last_detected_at DESC", "issue_id")


PICK_SCHEMA = "issue_id string, executive_rank int, repetition_adjustment double, executive_score double"


def _pick(limit: int, type_penalty: float, area_penalty: float):
    def choose(candidates: pd.DataFrame) -> pd.DataFrame:
        left = candidates.sort_values("position").reset_index(drop=True)
        total = left["total_cents"].to_numpy()
        types, areas = left["issue_type"].to_numpy(), left["business_area"].to_numpy()
        type_count = pd.Series(0, index=pd.unique(types))
        area_count = pd.Series(0, index=pd.unique(areas))
        taken = pd.Series(False, index=left.index)
        picked = []
        while len(picked) < limit and not taken.all():
            adjustment = (type_count.reindex(types).to_numpy() * round(type_penalty * 100)
                          + area_count.reindex(areas).to_numpy() * round(area_penalty * 100))
            score = pd.Series(total - adjustment)[~taken.to_numpy()]
            best = score.index[score.to_numpy() == score.max()][0]
            picked.append((left.at[best, "issue_id"], len(picked) + 1,
                           float(adjustment[best]) / 100, float(score[best]) / 100))
            taken[best] = True
            type_count[types[best]] += 1
            area_count[areas[best]] += 1
        return pd.DataFrame(picked, columns=["issue_id", "executive_rank", "repetition_adjustment", "executive_score"])

    return choose


def executive_priorities(scored: DataFrame, limit: int = 10, t: Thresholds = DEFAULTS) -> DataFrame:
    """Greedy choice with a penalty for repeated issue types and business areas.

    Within one (issue type, area) the penalty is the same for all, so only its
    first `limit` issues can be chosen. Those few rows per type and area go to
    one small fold; everything before is a distributed rank.
    """
    ties = ("total_cents DESC, priority_score DESC, critical_evidence_score DESC, high_finding_count DESC, "
            f"finding_count DESC, last_detected_at DESC, {MANAGER_ORDER}")
    totals = scored.selectExpr("*", "CAST(round((priority_score + critical_evidence_score) * 100) AS BIGINT) AS total_cents")
    finalists = first_per_key(totals, "issue_type, business_area", ties, keep=limit)
    ordered = finalists.selectExpr(
        "issue_id", "issue_type", "business_area", "total_cents", "1 AS fold",
        "row_number() OVER (ORDER BY priority_score DESC, critical_evidence_score DESC, high_finding_count DESC, "
        f"finding_count DESC, last_detected_at DESC, {MANAGER_ORDER}) AS position")
    picks = ordered.groupBy("fold").applyInPandas(
        _pick(limit, t.issue_type_repeat, t.business_area_repeat), PICK_SCHEMA)
    chosen = scored.join(picks, "issue_id")
    reason = say("Selected by executive score: base priority {p} + critical evidence {e} - repetition adjustment {r}.",
                 p=fixed("priority_score"), e=fixed("critical_evidence_score"), r=fixed("repetition_adjustment"))
    front = ["executive_rank", "issue_id", "title", "issue_type", "business_area", "priority_level", "priority_score",
             "critical_evidence_score", "repetition_adjustment", "executive_score", "critical_signals",
             "minimum_stock_ratio_percent"]
    back = ["status", "entity_type", "entity_id", "store_id", "product_id", "vendor_id", "period_label",
            "finding_count", "high_finding_count", "medium_finding_count", "low_finding_count", "summary",
            "evidence_summary", "last_detected_at"]
    return order_by(chosen.selectExpr(*front, f"{reason} AS selection_reason", *back), "executive_rank")


def evidence_references(selected: DataFrame, evidence: DataFrame, keep: int = 12) -> DataFrame:
    """First distinct finding ids of each selected issue, in arrival order."""
    wanted = evidence.join(selected.select("issue_id").distinct(), "issue_id", "left_semi").where("source_finding_id <> ''")
    distinct = wanted.groupBy("issue_id", "source_finding_id").agg(*aggregates({"arrival": "min(arrival)"}))
    return first_per_key(distinct, "issue_id", "arrival", keep=keep).groupBy("issue_id").agg(*aggregates({
        "included_count": "count(*)",
        "evidence_ids": "transform(array_sort(collect_list(struct(arrival, source_finding_id))), x -> x.source_finding_id)"}))


def selection_reference(scored: DataFrame, requested: DataFrame | None = None,
                        previous: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """Issues to analyse: requested ids in their order, else the previous list, else the current one.

    Requested issues score priority plus evidence without a penalty; an unknown id gets no
    issue columns and outcome 'not found'.
    """
    if requested is not None:
        return requested.selectExpr("issue_id", "requested_order").join(
            scored.selectExpr("issue_id", f"{round2('priority_score + critical_evidence_score')} AS executive_score"),
            "issue_id", "left",
        ).selectExpr(
            "issue_id", "CAST(requested_order AS INT) AS executive_rank", "executive_score",
            "if(executive_score IS NULL, 'not found', 'selected') AS outcome")
    source = previous if previous is not None else current
    if source is None:
        raise ValueError("one of requested, previous or current is needed")
    return source.selectExpr("issue_id", "executive_rank", "executive_score", "'selected' AS outcome")


def selection_of_run(scored: DataFrame, runs, run_at: str, requested: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The issues that a run analyses: those requested; else the list of the last run before it (a RunTable); else a ranking made now.

    An earlier list counts if it has a row with an id and a rank; its first `limit` ranks are taken."""
    if requested is not None:
        return selection_reference(scored, requested=requested)
    previous = runs.as_of(run_at)
    if previous is not None:
        usable = previous.where("issue_id IS NOT NULL AND executive_rank IS NOT NULL")
        if not usable.isEmpty():
            return selection_reference(scored, previous=order_by(usable, "executive_rank", "issue_id").limit(limit))
    return selection_reference(scored, current=executive_priorities(scored, limit))
