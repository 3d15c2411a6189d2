"""Complaint rules: volume outliers, open severe cases, monthly growth, ageing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwatch.functions.text import clean_text, fixed, safe_identifier, say, severity_rank
from tillwatch.operators import findings as fd
from tillwatch.operators.templates import (
    COMPLAINT_COUNTS, at_least_average, average_of, exact, merge_labels, month_over_month,
    monthly_totals, order_by, ratio_to_average, with_averages,
)
from tillwatch.thresholds import DEFAULTS, Thresholds

MEASURES = ["total_complaints", "high_severity_complaints"]


def entity_counts(complaints: DataFrame, key: str, labels: list[str]) -> DataFrame:
    return merge_labels(complaints, [key], labels, COMPLAINT_COUNTS)


def outliers(summary: DataFrame, multiplier: float, t: Thresholds) -> DataFrame:
    """Entities whose total or High count reaches multiplier times the average entity."""
    ratio = t.severe_outlier_ratio
    severe = " OR ".join(f"{ratio_to_average(m)} >= {ratio}" for m in MEASURES)
    return with_averages(summary, MEASURES).where(
        " OR ".join(at_least_average(m, multiplier) for m in MEASURES)
    ).selectExpr(
        "*", f"{average_of('total_complaints')} AS average",
        f"CASE WHEN {severe} THEN 'High' ELSE 'Medium' END AS outlier_severity",
    )


def _volume(rows: DataFrame, detected_at: str | None, label: str, more_evidence: str = "''",
            **values: str) -> DataFrame:
    return fd.record(
        rows, fd.COMPLAINTS, detected_at, business_area="'Customer Support'",
        severity="outlier_severity", benchmark_value="average", benchmark_label=f"'{label}'",
        evidence=say("Total Complaints: {total_complaints}; High-Severity Complaints: {high_severity_complaints}; "
                     "Open or In-Progress Complaints: {unresolved_complaints}; " + label + ": {average}{more}",
                     average=fixed("average"), more=more_evidence),
        **fd.columns("total_complaints", "high_severity_complaints", "unresolved_complaints"), **values,
    )


def high_complaint_products(complaints: DataFrame, t: Thresholds = DEFAULTS,
                            detected_at: str | None = None) -> DataFrame:
    rows = outliers(entity_counts(complaints, "product_id", ["product_name"]), t.complaint_outlier_multiplier, t)
    return _volume(
        rows, detected_at, "Average Complaints per Product",
        finding_id=say("HIGH-COMPLAINT-PRODUCT-{product_id}"), analysis_type="'High Complaint Product'",
        entity_type="'Product'", entity_id="product_id", entity_name="product_name",
        summary=say("{product_name} has an unusually high complaint volume compared with other products."),
        **fd.columns("product_id", "product_name"),
    )


def high_complaint_stores(complaints: DataFrame, t: Thresholds = DEFAULTS,
                          detected_at: str | None = None) -> DataFrame:
    rows = outliers(entity_counts(complaints, "store_id", ["store_name", "region"]), t.complaint_outlier_multiplier, t)
    return _volume(
        rows, detected_at, "Average Complaints per Store", say("; Region: {x}", x=clean_text("region")),
        finding_id=say("HIGH-COMPLAINT-STORE-{store_id}"), analysis_type="'High Complaint Store'",
        entity_type="'Store'", entity_id="store_id", entity_name="store_name",
        summary=say("{store_name} has an unusually high complaint burden compared with other stores."),
        **fd.columns("store_id", "store_name", "region"),
    )


def repeated_complaint_categories(complaints: DataFrame, t: Thresholds = DEFAULTS,
                                  detected_at: str | None = None) -> DataFrame:
    rows = outliers(entity_counts(complaints, "complaint_type", []), t.complaint_category_multiplier, t)
    slug = safe_identifier("complaint_type")
    return _volume(
        rows, detected_at, "Average Complaints per Category",
        finding_id=say("REPEATED-COMPLAINT-CATEGORY-{slug}", slug=slug),
        analysis_type="'Repeated Complaint Category'", entity_type="'Complaint Category'",
        entity_id=slug, entity_name="complaint_type", complaint_type="complaint_type",
        summary=say("{complaint_type} is a repeatedly occurring complaint category."),
    )


def with_age(complaints: DataFrame) -> DataFrame:
    """Unresolved complaints with their age against the last complaint date of the whole table."""
    last = complaints.selectExpr("max(date)").scalar()
    return complaints.where("status IN ('Open', 'In Progress')").withColumn(
        "age", F.datediff(last, F.col("date")))


def _case(rows: DataFrame, t: Thresholds, detected_at: str | None, evidence: str, **values: str) -> DataFrame:
    return fd.record(
        rows, fd.COMPLAINTS, detected_at, business_area="'Customer Support'",
        severity=f"CASE WHEN age >= {t.urgent_age_days} THEN 'High' ELSE 'Medium' END",
        entity_type="'Complaint'", entity_id="complaint_id", entity_name="complaint_type",
        complaint_severity="severity", complaint_status="status", complaint_date="date",
        complaint_age_days="age",
        evidence=say("Complaint Date: {date}; Age Against Latest Dataset Date: {age} days; " + evidence,
                     employee=clean_text("assigned_employee_id"), days="coalesce(resolution_time_days, 0)"),
        **fd.columns("store_id", "store_name", "product_id", "product_name", "region",
                     "complaint_id", "complaint_type"), **values,
    )


def open_high_severity_complaints(complaints: DataFrame, t: Thresholds = DEFAULTS,
                                  detected_at: str | None = None) -> DataFrame:
    return _case(
        with_age(complaints).where("severity = 'High'"), t, detected_at,
        "Status: {status}; Assigned Employee: {employee}; Recorded Resolution Time: {days} days",
        finding_id=say("OPEN-HIGH-COMPLAINT-{complaint_id}"),
        analysis_type="'Open High-Severity Complaint'",
        summary=say("A High-severity {complaint_type} complaint for {product_name} at {store_name} remains {status}."),
    )


def unresolved_complaint_ageing(complaints: DataFrame, t: Thresholds = DEFAULTS,
                                detected_at: str | None = None) -> DataFrame:
    return _case(
        with_age(complaints).where(f"age >= {t.unresolved_age_days}"), t, detected_at,
        "Complaint Severity: {severity}; Status: {status}; Assigned Employee: {employee}",
        finding_id=say("UNRESOLVED-AGEING-{complaint_id}"),
        analysis_type="'Unresolved Complaint Ageing'",
        summary=say("A {severity}-severity complaint for {product_name} at {store_name} has remained {status} "
                    "for {age} days relative to the latest dataset date."),
    )


def monthly_complaint_growth(complaints: DataFrame, t: Thresholds = DEFAULTS,
                             as_of_month: str | None = None,
                             detected_at: str | None = None) -> DataFrame:
    monthly = monthly_totals(complaints, ["store_id"], COMPLAINT_COUNTS, ["store_name", "region"], as_of_month)
    rows = month_over_month(monthly, ["store_id"], ["total_complaints"]).where(
        "previous_total_complaints > 0 AND total_complaints * 100 >= "
        f"previous_total_complaints * {exact(100 + t.complaint_growth_percent)}"
    ).selectExpr("*", "CAST(total_complaints - previous_total_complaints AS DOUBLE) "
                      "/ previous_total_complaints * 100 AS growth")
    return fd.record(
        rows, fd.COMPLAINTS, detected_at, finding_id=say("COMPLAINT-GROWTH-{store_id}-{month}"),
        analysis_type="'Monthly Complaint Growth'", business_area="'Customer Support'",
        severity=f"CASE WHEN growth >= {t.severe_growth_percent} THEN 'High' ELSE 'Medium' END",
        entity_type="'Store'", entity_id="store_id", entity_name="store_name",
        monthly_growth_percent="growth", benchmark_value="previous_total_complaints",
        benchmark_label=say("Previous Month Complaints ({previous_month})"),
        summary=say("{store_name} recorded a {growth}% increase in complaints in {month} compared with "
                    "{previous_month}.", growth=fixed("growth")),
        evidence=say("Current Month Complaints: {total_complaints}; Previous Month Complaints: "
                     "{previous_total_complaints}; High-Severity Complaints: {high_severity_complaints}; "
                     "Open or In-Progress Complaints: {unresolved_complaints}"),
        **fd.columns("store_id", "store_name", "region", "total_complaints",
                     "high_severity_complaints", "unresolved_complaints"),
    )


def order_findings(findings: DataFrame) -> DataFrame:
    return order_by(findings, severity_rank(), "analysis_type", "complaint_age_days DESC",
                    "total_complaints DESC", "finding_id")


def complaint_findings(complaints: DataFrame, t: Thresholds = DEFAULTS,
                       as_of_month: str | None = None, detected_at: str | None = None) -> DataFrame:
    """All six complaint rules (unordered)."""
    return (
        high_complaint_products(complaints, t, detected_at)
        .unionByName(high_complaint_stores(complaints, t, detected_at))
        .unionByName(repeated_complaint_categories(complaints, t, detected_at))
        .unionByName(open_high_severity_complaints(complaints, t, detected_at))
        .unionByName(monthly_complaint_growth(complaints, t, as_of_month, detected_at))
        .unionByName(unresolved_complaint_ageing(complaints, t, detected_at))
    )
