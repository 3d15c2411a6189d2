"""Finding records: one schema per family, empty text instead of NULL as in the published reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import clean_column, lit, round2

# fixed values: column lists of the four finding families ("t" text, "d" amount, "n" whole number)
SALES = {
    "finding_id": "t", "analysis_type": "t", "business_area": "t", "severity": "t",
    "entity_type": "t", "entity_id": "t", "entity_name": "t", "store_id": "t", "store_name": "t",
    "product_id": "t", "product_name": "t", "region": "t", "category": "t", "month": "t",
    "previous_month": "t", "current_sales": "d", "previous_sales": "d",
    "sales_change_percent": "d", "benchmark_value": "d", "benchmark_label": "t",
    "target_achievement_percent": "d", "summary": "t", "evidence": "t", "status": "t",
    "detected_at": "t",
}
INVENTORY = {
    "finding_id": "t", "analysis_type": "t", "business_area": "t", "severity": "t",
    "entity_type": "t", "entity_id": "t", "store_id": "t", "store_name": "t", "product_id": "t",
    "product_name": "t", "vendor_id": "t", "vendor_name": "t", "inventory_date": "t",
    "expiry_date": "t", "days_to_expiry": "n", "current_stock": "d", "reorder_level": "d",
    "stock_ratio": "d", "stock_status": "t", "reorder_required": "t", "related_complaints": "n",
    "high_severity_complaints": "n", "summary": "t", "evidence": "t", "status": "t",
    "detected_at": "t",
}
COMPLAINTS = {
    "finding_id": "t", "analysis_type": "t", "business_area": "t", "severity": "t",
    "entity_type": "t", "entity_id": "t", "entity_name": "t", "store_id": "t", "store_name": "t",
    "product_id": "t", "product_name": "t", "region": "t", "complaint_id": "t",
    "complaint_type": "t", "complaint_severity": "t", "complaint_status": "t",
    "complaint_date": "t", "complaint_age_days": "n", "total_complaints": "n",
    "high_severity_complaints": "n", "unresolved_complaints": "n", "monthly_growth_percent": "d",
    "benchmark_value": "d", "benchmark_label": "t", "summary": "t", "evidence": "t",
    "status": "t", "detected_at": "t",
}
VENDOR_FINANCE = {
    "finding_id": "t", "analysis_type": "t", "business_area": "t", "severity": "t",
    "entity_type": "t", "entity_id": "t", "entity_name": "t", "vendor_id": "t",
    "vendor_name": "t", "store_id": "t", "store_name": "t", "month": "t", "delivery_count": "n",
    "delayed_deliveries": "n", "partial_deliveries": "n", "average_delay_days": "d",
    "maximum_delay_days": "d", "average_quality_rating": "d", "on_time_delivery_rate": "d",
    "total_revenue": "d", "operating_profit": "d", "operating_profit_margin_percent": "d",
    "target_achievement_percent": "d", "risk_status": "t", "summary": "t", "evidence": "t",
    "status": "t", "detected_at": "t",
}

_EMPTY = {"t": "''", "d": "CAST(NULL AS DOUBLE)", "n": "CAST(NULL AS BIGINT)"}
_SHAPE = {
    "t": lambda x: x if x.startswith("'") else clean_column(x),
    "d": round2,
    "n": lambda x: f"CAST({x} AS BIGINT)",
}
NOW = "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')"


def stamp(detected_at: str | None) -> str:
    return lit(detected_at) if detected_at else NOW


def record(rows: DataFrame, family: dict[str, str], detected_at: str | None, **values: str) -> DataFrame:
    """Project rows to the family's schema (SQL expressions); names not given stay empty.

    Texts that are put together become columns first: they are made once, and cleaned as any other column."""
    values = {"status": "'Open'", **values, "detected_at": stamp(detected_at)}
    unknown = set(values) - set(family)
    if unknown:
        raise ValueError(f"not in the finding schema: {sorted(unknown)}")
    made = {f"made_{name}": x for name, x in values.items() if family[name] == "t" and not x.startswith("'") and not x.isidentifier()}
    rows = rows.selectExpr("*", *[f"{x} AS {name}" for name, x in made.items()])
    values |= {name.removeprefix("made_"): name for name in made}
    return rows.selectExpr(*[
        f"{_SHAPE[kind](values[name]) if name in values else _EMPTY[kind]} AS {name}"
        for name, kind in family.items()
    ])


def columns(*names: str) -> dict[str, str]:
    """Columns passed through under their own name."""
    return {name: name for name in names}


def rule(condition: str, analysis_type: str, severity: str, summary: str, evidence: str, **more: str) -> str:
    """A struct describing the finding when the condition holds, else NULL."""
    fields = {"analysis_type": lit(analysis_type), "severity": severity, "summary": summary,
              "evidence": evidence, **more}
    body = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"CASE WHEN {condition} THEN named_struct({body}) END"


def apply_rules(snapshot: DataFrame, *rules: str) -> DataFrame:
    """One pass over a snapshot: every rule that fires on a row yields one output row."""
    return snapshot.selectExpr("*", f"inline(array_compact(array({', '.join(rules)})))")
