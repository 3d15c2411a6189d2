"""Finding lists with filters and pages, summaries, and the monitoring snapshot over all sources."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from tillwatch.functions.text import clean_text, lit, severity_rank
from tillwatch.operators.templates import aggregates, order_by

LOG = logging.getLogger(__name__)
# fixed values: order of the monitored sources
SOURCES = ("sales", "inventory", "complaints", "vendors", "finance")


def matches(**filters: str | None) -> str:
    """Trimmed, case-insensitive equality; a filter that is None is left out."""
    parts = [
        f"lower(trim(coalesce(CAST({column} AS STRING), ''))) = lower(trim({lit(value)}))"
        for column, value in filters.items() if value is not None
    ]
    return " AND ".join(parts) or "TRUE"


def finding_page(findings: DataFrame, limit: int, offset: int = 0, **filters: str | None) -> DataFrame:
    """One page of the filtered findings in a total order."""
    rows = findings.where(matches(**filters))
    return order_by(rows, severity_rank(), "analysis_type", "finding_id").offset(offset).limit(limit)


def summary(findings: DataFrame, **filters: str | None) -> DataFrame:
    counted = findings.where(matches(**filters)).groupBy("analysis_type", "severity").agg(
        *aggregates({"finding_count": "count(*)"}))
    return order_by(counted, severity_rank(), "analysis_type")


def match_counts(findings: DataFrame, **filters: str | None) -> DataFrame:
    """Total and matching rows in one pass."""
    return findings.agg(*aggregates({
        "total_findings": "count(*)", "matching_findings": f"count_if({matches(**filters)})"}))


def by_source(findings: DataFrame) -> DataFrame:
    """Compact findings labelled with the five monitored sources."""
    source = ("CASE WHEN source_module <> 'vendor_finance' THEN source_module "
              "WHEN business_area = 'Procurement' THEN 'vendors' ELSE 'finance' END")
    names = ("finding_id", "analysis_type", "business_area", "severity", "entity_type", "entity_id", "summary", "evidence")
    return findings.selectExpr(f"{source} AS source", *[f"{clean_text(c)} AS {c}" for c in names])


def totals(compact: DataFrame) -> DataFrame:
    return compact.groupBy("source").agg(*aggregates({
        "total": "count(*)", "high": "count_if(severity = 'High')", "medium": "count_if(severity = 'Medium')",
        "low": "count_if(severity = 'Low')"}))


def top_findings(compact: DataFrame, limit: int) -> DataFrame:
    rank = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCES, 1)) + " ELSE 99 END"
    return order_by(compact, severity_rank(), rank, "analysis_type", "finding_id").limit(limit)


def health(compact: DataFrame, failed_sources: int = 0) -> DataFrame:
    counted = compact.agg(*aggregates({
        "high": "count_if(severity = 'High')", "medium": "count_if(severity = 'Medium')"}))
    return counted.selectExpr(
        "high AS high_findings", "medium AS medium_findings", f"CAST({failed_sources} AS BIGINT) AS failed_sources",
        f"CASE WHEN high >= 10 THEN 'Critical' WHEN high > 0 OR {failed_sources} > 0 THEN 'At Risk' "
        "WHEN medium > 0 THEN 'Watch' ELSE 'Stable' END AS health_status")


def run_sources(sources: dict[str, Callable[[], DataFrame]], sink: Callable[[str, DataFrame], None]) -> list[str]:
    """Build and write each source on its own; a failing one does not stop the others.

    Returns the names that failed and raises when all of them did.
    """
    failed = []
    for name, build in sources.items():
        try:
            sink(name, build())
        except Exception:  # noqa: BLE001
            LOG.exception("source %s failed", name)
            failed.append(name)
    if sources and len(failed) == len(sources):
        raise RuntimeError(f"all sources failed: {', '.join(failed)}")
    return failed
