"""Registered queries against their SQL; all of them with TILLWATCH_ALL=1, a spread of them otherwise."""

from __future__ import annotations

import os

import pytest
from crosscheck import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ("store_sales_decline", "inventory_findings", "vendor_findings", "repeated_complaint_category", "kpi_table", "store_monthly_view",
        "cleaned_sales", "latest_imports", "document_validation", "consolidated_issues", "evidence_profiles", "recommendations", "task_transitions",
        "stemmed_search", "violation_samples", "dataset_verdicts", "processed_violations", "cleaned_finance", "cleaning_report", "bucketed_upsert", "refresh_log",
        "complaint_growth_last_full_month", "previous_selection", "task_details", "latest_brief", "ungrounded_causes", "ungrounded_recommendations",
        "ungrounded_brief", "brief_references", "attention_links")
NAMES = tuple(entry.oracle_sql()) if os.environ.get("TILLWATCH_ALL") else SOME


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    problem, _ = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_one_fact_scan_for_month_over_month(spark):
    """The latest-month subquery runs on the exchange of the main query: lineitem is read once."""
    df = entry.queries()["store_sales_decline"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("lineitem.parquet") == 1
