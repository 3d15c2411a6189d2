"""Vendor delivery rules and store finance rules, each family in one pass over its snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import clean_text, currency, currency0, fixed, say, severity_rank, zero
from tillwatch.operators import findings as fd
from tillwatch.operators.templates import aggregates, exact, latest_finance, order_by
from tillwatch.thresholds import DEFAULTS, Thresholds

DELIVERY_METRICS = {
    "delivery_count": "count(*)",
    "delayed_deliveries": "count_if(delay_days > 0)",
    "partial_deliveries": "count_if(received_quantity < ordered_quantity)",
    "average_delay_days": "avg(delay_days)",
    "maximum_delay_days": "max(delay_days)",
    "average_quality_rating": "try_divide(CAST(sum(quality_rating) AS DOUBLE), CAST(count(quality_rating) AS DOUBLE))",
    "on_time_delivery_rate": "count_if(delay_days <= 0) * 100D / count(*)",
}


def vendor_snapshot(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("vendor_id", "vendor_name").agg(*aggregates(DELIVERY_METRICS))


def finance_snapshot(finance: DataFrame) -> DataFrame:
    return latest_finance(finance).selectExpr(
        "*", "CASE WHEN total_revenue > 0 THEN CAST(operating_profit AS DOUBLE) * 100 "
             "/ CAST(total_revenue AS DOUBLE) ELSE 0D END AS operating_profit_margin_percent")


def _vendor_rules(t: Thresholds) -> dict[str, str]:
    delay, longest = zero("average_delay_days"), zero("maximum_delay_days")
    texts = dict(delay=fixed(delay), longest=fixed(longest, 0), on_time=fixed("on_time_delivery_rate"),
                 quality=fixed("average_quality_rating"))
    return {
        "Repeated Vendor Delays": fd.rule(
            f"average_delay_days >= {t.vendor_average_delay} OR delayed_deliveries >= {t.vendor_delayed_deliveries}",
            "Repeated Vendor Delays",
            f"CASE WHEN {delay} >= 10 OR {longest} >= 15 OR on_time_delivery_rate < 50 THEN 'High' ELSE 'Medium' END",
            say("{vendor_name} has repeated delivery delays that may disrupt inventory replenishment."),
            say("Delivery Count: {delivery_count}; Delayed Deliveries: {delayed_deliveries}; Average Delay: {delay} days; "
                "Maximum Delay: {longest} days; On-Time Delivery Rate: {on_time}%", **texts),
            prefix="'VENDOR-DELAY-'"),
        "Partial Vendor Deliveries": fd.rule(
            f"partial_deliveries >= {t.vendor_partial_deliveries}", "Partial Vendor Deliveries",
            "CASE WHEN partial_deliveries >= 3 THEN 'High' ELSE 'Medium' END",
            say("{vendor_name} has repeated partial deliveries, which may create inventory availability risk."),
            say("Delivery Count: {delivery_count}; Partial Deliveries: {partial_deliveries}; "
                "Delayed Deliveries: {delayed_deliveries}; Average Delay: {delay} days", **texts),
            prefix="'PARTIAL-DELIVERY-'"),
        "Low Vendor Quality Rating": fd.rule(
            f"average_quality_rating < {t.vendor_low_quality}", "Low Vendor Quality Rating",
            "CASE WHEN average_quality_rating < 3.0D THEN 'High' ELSE 'Medium' END",
            say("{vendor_name} has a below-threshold average quality rating."),
            say("Average Quality Rating: {quality} out of 5; Delivery Count: {delivery_count}; "
                "Partial Deliveries: {partial_deliveries}; Average Delay: {delay} days", **texts),
            prefix="'LOW-VENDOR-QUALITY-'"),
        "Low On-Time Delivery Rate": fd.rule(
            f"on_time_delivery_rate < {t.vendor_low_on_time}", "Low On-Time Delivery Rate",
            "CASE WHEN on_time_delivery_rate < 50 THEN 'High' ELSE 'Medium' END",
            say("{vendor_name} has a low on-time delivery rate."),
            say("On-Time Delivery Rate: {on_time}%; Delayed Deliveries: {delayed_deliveries}; "
                "Delivery Count: {delivery_count}; Average Delay: {delay} days", **texts),
            prefix="'LOW-ON-TIME-RATE-'"),
    }


def _finance_rules(t: Thresholds) -> dict[str, str]:
    texts = dict(
        revenue=currency("total_revenue"), profit=currency("operating_profit"),
        margin=fixed("operating_profit_margin_percent"), target=fixed(zero("target_achievement_percent")),
        risk=clean_text("risk_status"), profit0=currency0("operating_profit"),
    )
    money = "Revenue: {revenue}; Operating Profit: {profit}"
    return {
        "Low Operating Profit": fd.rule(
            f"operating_profit >= 0 AND operating_profit_margin_percent < {t.low_margin_percent}",
            "Low Operating Profit",
            "CASE WHEN operating_profit_margin_percent < 5 THEN 'High' ELSE 'Medium' END",
            say("{store_name} has a low operating-profit margin in {month}."),
            say(money + "; Operating Profit Margin: {margin}%; Target Achievement: {target}%", **texts),
            prefix="'LOW-PROFIT-'"),
        "Loss-Making Store": fd.rule(
            "operating_profit < 0", "Loss-Making Store", "'High'",
            say("{store_name} recorded an operating loss in {month}."),
            say(money + "; Operating Profit Margin: {margin}%; Risk Status: {risk}", **texts),
            prefix="'LOSS-MAKING-'"),
        "Low Target Achievement": fd.rule(
            f"target_achievement_percent < {exact(t.low_target_percent)}", "Low Target Achievement",
            f"CASE WHEN target_achievement_percent < {exact(t.severe_target_percent)} THEN 'High' ELSE 'Medium' END",
            say("{store_name} achieved only {target}% of its target in {month}.", **texts),
            say(money + "; Target Achievement: {target}%; Risk Status: {risk}", **texts),
            prefix="'LOW-TARGET-'"),
        "High Financial Risk": fd.rule(
            "lower(trim(risk_status)) = 'high risk'", "High Financial Risk", "'High'",
            say("{store_name} is classified as High Risk in the finance report for {month}."),
            say("Revenue: {revenue}; Operating Profit: {profit0}; Operating Profit Margin: {margin}%; "
                "Target Achievement: {target}%; Risk Status: {risk}", **texts),
            prefix="'HIGH-FINANCIAL-RISK-'"),
    }


VENDOR_RULES = ("Repeated Vendor Delays", "Partial Vendor Deliveries",
                "Low Vendor Quality Rating", "Low On-Time Delivery Rate")
FINANCE_RULES = ("Low Operating Profit", "Loss-Making Store",
                 "Low Target Achievement", "High Financial Risk")


def vendor_findings(snap: DataFrame, t: Thresholds = DEFAULTS, detected_at: str | None = None,
                    only: tuple[str, ...] = VENDOR_RULES) -> DataFrame:
    rules = _vendor_rules(t)
    return fd.record(
        fd.apply_rules(snap, *[rules[name] for name in only]), fd.VENDOR_FINANCE, detected_at,
        finding_id=say("{prefix}{vendor_id}"), business_area="'Procurement'", entity_type="'Vendor'",
        entity_id="vendor_id", entity_name="vendor_name",
        average_delay_days=zero("average_delay_days"), maximum_delay_days=zero("maximum_delay_days"),
        average_quality_rating=zero("average_quality_rating"),
        **fd.columns("analysis_type", "severity", "vendor_id", "vendor_name", "delivery_count",
                     "delayed_deliveries", "partial_deliveries", "on_time_delivery_rate", "summary",
                     "evidence"),
    )


def finance_findings(snap: DataFrame, t: Thresholds = DEFAULTS, detected_at: str | None = None,
                     only: tuple[str, ...] = FINANCE_RULES) -> DataFrame:
    rules = _finance_rules(t)
    return fd.record(
        fd.apply_rules(snap, *[rules[name] for name in only]), fd.VENDOR_FINANCE, detected_at,
        finding_id=say("{prefix}{store_id}-{month}"), business_area="'Finance'", entity_type="'Store'",
        entity_id="store_id", entity_name="store_name", total_revenue=zero("total_revenue"),
        operating_profit=zero("operating_profit"),
        target_achievement_percent=zero("target_achievement_percent"),
        **fd.columns("analysis_type", "severity", "store_id", "store_name", "month",
                     "operating_profit_margin_percent", "risk_status", "summary", "evidence"),
    )


def vendor_finance_findings(deliveries: DataFrame, finance: DataFrame, t: Thresholds = DEFAULTS,
                            detected_at: str | None = None) -> DataFrame:
    return vendor_findings(vendor_snapshot(deliveries), t, detected_at).unionByName(
        finance_findings(finance_snapshot(finance), t, detected_at))


def order_findings(findings: DataFrame) -> DataFrame:
    return order_by(findings, severity_rank(), "business_area", "analysis_type",
                    "average_delay_days DESC", "target_achievement_percent", "finding_id")
