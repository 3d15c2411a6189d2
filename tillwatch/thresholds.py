"""Rule thresholds. Every operator takes them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values: published defaults of the monitoring rules
    priority_high: float = 85.0
    priority_medium: float = 65.0
    high_severity_points: float = 55.0
    medium_severity_points: float = 35.0
    low_severity_points: float = 15.0
    cross_area_bonus: float = 7.0
    max_cross_area_bonus: float = 14.0
    additional_high_bonus: float = 10.0
    max_additional_high_bonus: float = 20.0
    volume_bonus: float = 1.0
    max_volume_bonus: float = 8.0
    store_decline_percent: float = 20.0
    product_decline_percent: float = 30.0
    category_decline_percent: float = 20.0
    region_decline_percent: float = 20.0
    severe_decline_percent: float = 40.0
    low_target_percent: float = 70.0
    severe_target_percent: float = 50.0
    product_to_category_ratio: float = 0.60
    severe_product_ratio: float = 0.40
    min_previous_product_sales: float = 50000.0
    low_stock_ratio: float = 0.80
    stockout_ratio: float = 0.50
    severe_stock_ratio: float = 0.25
    overstock_ratio: float = 3.0
    severe_overstock_ratio: float = 5.0
    near_expiry_days: int = 30
    urgent_expiry_days: int = 7
    inventory_complaints: int = 20
    inventory_high_complaints: int = 5
    complaint_outlier_multiplier: float = 1.50
    complaint_category_multiplier: float = 1.25
    severe_outlier_ratio: float = 2.0
    complaint_growth_percent: float = 20.0
    severe_growth_percent: float = 40.0
    unresolved_age_days: int = 7
    urgent_age_days: int = 14
    vendor_average_delay: float = 5.0
    vendor_delayed_deliveries: int = 3
    vendor_low_quality: float = 3.5
    vendor_low_on_time: float = 70.0
    vendor_partial_deliveries: int = 2
    low_margin_percent: float = 10.0
    issue_type_repeat: float = 18.0
    business_area_repeat: float = 4.0


DEFAULTS = Thresholds()
