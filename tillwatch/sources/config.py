"""Fixed dataset descriptions: columns, keys, references, formats and label maps."""

from __future__ import annotations

# fixed values: canonical labels by lower-case key
LABELS = {
    "is_perishable": ("Yes", "No"),
    "region": ("North", "South", "East", "West", "Central"),
    "department": ("Sales", "Inventory", "Finance", "Procurement", "Customer Support"),
    "severity": ("High", "Medium", "Low"),
    "status": ("Open", "In Progress", "Resolved", "Closed"),
    "stock_status": ("Low Stock", "Reorder Soon", "Overstock", "Normal"),
    "reorder_required": ("Yes", "No"),
    "risk_status": ("High Risk", "Medium Risk", "Low Risk"),
    "delivery_status": ("Delayed and Partial", "Delayed", "Partial Delivery", "Delivered On Time"),
    "supply_status": ("Active", "Delayed", "Inactive"),
    "operational_status": ("Active", "Inactive"),
    "employment_status": ("Active", "Inactive"),
    "payment_status": ("Paid", "Pending", "Delayed"),
}

# fixed values, per dataset: columns in load order, key, date / month / whole-number / decimal columns,
# categorical columns, columns that must be filled, columns checked for negative values, references
DATASETS = {
    "products": {
        "columns": (
            "product_id", "product_name", "category", "sub_category", "brand", "unit_price", "cost_price", "margin_percent",
            "reorder_level", "shelf_life_days", "is_perishable", "vendor_id",
        ),
        "key": "product_id",
        "whole": ("reorder_level",),
        "decimal": ("unit_price", "cost_price", "margin_percent"),
        "labels": ("category", "sub_category", "is_perishable"),
        "required": ("product_id", "product_name", "vendor_id", "unit_price", "cost_price"),
        "filled": ("product_id", "vendor_id"),
        "non_negative": ("unit_price", "cost_price", "margin_percent", "reorder_level"),
        "references": {"vendor_id": ("vendors", "vendor_id")},
    },
    "stores": {
        "columns": (
            "store_id", "store_name", "city", "state", "region", "store_type", "manager_id", "opening_date", "monthly_sales_target",
            "operational_status",
        ),
        "key": "store_id",
        "dates": ("opening_date",),
        "decimal": ("monthly_sales_target",),
        "labels": ("region", "operational_status"),
        "required": ("store_id", "store_name", "manager_id", "monthly_sales_target"),
        "filled": ("store_id", "manager_id"),
        "non_negative": ("monthly_sales_target",),
        "references": {"manager_id": ("employees", "employee_id")},
    },
    "vendors": {
        "columns": (
            "vendor_id", "vendor_name", "vendor_category", "contact_person", "city", "state", "region", "average_delivery_days", "rating",
            "payment_terms", "supply_status",
        ),
        "key": "vendor_id",
        "whole": ("average_delivery_days",),
        "decimal": ("rating",),
        "labels": ("region", "supply_status"),
        "required": ("vendor_id", "vendor_name", "average_delivery_days", "rating"),
        "filled": ("vendor_id",),
        "non_negative": ("average_delivery_days", "rating"),
    },
    "employees": {
        "columns": (
            "employee_id", "employee_name", "role", "department", "store_id", "region", "email", "monthly_target", "performance_status",
            "employment_status",
        ),
        "key": "employee_id",
        "decimal": ("monthly_target",),
        "labels": ("department", "region", "employment_status"),
        "required": ("employee_id", "employee_name", "role", "store_id"),
        "filled": ("employee_id",),
    },
    "sales": {
        "columns": (
            "sale_id", "date", "store_id", "store_name", "region", "product_id", "product_name", "category", "employee_id",
            "quantity_sold", "unit_price", "discount_percent", "total_sales", "total_cost", "profit", "payment_status",
        ),
        "key": "sale_id",
        "dates": ("date",),
        "whole": ("quantity_sold",),
        "decimal": ("unit_price", "discount_percent", "total_sales", "total_cost", "profit"),
        "labels": ("region", "payment_status"),
        "required": ("sale_id", "date", "store_id", "product_id", "employee_id", "total_sales"),
        "filled": ("sale_id", "store_id", "product_id"),
        "non_negative": ("quantity_sold", "unit_price", "discount_percent", "total_sales", "total_cost"),
        "references": {"store_id": ("stores", "store_id"), "product_id": ("products", "product_id"), "employee_id": ("employees", "employee_id")},
    },
    "inventory": {
        "columns": (
            "inventory_id", "date", "store_id", "store_name", "product_id", "product_name", "category", "vendor_id", "current_stock",
            "reorder_level", "stock_status", "reorder_required", "expiry_date",
        ),
        "key": "inventory_id",
        "dates": ("date",),
        "whole": ("current_stock", "reorder_level", "days_to_expiry"),
        "labels": ("stock_status", "reorder_required"),
        "required": ("inventory_id", "date", "store_id", "product_id", "vendor_id", "current_stock"),
        "filled": ("inventory_id", "date", "store_id", "product_id"),
        "non_negative": ("current_stock", "reorder_level"),
        "drop": ("reorder_trigger_level",),
        "load_dates": ("date", "expiry_date"),
        "references": {"store_id": ("stores", "store_id"), "product_id": ("products", "product_id"), "vendor_id": ("vendors", "vendor_id")},
    },
    "complaints": {
        "columns": (
            "complaint_id", "date", "customer_id", "store_id", "store_name", "region", "product_id", "product_name", "category",
            "complaint_type", "complaint_description", "severity", "status", "assigned_employee_id", "resolution_time_days",
        ),
        "key": "complaint_id",
        "dates": ("date",),
        "whole": ("resolution_time_days",),
        "labels": ("severity", "status"),
        "required": ("complaint_id", "date", "store_id", "product_id", "severity", "status"),
        "filled": ("complaint_id", "store_id"),
        "references": {"store_id": ("stores", "store_id"), "product_id": ("products", "product_id")},
    },
    "finance": {
        "columns": (
            "finance_id", "month", "store_id", "store_name", "region", "monthly_sales_target", "total_revenue", "total_cost",
            "gross_profit", "operating_expense", "operating_profit", "target_achievement_percent", "risk_status",
        ),
        "key": "finance_id",
        "months": ("month",),
        "decimal": (
            "monthly_sales_target", "total_revenue", "total_cost", "gross_profit", "operating_expense", "operating_profit",
            "target_achievement_percent",
        ),
        "labels": ("region", "risk_status"),
        "required": ("finance_id", "month", "store_id", "total_revenue", "gross_profit", "operating_profit", "risk_status"),
        "filled": ("finance_id", "store_id"),
        "non_negative": ("monthly_sales_target", "total_revenue", "total_cost", "gross_profit", "operating_expense"),
        "references": {"store_id": ("stores", "store_id")},
    },
    "vendor_deliveries": {
        "columns": (
            "purchase_order_id", "order_date", "expected_delivery_date", "actual_delivery_date", "store_id", "store_name", "vendor_id",
            "vendor_name", "product_id", "product_name", "ordered_quantity", "received_quantity", "unit_cost", "purchase_value",
            "delay_days", "delivery_status", "quality_rating", "assigned_employee_id",
        ),
        "key": "purchase_order_id",
        "dates": ("order_date", "expected_delivery_date", "actual_delivery_date"),
        "whole": ("ordered_quantity", "received_quantity", "delay_days"),
        "decimal": ("unit_cost", "purchase_value", "quality_rating"),
        "labels": ("delivery_status",),
        "required": ("purchase_order_id", "store_id", "vendor_id", "product_id", "delay_days", "delivery_status"),
        "filled": ("purchase_order_id", "store_id", "vendor_id", "product_id"),
        "non_negative": ("ordered_quantity", "received_quantity", "unit_cost", "purchase_value", "delay_days", "quality_rating"),
        "references": {"store_id": ("stores", "store_id"), "vendor_id": ("vendors", "vendor_id"), "product_id": ("products", "product_id")},
    },
}
# parents come before their children
LOAD_ORDER = ("vendors", "employees", "stores", "products", "sales", "inventory", "complaints", "finance", "vendor_deliveries")


def names(dataset: str, what: str) -> list[str]:
    return list(DATASETS[dataset].get(what, ()))
