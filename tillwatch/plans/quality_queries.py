"""Registered queries over raw texts, checks, cleaning, loading and scalar functions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from tillwatch.functions import text
from tillwatch.operators import cleaning, combined, quality
from tillwatch.plans.catalog import query
from tillwatch.plans.detectors import AT, vendor_snapshot_of
from tillwatch.plans.reports import all_tables
from tillwatch.plans.stages import own_folder
from tillwatch.sources import sinks
from tillwatch.sources.business import Business
from tillwatch.sources.config import LOAD_ORDER
from tillwatch.sources.versioned import BucketedTable

DAY = "date_format({0}, 'dd-MM-yy')"


def raw_tables(b: Business) -> dict[str, DataFrame]:
    """The nine datasets as they would arrive: all text, dates as DD-MM-YY, with the dirt the sources have."""
    tables = all_tables(b)
    tables["vendors"] = b.raw("supplier").selectExpr(
        "concat('V', s_suppkey) AS vendor_id", "s_name AS vendor_name", "s_suppkey % 10 AS average_delivery_days", "round(s_acctbal, 2) AS rating")
    tables["vendor_deliveries"] = b.deliveries(
        "purchase_order_id", "order_date", "expected_delivery_date", "recorded_delivery_date", "store_id", "vendor_id", "product_id",
        "ordered_quantity", "received_quantity", "purchase_value", "delay_days", "delivery_status", "quality_rating",
    ).withColumnRenamed("recorded_delivery_date", "actual_delivery_date")
    out = {}
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        out[name] = df.selectExpr(*[
            f"{DAY.format(c)} AS {c}" if kinds[c] == "date" else f"CAST({c} AS STRING) AS {c}" for c in df.columns])
    return out


# every third label in lower case with blanks, some values spelled as missing, some numbers broken
DIRTY_SALES = {
    "sale_id": "concat(' ', lower(sale_id))",
    "date": f"CASE WHEN quantity_sold = 13 THEN '31-02-26' ELSE {DAY.format('date')} END",
    "store_id": "lower(store_id)",
    "region": "CASE WHEN quantity_sold % 3 = 0 THEN concat(lower(region), '  ') ELSE region END",
    "product_name": "replace(product_name, ' ', '  ')",
    "employee_id": "CASE WHEN quantity_sold % 10 = 0 THEN 'N/A' ELSE employee_id END",
    "quantity_sold": "CASE WHEN quantity_sold = 7 THEN '3.5' ELSE CAST(quantity_sold AS STRING) END",
    "unit_price": "CAST(unit_price AS STRING)",
    "total_sales": "CASE WHEN quantity_sold = 9 THEN 'abc' ELSE CAST(total_sales AS STRING) END",
    "payment_status": "CASE WHEN quantity_sold % 2 = 0 THEN upper(payment_status) WHEN quantity_sold % 5 = 0 THEN 'null' ELSE payment_status END",
}


def dirty_sales(b: Business) -> DataFrame:
    return b.sales().selectExpr(*[f"{sql} AS {c}" for c, sql in DIRTY_SALES.items()])


def dirty_products(b: Business) -> DataFrame:
    return b.products().selectExpr(
        "lower(product_id) AS product_id", "product_name", "upper(category) AS category",
        "CASE WHEN reorder_level % 4 = 0 THEN upper(is_perishable) ELSE concat(' ', lower(is_perishable)) END AS is_perishable",
        "CASE WHEN reorder_level = 14 THEN '2.5' WHEN reorder_level = 16 THEN 'none' WHEN reorder_level = 18 THEN '-1' "
        "ELSE CAST(shelf_life_days AS STRING) END AS shelf_life_days",
        "CAST(reorder_level AS STRING) AS reorder_level", "vendor_id")


def dirty_inventory(b: Business) -> DataFrame:
    return b.inventory().selectExpr(
        "inventory_id", f"{DAY.format('date')} AS date", "store_id",
        "CASE WHEN current_stock = 5 THEN 'P-NONE' ELSE lower(product_id) END AS product_id",
        "CAST(current_stock AS STRING) AS current_stock", "CAST(reorder_level AS STRING) AS reorder_level", "lower(stock_status) AS stock_status",
        f"CASE WHEN current_stock = 3 THEN '99-99-99' ELSE {DAY.format('expiry_date')} END AS expiry_date",
        "'x' AS reorder_trigger_level")


@query()
def raw_violations(b: Business):
    return quality.violations(raw_tables(b))


@query()
def validation_verdict(b: Business):
    return quality.verdict(quality.violations(raw_tables(b)))


@query()
def validation_with_override(b: Business):
    """The same checks with the sales of the dirty file in place of the stored ones."""
    tables = quality.with_overrides(raw_tables(b), {"sales": dirty_sales(b)})
    return quality.violations(tables, only="sales")


@query()
def reference_samples(b: Business):
    return quality.reference_samples(raw_tables(b), "sales", "employee_id")


@query()
def violation_samples(b: Business):
    """Samples of all 14 references and all number columns, with the dirty sales in place of the stored ones."""
    return quality.violation_samples(quality.with_overrides(raw_tables(b), {"sales": dirty_sales(b)}))


@query()
def dataset_verdicts(b: Business):
    """The nine verdicts with files that lack columns: sales without product_id, stock without expiry dates, finance without expenses."""
    tables = raw_tables(b)
    return quality.dataset_verdicts(quality.with_overrides(tables, {
        "sales": dirty_sales(b), "inventory": tables["inventory"].drop("expiry_date"), "finance": tables["finance"].drop("operating_expense")}))


def processed_tables(b: Business) -> dict[str, DataFrame]:
    """Four datasets as cleaned files: ISO dates and months, some of them spoiled or missing."""
    tables = all_tables(b)
    spoiled = {
        "stores": {"opening_date": "CASE WHEN store_number % 5 = 0 THEN '01/02/1994' WHEN store_number % 5 = 1 THEN 'null' ELSE CAST(opening_date AS STRING) END"},
        "sales": {"date": "CASE WHEN quantity_sold = 13 THEN '2026-02-31' WHEN quantity_sold = 11 THEN '' ELSE CAST(date AS STRING) END"},
        "finance": {"month": "CASE WHEN month LIKE '%-02' THEN replace(month, '-02', '-13') WHEN month LIKE '%-03' THEN 'N/A' ELSE month END"},
    }
    out = {}
    for name in ("stores", "employees", "sales", "finance"):
        df = b.stores() if name == "stores" else tables[name]
        out[name] = df.selectExpr(*[f"{spoiled.get(name, {}).get(c, f'CAST({c} AS STRING)')} AS {c}" for c in tables[name].columns])
    return out


@query()
def processed_violations(b: Business):
    """The checks of cleaned files: dates and months in ISO form, which must be filled."""
    return quality.violations(processed_tables(b), processed=True)


@query()
def shelf_life_checks(b: Business):
    return quality.shelf_life_checks(b.products().selectExpr("is_perishable", "CAST(shelf_life_days AS STRING) AS shelf_life_days"))


@query()
def expiry_checks(b: Business):
    return quality.expiry_checks(
        b.inventory().selectExpr("product_id", "CAST(date AS STRING) AS date", "CAST(expiry_date AS STRING) AS expiry_date"), b.products())


@query()
def delivery_checks(b: Business):
    return quality.delivery_checks(b.deliveries(
        "order_date", "expected_delivery_date", "recorded_delivery_date", "ordered_quantity", "received_quantity", "delay_days",
    ).withColumnRenamed("recorded_delivery_date", "actual_delivery_date"))


@query()
def cleaned_sales(b: Business):
    return cleaning.clean("sales", dirty_sales(b))


@query()
def cleaned_products(b: Business):
    return cleaning.clean("products", dirty_products(b))


@query()
def cleaned_inventory(b: Business):
    return cleaning.clean("inventory", dirty_inventory(b), cleaning.accepted(cleaning.clean("products", dirty_products(b))))


def dirty_finance(b: Business) -> DataFrame:
    """Months with one digit, unknown ones and missing ones."""
    month = ("CASE WHEN month LIKE '%-0%' AND store_id < 'S012' THEN replace(month, '-0', '-') WHEN month LIKE '%-12' THEN replace(month, '-12', '-13') "
             "WHEN month LIKE '%-11' THEN 'n/a' ELSE concat(' ', month) END")
    rest = [c for c in b.finance().columns if c not in ("month", "risk_status")]
    return b.finance().selectExpr(f"{month} AS month", "upper(risk_status) AS risk_status", *[f"CAST({c} AS STRING) AS {c}" for c in rest])


@query()
def cleaned_finance(b: Business):
    return cleaning.clean("finance", dirty_finance(b))


@query()
def accepted_sales(b: Business):
    """Two copies of the file: exact duplicates are removed."""
    twice = dirty_sales(b).unionByName(dirty_sales(b))
    return cleaning.accepted(cleaning.clean("sales", twice)).groupBy("region", "payment_status").agg(
        F.expr("count(*) AS row_count"), F.expr("CAST(sum(CAST(total_sales AS DECIMAL(18,2))) AS DOUBLE) AS total_sales"))


@query()
def cleaning_statistics(b: Business):
    raw = dirty_sales(b)
    return cleaning.statistics("sales", raw, cleaning.clean("sales", raw))


@query()
def cleaning_report(b: Business):
    """All nine datasets cleaned and written, four of them dirty, with the counters of each."""
    folder, rows = own_folder(b.spark, "cleaned"), []
    raw = raw_tables(b) | {"sales": dirty_sales(b), "products": dirty_products(b), "inventory": dirty_inventory(b), "finance": dirty_finance(b)}
    for name in LOAD_ORDER:  # products come before the stock that looks up their flags
        products = b.spark.read.parquet(f"{folder}/products") if name == "inventory" else None
        rows.append(cleaning.cleaned_with_report(name, raw[name], products, lambda df, name=name: sinks.write_table(df, f"{folder}/{name}")))
    return b.spark.createDataFrame(rows, cleaning.REPORT)


@query()
def typed_finance(b: Business):
    """Finance as text loaded into typed columns."""
    return cleaning.typed("finance", b.finance().selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in b.finance().columns]))


def price_update(b: Business) -> DataFrame:
    return b.products().where("reorder_level % 4 = 0").selectExpr("product_id", "product_name", "CAST(unit_price + 1 AS DECIMAL(12,2)) AS unit_price").unionByName(
        b.stores().selectExpr("concat('NEW-', store_id) AS product_id", "store_name AS product_name", "CAST(1 AS DECIMAL(12,2)) AS unit_price"))


@query()
def product_upsert(b: Business):
    """New prices for every product of even reorder level and one new product per nation."""
    target = b.products().select("product_id", "product_name", "category", "unit_price")
    return cleaning.upsert(target, price_update(b), "product_id")


@query()
def bucketed_upsert(b: Business):
    """The same merge into a table of key buckets, in two batches: the prices, then the new products."""
    table = BucketedTable(b.spark, own_folder(b.spark, "products"), "product_id", buckets=16)
    table.create(b.products().select("product_id", "product_name", "category", "unit_price"))
    table.merge(price_update(b).where("product_id NOT LIKE 'NEW-%'"), 1)
    table.merge(price_update(b).where("product_id LIKE 'NEW-%'"), 2)
    return table.read()


@query()
def refresh_log(b: Business):
    """The log of a full refresh of all nine tables."""
    return sinks.full_refresh(all_tables(b), own_folder(b.spark, "refresh"), "v1", datetime.datetime(2001, 8, 1, 6))


def import_logs(b: Business) -> DataFrame:
    """Import log rows from the event stream."""
    return b.raw("events").selectExpr(
        "event_id AS import_id", "event_type AS dataset_name", "concat('file-', user_id, '.csv') AS source_file_name", "user_id AS total_rows",
        "CASE WHEN value < 10 THEN 0 ELSE user_id END AS successful_rows", "CASE WHEN value < 10 THEN user_id ELSE 0 END AS failed_rows",
        "CASE WHEN value < 5 THEN 'Failed' WHEN value < 10 THEN 'Rejected' ELSE 'Success' END AS import_status", "ts AS imported_at")


@query()
def import_history(b: Business):
    return sinks.import_history(import_logs(b), 50, 5, dataset_name=" CLICK ", import_status="success")


@query()
def import_history_counts(b: Business):
    return sinks.import_counts(import_logs(b), dataset_name="click", import_status=None)


@query()
def latest_imports(b: Business):
    return sinks.latest_imports(import_logs(b))


@query()
def issue_records(b: Business):
    return combined.issue_record(combined.vendor_risk(b.deliveries(
        "vendor_id", "vendor_name", "delay_days", "received_quantity", "ordered_quantity", "quality_rating"), **AT))


@query()
def scalar_functions(b: Business):
    """Identifiers, texts, numbers and dates of every supplier and its deliveries."""
    rows = vendor_snapshot_of(b).selectExpr("*", "concat('FIN-', vendor_id, '-2026-0', delivery_count % 9 + 1, '-x') AS some_id",
                                            "concat('  Delay:  ', delivery_count, ',500 days ') AS note")
    return rows.selectExpr(
        "vendor_id", f"{text.safe_identifier('vendor_name')} AS slug", f"{text.clean_text('note')} AS cleaned",
        f"{text.currency('average_delay_days * 1000000')} AS money", f"{text.percent('on_time_delivery_rate')} AS rate", f"{text.count_text('delivery_count * 1000')} AS grouped_count",
        f"{text.year_month_in_text('some_id')} AS period", f"{text.number_in('note', 'delay:[ ]*([0-9,]+)')} AS parsed",
        f"{text.evidence({'Deliveries': 'delivery_count', 'Nothing': 'CAST(NULL AS STRING)', 'Vendor': 'vendor_name'})} AS evidence",
        f"{text.entity_code(text.lit(''), 'Store', 'S', text.lit('Other'), 'concat(vendor_id, chr(45), chr(83), lpad(delivery_count % 1000, 3, chr(48)))')} AS store_code",
        f"{text.days_between(text.lit('2026-01-01'), 'concat(chr(50), substring(some_id, locate(chr(45), some_id, 5) + 2, 6), chr(45), chr(49), chr(48))')} AS days",
        f"{text.round2('average_delay_days')} AS rounded")
