"""SQL cross-checks of validation, cleaning, loading and scalar functions."""

from __future__ import annotations

from tillwatch.oracle.detectors import DETECTED, LEGACY_VENDOR, VENDOR_SNAPSHOT
from tillwatch.oracle.reports import COUNTED
from tillwatch.oracle.views import f2, g2, r2, with_views

DAY = "strftime({0}, '%d-%m-%y')"
FILLED = {"products": "product_id vendor_id", "stores": "store_id manager_id", "vendors": "vendor_id", "employees": "employee_id",
          "sales": "sale_id store_id product_id", "inventory": "inventory_id date store_id product_id", "complaints": "complaint_id store_id",
          "finance": "finance_id store_id", "vendor_deliveries": "purchase_order_id store_id vendor_id product_id"}
NUMBERS = {"products": "unit_price cost_price reorder_level", "stores": "monthly_sales_target", "vendors": "average_delivery_days rating",
           "sales": "quantity_sold unit_price discount_percent total_sales total_cost", "inventory": "current_stock reorder_level",
           "finance": "monthly_sales_target total_revenue total_cost gross_profit operating_expense",
           "vendor_deliveries": "ordered_quantity received_quantity purchase_value delay_days quality_rating"}
DATES = {"stores": "opening_date", "sales": "date", "inventory": "date", "complaints": "date",
         "vendor_deliveries": "order_date expected_delivery_date actual_delivery_date"}
KEYS = {"products": "product_id", "stores": "store_id", "vendors": "vendor_id", "employees": "employee_id", "sales": "sale_id", "inventory": "inventory_id",
        "complaints": "complaint_id", "finance": "finance_id", "vendor_deliveries": "purchase_order_id"}
LINKS = [("products", "vendor_id", "vendors", "vendor_id"), ("stores", "manager_id", "employees", "employee_id"), ("sales", "store_id", "stores", "store_id"),
         ("sales", "product_id", "products", "product_id"), ("sales", "employee_id", "employees", "employee_id"), ("inventory", "store_id", "stores", "store_id"),
         ("inventory", "product_id", "products", "product_id"), ("inventory", "vendor_id", "vendors", "vendor_id"), ("complaints", "store_id", "stores", "store_id"),
         ("complaints", "product_id", "products", "product_id"), ("finance", "store_id", "stores", "store_id"), ("vendor_deliveries", "store_id", "stores", "store_id"),
         ("vendor_deliveries", "vendor_id", "vendors", "vendor_id"), ("vendor_deliveries", "product_id", "products", "product_id")]


def gone(x: str, spellings: str = "'', 'na', 'n/a', 'none', 'nan'") -> str:
    return f"({x} IS NULL OR lower(trim({x})) IN ({spellings}))"


def num(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS DOUBLE)"


def day(x: str) -> str:
    t = f"trim({x})"
    return (f"TRY_CAST(CASE WHEN regexp_matches({t}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{2}}$') THEN CASE WHEN CAST(split_part({t}, '-', 3) AS INTEGER) >= 69 THEN '19' ELSE '20' END "
            f"|| split_part({t}, '-', 3) || '-' || lpad(split_part({t}, '-', 2), 2, '0') || '-' || lpad(split_part({t}, '-', 1), 2, '0') END AS DATE)")


def rule(dataset: str, name: str, column: str, condition: str, shown: str, table: str | None = None) -> str:
    return (f"SELECT '{dataset}' AS dataset, '{name}' AS rule, '{column}' AS column_name, count(*) FILTER ({condition}) AS violations, "
            f"min({shown}) FILTER ({condition}) AS example FROM {table or 'raw_' + dataset}")


def dataset_rules(ds: str, table: str | None = None, without: tuple[str, ...] = ()) -> list[str]:
    out = [rule(ds, "missing value", c, gone(c), c, table) for c in FILLED[ds].split() if c not in without]
    for c in NUMBERS.get(ds, "").split():
        if c in without:
            continue
        out.append(rule(ds, "not numeric", c, f"NOT {gone(c)} AND {num(c)} IS NULL", c, table))
        out.append(rule(ds, "negative value", c, f"NOT {gone(c)} AND {num(c)} < 0", c, table))
    out += [rule(ds, "invalid date", c, f"NOT {gone(c)} AND {day(c)} IS NULL", c, table) for c in DATES.get(ds, "").split()]
    key = KEYS[ds]
    source = table or f"raw_{ds}"
    out.append(f"SELECT '{ds}', 'duplicate key', '{key}', CAST(sum(n - 1) AS BIGINT), min({key}) FILTER (n > 1) FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key})")
    for child, column, parent, parent_key in LINKS:
        if child == ds and column not in without:
            out.append(f"SELECT '{ds}', 'unknown reference', '{column}', count(DISTINCT {column}), min({column}) FROM {source} "
                       f"WHERE NOT {gone(column)} AND {column} NOT IN (SELECT {parent_key} FROM raw_{parent})")
    return out


EXPECTED = "CASE WHEN {s} < {r} * 0.80::DOUBLE THEN 'Low Stock' WHEN {s} < {r} THEN 'Reorder Soon' WHEN {s} > {r} * 3 THEN 'Overstock' ELSE 'Normal' END".format(s=num("current_stock"), r=num("reorder_level"))
SPECIAL = [
    rule("inventory", "stock status mismatch", "stock_status", f"stock_status <> {EXPECTED}", "inventory_id"),
    rule("inventory", "reorder flag mismatch", "reorder_required", f"reorder_required <> CASE WHEN {EXPECTED} = 'Low Stock' THEN 'Yes' ELSE 'No' END", "inventory_id"),
    rule("inventory", "expiry before record", "expiry_date", f"{day('expiry_date')} < {day('date')}", "inventory_id"),
    rule("finance", "gross profit mismatch", "gross_profit", f"abs({num('gross_profit')} - ({num('total_revenue')} - {num('total_cost')})) > 1", "finance_id"),
    rule("finance", "operating profit mismatch", "operating_profit", f"abs({num('operating_profit')} - ({num('gross_profit')} - {num('operating_expense')})) > 1", "finance_id"),
    rule("vendor_deliveries", "delivered before order", "actual_delivery_date", f"{day('actual_delivery_date')} < {day('order_date')}", "purchase_order_id"),
    rule("vendor_deliveries", "delay mismatch", "delay_days", f"date_diff('day', {day('expected_delivery_date')}, {day('actual_delivery_date')}) <> {num('delay_days')}", "purchase_order_id"),
]
RAW = {f"raw_{n}": (f"SELECT COLUMNS(* EXCLUDE ({', '.join(dates) or 'zzz'}))::VARCHAR{''.join(', ' + DAY.format(c) + ' AS ' + c for c in dates)} FROM {n}" if dates
                    else f"SELECT COLUMNS(*)::VARCHAR FROM {n}")
       for n, dates in {"products": [], "stores": ["opening_date"], "employees": [], "sales": ["date"], "inventory": ["date", "expiry_date"],
                        "complaints": ["date"], "finance": []}.items()}
RAW["raw_vendors"] = "SELECT 'V' || s_suppkey AS vendor_id, s_name AS vendor_name, CAST(s_suppkey % 10 AS VARCHAR) AS average_delivery_days, CAST(round(s_acctbal, 2) AS VARCHAR) AS rating FROM supplier"
RAW["raw_vendor_deliveries"] = (f"SELECT purchase_order_id, {DAY.format('order_date')} AS order_date, {DAY.format('expected_delivery_date')} AS expected_delivery_date, "
                                f"{DAY.format('recorded_delivery_date')} AS actual_delivery_date, store_id, vendor_id, product_id, CAST(ordered_quantity AS VARCHAR) AS ordered_quantity, "
                                "CAST(received_quantity AS VARCHAR) AS received_quantity, CAST(purchase_value AS VARCHAR) AS purchase_value, CAST(delay_days AS VARCHAR) AS delay_days, "
                                "delivery_status, CAST(quality_rating AS VARCHAR) AS quality_rating FROM vendor_deliveries")
DIRTY_SALES = (f"SELECT ' ' || lower(sale_id) AS sale_id, CASE WHEN quantity_sold = 13 THEN '31-02-26' ELSE {DAY.format('date')} END AS date, lower(store_id) AS store_id, "
               "CASE WHEN quantity_sold % 3 = 0 THEN lower(region) || '  ' ELSE region END AS region, replace(product_name, ' ', '  ') AS product_name, "
               "CASE WHEN quantity_sold % 10 = 0 THEN 'N/A' ELSE employee_id END AS employee_id, CASE WHEN quantity_sold = 7 THEN '3.5' ELSE CAST(quantity_sold AS VARCHAR) END AS quantity_sold, "
               "CAST(unit_price AS VARCHAR) AS unit_price, CASE WHEN quantity_sold = 9 THEN 'abc' ELSE CAST(total_sales AS VARCHAR) END AS total_sales, "
               "CASE WHEN quantity_sold % 2 = 0 THEN upper(payment_status) WHEN quantity_sold % 5 = 0 THEN 'null' ELSE payment_status END AS payment_status FROM sales")
NULLS = "'', 'na', 'n/a', 'none', 'null', 'nan'"
SALES_NUMBERS = "CASE WHEN {0} IN ('abc') THEN 1 ELSE 0 END"
CLEAN_SALES = (f"SELECT upper(trim(sale_id)) AS sale_id, strftime({day('date')}, '%Y-%m-%d') AS date, upper(store_id) AS store_id, trim(region) AS region, "
               f"replace(product_name, '  ', ' ') AS product_name, CASE WHEN employee_id = 'N/A' THEN NULL ELSE employee_id END AS employee_id, "
               f"CASE WHEN quantity_sold = '3.5' THEN '3' ELSE quantity_sold END AS quantity_sold, CAST(CAST({f2('unit_price')} AS DECIMAL(20,2)) AS VARCHAR) AS unit_price, "
               f"CAST(TRY_CAST({f2('TRY_CAST(total_sales AS DOUBLE)')} AS DECIMAL(20,2)) AS VARCHAR) AS total_sales, "
               "CASE WHEN payment_status = 'null' THEN NULL ELSE upper(left(payment_status, 1)) || lower(substr(payment_status, 2)) END AS payment_status, "
               f"CASE WHEN {day('date')} IS NULL THEN 'invalid date' WHEN quantity_sold = '3.5' THEN 'not whole quantity_sold' WHEN total_sales = 'abc' THEN 'not numeric total_sales' END AS problem FROM dirty_sales")
DIRTY_PRODUCTS = ("SELECT lower(product_id) AS product_id, product_name, upper(category) AS category, CASE WHEN reorder_level % 4 = 0 THEN upper(is_perishable) ELSE ' ' || lower(is_perishable) END AS is_perishable, "
                  "CASE WHEN reorder_level = 14 THEN '2.5' WHEN reorder_level = 16 THEN 'none' WHEN reorder_level = 18 THEN '-1' ELSE CAST(shelf_life_days AS VARCHAR) END AS shelf_life_days, "
                  "CAST(reorder_level AS VARCHAR) AS reorder_level, vendor_id FROM products")
CLEAN_PRODUCTS = ("SELECT upper(product_id) AS product_id, product_name, category, CASE lower(trim(is_perishable)) WHEN 'yes' THEN 'Yes' ELSE 'No' END AS is_perishable, "
                  "CASE WHEN lower(trim(dp.is_perishable)) = 'no' THEN 'NA' WHEN shelf_life_days IN ('2.5', 'none', '-1') THEN NULL ELSE shelf_life_days END AS shelf_life_days, reorder_level, vendor_id, "
                  "CASE WHEN lower(trim(dp.is_perishable)) = 'yes' AND dp.shelf_life_days = '2.5' THEN 'fractional shelf_life_days' WHEN lower(trim(dp.is_perishable)) = 'yes' AND dp.shelf_life_days = '-1' THEN 'shelf_life_days not positive' END AS problem FROM dirty_products dp")
DIRTY_INVENTORY = (f"SELECT inventory_id, {DAY.format('date')} AS date, store_id, CASE WHEN current_stock = 5 THEN 'P-NONE' ELSE lower(product_id) END AS product_id, CAST(current_stock AS VARCHAR) AS current_stock, "
                   f"CAST(reorder_level AS VARCHAR) AS reorder_level, lower(stock_status) AS stock_status, CASE WHEN current_stock = 3 THEN '99-99-99' ELSE {DAY.format('expiry_date')} END AS expiry_date FROM inventory")
CLEAN_INVENTORY = (f"SELECT inventory_id, strftime({day('d.date')}, '%Y-%m-%d') AS date, store_id, upper(d.product_id) AS product_id, current_stock, d.reorder_level, "
                   "CASE stock_status WHEN 'low stock' THEN 'Low Stock' WHEN 'reorder soon' THEN 'Reorder Soon' WHEN 'overstock' THEN 'Overstock' ELSE 'Normal' END AS stock_status, "
                   f"CASE WHEN p.is_perishable = 'No' THEN 'NA' WHEN p.is_perishable = 'Yes' THEN strftime({day('expiry_date')}, '%Y-%m-%d') END AS expiry_date, "
                   f"CASE WHEN p.product_id IS NULL THEN 'unknown product_id' WHEN p.is_perishable = 'Yes' AND expiry_date IS NOT NULL AND {day('d.expiry_date')} IS NULL THEN 'invalid expiry_date' END AS problem "
                   "FROM dirty_inventory d LEFT JOIN (SELECT * FROM clean_products WHERE problem IS NULL) p ON upper(d.product_id) = p.product_id")
VIOLATIONS = "SELECT * FROM (" + " UNION ALL ".join([r for ds in KEYS for r in dataset_rules(ds)] + SPECIAL) + ") WHERE violations > 0"
OVERRIDE = "SELECT * FROM (" + " UNION ALL ".join(dataset_rules("sales", "dirty_sales", ("product_id", "discount_percent", "total_cost")) + ["SELECT 'sales', 'missing column', 'product_id', 1, 'product_id'"]) + ") WHERE violations > 0"
ALL = list(COUNTED)
IMPORTS = ("SELECT event_id AS import_id, event_type AS dataset_name, 'file-' || user_id || '.csv' AS source_file_name, user_id AS total_rows, CASE WHEN value < 10 THEN 0 ELSE user_id END AS successful_rows, "
           "CASE WHEN value < 10 THEN user_id ELSE 0 END AS failed_rows, CASE WHEN value < 5 THEN 'Failed' WHEN value < 10 THEN 'Rejected' ELSE 'Success' END AS import_status, ts AS imported_at FROM events")


def counted(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS violations FROM {source}" for n, c in rules.items())


# ---- samples and verdicts of all datasets, with three files that lack columns -------------------
GIVEN = {"sales": ("dirty_sales", ("product_id", "discount_percent", "total_cost")), "inventory": (None, ("expiry_date",)), "finance": (None, ("operating_expense",))}


def sample_parts(ds: str, table: str, without: tuple[str, ...]) -> list[str]:
    out = [f"SELECT DISTINCT '{ds}' AS dataset, 'unknown reference' AS rule, '{column}' AS column_name, {column} AS value FROM {table} "
           f"WHERE NOT {gone(column)} AND {column} NOT IN (SELECT {parent_key} FROM raw_{parent})"
           for child, column, parent, parent_key in LINKS if child == ds and column not in without]
    return out + [f"SELECT DISTINCT '{ds}', 'not numeric', '{c}', {c} FROM {table} WHERE NOT {gone(c)} AND {num(c)} IS NULL"
                  for c in NUMBERS.get(ds, "").split() if c not in without]


SAMPLES = ("SELECT dataset, rule, column_name, CAST(row_number() OVER (PARTITION BY dataset, rule, column_name ORDER BY value) AS INTEGER) AS position, value FROM ("
           + " UNION ALL ".join(p for ds in KEYS for p in sample_parts(ds, "dirty_sales" if ds == "sales" else f"raw_{ds}", GIVEN["sales"][1] if ds == "sales" else ()))
           + ") QUALIFY position <= CASE rule WHEN 'unknown reference' THEN 10 ELSE 5 END")
WIDTH = {"vendors": 4, "employees": 6, "stores": 7, "products": 10, "sales": 10, "inventory": 12, "complaints": 15, "finance": 12, "vendor_deliveries": 13}
VERDICT_RULES = ([r for ds in KEYS for r in dataset_rules(ds, *GIVEN.get(ds, (None, ())))] + SPECIAL[:2] + SPECIAL[5:]
                 + ["SELECT 'sales', 'missing column', 'product_id', 1, 'product_id'"])
VERDICTS = ("SELECT d.dataset, row_count, column_count, coalesce(errors, 0) AS error_count, CASE WHEN d.dataset IN ('sales', 'inventory', 'finance') THEN 1::BIGINT ELSE 0 END AS warning_count, "
            "coalesce(errors, 0) = 0 AS is_valid FROM (" + " UNION ALL ".join(
                f"SELECT '{ds}' AS dataset, count(*) AS row_count, {n}::BIGINT AS column_count FROM raw_{ds}" for ds, n in WIDTH.items())
            + f") d LEFT JOIN (SELECT dataset, count(*) AS errors FROM ({' UNION ALL '.join(VERDICT_RULES)}) WHERE violations > 0 GROUP BY dataset) e USING (dataset)")

# ---- cleaned files: ISO dates and months ----------------------------------------------------------
SPELLED = "'', 'na', 'n/a', 'none', 'null', 'nan'"


def iso(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN TRY_CAST(trim({x}) AS DATE) END"


def processed_rules(ds: str, months: str = "") -> list[str]:
    table, none = f"iso_{ds}", lambda c: gone(c, SPELLED)
    out = [rule(ds, "missing value", c, none(c), c, table) for c in FILLED[ds].split()]
    for c in NUMBERS.get(ds, "").split():
        out += [rule(ds, "not numeric", c, f"NOT {none(c)} AND {num(c)} IS NULL", c, table), rule(ds, "negative value", c, f"NOT {none(c)} AND {num(c)} < 0", c, table)]
    for c in DATES.get(ds, "").split():
        out += [rule(ds, "invalid date", c, f"NOT {none(c)} AND {iso(c)} IS NULL", c, table), rule(ds, "missing date", c, none(c), c, table)]
    for c in months.split():
        out += [rule(ds, "missing month", c, none(c), c, table), rule(ds, "invalid month", c, f"NOT {none(c)} AND NOT regexp_matches(trim({c}), '^[0-9]{{4}}-(0?[1-9]|1[0-2])$')", c, table)]
    out.append(f"SELECT '{ds}', 'duplicate key', '{KEYS[ds]}', CAST(sum(n - 1) AS BIGINT), min({KEYS[ds]}) FILTER (n > 1) FROM (SELECT {KEYS[ds]}, count(*) AS n FROM {table} GROUP BY ALL)")
    out += [f"SELECT '{ds}', 'unknown reference', '{column}', count(DISTINCT {column}), min({column}) FROM {table} WHERE NOT {none(column)} AND {column} NOT IN (SELECT {key} FROM iso_{parent})"
            for child, column, parent, key in LINKS if child == ds and parent in ("stores", "employees")]
    return out


ISO = {
    "iso_employees": "SELECT COLUMNS(*)::VARCHAR FROM employees",
    "iso_stores": "SELECT COLUMNS(* EXCLUDE (opening_date))::VARCHAR, CASE WHEN store_number % 5 = 0 THEN '01/02/1994' WHEN store_number % 5 = 1 THEN 'null' ELSE CAST(opening_date AS VARCHAR) END AS opening_date FROM stores",
    "iso_sales": "SELECT COLUMNS(* EXCLUDE (date))::VARCHAR, CASE WHEN quantity_sold = 13 THEN '2026-02-31' WHEN quantity_sold = 11 THEN '' ELSE CAST(date AS VARCHAR) END AS date FROM sales",
    "iso_finance": "SELECT COLUMNS(* EXCLUDE (month))::VARCHAR, CASE WHEN month LIKE '%-02' THEN replace(month, '-02', '-13') WHEN month LIKE '%-03' THEN 'N/A' ELSE month END AS month FROM finance",
}
PROCESSED = ("SELECT * FROM (" + " UNION ALL ".join([
    *processed_rules("stores"), *processed_rules("employees"), *processed_rules("sales"), *processed_rules("finance", "month"),
    *[r.replace("raw_finance", "iso_finance") for r in SPECIAL[3:5]]]) + ") WHERE violations > 0")
MONEY = ("monthly_sales_target", "total_revenue", "total_cost", "gross_profit", "operating_expense", "operating_profit", "target_achievement_percent")
CLEAN_FINANCE = ("SELECT finance_id, store_id, store_name, region, risk_status, " + ", ".join(f"CAST(CAST({c} AS DECIMAL(20,2)) AS VARCHAR) AS {c}" for c in MONEY)
                 + ", CASE WHEN (month NOT LIKE '%-11' AND month NOT LIKE '%-12') OR (month LIKE '%-0%' AND store_id < 'S012') THEN month END AS month, "
                 "CASE WHEN month LIKE '%-12' THEN 'invalid month' WHEN month LIKE '%-11' THEN 'missing month' END AS problem FROM finance")
def report(ds: str, given: str, columns: int, final: str, usable: str, bad: str, counters: dict[str, str], lists: tuple[str, str, str], removed: str = "") -> str:
    zero = {"text": "0", "ids": "0", "labels": "0", "missing": "0", "dates": "0", "life": "0", "life_na": "0", "expiry": "0", "expiry_na": "0"} | counters
    n = {k: f"CAST(({v}) AS BIGINT)" for k, v in zero.items()}
    return (f"SELECT '{ds}_data.csv' AS input_file, '{ds}_clean.csv' AS output_file, (SELECT count(*) FROM {given}) AS original_rows, {columns}::INTEGER AS original_columns, "
            f"CAST(({final}) AS BIGINT) AS final_rows, CAST(({usable}) - ({final}) AS BIGINT) AS duplicates_removed, '{removed}' AS columns_removed, {n['text']} AS text_values_normalized, "
            f"{n['ids']} AS id_values_standardized, {n['labels']} AS categorical_values_standardized, {n['missing']} AS generic_missing_values_standardized, {n['dates']} AS date_values_standardized, "
            f"'{lists[0]}' AS date_columns_standardized, '{lists[1]}' AS month_columns_standardized, '{lists[2]}' AS numeric_columns_standardized, {n['life']} AS perishable_missing_shelf_life, "
            f"{n['life_na']} AS non_perishable_shelf_life_set_to_na, {n['expiry']} AS perishable_missing_expiry, {n['expiry_na']} AS non_perishable_expiry_set_to_na, CAST(({bad}) AS BIGINT) AS quarantined_rows")


def plain_report(ds: str, columns: int, dates: str, numbers: str, date_columns: int) -> str:
    """A dataset that is clean already: nothing changes but its dates."""
    rows = f"SELECT count(*) FROM raw_{ds}"
    return report(ds, f"raw_{ds}", columns, rows, rows, "0", {"dates": f"SELECT {date_columns} * count(*) FROM raw_{ds}"}, (dates, "", numbers))


def dirty_report(ds: str, columns: int, counters: dict[str, str], lists: tuple[str, str, str], removed: str = "") -> str:
    return report(ds, f"dirty_{ds}", columns, f"SELECT count(*) FROM (SELECT DISTINCT * FROM clean_{ds} WHERE problem IS NULL)",
                  f"SELECT count(*) FROM clean_{ds} WHERE problem IS NULL", f"SELECT count(*) FROM clean_{ds} WHERE problem IS NOT NULL", counters, lists, removed)


CLEANING_REPORT = " UNION ALL ".join([
    plain_report("vendors", 4, "", "average_delivery_days, rating", 0), plain_report("employees", 6, "", "monthly_target", 0),
    plain_report("stores", 7, "opening_date", "monthly_sales_target", 1), plain_report("complaints", 15, "date", "resolution_time_days", 1),
    plain_report("vendor_deliveries", 13, "order_date, expected_delivery_date, actual_delivery_date", "ordered_quantity, received_quantity, purchase_value, delay_days, quality_rating", 3),
    dirty_report("sales", 10, {
        "text": "SELECT sum((product_name LIKE '%  %')::INT + (region LIKE '%  ')::INT + 1) FROM dirty_sales", "ids": "SELECT 2 * count(*) FROM dirty_sales",
        "labels": "SELECT sum(CASE WHEN lower(trim(payment_status)) IN ('paid', 'pending', 'delayed') AND payment_status <> upper(left(payment_status, 1)) || lower(substr(payment_status, 2)) THEN 1 ELSE 0 END) FROM dirty_sales",
        "missing": "SELECT count(*) FILTER (employee_id = 'N/A') + count(*) FILTER (payment_status = 'null') FROM dirty_sales",
        "dates": "SELECT count(*) FROM dirty_sales WHERE date <> '31-02-26'"}, ("date", "", "quantity_sold, unit_price, total_sales")),
    dirty_report("products", 7, {
        "text": "SELECT count(*) FROM dirty_products WHERE is_perishable LIKE ' %'", "ids": "SELECT count(*) FROM dirty_products", "labels": "SELECT count(*) FROM dirty_products",
        "life": "SELECT count(*) FROM clean_products WHERE problem IS NULL AND is_perishable = 'Yes' AND shelf_life_days IS NULL",
        "life_na": "SELECT count(*) FROM clean_products WHERE problem IS NULL AND is_perishable = 'No'"}, ("", "", "reorder_level")),
    dirty_report("inventory", 9, {
        "ids": "SELECT count(*) FROM dirty_inventory WHERE current_stock <> '5'", "labels": "SELECT count(*) FROM dirty_inventory", "dates": "SELECT count(*) FROM dirty_inventory",
        "expiry": "SELECT count(*) FROM clean_inventory WHERE problem IS NULL AND expiry_date IS NULL", "expiry_na": "SELECT count(*) FROM clean_inventory WHERE problem IS NULL AND expiry_date = 'NA'"},
        ("date", "", "current_stock, reorder_level"), "reorder_trigger_level"),
    dirty_report("finance", 13, {
        "text": "SELECT count(*) FROM dirty_finance WHERE month NOT LIKE '%-11' AND month NOT LIKE '%-12' AND NOT (month LIKE '%-0%' AND store_id < 'S012')",
        "labels": "SELECT count(*) FROM dirty_finance"}, ("", "month", ", ".join(MONEY))),
])
REPORT_CTE = {**RAW, "dirty_sales": DIRTY_SALES, "clean_sales": CLEAN_SALES, "dirty_products": DIRTY_PRODUCTS, "clean_products": CLEAN_PRODUCTS,
              "dirty_inventory": DIRTY_INVENTORY, "clean_inventory": CLEAN_INVENTORY, "dirty_finance": "SELECT * FROM finance", "clean_finance": CLEAN_FINANCE}
PRODUCT_UPSERT = "SELECT product_id, product_name, category, CASE WHEN reorder_level % 4 = 0 THEN CAST(unit_price + 1 AS DECIMAL(12,2)) ELSE unit_price END AS unit_price FROM products UNION ALL SELECT 'NEW-' || store_id, store_name, NULL, CAST(1 AS DECIMAL(12,2)) FROM stores"
REFRESH_LOG = " UNION ALL ".join(
    f"SELECT 'v1' AS run_id, '{t}' AS dataset_name, '{t}.parquet' AS source_file_name, count(*) AS total_rows, count(*) AS successful_rows, 0::BIGINT AS failed_rows, 'Success' AS import_status, "
    f"NULL::VARCHAR AS error_message, TIMESTAMP '2001-08-01 06:00:00' AS imported_at, 0::BIGINT AS duplicate_rows FROM {t}" for t in KEYS)
SALES_CTE = {"dirty_sales": DIRTY_SALES, "clean_sales": CLEAN_SALES}
LABEL_CHANGES = "(CASE WHEN lower(trim(payment_status)) IN ('paid', 'pending', 'delayed') AND payment_status <> upper(left(payment_status, 1)) || lower(substr(payment_status, 2)) THEN 1 ELSE 0 END)"
SNAP = f"SELECT *, 'FIN-' || vendor_id || '-2026-0' || (delivery_count % 9 + 1) || '-x' AS some_id FROM ({VENDOR_SNAPSHOT})"

ORACLE: dict[str, str] = {
    "raw_violations": with_views(ALL, VIOLATIONS, RAW),
    "validation_verdict": with_views(ALL, f"SELECT count(*) = 0 AS is_valid, count(*) AS error_count, CAST(0 AS BIGINT) AS warning_count, CAST(sum(violations) AS BIGINT) AS violating_rows FROM ({VIOLATIONS})", RAW),
    "validation_with_override": with_views(ALL, OVERRIDE, {**RAW, "dirty_sales": DIRTY_SALES}),
    "reference_samples": with_views(["sales", "employees"], "SELECT DISTINCT employee_id AS value FROM sales WHERE employee_id NOT IN (SELECT employee_id FROM employees) ORDER BY 1 LIMIT 10"),
    "cleaning_report": with_views(ALL, CLEANING_REPORT, REPORT_CTE),
    "bucketed_upsert": with_views(["products", "stores"], PRODUCT_UPSERT),
    "refresh_log": with_views(ALL, REFRESH_LOG),
    "violation_samples": with_views(ALL, SAMPLES, {**RAW, "dirty_sales": DIRTY_SALES}),
    "dataset_verdicts": with_views(ALL, VERDICTS, {**RAW, "dirty_sales": DIRTY_SALES}),
    "processed_violations": with_views(["stores", "employees", "sales", "finance"], PROCESSED, ISO),
    "cleaned_finance": with_views(["finance"], CLEAN_FINANCE),
    "shelf_life_checks": with_views(["products"], counted({
        "invalid perishable flag": "is_perishable NOT IN ('Yes', 'No')", "missing shelf life": "is_perishable = 'Yes' AND shelf_life_days IS NULL", "invalid shelf life": "FALSE", "fractional shelf life": "FALSE",
        "shelf life not positive": "is_perishable = 'Yes' AND shelf_life_days <= 0", "shelf life of non-perishable": "is_perishable = 'No'"}, "products")),
    "expiry_checks": with_views(["inventory", "products"], counted({
        "unknown product": "is_perishable IS NULL", "missing expiry": "is_perishable = 'Yes' AND expiry_date IS NULL", "invalid expiry": "FALSE", "expiry of non-perishable": "is_perishable = 'No'",
        "expiry before record": "is_perishable = 'Yes' AND expiry_date < date"}, "(SELECT i.*, is_perishable FROM inventory i LEFT JOIN products USING (product_id))")),
    "delivery_checks": with_views(["vendor_deliveries"], counted({
        "expected before order": "expected_delivery_date < order_date", "actual before order": "recorded_delivery_date < order_date", "actual before expected": "recorded_delivery_date < expected_delivery_date",
        "received more than ordered": "received_quantity > ordered_quantity", "delay mismatch": "delay_days <> date_diff('day', expected_delivery_date, recorded_delivery_date)"}, "vendor_deliveries")),
    "cleaned_sales": with_views(["sales"], "SELECT * FROM clean_sales", SALES_CTE),
    "cleaned_products": with_views(["products"], CLEAN_PRODUCTS, {"dirty_products": DIRTY_PRODUCTS}),
    "cleaned_inventory": with_views(["products", "inventory"], CLEAN_INVENTORY, {"dirty_products": DIRTY_PRODUCTS, "clean_products": CLEAN_PRODUCTS, "dirty_inventory": DIRTY_INVENTORY}),
    "accepted_sales": with_views(["sales"], "SELECT region, payment_status, count(*) AS row_count, CAST(sum(CAST(total_sales AS DECIMAL(18,2))) AS DOUBLE) AS total_sales FROM (SELECT DISTINCT * FROM clean_sales WHERE problem IS NULL) GROUP BY region, payment_status", SALES_CTE),
    "cleaning_statistics": with_views(["sales"], "SELECT 'sales' AS dataset, (SELECT count(*) FROM dirty_sales) AS original_rows, CAST(10 AS INTEGER) AS original_columns, (SELECT count(*) FROM (SELECT DISTINCT * FROM clean_sales WHERE problem IS NULL)) AS final_rows, (SELECT count(*) FROM clean_sales WHERE problem IS NULL) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean_sales WHERE problem IS NULL)) AS duplicates_removed, (SELECT count(*) FROM clean_sales WHERE problem IS NOT NULL) AS quarantined_rows, CAST(0 AS INTEGER) AS columns_removed, "
        "(SELECT CAST(sum((product_name LIKE '%  %')::INT + (region LIKE '%  ')::INT + 1) AS BIGINT) FROM dirty_sales) AS text_values_normalized, (SELECT 2 * count(*) FROM dirty_sales) AS id_values_standardized, "
        f"(SELECT CAST(sum({LABEL_CHANGES}) AS BIGINT) FROM dirty_sales) AS categorical_values_standardized, (SELECT count(*) FILTER (employee_id = 'N/A') + count(*) FILTER (payment_status = 'null') FROM dirty_sales) AS generic_missing_values_standardized, "
        "(SELECT count(*) FROM dirty_sales WHERE date <> '31-02-26') AS date_values_standardized", SALES_CTE),
    "typed_finance": with_views(["finance"], "SELECT finance_id, month, store_id, store_name, region, monthly_sales_target, total_revenue, total_cost, gross_profit, operating_expense, operating_profit, target_achievement_percent, risk_status, CAST(NULL AS VARCHAR) AS problem FROM finance"),
    "product_upsert": with_views(["products", "stores"], "SELECT product_id, product_name, category, CASE WHEN reorder_level % 4 = 0 THEN CAST(unit_price + 1 AS DECIMAL(12,2)) ELSE unit_price END AS unit_price FROM products UNION ALL SELECT 'NEW-' || store_id, store_name, NULL, CAST(1 AS DECIMAL(12,2)) FROM stores"),
    "import_history": f"SELECT * FROM ({IMPORTS}) WHERE dataset_name = 'click' AND import_status = 'Success' ORDER BY imported_at DESC, import_id DESC LIMIT 50 OFFSET 5",
    "import_history_counts": f"SELECT count(*) AS total_records, count(*) FILTER (dataset_name = 'click') AS matching_records FROM ({IMPORTS})",
    "latest_imports": f"SELECT dataset_name, imported_at, import_id, source_file_name, total_rows, successful_rows, failed_rows, import_status FROM ({IMPORTS}) QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY imported_at DESC, import_id DESC) = 1",
    "issue_records": with_views(["vendor_deliveries"], "SELECT issue_id, issue_type, business_area AS department, issue_title AS title, issue_description AS description, priority, priority_score, "
        + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}_score" for c in ("impact", "urgency", "financial_risk", "customer_impact", "operational_risk", "confidence"))
        + f", CAST(NULL AS VARCHAR) AS affected_store_id, CAST(NULL AS VARCHAR) AS affected_product_id, entity_type, entity_id, evidence, status, detection_source, '{DETECTED[:10]}' AS detected_date, detected_at FROM ({LEGACY_VENDOR})"),
    "scalar_functions": with_views(["vendor_deliveries"], f"SELECT vendor_id, trim(regexp_replace(upper(vendor_name), '[^A-Z0-9]+', '-', 'g'), '-') AS slug, 'Delay: ' || delivery_count || ',500 days' AS cleaned, "
        f"'₹' || {g2('average_delay_days * 1000000')} AS money, {f2('on_time_delivery_rate')} || '%' AS rate, format('{{:,}}', delivery_count * 1000) AS grouped_count, '2026-0' || (delivery_count % 9 + 1) AS period, "
        "CAST(delivery_count || '500' AS DOUBLE) AS parsed, 'Deliveries: ' || delivery_count || '; Vendor: ' || vendor_name AS evidence, "
        "CASE WHEN TRUE THEN 'S' || lpad(CAST(delivery_count % 1000 AS VARCHAR), 3, '0') END AS store_code, "
        f"CAST(date_diff('day', DATE '2026-01-01', CAST('2026-0' || (delivery_count % 9 + 1) || '-10' AS DATE)) AS INTEGER) AS days, {r2('average_delay_days')} AS rounded FROM ({SNAP})"),
}
