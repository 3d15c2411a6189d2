"""Data-quality checks: every check of a dataset is a count in one aggregate over it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import MISSING_TEXT, MISSING_TEXT_RAW, is_missing, lit
from tillwatch.operators.templates import aggregates, order_by
from tillwatch.sources.config import DATASETS, names


def short_date(x: str) -> str:
    """DD-MM-YY text to a date of this century; impossible days are NULL."""
    return f"CAST(try_to_timestamp(trim({x}), 'd-M-yy') AS DATE)"


def in_century(date: str) -> str:
    """Years 69 to 99 are 1900s."""
    return f"CASE WHEN year({date}) >= 2069 THEN add_months({date}, -1200) ELSE {date} END"


def raw_date(x: str) -> str:
    """DD-MM-YY text to a date."""
    return in_century(short_date(x))


def iso_date(x: str) -> str:
    return rf"CASE WHEN trim({x}) RLIKE '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$' THEN try_cast(trim({x}) AS DATE) END"


def number(x: str) -> str:
    return f"try_cast(trim({x}) AS DOUBLE)"


def expected_stock_status(stock: str, reorder: str) -> str:
    return (f"CASE WHEN {stock} < {reorder} * 0.80D THEN 'Low Stock' WHEN {stock} < {reorder} THEN 'Reorder Soon' "
            f"WHEN {stock} > {reorder} * 3 THEN 'Overstock' ELSE 'Normal' END")


def checks(dataset: str, columns: list[str], processed: bool = False) -> list[tuple[str, str, str, str]]:
    """(rule, column, condition of a violation, text shown as the example) for the columns there are."""
    spellings = MISSING_TEXT if processed else MISSING_TEXT_RAW
    parse = iso_date if processed else raw_date
    have, found = set(columns), []
    for c in names(dataset, "filled"):
        if c in have:
            found.append(("missing value", c, is_missing(c, spellings), c))
    for c in names(dataset, "non_negative"):
        if c in have:
            found.append(("not numeric", c, f"NOT {is_missing(c, spellings)} AND {number(c)} IS NULL", c))
            found.append(("negative value", c, f"NOT {is_missing(c, spellings)} AND {number(c)} < 0", c))
    for c in names(dataset, "dates"):
        if c in have:
            found.append(("invalid date", c, f"NOT {is_missing(c, spellings)} AND {parse(c)} IS NULL", c))
            if processed:
                found.append(("missing date", c, is_missing(c, spellings), c))
    for c in names(dataset, "months"):
        if c in have and processed:
            found.append(("missing month", c, is_missing(c, spellings), c))
            found.append(("invalid month", c, f"NOT {is_missing(c, spellings)} AND NOT trim({c}) RLIKE '^[0-9]{{4}}-(0?[1-9]|1[0-2])$'", c))
    if dataset == "inventory" and {"current_stock", "reorder_level", "stock_status"} <= have:
        stock, reorder = number("current_stock"), number("reorder_level")
        known = f"{stock} IS NOT NULL AND {reorder} IS NOT NULL"
        status = expected_stock_status(stock, reorder)
        found.append(("stock status mismatch", "stock_status", f"{known} AND NOT (trim(stock_status) <=> {status})", "inventory_id"))
        if "reorder_required" in have:
            found.append(("reorder flag mismatch", "reorder_required",
                          f"{known} AND NOT (trim(reorder_required) <=> if({status} = 'Low Stock', 'Yes', 'No'))", "inventory_id"))
    if dataset == "inventory" and "expiry_date" in have and not processed:
        reference = next((c for c in ("date", "inventory_date", "record_date", "stock_date", "last_restock_date") if c in have), None)
        if reference:
            found.append(("invalid date", "expiry_date", f"NOT {is_missing('expiry_date', spellings)} AND {parse('expiry_date')} IS NULL", "expiry_date"))
            found.append(("expiry before record", "expiry_date", f"{parse('expiry_date')} < {parse(reference)}", "inventory_id"))
    if dataset == "finance" and {"total_revenue", "total_cost", "gross_profit", "operating_expense", "operating_profit"} <= have:
        n = {c: number(c) for c in ("total_revenue", "total_cost", "gross_profit", "operating_expense", "operating_profit")}
        found.append(("gross profit mismatch", "gross_profit", f"abs({n['gross_profit']} - ({n['total_revenue']} - {n['total_cost']})) > 1", "finance_id"))
        found.append(("operating profit mismatch", "operating_profit",
                      f"abs({n['operating_profit']} - ({n['gross_profit']} - {n['operating_expense']})) > 1", "finance_id"))
    if dataset == "vendor_deliveries" and {"order_date", "expected_delivery_date", "actual_delivery_date", "delay_days"} <= have:
        ordered, expected, actual = parse("order_date"), parse("expected_delivery_date"), parse("actual_delivery_date")
        found.append(("delivered before order", "actual_delivery_date", f"{actual} < {ordered}", "purchase_order_id"))
        found.append(("delay mismatch", "delay_days", f"datediff({actual}, {expected}) <> {number('delay_days')}", "purchase_order_id"))
    return found


def missing_columns(dataset: str, df: DataFrame) -> list[str]:
    return [c for c in names(dataset, "required") if c not in df.columns]


def column_violations(dataset: str, df: DataFrame, processed: bool = False) -> DataFrame:
    """Violation counts of all checks of one dataset, from a single pass, with one example each."""
    rules = checks(dataset, df.columns, processed)
    totals = {}
    for i, (_, _, condition, shown) in enumerate(rules):
        totals[f"n{i}"] = f"count_if({condition})"
        totals[f"e{i}"] = f"min(CAST({shown} AS STRING)) FILTER (WHERE {condition})"
    rows = ", ".join(
        f"struct({lit(dataset)} AS dataset, {lit(rule)} AS rule, {lit(column)} AS column_name, n{i} AS violations, e{i} AS example)"
        for i, (rule, column, _, _) in enumerate(rules))
    return df.agg(*aggregates(totals)).selectExpr(f"inline(array({rows}))").where("violations > 0")


def duplicate_keys(dataset: str, df: DataFrame) -> DataFrame:
    """Rows beyond the first of each key; missing keys count as equal."""
    key = DATASETS[dataset]["key"]
    groups = df.groupBy(key).agg(*aggregates({"n": "count(*)"}))
    return groups.agg(*aggregates({
        "violations": "coalesce(sum(n - 1), 0)", "example": f"min(CAST({key} AS STRING)) FILTER (WHERE n > 1)"})).selectExpr(
        f"{lit(dataset)} AS dataset", "'duplicate key' AS rule", f"{lit(key)} AS column_name", "violations", "example").where("violations > 0")


def broken_references(dataset: str, tables: dict[str, DataFrame], spellings: tuple[str, ...] = MISSING_TEXT_RAW) -> list[DataFrame]:
    """Distinct child values without a parent, per reference; values are made distinct before the join."""
    found = []
    for column, (parent, parent_key) in DATASETS[dataset].get("references", {}).items():
        child = tables[dataset]
        if column not in child.columns or parent not in tables:
            continue
        values = child.where(f"NOT {is_missing(column, spellings)}").selectExpr(f"{column} AS value").distinct()
        parents = tables[parent].selectExpr(f"{parent_key} AS value")
        found.append(values.join(parents, "value", "left_anti").agg(*aggregates({
            "violations": "count(*)", "example": "min(CAST(value AS STRING))"})).selectExpr(
            f"{lit(dataset)} AS dataset", "'unknown reference' AS rule", f"{lit(column)} AS column_name", "violations", "example").where("violations > 0"))
    return found


def reference_samples(tables: dict[str, DataFrame], dataset: str, column: str, keep: int = 10) -> DataFrame:
    """The first values (in text order) that break one reference."""
    parent, parent_key = DATASETS[dataset]["references"][column]
    values = tables[dataset].where(f"NOT {is_missing(column)}").selectExpr(f"{column} AS value").distinct()
    return order_by(values.join(tables[parent].selectExpr(f"{parent_key} AS value"), "value", "left_anti"), "value").limit(keep)


def _tagged(dataset: str, df: DataFrame, tables: dict[str, DataFrame], spellings: tuple[str, ...]) -> DataFrame | None:
    """Every reference value and every value that is no number, with what it belongs to: one pass over the dataset."""
    marks = []
    for column, (parent, key) in DATASETS[dataset].get("references", {}).items():
        if column in df.columns and parent in tables and key in tables[parent].columns:
            marks.append((column, f"NOT {is_missing(column, spellings)}", "unknown reference", lit(f"{parent}.{key}")))
    for column in names(dataset, "non_negative"):
        if column in df.columns:
            marks.append((column, f"NOT {is_missing(column, spellings)} AND {number(column)} IS NULL", "not numeric", "CAST(NULL AS STRING)"))
    if not marks:
        return None
    listed = ", ".join(
        f"CASE WHEN {condition} THEN struct({lit(dataset)} AS dataset, {lit(rule)} AS rule, {lit(column)} AS column_name, {parent} AS parent, CAST({column} AS STRING) AS value) END"
        for column, condition, rule, parent in marks)
    return df.selectExpr(f"inline(array_compact(array({listed})))").distinct()


def violation_samples(tables: dict[str, DataFrame], references: int = 10, numbers: int = 5, processed: bool = False) -> DataFrame:
    """The first offending values (in text order) of every reference and every number column of all datasets.

    Values are tagged with the key they refer to and made distinct; one anti-join against the tagged keys of all parents settles all
    references at once. The rank per rule and column goes below the shuffle as a group limit."""
    spellings = MISSING_TEXT if processed else MISSING_TEXT_RAW
    parts = [part for name, df in tables.items() if (part := _tagged(name, df, tables, spellings)) is not None]
    keys = sorted({r for name in tables for r in DATASETS[name].get("references", {}).values() if r[0] in tables and r[1] in tables[r[0]].columns})
    values, parents = parts[0], None
    for part in parts[1:]:
        values = values.unionByName(part)
    for table, key in keys:
        own = tables[table].selectExpr(f"{lit(f'{table}.{key}')} AS parent", f"CAST({key} AS STRING) AS value")
        parents = own if parents is None else parents.unionByName(own)
    if parents is not None:
        values = values.join(parents, ["parent", "value"], "left_anti")  # values without a parent stay
    ranked = values.selectExpr(
        "dataset", "rule", "column_name", "row_number() OVER (PARTITION BY dataset, rule, column_name ORDER BY value) AS position", "value")
    return ranked.where(f"position <= {max(references, numbers)}").where(f"position <= CASE rule WHEN 'unknown reference' THEN {references} ELSE {numbers} END")


def skipped_checks(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(dataset, reason) of the checks that can't run: absent datasets, absent columns of references, absent inputs of a rule."""
    found = [(d, "dataset not given") for d in DATASETS if d not in tables]
    needed = {
        "inventory": [("stock status", ("current_stock", "reorder_level", "stock_status")), ("expiry date", ("expiry_date",))],
        "finance": [("finance calculation", ("total_revenue", "total_cost", "gross_profit", "operating_expense", "operating_profit"))],
        "vendor_deliveries": [("delivery dates", ("order_date", "expected_delivery_date", "actual_delivery_date", "delay_days"))],
    }
    for dataset, df in tables.items():
        have = set(df.columns)
        for column, (parent, key) in DATASETS[dataset].get("references", {}).items():
            if parent not in tables:
                continue
            if column not in have:
                found.append((dataset, f"reference column {column} not found"))
            elif key not in tables[parent].columns:
                found.append((parent, f"reference column {key} not found"))
        for check, columns in needed.get(dataset, ()):
            if not set(columns) <= have:
                found.append((dataset, f"{check} check skipped"))
        if dataset == "inventory" and "expiry_date" in have and not {"date", "inventory_date", "record_date", "stock_date", "last_restock_date"} & have:
            found.append((dataset, "expiry date check skipped"))
    return found


def dataset_verdicts(tables: dict[str, DataFrame], processed: bool = False) -> DataFrame:
    """A row per dataset: rows and columns, errors (rules that found something), warnings (checks that could not run), verdict.

    Every finding is tagged with its severity and the findings are folded per dataset; the row count comes out of the same aggregate
    as the column checks."""
    spark = next(iter(tables.values())).sparkSession
    spellings = MISSING_TEXT if processed else MISSING_TEXT_RAW
    known = [(d, "error", 1) for d, df in tables.items() for _ in missing_columns(d, df)] + [(d, "warning", 1) for d, _ in skipped_checks(tables)]
    tagged = spark.createDataFrame(known, "dataset string, tag string, amount bigint")
    for dataset, df in tables.items():
        rules = checks(dataset, df.columns, processed)
        counted = df.agg(*aggregates({"n": "count(*)"} | {f"n{i}": f"count_if({condition})" for i, (_, _, condition, _) in enumerate(rules)}))
        rows = ", ".join([f"struct({lit(dataset)} AS dataset, 'rows' AS tag, n AS amount)", *[
            f"struct({lit(dataset)} AS dataset, 'error' AS tag, CAST(if(n{i} > 0, 1, 0) AS BIGINT) AS amount)" for i in range(len(rules))]])
        tagged = tagged.unionByName(counted.selectExpr(f"inline(array({rows}))"))
        more = broken_references(dataset, tables, spellings)
        if DATASETS[dataset]["key"] in df.columns:
            more.append(duplicate_keys(dataset, df))
        for part in more:
            tagged = tagged.unionByName(part.selectExpr("dataset", "'error' AS tag", "CAST(1 AS BIGINT) AS amount"))
    widths = " ".join(f"WHEN {lit(d)} THEN {len(df.columns)}" for d, df in tables.items())
    total = lambda tag: f"CAST(coalesce(sum(amount) FILTER (WHERE tag = '{tag}'), 0) AS BIGINT)"
    return tagged.groupBy("dataset").agg(*aggregates({"row_count": total("rows"), "error_count": total("error"), "warning_count": total("warning")})).selectExpr(
        "dataset", "row_count", f"CAST(CASE dataset {widths} ELSE 0 END AS BIGINT) AS column_count", "error_count", "warning_count", "error_count = 0 AS is_valid")


def violations(tables: dict[str, DataFrame], processed: bool = False, only: str | None = None) -> DataFrame:
    """All violations of all datasets, or of one; a missing required column is a violation too.

    With `only`, no other table is read but those that the dataset refers to."""
    spark = next(iter(tables.values())).sparkSession
    schema = "dataset string, rule string, column_name string, violations bigint, example string"
    absent = [(d, "missing column", c, 1, c) for d, df in tables.items() if only in (None, d) for c in missing_columns(d, df)]
    parts = [spark.createDataFrame(absent, schema)]
    for dataset, df in tables.items():
        if only not in (None, dataset):
            continue
        parts.append(column_violations(dataset, df, processed))
        if DATASETS[dataset]["key"] in df.columns:
            parts.append(duplicate_keys(dataset, df))
        parts += broken_references(dataset, tables, MISSING_TEXT if processed else MISSING_TEXT_RAW)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def with_overrides(tables: dict[str, DataFrame], overrides: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Replace named datasets for one validation run."""
    unknown = set(overrides) - set(DATASETS)
    if unknown:
        raise ValueError(f"unknown datasets: {sorted(unknown)}")
    return {**tables, **overrides}


def verdict(found: DataFrame) -> DataFrame:
    return found.agg(*aggregates({
        "error_count": "count(*)", "violating_rows": "coalesce(sum(violations), 0)"})).selectExpr(
        "error_count = 0 AS is_valid", "error_count", "CAST(0 AS BIGINT) AS warning_count", "violating_rows")


def shelf_life_checks(products: DataFrame) -> DataFrame:
    """Perishable products need a positive whole shelf life, others the literal NA."""
    life, days = "trim(shelf_life_days)", number("shelf_life_days")
    yes, no, missing = "trim(is_perishable) = 'Yes'", "trim(is_perishable) = 'No'", is_missing("shelf_life_days")
    return _counted(products, {
        "invalid perishable flag": "trim(is_perishable) NOT IN ('Yes', 'No')",
        "missing shelf life": f"{yes} AND {missing}",
        "invalid shelf life": f"{yes} AND NOT {missing} AND {days} IS NULL",
        "fractional shelf life": f"{yes} AND {days} % 1 <> 0",
        "shelf life not positive": f"{yes} AND {days} <= 0",
        "shelf life of non-perishable": f"{no} AND NOT (upper({life}) <=> 'NA')",
    })


def expiry_checks(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Expiry rules by the product's perishable flag; unknown products are counted."""
    flags = products.selectExpr("product_id", "is_perishable AS flag")
    expiry, missing = iso_date("expiry_date"), is_missing("expiry_date")
    return _counted(inventory.join(flags, "product_id", "left"), {
        "unknown product": f"NOT {is_missing('product_id')} AND flag IS NULL",
        "missing expiry": f"flag = 'Yes' AND {missing}",
        "invalid expiry": f"flag = 'Yes' AND NOT {missing} AND {expiry} IS NULL",
        "expiry of non-perishable": "flag = 'No' AND NOT (upper(trim(expiry_date)) <=> 'NA')",
        "expiry before record": f"flag = 'Yes' AND {expiry} < {iso_date('date')}",
    })


def delivery_checks(deliveries: DataFrame) -> DataFrame:
    """Five plausibility counts over typed deliveries."""
    return _counted(deliveries, {
        "expected before order": "expected_delivery_date < order_date",
        "actual before order": "actual_delivery_date < order_date",
        "actual before expected": "actual_delivery_date < expected_delivery_date",
        "received more than ordered": "received_quantity > ordered_quantity",
        "delay mismatch": "delay_days <> datediff(actual_delivery_date, expected_delivery_date)",
    })


def _counted(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    rows = ", ".join(f"struct({lit(rule)} AS rule, n{i} AS violations)" for i, rule in enumerate(rules))
    return df.agg(*aggregates({f"n{i}": f"count_if({c})" for i, c in enumerate(rules.values())})).selectExpr(f"inline(array({rows}))")
