"""Cleaning of all-text datasets into canonical text, and typed loading.

Bad values do not stop the job: a row carries the first problem found in it and
goes to quarantine. `strict=True` restores the stop-on-first-problem behaviour.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession

from tillwatch.functions.text import MISSING_TEXT, fixed, is_missing, lit, round2, text_list
from tillwatch.operators.quality import in_century, iso_date, number, raw_date, short_date
from tillwatch.operators.templates import aggregates, observed
from tillwatch.sources.config import DATASETS, LABELS, names


def read_raw(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV as text, nothing inferred; headers are normalised."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return normalise_headers(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path))


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])


def squeeze(x: str) -> str:
    return rf"regexp_replace(trim({x}), '\\s+', ' ')"


def known(x: str) -> str:
    """The text, or NULL when it spells a missing value; x is already squeezed."""
    return f"CASE WHEN lower({x}) NOT IN ({text_list(MISSING_TEXT)}) THEN {x} END"


def _canonical(column: str, x: str) -> str:
    labels = LABELS.get(column, ())
    listed = " ".join(f"WHEN {lit(v.lower())} THEN {lit(v)}" for v in labels)
    return f"CASE lower({x}) {listed} ELSE {x} END" if listed else x


def _cleaned(dataset: str, columns: list[str]) -> tuple[dict[str, str], list[str]]:
    """Final text and problem expressions over the squeezed columns t_*, in which missing is NULL, and the parsed ones p_*."""
    final, problems = {}, []
    ids = [c for c in columns if c == "id" or c.endswith("_id")]
    whole, decimal = names(dataset, "whole"), names(dataset, "decimal")
    for c in columns:
        t = f"t_{c}"
        if c in ids:
            final[c] = f"upper({t})"
        elif c in names(dataset, "labels"):
            final[c] = _canonical(c, t)
        elif c in names(dataset, "dates"):
            final[c] = f"date_format(p_{c}, 'yyyy-MM-dd')"
            problems.append(f"CASE WHEN {t} IS NULL THEN 'missing {c}' WHEN p_{c} IS NULL THEN 'invalid {c}' END")
        elif c in names(dataset, "months"):
            final[c] = rf"CASE WHEN {t} RLIKE '^\\d{{4}}-(0?[1-9]|1[0-2])$' THEN concat(substring({t}, 1, 5), lpad(substring({t}, 6), 2, '0')) END"
            problems.append(f"CASE WHEN {t} IS NULL THEN 'missing {c}' WHEN NOT {t} RLIKE '^[0-9]{{4}}-(0?[1-9]|1[0-2])$' THEN 'invalid {c}' END")
        elif c in whole or c in decimal:
            n = f"p_{c}"
            problems.append(f"CASE WHEN {t} IS NOT NULL AND {n} IS NULL THEN 'not numeric {c}' END")
            if c in whole:
                problems.append(f"CASE WHEN {n} % 1 <> 0 THEN 'not whole {c}' END")
                final[c] = f"CAST(CAST({n} AS BIGINT) AS STRING)"
            else:
                final[c] = f"CAST(CAST({fixed(n)} AS DECIMAL(20,2)) AS STRING)"
        else:
            final[c] = t
    return final, problems


def _parsed(dataset: str, staged: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers and dates parsed once, as columns p_*: their texts and problems only look at them."""
    numbers = [c for c in columns if c in names(dataset, "whole") + names(dataset, "decimal") + (["shelf_life_days"] if dataset == "products" else [])]
    dates = [c for c in columns if c in names(dataset, "dates") + (["expiry_date"] if dataset == "inventory" else [])]
    first = staged.selectExpr("*", *[f"try_cast(t_{c} AS DOUBLE) AS p_{c}" for c in numbers], *[f"{short_date(f't_{c}')} AS d_{c}" for c in dates])
    return first.selectExpr("*", *[f"{in_century(f'd_{c}')} AS p_{c}" for c in dates]) if dates else first


def clean(dataset: str, raw: DataFrame, products: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Canonical text columns plus `problem` (NULL when the row is usable)."""
    columns = [c for c in raw.columns if c not in names(dataset, "drop")]
    final, problems = _cleaned(dataset, columns)
    staged = raw.selectExpr(*[f"{squeeze(c)} AS t_{c}" for c in columns]).selectExpr(*[f"{known(f't_{c}')} AS t_{c}" for c in columns])
    staged = _parsed(dataset, staged, columns)
    if dataset == "products":
        life = "p_shelf_life_days"
        flag = _canonical("is_perishable", "t_is_perishable")
        filled = f"{flag} = 'Yes' AND t_shelf_life_days IS NOT NULL"
        final["shelf_life_days"] = (f"CASE WHEN {flag} = 'No' THEN 'NA' WHEN {filled} AND {life} > 0 AND {life} % 1 = 0 "
                                    f"THEN CAST(CAST({life} AS BIGINT) AS STRING) END")
        problems += [
            "CASE WHEN t_product_id IS NULL THEN 'missing product_id' END",
            f"CASE WHEN {flag} IS NULL THEN 'missing is_perishable' WHEN {flag} NOT IN ('Yes', 'No') THEN 'invalid is_perishable' END",
            f"CASE WHEN {filled} AND {life} IS NULL THEN 'invalid shelf_life_days' WHEN {filled} AND {life} % 1 <> 0 THEN 'fractional shelf_life_days' "
            f"WHEN {filled} AND {life} <= 0 THEN 'shelf_life_days not positive' END"]
    if dataset == "inventory":
        if products is None:
            raise ValueError("inventory cleaning needs the cleaned products")
        flags = products.selectExpr("product_id AS flag_id", "is_perishable AS flag")
        staged = staged.selectExpr("*", "upper(t_product_id) AS flag_id").join(flags, "flag_id", "left")
        filled = "flag = 'Yes' AND t_expiry_date IS NOT NULL"
        final["expiry_date"] = f"CASE WHEN flag = 'No' THEN 'NA' WHEN {filled} THEN date_format(p_expiry_date, 'yyyy-MM-dd') END"
        problems += ["CASE WHEN flag_id IS NOT NULL AND flag IS NULL THEN 'unknown product_id' END",
                     f"CASE WHEN {filled} AND p_expiry_date IS NULL THEN 'invalid expiry_date' END"]
    problem = f"coalesce({', '.join(problems)}, NULL)" if problems else "CAST(NULL AS STRING)"
    if strict:
        problem = f"CASE WHEN {problem} IS NOT NULL THEN raise_error(concat('{dataset}: ', {problem})) END"
    return staged.selectExpr(*[f"{final[c]} AS {c}" for c in columns], f"{problem} AS problem")


def accepted(cleaned: DataFrame) -> DataFrame:
    """Usable rows without exact duplicates."""
    return cleaned.where("problem IS NULL").drop("problem").dropDuplicates()


def quarantined(cleaned: DataFrame) -> DataFrame:
    return cleaned.where("problem IS NOT NULL")


def statistics(dataset: str, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row of cleaning counts: the raw side in one pass, the result in another."""
    columns = [c for c in raw.columns if c not in names(dataset, "drop")]
    ids = [c for c in columns if c == "id" or c.endswith("_id")]
    labels = [c for c in columns if c in names(dataset, "labels")]
    dates = [c for c in columns if c in names(dataset, "dates")]
    plain = [c for c in columns if c not in ids + labels + dates + names(dataset, "months") + names(dataset, "whole") + names(dataset, "decimal")
             and (dataset, c) not in (("products", "shelf_life_days"), ("inventory", "expiry_date"))]

    def total(parts: list[str]) -> str:
        return " + ".join(f"coalesce(sum(CAST({p} AS BIGINT)), 0)" for p in parts) or "CAST(0 AS BIGINT)"

    # as in the stepwise job, values that become missing are not counted as changed text
    counts = raw.agg(*aggregates({
        "original_rows": "count(*)",
        "text_values_normalized": total([f"coalesce({c} <> {squeeze(c)}, FALSE)" for c in raw.columns]),
        "id_values_standardized": total([f"coalesce(NOT {is_missing(c)} AND {squeeze(c)} <> upper({squeeze(c)}), FALSE)" for c in ids]),
        "categorical_values_standardized": total([f"coalesce({squeeze(c)} <> {_canonical(c, squeeze(c))}, FALSE)" for c in labels]),
        "generic_missing_values_standardized": total([is_missing(c) for c in plain + ids + labels]),
        "date_values_standardized": total([f"{raw_date(squeeze(c))} IS NOT NULL" for c in dates]),
    }))
    kept = cleaned.where("problem IS NULL").drop("problem")
    sizes = kept.groupBy(*kept.columns).agg(*aggregates({"n": "count(*)"})).agg(*aggregates({
        "final_rows": "count(*)", "duplicates_removed": "coalesce(sum(n - 1), 0)"}))
    bad = cleaned.selectExpr("count_if(problem IS NOT NULL)").scalar()
    one = sizes.selectExpr("struct(final_rows, duplicates_removed)").scalar()
    return counts.select("*", bad.alias("quarantined_rows"), one.alias("r")).selectExpr(
        f"'{dataset}' AS dataset", "original_rows", f"CAST({len(raw.columns)} AS INT) AS original_columns", "r.final_rows", "r.duplicates_removed",
        "quarantined_rows", f"CAST({len(raw.columns) - len(columns)} AS INT) AS columns_removed", "text_values_normalized", "id_values_standardized",
        "categorical_values_standardized", "generic_missing_values_standardized", "date_values_standardized")


REPORT = ("input_file string, output_file string, original_rows bigint, original_columns int, final_rows bigint, duplicates_removed bigint, "
          "columns_removed string, text_values_normalized bigint, id_values_standardized bigint, categorical_values_standardized bigint, "
          "generic_missing_values_standardized bigint, date_values_standardized bigint, date_columns_standardized string, month_columns_standardized string, "
          "numeric_columns_standardized string, perishable_missing_shelf_life bigint, non_perishable_shelf_life_set_to_na bigint, "
          "perishable_missing_expiry bigint, non_perishable_expiry_set_to_na bigint, quarantined_rows bigint")


def cleaned_with_report(dataset: str, raw: DataFrame, products: DataFrame | None, write: Callable[[DataFrame], None]) -> tuple:
    """Clean, remove duplicates and write one dataset; gives its row of the report (REPORT).

    The counters ride on the cleaning pass: they are observed on the rows as they come in, as they leave the cleaning and as they
    leave the removal of duplicates, while `write` runs. Nothing is read a second time."""
    columns = [c for c in raw.columns if c not in names(dataset, "drop")]
    ids = [c for c in columns if c == "id" or c.endswith("_id")]
    labels, dates, months = ([c for c in columns if c in names(dataset, what)] for what in ("labels", "dates", "months"))
    numbers = [c for c in columns if c in names(dataset, "whole") + names(dataset, "decimal")]
    special = [("products", "shelf_life_days"), ("inventory", "expiry_date")]
    plain = [c for c in columns if c not in ids + labels + dates + months + numbers and (dataset, c) not in special]

    def total(parts: list[str]) -> str:
        return " + ".join(f"coalesce(sum(CAST({p} AS BIGINT)), 0)" for p in parts) or "sum(CAST(0 AS BIGINT))"

    came, left, stayed = Observation(), Observation(), Observation()
    incoming = raw.observe(came, *aggregates({
        "original_rows": "count(*)",
        "text_values": total([f"coalesce({c} <> {squeeze(c)}, FALSE)" for c in raw.columns]),
        "id_values": total([f"coalesce(NOT {is_missing(c)} AND {squeeze(c)} <> upper({squeeze(c)}), FALSE)" for c in ids]),
        "label_values": total([f"coalesce({squeeze(c)} <> {_canonical(c, squeeze(c))}, FALSE)" for c in labels]),
        "missing_values": total([is_missing(c) for c in plain + ids + labels]),
        "date_values": total([f"{raw_date(squeeze(c))} IS NOT NULL" for c in dates]),
    }))
    perishable = {
        "missing_life": "is_perishable = 'Yes' AND shelf_life_days IS NULL" if dataset == "products" else "FALSE",
        "life_na": "is_perishable = 'No'" if dataset == "products" else "FALSE",
        "missing_expiry": "product_id IS NOT NULL AND expiry_date IS NULL" if dataset == "inventory" else "FALSE",
        "expiry_na": "expiry_date = 'NA'" if dataset == "inventory" else "FALSE",
    }
    outgoing = clean(dataset, incoming, products).observe(left, *aggregates(
        {"usable": "count_if(problem IS NULL)", "bad": "count_if(problem IS NOT NULL)"} | {k: f"count_if(problem IS NULL AND {v})" for k, v in perishable.items()}))
    write(accepted(outgoing).observe(stayed, *aggregates({"final_rows": "count(*)"})))
    original, text, ids_changed, label, missing, date = observed(came, "original_rows", "text_values", "id_values", "label_values", "missing_values", "date_values")
    usable, bad, *flags = observed(left, "usable", "bad", *perishable)
    (final,) = observed(stayed, "final_rows")
    listed = ", ".join
    return (
        f"{dataset}_data.csv", f"{dataset}_clean.csv", original, len(raw.columns), final, usable - final, listed(x for x in raw.columns if x not in columns),
        text, ids_changed, label, missing, date, listed(dates), listed(months), listed(numbers), *flags, bad)


def typed(dataset: str, cleaned: DataFrame) -> DataFrame:
    """Typed columns in load order; missing or unexpected columns raise, bad values go to `problem`."""
    expected = names(dataset, "columns")
    missing = [c for c in expected if c not in cleaned.columns]
    extra = [c for c in cleaned.columns if c not in expected]
    if missing or extra:
        raise ValueError(f"{dataset}: missing columns {missing or 'none'}, unexpected columns {extra or 'none'}")
    dates = names(dataset, "load_dates") or names(dataset, "dates")
    whole = names(dataset, "whole") + (["shelf_life_days"] if dataset == "products" else [])
    exprs, problems = [], []
    for c in expected:
        value = f"CASE WHEN NOT {is_missing(c)} THEN trim({c}) END"
        if c in dates:
            converted = iso_date(value)
        elif c in whole:
            converted = f"CAST(CASE WHEN {number(value)} % 1 = 0 THEN {number(value)} END AS BIGINT)"
        elif c in names(dataset, "decimal"):
            converted = f"CAST({round2(number(value))} AS DECIMAL(14,2))"
        else:
            exprs.append(f"{value} AS {c}")
            continue
        exprs.append(f"{converted} AS {c}")
        problems.append(f"CASE WHEN NOT {is_missing(c)} AND {converted} IS NULL THEN 'bad {c}' END")
    problem = f"coalesce({', '.join(problems)}, NULL)" if problems else "CAST(NULL AS STRING)"
    return cleaned.selectExpr(*exprs, f"{problem} AS problem")


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Insert new keys and replace the other columns of known ones; nothing is deleted."""
    if source.columns == [key]:
        return target.unionByName(source.join(target, key, "left_anti"), allowMissingColumns=True)
    rest = [c for c in target.columns if c not in source.columns]
    fresh = source.join(target.select(key, *rest), key, "left") if rest else source
    return target.join(source.select(key), key, "left_anti").unionByName(fresh.select(*target.columns))
