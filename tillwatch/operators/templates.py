"""Reusable plan shapes: month over month, outlier against the average, latest row per key."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, functions as F


def exact(value: float) -> str:
    """A threshold as a decimal literal, so that comparisons at the edge are exact."""
    return f"{Decimal(str(value))}BD"


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """Order by SQL sort expressions such as 'score DESC NULLS LAST'."""
    columns = []
    for item in keys:
        nulls_first = item.endswith(" NULLS FIRST")
        body = item.removesuffix(" NULLS FIRST").removesuffix(" NULLS LAST")
        down = body.endswith(" DESC")
        column = F.expr(body.removesuffix(" DESC").removesuffix(" ASC"))
        if down:
            columns.append(column.desc_nulls_first() if nulls_first else column.desc_nulls_last())
        else:
            columns.append(column.asc_nulls_first() if nulls_first else column.asc_nulls_last())
    return df.orderBy(*columns)


def aggregates(named: dict[str, str]) -> list[Column]:
    return [F.expr(f"{sql} AS {name}") for name, sql in named.items()]


def observed(what: Observation, *names: str) -> tuple[int, ...]:
    """Counts taken during a write; zeros if Spark found the input empty while planning and so ran nothing that could count."""
    try:
        found = what.get
    except Py4JJavaError as problem:
        if "AssertionError" not in str(problem.java_exception):
            raise
        found = {}
    return tuple(found.get(name) or 0 for name in names)


def merge_labels(fact: DataFrame, keys: Sequence[str], labels: Sequence[str],
                 sums: dict[str, str], names: Sequence[str] | None = None) -> DataFrame:
    """Sum-like aggregates per key with the text maximum of each label.

    The label is a grouping key of the first step, so that step stays a hash
    aggregate with map-side combine; max(text) only sees the small result.
    """
    first = fact.groupBy(*[F.expr(k) for k in keys], *labels).agg(*aggregates(sums))
    if not labels:
        return first
    return first.groupBy(*(names or keys)).agg(
        *aggregates({n: f"sum({n})" for n in sums} | {x: f"max({x})" for x in labels})
    )


def monthly_totals(fact: DataFrame, keys: Sequence[str], sums: dict[str, str],
                   labels: Sequence[str] = (), as_of_month: str | None = None) -> DataFrame:
    """One row per key and calendar month; the month is a DATE until it is shown."""
    if as_of_month is not None:
        fact = fact.where(f"date < add_months(DATE '{as_of_month}-01', 1)")
    return merge_labels(fact, [*keys, "trunc(date, 'month') AS month_start"], labels, sums,
                        [*keys, "month_start"])


def latest_month(monthly: DataFrame) -> Column:
    """Scalar subquery for the last month over all keys.

    It refers to every column of the aggregate, so it is planned on the same
    exchange as the main query and the fact is not read a second time.
    """
    rest = [c for c in monthly.columns if c != "month_start"]
    return monthly.selectExpr(f"max(struct(month_start, {', '.join(rest)})).month_start").scalar()


def latest_date_month(fact: DataFrame, as_of_month: str | None = None) -> Column:
    """The same month from the dates of a stored fact: a scan of one column."""
    if as_of_month is not None:
        fact = fact.where(f"date < add_months(DATE '{as_of_month}-01', 1)")
    return fact.selectExpr("trunc(max(date), 'month')").scalar()


def with_previous(monthly: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add the previous month with data (per key) and its values."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY month_start)"
    return monthly.selectExpr(
        "*", "date_format(month_start, 'yyyy-MM') AS month",
        f"date_format(lag(month_start) {over}, 'yyyy-MM') AS previous_month",
        *[f"lag({v}) {over} AS previous_{v}" for v in values],
    )


def month_over_month(monthly: DataFrame, keys: Sequence[str], values: Sequence[str], latest: Column | None = None) -> DataFrame:
    """Rows of the global latest month next to each key's previous month with data."""
    return with_previous(monthly, keys, values).where(F.col("month_start") == (latest_month(monthly) if latest is None else latest))


def decline_percent(current: str, previous: str) -> str:
    c, p = f"CAST({current} AS DOUBLE)", f"CAST({previous} AS DOUBLE)"
    return f"CASE WHEN {previous} > 0 THEN ({p} - {c}) / {p} * 100 ELSE 0D END"


COMPLAINT_COUNTS = {
    "total_complaints": "count(*)",
    "high_severity_complaints": "count_if(severity = 'High')",
    "unresolved_complaints": "count_if(status IN ('Open', 'In Progress'))",
}


def with_averages(summary: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Attach `benchmark` = sums of the measures and the number of entities, as a scalar subquery."""
    rest = [c for c in summary.columns if c not in measures]
    fields = ["count(*) AS entities"] + [f"sum({m}) AS {m}" for m in measures]
    fields += [f"max({c}) AS {c}" for c in rest]
    stats = summary.selectExpr(f"struct({', '.join(fields)})").scalar()
    return summary.withColumn("benchmark", stats)


def average_of(measure: str) -> str:
    return f"try_divide(CAST(benchmark.{measure} AS DOUBLE), CAST(benchmark.entities AS DOUBLE))"


def at_least_average(measure: str, multiplier: float) -> str:
    """measure >= multiplier * average, without rounding the average."""
    return (f"CAST({measure} AS DECIMAL(18,0)) * CAST(benchmark.entities AS DECIMAL(18,0)) "
            f">= CAST(benchmark.{measure} AS DECIMAL(24,0)) * {exact(multiplier)}")


def ratio_to_average(measure: str) -> str:
    average = average_of(measure)
    return f"(CASE WHEN {average} > 0 THEN CAST({measure} AS DOUBLE) / {average} ELSE 0D END)"


def first_per_key(df: DataFrame, key: str, order: str, keep: int = 1) -> DataFrame:
    """First rows per key; the rank filter is pushed below the shuffle as a group limit."""
    ranked = df.selectExpr("*", f"row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rank")
    return ranked.where(f"_rank <= {keep}").drop("_rank")


def latest_finance(finance: DataFrame) -> DataFrame:
    return first_per_key(finance, "store_id", "month DESC NULLS LAST, finance_id")


def first_rows(df: DataFrame, limit: int, order: str, rank: str | None = None) -> DataFrame:
    """Top-N by a total order; the rank is numbered after the limit, on at most N rows."""
    top = order_by(df, *[k.strip() for k in order.split(",")]).limit(limit)
    if rank is None:
        return top
    return top.selectExpr(f"row_number() OVER (ORDER BY {order}) AS {rank}", "*")
