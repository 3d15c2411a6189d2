"""Business tables (stores, sales, complaints, ...) as views over the driver's star schema.

Each builder joins only the dimensions that the requested columns need, so a
detector that looks at stores never touches `part`. Small sides are left to the
optimizer, which broadcasts by measured size only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed value: the stock-count day of the sample data
SNAPSHOT_DATE = "2001-07-31"

COMPLAINT_TYPES = {
    "1-URGENT": "Out of Stock",
    "2-HIGH": "Damaged Product",
    "3-MEDIUM": "Late Delivery",
    "4-NOT SPECIFIED": "Billing Error",
    "5-LOW": "Poor Service",
}
UNRESOLVED = ("Open", "In Progress")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def code(letter: str, number: str) -> str:
    """Three-digit code of one of the few stores or employees."""
    return f"concat('{letter}', lpad(CAST({number} AS STRING), 3, '0'))"


def key(letter: str, number: str) -> str:
    return f"concat('{letter}', CAST({number} AS STRING))"


def choose(subject: str, labels: dict[str, str]) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


STOCK_STATUS = (
    "CASE WHEN current_stock * 10 < reorder_level * 8 THEN 'Low Stock' "
    "WHEN current_stock < reorder_level THEN 'Reorder Soon' "
    "WHEN current_stock > reorder_level * 3 THEN 'Overstock' ELSE 'Normal' END"
)
QUANTITY = "CAST(l_quantity AS INT)"
AMOUNT = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
COST = "CAST(l_extendedprice * 0.8D AS DECIMAL(18,4))"
LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

# one expression per column of the fact tables, over the joined order lines
LINE_COLUMNS = {
    "date": "CAST(o_orderdate AS DATE)",
    "store_id": "store_id",
    "store_name": "store_name",
    "region": "region",
    "product_id": key("P", "l_partkey"),
    "product_name": "product_name",
    "category": "category",
    "employee_id": code("E", "o_custkey % 27"),
    "sale_id": "concat('SALE-', concat_ws('-', l_orderkey, l_linenumber))",
    "quantity_sold": QUANTITY,
    "unit_price": "unit_price",
    "discount_percent": "CAST(l_discount * 100 AS DECIMAL(6,2))",
    "total_sales": AMOUNT,
    "total_cost": COST,
    "profit": f"CAST({AMOUNT} - {COST} AS DECIMAL(18,4))",
    "payment_status": "CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' ELSE 'Delayed' END",
    "complaint_id": f"concat('COMP-', {LINE})",
    "customer_id": key("C", "o_custkey"),
    "complaint_type": choose("o_orderpriority", COMPLAINT_TYPES),
    "complaint_description": f"concat('Reported as ', {choose('o_orderpriority', COMPLAINT_TYPES)})",
    "severity": f"CASE WHEN {QUANTITY} >= 40 THEN 'High' WHEN {QUANTITY} >= 20 THEN 'Medium' ELSE 'Low' END",
    "status": "CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'In Progress' "
              "WHEN l_linestatus = 'O' THEN 'Open' WHEN l_linenumber % 2 = 0 THEN 'Closed' ELSE 'Resolved' END",
    "assigned_employee_id": code("E", "o_custkey % 27"),
    "resolution_time_days": f"CASE WHEN l_linestatus <> 'O' THEN l_linenumber * 2 + {QUANTITY} % 7 END",
}
DELAY = ("CAST(greatest(pmod(datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)), 20) "
         "- CASE l_suppkey % 10 WHEN 4 THEN 4 WHEN 9 THEN 8 ELSE 16 END, 0) AS INT)")
RECEIVED = (f"CASE WHEN (l_orderkey + l_partkey) % 10 = 0 THEN CAST({QUANTITY} * 9 DIV 10 AS INT) "
            f"ELSE {QUANTITY} END")
DELIVERY_COLUMNS = {
    "purchase_order_id": f"concat('PO-', {LINE})",
    "order_date": "CAST(o_orderdate AS DATE)",
    "expected_delivery_date": "date_add(CAST(o_orderdate AS DATE), 10)",
    "actual_delivery_date": f"date_add(CAST(o_orderdate AS DATE), {DELAY} + 10)",
    "store_id": "store_id",
    "store_name": "store_name",
    "vendor_id": key("V", "l_suppkey"),
    "vendor_name": "s_name",
    "product_id": key("P", "l_partkey"),
    "product_name": "product_name",
    "ordered_quantity": QUANTITY,
    "received_quantity": RECEIVED,
    "unit_cost": "CAST(unit_price * 0.80BD AS DECIMAL(12,2))",
    "purchase_value": "CAST(l_extendedprice AS DECIMAL(14,2))",
    "delay_days": DELAY,
    "delivery_status": f"CASE WHEN {DELAY} > 0 AND {RECEIVED} < {QUANTITY} THEN 'Delayed and Partial' "
                       f"WHEN {DELAY} > 0 THEN 'Delayed' WHEN {RECEIVED} < {QUANTITY} THEN 'Partial Delivery' "
                       "ELSE 'Delivered On Time' END",
    "quality_rating": "CASE WHEN l_suppkey % 10 IN (4, 9) THEN CAST(2.5 AS DECIMAL(3,1)) "
                      "ELSE CAST(3.5BD + (l_linenumber % 4) * 0.5BD AS DECIMAL(3,1)) END",
    # the ship date as recorded, unrelated to the order date: input of the date checks
    "recorded_delivery_date": "CAST(l_shipdate AS DATE)",
}
SALES_COLUMNS = (
    "sale_id", "date", "store_id", "store_name", "region", "product_id", "product_name",
    "category", "employee_id", "quantity_sold", "unit_price", "discount_percent",
    "total_sales", "total_cost", "profit", "payment_status",
)
COMPLAINT_COLUMNS = (
    "complaint_id", "date", "customer_id", "store_id", "store_name", "region", "product_id",
    "product_name", "category", "complaint_type", "complaint_description", "severity",
    "status", "assigned_employee_id", "resolution_time_days",
)


class Business:
    """The nine business tables for one data directory; the facts over `joined` lines (see `lines`) where these are at hand."""

    def __init__(self, spark: SparkSession, sf_dir: str, joined: DataFrame | None = None, stored_stores: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.joined = joined
        self.stored_stores = stored_stores

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    # ---- dimensions -------------------------------------------------------
    def stores(self) -> DataFrame:
        if self.stored_stores is not None:
            return self.stored_stores
        return self.raw("nation").join(self.raw("region"), F.expr("n_regionkey = r_regionkey")).selectExpr(
            "n_nationkey AS store_number", f"{code('S', 'n_nationkey')} AS store_id",
            "n_name AS store_name", "r_name AS region", f"{code('E', 'n_nationkey')} AS manager_id",
            "date_add(DATE '1994-01-01', n_nationkey) AS opening_date",
            "CAST(n_nationkey * 1000 + 50000 AS DECIMAL(14,2)) AS monthly_sales_target",
            "CASE WHEN n_nationkey % 12 = 11 THEN 'Inactive' ELSE 'Active' END AS operational_status",
        )

    def employees(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            f"{code('E', 'n_nationkey')} AS employee_id", "concat('Employee ', n_name) AS employee_name",
            "'Store Manager' AS role", "'Sales' AS department", f"{code('S', 'n_nationkey')} AS store_id",
            "CAST(n_nationkey * 100 + 5000 AS DECIMAL(14,2)) AS monthly_target",
        )

    def vendors(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            f"{key('V', 's_suppkey')} AS vendor_id", "s_name AS vendor_name",
            "CAST(s_suppkey % 10 AS INT) AS average_delivery_days",
            "CAST(3 + (s_suppkey % 5) * 0.5BD AS DECIMAL(3,1)) AS rating",
        )

    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS product_number", f"{key('P', 'p_partkey')} AS product_id",
            "p_name AS product_name", "p_type AS category", "p_brand AS brand",
            "CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price",
            "CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 0.80BD AS DECIMAL(12,2)) AS cost_price",
            "p_size * 2 + 10 AS reorder_level",
            "CASE WHEN p_size <= 15 THEN p_size * 3 END AS shelf_life_days",
            "CASE WHEN p_size <= 15 THEN 'Yes' ELSE 'No' END AS is_perishable",
            f"{key('V', 'p_partkey DIV 20')} AS vendor_id",
        )

    # ---- facts --------------------------------------------------------------
    def _lines(self, columns: tuple[str, ...], last_month: bool = False) -> DataFrame:
        """lineitem with its order and, where asked for, store and product columns; all of it, or the last month of orders."""
        orders = self.raw("orders")
        if last_month:
            first_day = orders.selectExpr("CAST(trunc(max(o_orderdate), 'month') AS TIMESTAMP_NTZ)").scalar()
            orders = orders.where(F.col("o_orderdate") >= first_day)
        stored = self.joined is not None and not last_month
        lines = self.joined if stored else self.raw("lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
        if {"store_id", "store_name", "region"} & set(columns):
            stores = self.stores().select("store_number", "store_id", "store_name", "region")
            if stored:
                lines = lines.selectExpr("*", "explode(homes) AS home").join(stores, F.expr("home = store_number"))
            else:
                homes = self.raw("customer").join(stores, F.expr("c_nationkey = store_number")).select(
                    "c_custkey", "store_id", "store_name", "region")
                lines = lines.join(homes, F.expr("o_custkey = c_custkey"))
        if {"product_name", "category", "unit_price"} & set(columns):
            products = self.products().select("product_number", "product_name", "category", "unit_price")
            lines = lines.join(products, F.expr("l_partkey = product_number"))
        return lines

    def lines(self) -> DataFrame:
        """lineitem with its order and `homes`, the nation of each customer with the order's key: what all facts are made of, joined once.

        A fact with stores has a row for each home, one without stores a row for each line, as where it joins the tables itself."""
        homes = self.raw("customer").where("c_nationkey IS NOT NULL").groupBy("c_custkey").agg(F.expr("collect_list(c_nationkey) AS homes"))
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").join(
            homes, F.expr("o_custkey = c_custkey"), "left").drop("c_custkey")
        return self.raw("lineitem").drop("l_tax").join(orders, F.expr("l_orderkey = o_orderkey")).drop("o_orderkey")

    def sales(self, *columns: str, last_month: bool = False) -> DataFrame:
        columns = columns or SALES_COLUMNS
        return self._lines(columns, last_month).selectExpr(*[f"{LINE_COLUMNS[c]} AS {c}" for c in columns])

    def monthly_sales(self) -> DataFrame:
        """Sales, cost and profit by store, product and month (`date` is its first day): added up by key, then named."""
        if self.joined is not None:
            lines = self.joined.selectExpr("*", "explode(homes) AS c_nationkey")
        else:
            lines = self.raw("lineitem").join(self.raw("orders"), F.expr("l_orderkey = o_orderkey")).join(
                self.raw("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        money = {c: f"CAST(sum({LINE_COLUMNS[c]}) AS DECIMAL(18,4))" for c in ("total_sales", "total_cost", "profit")}
        sums = lines.groupBy("c_nationkey", "l_partkey", F.expr("CAST(trunc(o_orderdate, 'month') AS DATE) AS date")).agg(
            *[F.expr(f"{sql} AS {c}") for c, sql in money.items()])
        stores = self.stores().select("store_number", "store_id", "store_name", "region")
        products = self.products().select("product_number", "product_id", "product_name", "category")
        return sums.join(stores, F.expr("c_nationkey = store_number")).join(products, F.expr("l_partkey = product_number")).select(
            "store_id", "store_name", "region", "product_id", "product_name", "category", "date", *money)

    def complaints(self, *columns: str) -> DataFrame:
        columns = columns or COMPLAINT_COLUMNS
        return self._lines(columns).where("l_returnflag = 'R'").selectExpr(
            *[f"{LINE_COLUMNS[c]} AS {c}" for c in columns])

    def deliveries(self, *columns: str) -> DataFrame:
        columns = columns or tuple(c for c in DELIVERY_COLUMNS if c != "recorded_delivery_date")
        lines = self._lines(columns + (("unit_price",) if "unit_cost" in columns else ()))
        if "vendor_name" in columns:
            lines = lines.join(self.raw("supplier").select("s_suppkey", "s_name"),
                               F.expr("l_suppkey = s_suppkey"))
        return lines.selectExpr(*[f"{DELIVERY_COLUMNS[c]} AS {c}" for c in columns])

    def inventory(self) -> DataFrame:
        parts = self.raw("part").selectExpr(
            "p_partkey", "p_name AS product_name", "p_type AS category", "p_size",
            "CAST(p_partkey % 25 AS INT) AS store_key", "p_size * 2 + 10 AS reorder_level",
            "CAST((p_partkey * 37) % ((p_size * 2 + 10) * 4 + 1) AS INT) AS current_stock")
        stores = self.stores().select("store_number", "store_id", "store_name")
        return parts.join(stores, F.expr("store_key = store_number")).selectExpr(
            f"{key('INV', 'p_partkey')} AS inventory_id", f"DATE '{SNAPSHOT_DATE}' AS date",
            "store_id", "store_name", f"{key('P', 'p_partkey')} AS product_id", "product_name",
            "category", f"{key('V', 'p_partkey DIV 20')} AS vendor_id", "current_stock", "reorder_level",
            f"{STOCK_STATUS} AS stock_status",
            "CASE WHEN current_stock * 10 < reorder_level * 8 THEN 'Yes' ELSE 'No' END AS reorder_required",
            f"CASE WHEN p_size <= 15 THEN date_add(DATE '{SNAPSHOT_DATE}', CAST(p_partkey % 61 AS INT) - 10) "
            "END AS expiry_date",
        )

    def finance(self, sales: DataFrame | None = None) -> DataFrame:
        """One row per store and month, with the store's mean monthly revenue as target; from sales that are at hand, if given."""
        money = "DECIMAL(18,2)"
        monthly = (
            (sales if sales is not None else self.sales("store_id", "store_name", "region", "date", "total_sales", "total_cost"))
            .groupBy("store_id", "store_name", "region", F.expr("trunc(date, 'month') AS month_start"))
            .agg(F.expr(f"CAST(sum(total_sales) AS {money}) AS total_revenue"),
                 F.expr(f"CAST(sum(total_cost) AS {money}) AS total_cost"))
        )
        per_store = "OVER (PARTITION BY store_id)"
        share = "CAST(CAST(substring(store_id, 2, 3) AS INT) % 5 * 3 + 4 AS DECIMAL(3,0))"
        return monthly.selectExpr(
            "*", "date_format(month_start, 'yyyy-MM') AS month",
            f"CAST(floor(CAST(sum(total_revenue) {per_store} AS DOUBLE) / count(*) {per_store}) AS {money}) "
            "AS monthly_sales_target",
            f"CAST(total_revenue - total_cost AS {money}) AS gross_profit",
            f"CAST(total_revenue * {share} * 0.01BD AS {money}) AS operating_expense",
        ).selectExpr(
            "*", f"CAST(gross_profit - operating_expense AS {money}) AS operating_profit",
            "CAST(format_number(CAST(total_revenue AS DOUBLE) / CAST(monthly_sales_target AS DOUBLE) * 100, '0.00') "
            "AS DECIMAL(10,2)) AS target_achievement_percent",
        ).selectExpr(
            "concat_ws('-', 'FIN', store_id, month) AS finance_id", "month", "store_id", "store_name",
            "region", "monthly_sales_target", "total_revenue", "total_cost", "gross_profit",
            "operating_expense", "operating_profit", "target_achievement_percent",
            "CASE WHEN target_achievement_percent < 60 OR operating_profit < 0 THEN 'High Risk' "
            "WHEN target_achievement_percent < 85 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_status",
        )

    def documents(self) -> DataFrame:
        return self.raw("documents")
