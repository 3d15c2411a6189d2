"""Plans and results that matter for large tables: what is written, broadcast and dealt."""

from __future__ import annotations

import os
import re

from tillwatch.functions.text import clean_column, clean_column_or_nan, clean_text, clean_text_or_nan
from tillwatch.operators import findings, grounding, issues, rootcause, sales, vendor_finance
from tillwatch.operators.templates import aggregates
from tillwatch.plans import all_queries, stages
from tillwatch.sources.business import Business


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_context_writes_only_the_stage_it_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "_WRITTEN", {})
    monkeypatch.setattr(stages, "shared_folder", lambda spark: str(tmp_path))
    s = stages.Stages(Business(spark, "/root/testdata/sf0.001"))
    for name, written in (("store_sales", {"sales"}), ("finance", {"sales", "finance"}), ("case_products", {"sales", "finance", "complaints"})):
        s.context(name).collect()
        assert {os.path.basename(path) for path in stages._WRITTEN.values()} == written


def test_findings_are_written_once(spark, tmp_path, monkeypatch):
    """Each family with its issue keys, read as one table: no stage holds the findings a second time."""
    monkeypatch.setattr(stages, "_WRITTEN", {})
    monkeypatch.setattr(stages, "shared_folder", lambda spark: str(tmp_path))
    s = stages.Stages(Business(spark, "/root/testdata/sf0.001"))
    found = s.table("findings")
    whole = issues.with_issue_key(issues.all_findings(s.families()))
    rows = lambda df: sorted(map(str, df.collect()))
    assert found.schema.simpleString() == whole.schema.simpleString() and rows(found) == rows(whole) != []
    folders = {name for *_, names in [(p, d) for p, d, _ in os.walk(tmp_path)] for name in names}
    assert {f"findings_{module}" for module in issues.MODULES} <= folders and "findings" not in folders and not any(f.startswith("family") for f in folders)


def test_a_brief_reads_the_lines_once(spark, tmp_path, monkeypatch):
    """KPIs and texts are stages: no plan of a brief goes back to the order lines."""
    monkeypatch.setattr(stages, "_WRITTEN", {})
    monkeypatch.setattr(stages, "shared_folder", lambda spark: str(tmp_path))
    b = Business(spark, "/root/testdata/sf0.001")
    for name in ("ungrounded_brief", "brief_summary", "daily_brief"):
        assert "lineitem" not in plan(all_queries()[name](spark, b.sf_dir))


def test_grounding_sends_no_table_to_every_task(spark):
    returned = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), (None, "x")], "key string, value string")
    allowed = spark.createDataFrame([("a", "x"), ("b", None), (None, "x"), ("c", "y")], "key string, value string")
    found = grounding.unsupported(returned, allowed, "factor")
    assert sorted(((r.key or "", r.detail or "") for r in found.collect())) == [("", "x"), ("a", "y"), ("b", "")]
    texts = spark.createDataFrame([("a", "FIN-X1 cost 10.00 and 7"), ("b", "S-1 and 3"), (None, "T-1")], "key string, text string")
    facts = spark.createDataFrame([("a", "10.004 FIN-X1"), ("b", "S-2, 3"), (None, "T-1")], "key string, text string")
    unknown = grounding.unknown_mentions(texts, facts)
    assert sorted((r.key or "", r.deviation, r.detail) for r in unknown.collect()) == [
        ("", "unknown id", "T-1"), ("a", "unknown number", "7"), ("b", "unknown id", "S-1")]
    for df in (found, unknown):
        assert "Broadcast" not in plan(df)


def lines(spark):
    rows = [(f"P{p}", f"Product {p}", "Toys", f"S{s}", f"2001-{m:02d}-01", 100.0 * p + m, 1.0)
            for p in range(6) for s in range(3) for m in (1, 2, 4)]
    return spark.createDataFrame(rows, "product_id string, product_name string, category string, store_id string, date string, total_sales double, profit double").selectExpr(
        "product_id", "product_name", "category", "store_id", "CAST(date AS DATE) AS date", "CAST(total_sales AS DECIMAL(18,4)) AS total_sales", "CAST(profit AS DECIMAL(18,4)) AS profit")


def test_product_sales_of_wanted_products(spark):
    whole = rootcause.product_sales_context(lines(spark))
    wanted = spark.createDataFrame([("P1", "S2"), ("P1", "all"), ("P3", "all"), ("P4", "S0"), ("P9", "all"), (None, "all")], "product_id string, store_key string")
    some = rootcause.product_sales_context(lines(spark), wanted)
    assert whole.schema.simpleString() == some.schema.simpleString()
    expected = whole.join(wanted, ["product_id", "store_key"], "left_semi")
    rows = lambda df: sorted(map(str, df.select(*whole.columns).collect()))
    assert rows(some) == rows(expected) and expected.count() == 4 * (3 + 1)


def test_product_sales_are_dealt_once(spark):
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan(rootcause.product_sales_context(lines(spark)))))
    assert {d.split(",")[0] for d in dealt} == {"product_id"} and all(d.count(",") == 1 for d in dealt)


def test_cleaning_of_columns(spark):
    texts = [None, "", "  a  b ", "nan", " NaN ", "\tnan", "a\tb", "a\nb\r", "\x0bnan\x0c", "plain", "a b", " x", "a\x0bb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for quick, plain in ((clean_column, clean_text), (clean_column_or_nan, clean_text_or_nan)):
        assert df.where(f"NOT ({quick('t')} <=> {plain('t')})").count() == 0


def test_summed_sales_give_the_same_product_findings(spark):
    summed = lines(spark).selectExpr("*", "store_id AS store_name", "'North' AS region")
    finance = spark.createDataFrame([], "store_id string, store_name string, month string, finance_id string, region string, target_achievement_percent decimal(10,2), "
                                        "total_revenue decimal(18,2), monthly_sales_target decimal(18,2), operating_profit decimal(18,2), risk_status string")
    stores = spark.createDataFrame([("S0", "North")], "store_id string, region string")
    rows = lambda flag: sorted(map(str, sales.sales_findings(summed, finance, stores, detected_at="x", summed=flag).collect()))
    assert rows(True) == rows(False) != []


def test_recorded_findings_need_no_second_cleaning(spark):
    """Texts put together from odd columns come out clean, and only 'nan' is left for the issue key."""
    odd = spark.createDataFrame([("a  b", "nan"), (None, " x\t"), ("", " "), ("c", "NaN"), ("d\n\ne ", "plain")], "p string, q string")
    made = findings.record(odd, findings.SALES, "x", finding_id="concat(' ', coalesce(p, ''), q, '  ')", entity_id="q", store_id="p", business_area="'Sales'",
                           analysis_type="concat('Store ', coalesce(p, ''), ' Decline')")
    rows = lambda df: sorted(map(str, df.collect()))
    plain = odd.selectExpr(f"{clean_text(chr(39) + ' ' + chr(39) + ' || coalesce(p, ' + chr(39) * 2 + ') || q')} AS finding_id")
    assert rows(made.select("finding_id")) == rows(plain)
    arrived = issues.harmonise(made, "sales")
    assert rows(issues.with_issue_key(arrived, recorded=True)) == rows(issues.with_issue_key(arrived))


def test_only_repeated_evidence_is_dealt(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "f1", 1, "a"), ("i1", "f1", 3, "b"), ("i1", "f2", 1, "c"), (None, "f1", 1, "d"), (None, "f1", 2, "e"), ("i2", None, 1, "f")],
                                 "issue_id string, source_finding_id string, arrival int, evidence string")
    issues.repeated_evidence(rows).write.parquet(f"{tmp_path}/repeated")
    repeated = spark.read.parquet(f"{tmp_path}/repeated")
    some = issues.stored_evidence(rows, repeated)
    assert sorted(map(str, some.collect())) == sorted(map(str, issues.stored_evidence(rows).collect()))
    assert repeated.count() == 2 and sorted(r.evidence for r in some.collect()) == ["b", "c", "e", "f"]
    singles = rows.where("arrival > 1")
    issues.repeated_evidence(singles).write.parquet(f"{tmp_path}/none")
    whole = issues.stored_evidence(singles, spark.read.parquet(f"{tmp_path}/none"))
    # nothing is left for the exchange and the window
    assert whole.count() == 2 and "EmptyRelation" in plan_after(whole)


def plan_after(df) -> str:
    """The plan as it was run."""
    run = df._jdf.queryExecution()
    run.executedPlan().executeCollect()
    return run.executedPlan().toString().split("Initial Plan")[0]


def tables(folder, spark):
    """Small tables with repeated and null customers, orders without one, and lines without an order."""
    made = {
        "region": ([(0, "North"), (1, "South")], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 1), (None, "C", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 0), (1, 1), (2, None), (3, 1), (3, 1), (None, 0)], "c_custkey long, c_nationkey int"),
        "supplier": ([(7, "Seven"), (8, "Eight")], "s_suppkey long, s_name string"),
        "part": ([(5, "bolt", "b", "SMALL", 3, 9.5), (6, "ring", "b", "LARGE", 30, 2.25)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(10, 1, "F", "1-URGENT"), (11, 2, "O", "5-LOW"), (12, 3, "O", "2-HIGH"), (13, 9, "F", None), (14, None, "F", "5-LOW"), (12, 1, "F", "2-HIGH")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(k, 5 + n % 2, 7 + n % 3, n, 10.0 * n, 100.0 + n, 0.05, 0.0, "RAN"[n % 3], "OF"[n % 2]) for k in (10, 11, 12, 13, 14, 15, None) for n in range(1, 5)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in made.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.selectExpr("*", "CAST(date_add(DATE '2001-01-20', CAST(o_orderkey AS INT)) AS TIMESTAMP_NTZ) AS o_orderdate")
        if name == "lineitem":
            df = df.selectExpr("*", "CAST(date_add(DATE '2001-02-01', l_linenumber * 9) AS TIMESTAMP_NTZ) AS l_shipdate")
        df.write.parquet(f"{folder}/{name}.parquet")
    return Business(spark, str(folder))


def test_facts_over_shared_lines_are_the_same(spark, tmp_path):
    """Joined once for all: the same rows as where each fact joins the tables itself, and no customers or orders in the plans."""
    b = tables(tmp_path, spark)
    b.lines().write.parquet(f"{tmp_path}/lines")
    b.stores().write.parquet(f"{tmp_path}/stores")
    shared = Business(spark, b.sf_dir, spark.read.parquet(f"{tmp_path}/lines"), spark.read.parquet(f"{tmp_path}/stores"))
    rows = lambda df: sorted(map(str, df.collect()))
    for made in (lambda x: x.monthly_sales(), lambda x: x.sales(), lambda x: x.sales("date", "total_sales", "quantity_sold"), lambda x: x.complaints(),
                 lambda x: x.deliveries(), lambda x: x.deliveries("vendor_id", "vendor_name", "delay_days", "received_quantity", "ordered_quantity", "quality_rating")):
        own, other = made(b), made(shared)
        assert own.schema.simpleString() == other.schema.simpleString() and rows(own) == rows(other) != []
        assert "customer.parquet" not in plan(other) and "orders.parquet" not in plan(other)


def test_product_complaints_of_wanted_products(spark):
    cases = spark.createDataFrame([(f"P{n % 3}", f"S{n % 2}", f"Name {n % 5}", "High" if n % 4 else "Low", "Open" if n % 3 else "Closed", "Out of Stock") for n in range(40)],
                                  "product_id string, store_id string, product_name string, severity string, status string, complaint_type string")
    whole = rootcause.product_complaint_context(cases)
    wanted = spark.createDataFrame([("P0", "all"), ("P1", "S1"), ("P9", "all"), (None, "all")], "product_id string, store_key string")
    some = rootcause.product_complaint_context(cases, wanted)
    rows = lambda df: sorted(map(str, df.select(*whole.columns).collect()))
    assert whole.schema.simpleString() == some.select(*whole.columns).schema.simpleString()
    assert rows(some) == rows(whole.join(wanted, ["product_id", "store_key"], "left_semi")) and some.count() == 2


def test_vendor_context_sorts_no_deliveries(spark):
    rows = spark.createDataFrame(
        [("V1", "a", 3, 8, 9, 2.5), ("V1", "b", None, 9, 9, None), ("V1", "a", 0, 8, 9, 4.0), ("V1", None, -1, 9, 9, 3.5), (None, "c", None, 1, 1, None)],
        "vendor_id string, vendor_name string, delay_days int, received_quantity int, ordered_quantity int, rating double")
    deliveries = rows.selectExpr("*", "CAST(rating AS DECIMAL(3,1)) AS quality_rating")
    made = rootcause.vendor_delivery_context(deliveries)
    direct = deliveries.groupBy("vendor_id").agg(*aggregates({"vendor_name": "max(vendor_name)", **vendor_finance.DELIVERY_METRICS}))
    assert made.schema.simpleString() == direct.schema.simpleString() and sorted(map(str, made.collect())) == sorted(map(str, direct.collect()))
    assert "HashAggregate" in plan(made) and "HashAggregate" not in plan(direct)


def test_texts_are_searched_once(spark):
    """Both sides of the comparison of numbers read one shuffle of the words found."""
    texts = spark.createDataFrame([("a", "FIN-X1 cost 10.00 and 7"), ("b", "S-1 and 3")], "key string, text string")
    unknown = grounding.unknown_mentions(texts, texts.where("key = 'a'"))
    assert [(r.key, r.detail) for r in unknown.orderBy("detail").collect()] == [("b", "3"), ("b", "S-1")]
    assert "ReusedExchange" in plan_after(unknown)
