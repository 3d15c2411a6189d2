"""Headline queries on the driver's data; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "store_sales_decline", "product_sales_decline", "product_underperformance", "sales_findings",
    "inventory_findings", "complaint_findings", "vendor_finance_findings", "kpi_table", "store_health",
    "combined_issues", "consolidated_issues", "evidence_profiles", "executive_priorities", "root_causes",
    "recommendations", "task_transitions", "cleaned_sales", "document_chunks", "document_search",
)


#: Shared tables, timed apart so that no query is charged for them.
STAGES = ("sales", "complaints", "finance", "inventory_snapshot", "vendor_snapshot", "deliveries", "findings", "issues", "evidence")


def main() -> None:
    from pyspark.sql import SparkSession

    from tillwatch.plans import all_queries
    from tillwatch.plans.document_queries import registered
    from tillwatch.plans.stages import Stages
    from tillwatch.sources.business import Business

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        # the tables are single files of some MB: small splits use all cores
        .config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, taken = all_queries(), {}
    start = time.perf_counter()
    for name in STAGES:
        Stages(Business(spark, sf_dir)).table(name)
        taken[f"stage {name}"] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
    registered(Business(spark, sf_dir))
    taken["stage documents"] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(taken.values()), 3), "unit": "sec",
        "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
