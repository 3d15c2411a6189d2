"""Intermediate tables of the issue pipeline, written once per application and shared.

Each stage has several consumers, so it is written as a table in the cluster's
shared checkpoint folder instead of being recomputed; losing an executor loses
nothing that was written.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tillwatch.operators import (
    complaints, executive, inventory, issues, recommend, rootcause, sales, vendor_finance,
)
from tillwatch.plans.detectors import AT, vendor_snapshot_of
from tillwatch.sources.business import Business

RUN_AT = "2001-08-01 06:00:00"
_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all nodes share: the cluster's checkpoint folder, else one in the warehouse; on a cluster never a machine's own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("on a cluster set spark.checkpoint.dir to a shared folder")
    return f"{warehouse}/_stages"


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables that a query writes for itself."""
    return f"{shared_folder(spark)}/tillwatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


class Stages:
    def __init__(self, b: Business):
        self.b = b
        self.spark = b.spark
        # many texts in one projection make a method that the JVM will not compile but interprets; above its limit Spark then uses smaller ones
        self.spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")

    def table(self, name: str, build=None) -> DataFrame:
        """Read a stage, writing it first when this application has not yet done so. A stage that is built in parts is written part by part
        and read as one table."""
        app = self.spark.sparkContext.applicationId
        slot = (app, self.b.sf_dir, name)
        if slot in _WRITTEN:
            try:
                return self.spark.read.parquet(_WRITTEN[slot])
            except AnalysisException:  # the folder was cleared
                pass
        digest = hashlib.sha256(self.b.sf_dir.encode()).hexdigest()[:12]
        path = f"{shared_folder(self.spark)}/tillwatch/{app}/{digest}/{name}"
        made = build() if build else getattr(self, f"_{name}")()
        if isinstance(made, dict):
            self.together(name, made)
            path = f"{path}_{{{','.join(made)}}}"
        else:
            made.write.mode("overwrite").parquet(path)
        _WRITTEN[slot] = path
        return self.spark.read.parquet(path)

    def together(self, prefix: str, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write independent tables as stages of their own, all at once: their jobs share the cluster instead of waiting for each other."""
        with ThreadPoolExecutor(max_workers=len(parts)) as pool:
            written = {name: pool.submit(self.table, f"{prefix}_{name}", lambda df=df: df) for name, df in parts.items()}
        return {name: future.result() for name, future in written.items()}

    # ---- loaded business tables that several rules read -------------------------
    def share_lines(self) -> None:
        """Write the joined order lines, for a query that needs several facts: the stages made of lines after this read them and join nothing again.

        The stores too: the size of a table is known, that of a join is guessed as a product, and lines would be dealt to a handful of stores."""
        self.table("stores")
        self.table("lines")

    def _lines(self) -> DataFrame:
        return self.b.lines()

    def _stores(self) -> DataFrame:
        return self.b.stores()

    def facts(self) -> Business:
        """The business tables, over the stored lines if this application has written them."""
        slot = (self.spark.sparkContext.applicationId, self.b.sf_dir, "lines")
        return Business(self.spark, self.b.sf_dir, self.table("lines"), self.table("stores")) if slot in _WRITTEN else self.b

    def _sales(self) -> DataFrame:
        """By store, product and month: every rule and context adds up months, so the lines themselves are not copied."""
        return self.facts().monthly_sales()

    def _complaints(self) -> DataFrame:
        return self.facts().complaints()

    def _finance(self) -> DataFrame:
        return self.b.finance(self.table("sales"))

    def _inventory_snapshot(self) -> DataFrame:
        return inventory.snapshot(self.facts().inventory(), self.b.products(), self.b.vendors(), self.table("complaints"))

    def _vendor_snapshot(self) -> DataFrame:
        return vendor_snapshot_of(self.facts())

    # ---- findings to priorities -------------------------------------------------
    def families(self) -> dict[str, DataFrame]:
        self.share_lines()
        vendors = vendor_finance.vendor_findings(self.table("vendor_snapshot"), **AT)
        stores = vendor_finance.finance_findings(vendor_finance.finance_snapshot(self.table("finance")), **AT)
        return {
            "sales": sales.sales_findings(self.table("sales"), self.table("finance"), self.facts().stores(), summed=True, **AT),
            "inventory": inventory.inventory_findings(self.table("inventory_snapshot"), **AT),
            "complaints": complaints.complaint_findings(self.table("complaints"), **AT),
            "vendor_finance": vendors.unionByName(stores),
        }

    def _findings(self) -> dict[str, DataFrame]:
        """By family: the issue key is made row by row, so each family is written once, with it."""
        return {module: issues.with_issue_key(issues.harmonise(df, module), recorded=True) for module, df in self.families().items()}

    def _issues(self) -> DataFrame:
        return issues.consolidate(self.table("findings")).selectExpr("*", f"TIMESTAMP_NTZ '{RUN_AT}' AS last_detected_at")

    def _evidence(self) -> DataFrame:
        rows = issues.evidence_rows(self.table("findings"))
        repeated = self.table("repeated_evidence", lambda: issues.repeated_evidence(rows))
        return executive.evidence_scores(issues.stored_evidence(rows, repeated))

    def _profiles(self) -> DataFrame:
        return executive.evidence_profiles(self.table("evidence"))

    def scored(self) -> DataFrame:
        return executive.scored_issues(self.table("issues"), self.table("profiles"))

    def _executive(self) -> DataFrame:
        return executive.executive_priorities(self.scored())

    # ---- the state left by an earlier run, before complaints were monitored ----------
    def _previous_issues(self) -> DataFrame:
        earlier = self.table("findings").where("source_module <> 'complaints'")
        state = "CASE finding_count % 3 WHEN 0 THEN 'In Progress' WHEN 1 THEN 'Open' ELSE 'Resolved' END"
        fresh = issues.consolidate(earlier).drop("status")
        at = "TIMESTAMP_NTZ '2001-07-01 06:00:00'"
        return fresh.selectExpr("*", f"{state} AS status", f"{at} AS created_at", f"{at} AS updated_at",
                                f"{at} AS last_detected_at")

    # ---- root causes and recommendations --------------------------------------------
    def _deliveries(self) -> DataFrame:
        return self.facts().deliveries("vendor_id", "vendor_name", "store_id", "store_name", "delay_days", "received_quantity",
                                 "ordered_quantity", "quality_rating")

    #: Each context with the stage it is made of; a query writes only the stages of the contexts it asks for.
    CONTEXTS = {
        "finance": ("finance", rootcause.store_finance_context),
        "store_sales": ("sales", rootcause.store_sales_context),
        "categories": ("sales", rootcause.store_category_decline),
        "stock_counts": ("inventory_snapshot", rootcause.store_inventory_counts),
        "store_cases": ("complaints", rootcause.store_complaint_counts),
        "stock": ("inventory_snapshot", rootcause.inventory_product_context),
        "vendors": ("deliveries", rootcause.vendor_delivery_context),
        "affected_stores": ("deliveries", rootcause.vendor_affected_stores),
        "case_types": ("complaints", rootcause.store_complaint_types),
        "case_products": ("complaints", rootcause.store_complaint_products),
        "product_cases": ("complaints", rootcause.product_complaint_context),
        "product_sales": ("sales", rootcause.product_sales_context),
        "case_categories": ("complaints", rootcause.complaint_category_context),
    }

    def context(self, name: str, **more) -> DataFrame:
        stage, build = self.CONTEXTS[name]
        return build(self.table(stage), **more)

    def contexts(self) -> dict[str, DataFrame]:
        """All contexts as stages, product sales and product complaints only of the products that the active issues look up."""
        self.share_lines()
        wanted = rootcause.investigated_issues(self.table("issues"))
        keyed = {"product_sales": rootcause.sold_products(wanted), "product_cases": rootcause.complaint_products(wanted)}
        return self.together("context", {name: self.context(name, **({"wanted": keyed[name]} if name in keyed else {})) for name in self.CONTEXTS})

    def _root_causes(self) -> DataFrame:
        return rootcause.analyses(self.table("issues"), self.table("evidence"), self.contexts(), RUN_AT)

    def _reviewed_causes(self) -> DataFrame:
        """Root causes as reviewers left them after an earlier run."""
        state = ("CASE evidence_count % 5 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Pending Review' WHEN 2 THEN 'Edited' "
                 "WHEN 3 THEN 'Rejected' ELSE 'Pending Review' END")
        kept = [c for c in self.table("root_causes").columns if c not in ("review_status", "generated_at")]
        return self.table("root_causes").selectExpr(
            *kept, f"{state} AS review_status", "1 AS analysis_version", "TIMESTAMP_NTZ '2001-07-01 06:00:00' AS generated_at")

    def _recommendations(self) -> DataFrame:
        rows = recommend.context(self.table("issues"), self.table("reviewed_causes"))
        return recommend.recommendations(rows, "2001-08-01", RUN_AT)

    def _stored_recommendations(self) -> DataFrame:
        """Recommendations of an earlier run in all five states."""
        state = ("CASE (length(issue_title) + length(issue_id)) % 5 WHEN 0 THEN 'Pending Review' WHEN 1 THEN 'Edited' "
                 "WHEN 2 THEN 'Accepted' WHEN 3 THEN 'Rejected' ELSE 'Converted to Task' END")
        kept = [c for c in self.table("recommendations").columns if c != "status"]
        return self.table("recommendations").selectExpr(*kept, f"{state} AS status")

    def _tasks(self) -> DataFrame:
        """One task per converted recommendation and per third accepted one, in all five states."""
        made = self.table("stored_recommendations").where(
            "status = 'Converted to Task' OR (status = 'Accepted' AND length(issue_id) % 3 = 0)")
        state = ("CASE length(issue_id) % 5 WHEN 0 THEN 'Unassigned' WHEN 1 THEN 'To Do' WHEN 2 THEN 'In Progress' "
                 "WHEN 3 THEN 'Blocked' ELSE 'Completed' END")
        return made.selectExpr(
            "concat('TASK-', recommendation_id) AS task_id", "issue_id", "recommendation_id", "recommendation_title AS title",
            "recommendation_text AS description", "CAST(NULL AS STRING) AS assigned_to", "suggested_owner_role AS assigned_role",
            "suggested_deadline AS due_date", "priority_level", f"{state} AS status")
