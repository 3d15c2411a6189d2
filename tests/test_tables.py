"""Written tables: buckets and their manifest, full refresh with rollback, runs and their parts, the import log."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tillwatch.operators import cleaning, grounding
from tillwatch.sources import sinks
from tillwatch.sources.config import LOAD_ORDER, names
from tillwatch.sources.runs import RunTable, run_sources
from tillwatch.sources.versioned import BucketedTable
from tillwatch.streaming.ingest import ingest_stream

AT = datetime.datetime(2026, 1, 1, 6)


def files(root):
    return {os.path.join(d, f) for d, _, found in os.walk(root) for f in found if f.startswith("part-")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=8)
    start = spark.range(200).selectExpr("id", "concat('name ', id) AS name", "id % 7 AS kept")
    table.create(start)
    before = files(tmp_path / "t/data")
    source = spark.createDataFrame([(3, "new three"), (1000, "added"), (None, "no id")], "id long, name string")
    touched = table.merge(source, 1)
    assert 0 < len(touched) <= 3 and before <= files(tmp_path / "t/data")  # no file is moved or replaced
    added = {int(f.split("bucket=")[1].split("/")[0]) for f in files(tmp_path / "t/data") - before}
    assert added == touched
    want = cleaning.upsert(start, source, "id")
    assert rows(table.read()) == rows(want) and table.version() == 1
    assert rows(table.read(as_of=0)) == rows(start)
    table.merge(source, 1)  # the same batch again
    assert rows(table.read()) == rows(want)
    assert table.merge(source.limit(0), 2) == set() and rows(table.read()) == rows(want)


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=4)
    table.create(spark.range(20).selectExpr("id", "'x' AS name"))
    broken = spark.range(5).selectExpr("id", "if(id = 4, raise_error('boom'), 'y') AS name")
    with pytest.raises(Exception, match="boom"):
        table.merge(broken, 1)
    assert table.version() == 0 and {r["name"] for r in table.read().collect()} == {"x"}


def test_bucketed_table_from_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=4)
    table.create(spark.createDataFrame([], "id long, name string"))
    assert table.read().count() == 0
    table.merge(spark.createDataFrame([(1, "a")], "id long, name string"), 1)
    assert rows(table.read()) == [(1, "a")]


def small(spark, n):
    return spark.range(n).selectExpr("id", "'x' AS v")


def test_full_refresh_switches_only_when_all_counts_agree(spark, tmp_path):
    root = str(tmp_path / "r")
    tables = {name: small(spark, 3 + k) for k, name in enumerate(LOAD_ORDER)}
    log = sinks.full_refresh(tables, root, "v1", AT)
    assert {(r["dataset_name"], r["total_rows"], r["successful_rows"], r["import_status"]) for r in log.collect()} == {
        (name, 3 + k, 3 + k, "Success") for k, name in enumerate(LOAD_ORDER)}
    assert sinks.current_version(spark, root) == "v1"
    # a dataset that fails midway
    broken = tables | {"products": small(spark, 9).selectExpr("if(id = 8, raise_error('boom'), id) AS id", "v")}
    with pytest.raises(sinks.RefreshError) as caught:
        sinks.full_refresh(broken, root, "v2", AT)
    place = LOAD_ORDER.index("products")
    got = {r["dataset_name"]: r["import_status"] for r in caught.value.log.collect()}
    assert got == {name: "Rolled Back" for name in LOAD_ORDER[:place]} | {"products": "Failed"}
    assert sinks.current_version(spark, root) == "v1"
    # a count that does not agree
    with pytest.raises(sinks.RefreshError, match="v3 stopped at sales"):
        sinks.full_refresh(tables, root, "v3", AT, counted=lambda df: df.count() - ("/sales" in df.inputFiles()[0]))
    assert sinks.current_version(spark, root) == "v1"
    stored = spark.read.parquet(f"{root}/refresh_log")
    assert stored.where("import_status = 'Failed'").count() == 2 and stored.where("run_id = 'v1'").count() == len(LOAD_ORDER)
    assert "boom" in stored.where("run_id = 'v2' AND import_status = 'Failed'").first()["error_message"]
    assert sinks.full_refresh(tables | {"finance": small(spark, 0)}, root, "v4", AT).where("dataset_name = 'finance'").first()["total_rows"] == 0
    assert sinks.current_version(spark, root) == "v4"


def test_a_file_name_that_comes_again_adds_a_log_row(spark, tmp_path):
    columns = names("vendors", "columns")
    base = {c: "x" for c in columns} | {"average_delivery_days": "3", "rating": "4", "region": "North", "supply_status": "Active"}
    raw = spark.createDataFrame([tuple((base | {"vendor_id": f"V{k}"})[c] for c in columns) for k in range(3)], ", ".join(f"{c} string" for c in columns))
    empty = cleaning.typed("vendors", cleaning.accepted(cleaning.clean("vendors", raw))).drop("problem").limit(0)
    table = BucketedTable(spark, str(tmp_path / "t"), "vendor_id", buckets=4)
    table.create(empty)
    log = str(tmp_path / "log")
    for month in (1, 2, 2):  # the second import of February repeats a run
        at = datetime.datetime(2026, month, 1)
        assert sinks.import_dataset("vendors", raw, {}, table, None, str(tmp_path / f"m{month}"), log, "vendors.csv", at) == "Success"
    found = spark.read.parquet(log).orderBy("imported_at").collect()
    assert [(r["source_file_name"], r["imported_at"].month, r["total_rows"], r["successful_rows"]) for r in found] == [("vendors.csv", 1, 3, 3), ("vendors.csv", 2, 3, 3)]
    history = sinks.import_history(spark.read.parquet(log).withColumnRenamed("run_id", "import_id"), 10)
    assert history.count() == 2 and table.read().count() == 3


def test_stream_into_a_bucketed_table(spark, tmp_path):
    columns = names("vendors", "columns")
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *keys):
        lines = [",".join([k, "Name " + k, "c", "p", "city", "state", "north", "3", "4.5", "30 days", "active"]) for k in keys]
        (folder / name).write_text("\n".join([",".join(columns), *lines]) + "\n")

    kinds = {"average_delivery_days": "bigint", "rating": "decimal(14,2)"}
    table = BucketedTable(spark, str(tmp_path / "t"), "vendor_id", buckets=8)
    table.create(spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)))
    put("a.csv", *[f"v{k}" for k in range(30)])
    ingest_stream(spark, "vendors", str(folder), str(tmp_path / "o"), dict, table=table).awaitTermination(120)
    first = files(tmp_path / "t/data")
    put("b.csv", "v3")
    ingest_stream(spark, "vendors", str(folder), str(tmp_path / "o"), dict, table=table).awaitTermination(120)
    assert table.version() == 2 and table.read().count() == 30
    assert len({f.split("bucket=")[1].split("/")[0] for f in files(tmp_path / "t/data") - first}) == 1


def test_runs_and_time(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "runs"))
    for k in (1, 2, 3):
        table.append(spark.range(k), f"2026-01-0{k} 06:00:00")
    assert table.as_of("2026-01-03 06:00:00").count() == 2 and table.as_of().count() == 3 and table.as_of("2026-01-01 06:00:00") is None
    table.append(spark.range(7), "2026-01-02 06:00:00")  # a run that is repeated replaces itself
    assert table.read("2026-01-02 06:00:00").count() == 7 and table.commits().count() == 3


def test_sources_that_fail(spark, tmp_path):
    """One failing source leaves the others usable, whether it fails while planned or while it runs; all failing is an error."""
    table = RunTable(spark, str(tmp_path / "runs"))
    at_run = spark.range(5).selectExpr("CAST(if(id = 4, raise_error('at run'), id) AS BIGINT) AS id")

    def at_plan():
        raise KeyError("no such table")

    report = run_sources(table, "r1", {"sales": lambda: spark.range(3), "finance": lambda: at_run, "stock": at_plan, "vendors": lambda: spark.range(2)})
    got = {r["source"]: (r["status"], r["row_count"], r["error_type"]) for r in report.collect()}
    assert got["sales"] == ("Completed", 3, None) and got["vendors"] == ("Completed", 2, None)
    assert got["finance"][0] == got["stock"][0] == "Failed" and got["stock"][2] == "KeyError"
    assert table.read("r1").count() == 5 and {r["part"] for r in table.commits().collect()} == {"sales", "vendors"}
    with pytest.raises(RuntimeError, match="all sources failed"):
        run_sources(table, "r2", {"finance": lambda: at_run, "stock": at_plan})
    assert table.read("r2") is None and table.last_before() == "r1"


def test_mentions_and_tolerance(spark):
    facts = spark.createDataFrame([(1, "Sales 1,234.50 at S003-1, growth 12.34%"), (2, "nothing")], "key int, text string")
    texts = spark.createDataFrame([
        (1, "It sold 1234.5 (12.339%) at S003-1."), (1, "But 12.4 and S003-2 and 99."), (2, "3 visits"), (3, "A-1 without facts 7")], "key int, text string")
    found = {(r["key"], r["deviation"], r["detail"]) for r in grounding.unknown_mentions(texts, facts).collect()}
    assert found == {(1, "unknown number", "12.4"), (1, "unknown id", "S003-2"), (1, "unknown number", "99"), (2, "unknown number", "3"), (3, "unknown id", "A-1"), (3, "unknown number", "7")}


def test_changed_fields(spark):
    schema = "id int, label string, amount double, place int"
    expected = spark.createDataFrame([(1, "a  b", 1.0, 1), (2, "c", 2.0, 2), (3, "d", None, 3)], schema)
    returned = spark.createDataFrame([(1, " a b", 1.0000001, 2), (2, "C", 2.1, 1), (4, "x", 0.0, 4)], schema)
    found = {(r["key"], r["deviation"]) for r in grounding.changed_fields(expected, returned, "id", ("label",), ("amount",), "place").collect()}
    assert found == {(1, "order changed"), (2, "order changed"), (2, "label changed"), (2, "amount changed"), (3, "missing item"), (4, "unknown item")}


def test_cleaning_report_of_an_empty_file(spark, tmp_path):
    raw = spark.createDataFrame([], "vendor_id string, rating string")
    row = cleaning.cleaned_with_report("vendors", raw, None, lambda df: sinks.write_table(df, str(tmp_path / "v")))
    assert row[2:6] == (0, 2, 0, 0) and spark.read.parquet(str(tmp_path / "v")).count() == 0
    assert spark.createDataFrame([row], cleaning.REPORT).withColumn("x", F.lit(1)).count() == 1
