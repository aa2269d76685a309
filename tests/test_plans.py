"""Plan shapes that the scale design relies on (checked on the physical plan, not on timings)."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strata.operators.changes import scd2_from_changes
from strata.plans import registry
from strata.sources import bronze as bz

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cartesian_no_python_udf(spark, name):
    plan = _plan(registry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan, f"{name}: {bad}"


def test_scd2_plain_path_is_one_shuffle(spark, tmp_root):
    spark.range(1000).select((F.col("id") % 37).alias("k"), F.col("id").alias("s"), (F.col("id") % 3).alias("v")).write.parquet(tmp_root + "/log")
    log = spark.read.parquet(tmp_root + "/log")
    plan = _plan(scd2_from_changes(log, ["k"], "s", hot_key_rows=None))
    assert _shuffles(plan) == 1 and "FileScan" in plan


def test_revenue_aggregates_before_the_join(spark):
    plan = _plan(registry.queries()["revenue_by_customer_month"](spark, SF))
    join_at = plan.find("Join")
    partial_at = plan.find("partial_sum(amount")
    assert 0 <= join_at < partial_at  # the partial aggregate sits below (after, in the text) the join


def test_current_snapshot_prunes_partitions(spark, tmp_root):
    path = tmp_root + "/bronze"
    for i in (1, 2):
        bz.load_snapshot(spark, spark.range(5), path, "t", f"2026-01-0{i} 00:00:00", i)
    cur = bz.read_current(spark, path)
    # by the load log: the scan lists the newest load's folder alone, and no other id is looked at
    assert {f.rsplit("/", 2)[1] for f in cur.inputFiles()} == {"_snapshot_id=2"}
    assert _shuffles(_plan(cur)) == 0 and cur.count() == 5


def test_time_filter_reaches_the_scan(spark):
    plan = _plan(registry.queries()["job_runs_recent"](spark, SF))
    scan = [line for line in plan.split("\n") if "FileScan" in line]
    assert scan and "2024-01-24" in scan[0]


def test_top_products_uses_bounded_top_k(spark):
    plan = _plan(registry.queries()["top_products"](spark, SF))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_entry_is_registered():
    assert "revenue_by_customer_month" in entry.queries()


def test_change_batch_rebuild_combines_before_it_shuffles(spark, tmp_root):
    """Bronze rows of the touched buckets: copies are combined map-side and dealt by key and
    sequence, and one more shuffle by bucket serves the SCD scan."""
    from strata.plans.catalog import table_config
    from strata.plans.silver import changes_view, scd_from_changes
    from strata.sources.tables import BUCKET

    cfg = table_config("crm_files", "products")
    rows = spark.range(500).select(
        F.concat(F.lit(" P-"), (F.col("id") % 40).cast("string")).alias("product_code"),
        F.lit("n").alias("product_name"),
        F.lit("c").alias("category"),
        (F.col("id") % 3).cast("string").alias("price"),
        F.lit("2026-01-01").alias("valid_from"),
        F.lit("f.csv").alias("_file_path"),
        F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("_file_modification_time"),
        F.lit("2026-01-02 00:00:00").cast("timestamp_ntz").alias("_ingested_at"),
        (F.col("id") % 40 % 8).cast("int").alias(BUCKET),
    )
    rows.write.partitionBy(BUCKET).parquet(tmp_root + "/bronze")
    history = spark.read.parquet(tmp_root + "/bronze").where(F.col(BUCKET).isin(1, 2, 3))
    out = scd_from_changes(changes_view(history, cfg, cluster_by=BUCKET).df, cfg, cluster_by=BUCKET, hot_key_rows=None)
    plan = _plan(out)
    assert _shuffles(plan) == 2
    first = plan[plan.rindex("Exchange ") :]  # the lowest exchange
    assert "_file_modification_time" in first.split("\n")[0] and "partial_min" in first
    scan = [line for line in plan.split("\n") if "FileScan" in line][0]
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", scan), scan  # only the touched buckets are read
