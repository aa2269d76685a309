"""End to end: Bronze snapshots and Silver versions on disk, files through streams, JDBC."""

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rows import PRODUCTS_1, PRODUCTS_2, customers
from strata.config import Rule, SourceConfig, read_source
from strata.operators.keys import END, START
from strata.operators.quality import ExpectationFailed
from strata.plans.catalog import CRM_FILES, SALESDB
from strata.plans.pipeline import Lake, load_source_table, read_silver, run_files_table, run_snapshot_table
from strata.sources import bronze as bz
from strata.sources.files import read_files
from strata.sources.jdbc import read_table

CUST = "customer_id int, name string, email string, city string, segment string"
R1, R2 = customers("Client  {}", " Mail{}@Post.test ")


def test_snapshot_pipeline_two_rounds(spark, tmp_root):
    src = read_source(SALESDB)
    cfg = src.table("customers")
    lake = Lake(spark, tmp_root, buckets=4)
    for i, rows in enumerate((R1, R2), start=1):
        res = load_source_table(lake, src, cfg, spark.createDataFrame(rows, CUST), f"2026-01-0{i} 06:00:00")
        assert (res.snapshot_id, res.rows) == (i, len(rows))
        out = run_snapshot_table(lake, src, cfg)
        assert out["version"] == i and out["rules"]["valid_email"]["failed"] == 0
    silver = read_silver(lake, "salesdb", cfg).collect()
    assert (len(silver), sum(1 for r in silver if r[END] is None)) == (24, 20)
    # time travel on Bronze and on Silver
    path = lake.bronze_path("salesdb", "customers")
    assert bz.read_as_of(spark, path, timestamp="2026-01-01 12:00:00").count() == 20
    assert bz.read_current(spark, path).count() == 20
    assert lake.silver("salesdb", cfg).read(1).count() == 20
    # a retried run of a published snapshot is a no-op; published versions are immutable
    assert run_snapshot_table(lake, src, cfg, snapshot_id=2)["skipped"]
    with pytest.raises(ValueError, match="immutable"):
        lake.silver("salesdb", cfg).write(spark.createDataFrame(R1, CUST), 2)
    assert len(read_silver(lake, "salesdb", cfg).collect()) == 24


def test_fail_rule_publishes_nothing(spark, tmp_root):
    src = read_source(SALESDB)
    base = src.table("orders")
    cfg = base.with_rules(Rule("small", "amount < 100", "fail"))
    lake = Lake(spark, tmp_root, buckets=4)
    schema = "order_id int, customer_id int, order_date string, amount int, status string, is_deleted boolean"
    ok = spark.createDataFrame([(1, 1, "2026-02-01", 5, " open", False)], schema)
    load_source_table(lake, src, cfg, ok, "2026-01-01 06:00:00")
    run_snapshot_table(lake, src, cfg)
    bad = spark.createDataFrame([(1, 1, "2026-02-01", 5, "shipped", False), (2, 1, "01.02.2026", 500, "open", False)], schema)
    load_source_table(lake, src, cfg, bad, "2026-01-02 06:00:00")
    with pytest.raises(ExpectationFailed, match="small"):
        run_snapshot_table(lake, src, cfg)
    silver = lake.silver("salesdb", cfg)
    assert silver.current_version() == 1
    assert [r.status for r in silver.read().collect()] == ["open"]


def _write_csv(folder, name, rows, when):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("product_code;product_name;category;price;valid_from\n")
        for r in rows:
            f.write(";".join(r) + "\n")
    ts = when.replace(tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (ts, ts))


FILE1 = [tuple(v or "" for v in r) for r in PRODUCTS_1]
FILE2 = PRODUCTS_2


def test_files_pipeline_with_late_file(spark, tmp_root):
    src = read_source(CRM_FILES)
    cfg = src.table("products")
    landing = os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    lake = Lake(spark, os.path.join(tmp_root, "lake"), buckets=4)
    _write_csv(landing, "products_1_r1.csv", FILE1, dt.datetime(2026, 10, 1, 8))
    _write_csv(landing, "notes.txt", [("x", "y", "z", "1", "2")], dt.datetime(2026, 10, 1, 8))
    first = run_files_table(lake, src, cfg, landing)
    assert first["bronze_rows"] == 6
    assert first["batches"][0]["rules"]["price_present"]["failed"] == 1
    _write_csv(landing, "products_2_r2.csv", FILE2, dt.datetime(2026, 10, 8, 8))
    run_files_table(lake, src, cfg, landing)
    got = read_silver(lake, "crm_files", cfg)
    rows = sorted((r.product_code, r.price, r[END] is None) for r in got.collect())
    assert rows == [
        ("K-07", "398.00", True),
        ("K-07", "412.50", False),
        ("K-08", "18.75", True),
        ("K-09", None, True),
        ("M-01", "7.20", True),
        ("M-02", "3.10", True),
        ("T-55", "64.00", True),
    ]
    again = run_files_table(lake, src, cfg, landing)  # nothing new: no rows, no batch
    assert again["bronze_rows"] == 0 and again["batches"] == []
    # a late file: older modification time than file 2, arriving last -> lands in the middle
    _write_csv(landing, "products_0_late.csv", [("K-07", "Garden Chair XL", "Outdoor", "405.25", "2026-05-01")], dt.datetime(2026, 10, 5, 8))
    run_files_table(lake, src, cfg, landing)
    p100 = sorted((r[START], r.price) for r in read_silver(lake, "crm_files", cfg).where("product_code = 'K-07'").collect())
    assert [p for _, p in p100] == ["412.50", "405.25", "398.00"]


def test_read_files_formats_and_lineage(spark, tmp_root):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for fmt in ("csv", "json", "parquet"):
        path = os.path.join(tmp_root, fmt)
        df.write.format(fmt).option("header", "true").save(path)
        got = read_files(spark, path, fmt, {"header": "true"}, pattern=f"*.{fmt}" if fmt != "parquet" else "*.parquet")
        assert got.count() == 2
        assert {"_file_path", "_file_modification_time", "_ingested_at"} <= set(got.columns)


def test_jdbc_partitioned_read(spark):
    url = "jdbc:derby:memory:strata_test;create=true"
    # upper-case names: what unquoted SQL identifiers resolve to in the database
    df = spark.range(0, 1000).select(F.col("id").cast("int").alias("ID"), (F.col("id") % 7).cast("int").alias("GRP"))
    df.write.format("jdbc").option("url", url).option("dbtable", "NUMS").mode("overwrite").save()
    got = read_table(spark, url, "NUMS", partition_column="ID", num_partitions=4)
    assert got.rdd.getNumPartitions() == 4
    assert got.count() == 1000 and got.where("GRP = 3").count() == 143


def test_files_pipeline_raw_key_spellings_share_history(spark, tmp_root):
    """Raw keys that clean to the same key (' P-6 ' and 'P-6') must rebuild together."""
    src = read_source(CRM_FILES)
    cfg = src.table("products")
    landing = os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    lake = Lake(spark, os.path.join(tmp_root, "lake"), buckets=16)
    codes = [f"P-{i}" for i in range(12)]
    _write_csv(landing, "products_1_a.csv", [(f" {c}  ", "Thing", "Cat", "1.00", "2026-01-01") for c in codes], dt.datetime(2026, 10, 1, 8))
    run_files_table(lake, src, cfg, landing)
    _write_csv(landing, "products_2_b.csv", [(c, "Thing", "Cat", "2.00", "2026-01-02") for c in codes], dt.datetime(2026, 10, 2, 8))
    run_files_table(lake, src, cfg, landing)
    got = read_silver(lake, "crm_files", cfg).collect()
    per = {}
    for r in got:
        per.setdefault(r.product_code, []).append((r.price, r[END] is None))
    assert {k: sorted(v) for k, v in per.items()} == {c: [("1.00", False), ("2.00", True)] for c in codes}


def test_stream_fail_rule_keeps_previous_version(spark, tmp_root):
    base = read_source(CRM_FILES)
    t = base.table("products")
    cfg = t.with_rules(Rule("price_sane", "try_cast(price AS DECIMAL(12,2)) < 5000", "fail"))
    src = SourceConfig(name=base.name, type=base.type, format="csv", options=base.options, tables=(cfg,))
    landing = os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    lake = Lake(spark, os.path.join(tmp_root, "lake"), buckets=4)
    _write_csv(landing, "products_1.csv", FILE2, dt.datetime(2026, 10, 1, 8))
    run_files_table(lake, src, cfg, landing)
    silver = lake.silver("crm_files", cfg)
    before = silver.current_version()
    _write_csv(landing, "products_2.csv", [("K-07", "Laptop", "Outdoor", "99999.00", "2026-10-02")], dt.datetime(2026, 10, 2, 8))
    with pytest.raises(Exception, match="price_sane"):
        run_files_table(lake, src, cfg, landing)
    assert silver.current_version() == before
    assert sorted(r.price for r in read_silver(lake, "crm_files", cfg).collect()) == ["398.00", "64.00"]


def test_run_sources_and_gold(spark, tmp_root):
    from strata.plans.gold import read_materialized
    from strata.plans.pipeline import refresh_sales_gold, run_source

    sales, crm = read_source(SALESDB), read_source(CRM_FILES)
    lake = Lake(spark, os.path.join(tmp_root, "lake"), buckets=4)
    customers = spark.createDataFrame(R1, CUST)
    orders = spark.createDataFrame(
        [(1, 1, "2026-02-01", 10, " open", False), (2, 2, "02/03/2026", 5, "cancelled", False), (3, 1, "20260215", 7, "SHIPPED", False)],
        "order_id int, customer_id int, order_date string, amount int, status string, is_deleted boolean",
    )
    res = run_source(lake, sales, {"customers": customers, "orders": orders}, ingested_at="2026-01-01 06:00:00")
    assert [r["table"] for r in res] == ["customers", "orders"]
    landing = os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    _write_csv(landing, "products_1.csv", FILE1, dt.datetime(2026, 10, 1, 8))
    run_source(lake, crm, location=landing)
    out = refresh_sales_gold(lake, sales, crm)
    rev = read_materialized(spark, out["revenue_by_customer_month"]).collect()
    assert sorted((r.customer_id, str(r.month), r.orders, int(r.revenue)) for r in rev) == [(1, "2026-02-01", 2, 17)]
    assert spark.table(out["product_price_history"]).where("is_current").count() == 5


def test_incremental_cursor_pipeline(spark, tmp_root):
    from strata.plans.pipeline import run_source

    orders_t = {
        "name": "orders",
        "load": {"type": "incremental", "cursor_column": "updated_at"},
        "keys": ["order_id"],
        "silver": {
            "scd_type": 1,
            "transforms": [{"column": "status", "fn": "clean_string"}],
            "expectations": {"positive_amount": {"expr": "amount >= 0", "action": "drop"}},
        },
    }
    src = read_source({"source": {"name": "erp", "type": "sqlserver"}, "tables": [orders_t]})
    lake = Lake(spark, os.path.join(tmp_root, "lake"), buckets=4)
    schema = "order_id int, amount int, status string, updated_at timestamp_ntz"
    t = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    day1 = [(1, 10, " open", t[0]), (2, 20, "open", t[0])]
    day2 = day1 + [(3, 30, "open", t[1])]
    day3 = [(1, 11, "shipped ", t[2]), (2, 20, "open", t[0]), (3, 30, "open", t[1])]
    rows_loaded = []
    for d, rows in enumerate((day1, day2, day3), start=1):
        res = run_source(lake, src, {"orders": spark.createDataFrame(rows, schema)}, ingested_at=f"2026-01-0{d} 06:00:00")
        rows_loaded.append(res[0]["rows"])
    assert rows_loaded == [2, 1, 1]  # only rows past the high-water mark
    got = sorted((r.order_id, r.amount, r.status) for r in read_silver(lake, "erp", src.table("orders")).collect())
    assert got == [(1, 11, "shipped"), (2, 20, "open"), (3, 30, "open")]


def test_files_pipeline_scd1(spark, tmp_root):
    base = read_source(CRM_FILES)
    t = base.table("products")
    cfg = replace(t, scd_type=1, history=None)
    src = SourceConfig(name=base.name, type=base.type, format="csv", options=base.options, tables=(cfg,))
    landing = os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    lake = Lake(spark, os.path.join(tmp_root, "lake"), buckets=4)
    _write_csv(landing, "products_1.csv", FILE1, dt.datetime(2026, 10, 1, 8))
    run_files_table(lake, src, cfg, landing)
    _write_csv(landing, "products_2.csv", FILE2, dt.datetime(2026, 10, 8, 8))
    run_files_table(lake, src, cfg, landing)
    got = sorted((r.product_code, r.price) for r in read_silver(lake, "crm_files", cfg).collect())
    assert got == [("K-07", "398.00"), ("K-08", "18.75"), ("K-09", None), ("M-01", "7.20"), ("M-02", "3.10"), ("T-55", "64.00")]
