"""Registered queries that run the write paths: pipelines to disk, streams, file reads.

Each call works in a fresh folder below the shared checkpoint folder
(``spark.checkpoint.dir``) and returns the result read back from disk.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import Rule, SourceConfig, read_source, read_table
from strata.functions.sql import register_functions
from strata.operators.changes import unique_key_check
from strata.operators.quality import ExpectationFailed, expectation_metrics
from strata.operators.transforms import apply_transforms
from strata.plans import gold, registry
from strata.plans.catalog import CRM_FILES, SALESDB
from strata.plans.pipeline import Lake, load_source_table, read_silver, run_cursor_table, run_files_table, run_snapshot_table
from strata.plans.silver import snapshot_view
from strata.session import scratch_path
from strata.sources import bronze as bz
from strata.sources import metadata, model
from strata.sources.files import read_files


SNAPSHOT_AS_OF = "2026-01-02 12:00:00"


def _lake(spark: SparkSession, name: str, buckets: int = 4) -> Lake:
    return Lake(spark, scratch_path(spark, "queries", f"{name}-{uuid.uuid4().hex[:10]}"), buckets)


def _snapshot_pipeline(spark: SparkSession, sf: str, table: str) -> DataFrame:
    src = read_source(SALESDB)
    cfg = src.table(table)
    lake = _lake(spark, f"silver_{table}")
    derive = model.customers_snapshots if table == "customers" else model.orders_snapshots
    for k in (1, 2, 3):
        raw = derive(spark, sf, snapshots=(k,)).drop("_snapshot_id", "_ingested_at")
        load_source_table(lake, src, cfg, raw, model.SNAPSHOT_LOADED_AT[k], snapshot_id=k)
        run_snapshot_table(lake, src, cfg, snapshot_id=k)
    return read_silver(lake, src.name, cfg)


def q_silver_customers(spark, sf):
    """Customers through Bronze snapshots on disk and three published Silver versions."""
    return _snapshot_pipeline(spark, sf, "customers")


def q_silver_orders(spark, sf):
    return _snapshot_pipeline(spark, sf, "orders")


def q_change_feed_stored(spark, sf):
    """The feed between two published versions, from the rows that the second one opened and closed."""
    src, lake = read_source(SALESDB), _lake(spark, "feed")
    cfg = replace(src.table("customers"), history=None)
    for k in (1, 2, 3):
        raw = model.customers_snapshots(spark, sf, snapshots=(k,)).drop("_snapshot_id", "_ingested_at")
        load_source_table(lake, src, cfg, raw, model.SNAPSHOT_LOADED_AT[k])
        run_snapshot_table(lake, src, cfg)
    return lake.silver(src.name, cfg).change_feed(2, 3)


def q_profile_from_log(spark, sf):
    """Completeness and freshness of three loads, merged from their log entries."""
    lake, src = _bronze(spark, sf, "profile")
    columns = ["name", "email", "city", "segment"]
    return bz.load_profile(spark, lake.bronze_path(src.name, "customers"), columns, "updated_at").drop("distinct_about", "median_about")


def q_rebucketed_load(spark, sf):
    """The table is dealt to another number of buckets between two loads; nothing is lost or doubled."""
    src, lake = read_source(SALESDB), _lake(spark, "rebucketed")
    cfg = src.table("customers")
    for k in (1, 2, 3):
        raw = model.customers_snapshots(spark, sf, snapshots=(k,)).drop("_snapshot_id", "_ingested_at")
        load_source_table(lake, src, cfg, raw, model.SNAPSHOT_LOADED_AT[k])
        run_snapshot_table(lake, src, cfg)
        if k == 2:
            lake.silver(src.name, cfg).rebucket(7)
            lake = Lake(spark, lake.root, 7)
    return read_silver(lake, src.name, cfg)


def q_schema_added_column(spark, sf):
    """Columns come, go and widen between snapshots: the first has no ``updated_at``, ``points`` comes
    with the second as int and is a bigint in the third, which has no ``updated_at`` any more."""
    src, lake = read_source(SALESDB), _lake(spark, "added_column")
    cfg = src.table("customers")
    points = {2: (F.col("customer_id") % 1000).cast("int"), 3: F.col("customer_id") % 1000 + 3_000_000_000}
    for k in (1, 2, 3):
        raw = model.customers_snapshots(spark, sf, snapshots=(k,)).drop("_snapshot_id", "_ingested_at")
        raw = raw if k == 2 else raw.drop("updated_at")
        load_source_table(lake, src, cfg, raw.withColumn("points", points[k]) if k > 1 else raw, model.SNAPSHOT_LOADED_AT[k])
        run_snapshot_table(lake, src, cfg)
    return read_silver(lake, src.name, cfg)


def q_schema_widened_json(spark, sf):
    """Exports as JSON whose price is a number in some and text in others, and one with a new field;
    values arrive as their text, and the table's history is that of all changes."""
    base = read_source(CRM_FILES)
    cfg = replace(base.table("products"), pattern="products_*.json")
    src = replace(base, format="json", options={}, tables=(cfg,))
    lake = _lake(spark, "widened_json")
    landing = f"{lake.root}/landing"
    for f in sorted(model.FILE_ARRIVED_AT, key=lambda k: model.FILE_ARRIVED_AT[k]):
        rows = model.products_changes(spark, sf, files=(f,)).select("product_code", "product_name", "category", "price", "valid_from")
        rows = rows.withColumn("price", F.col("price").cast("decimal(12,2)")) if f % 2 else rows
        _export(spark, rows.withColumn("badge", F.lit(True)) if f == 3 else rows, landing, f, "json", {})
        run_files_table(lake, src, cfg, landing)
    return _wall_clock(read_silver(lake, src.name, cfg))


CSV_OUT = {"header": "true", "delimiter": ";", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _write_landing(spark: SparkSession, sf: str, landing: str, files=None) -> None:
    """The product change rows as ';'-separated CSV exports named ``products_<n>_<part>.csv``.

    Each export is written by Spark into a staging folder (values kept verbatim, padding
    included); its part files are then moved into the landing folder under export names and
    given the export's modification time, as the exporting system would (file-system
    operations on a handful of files; no data passes through the driver).
    """
    rows = model.products_changes(spark, sf)
    cols = ["product_code", "product_name", "category", "price", "valid_from"]
    for f in files or sorted(model.FILE_ARRIVED_AT, key=lambda k: model.FILE_ARRIVED_AT[k]):
        # columns in another order in every other export: they are bound by name
        part = rows.where(F.col("_file_path") == f"products_f{f}.csv").select(*(cols if f % 2 else reversed(cols)))
        _export(spark, part, landing, f, "csv", CSV_OUT)


def _export(spark: SparkSession, part: DataFrame, landing: str, f: int, fmt: str, options: dict[str, str]) -> None:
    jvm = spark.sparkContext._jvm
    staging = f"{landing}/_staging/{f}"
    part.write.format(fmt).options(**options).save(staging)
    src = jvm.org.apache.hadoop.fs.Path(staging)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mtime = int(dt.datetime.fromisoformat(model.FILE_MODIFIED_AT[f]).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    for i, st in enumerate(s for s in fs.listStatus(src) if s.getPath().getName().endswith(f".{fmt}")):
        target = jvm.org.apache.hadoop.fs.Path(f"{landing}/products_{f}_{i:05d}.{fmt}")
        fs.rename(st.getPath(), target)
        fs.setTimes(target, mtime, -1)


def q_file_stream_ingest(spark, sf):
    """Files -> Bronze stream -> Silver via foreachBatch (sequence = file time)."""
    src = read_source(CRM_FILES)
    cfg = src.table("products")
    lake = _lake(spark, "files")
    landing = f"{lake.root}/landing"
    _write_landing(spark, sf, landing)
    run_files_table(lake, src, cfg, landing)
    return _wall_clock(read_silver(lake, src.name, cfg))


def q_scd2_late_arrival(spark, sf):
    """The exports arrive one by one, the last one older than two before it; the table's
    history is that of all changes in sequence order."""
    src = read_source(CRM_FILES)
    cfg = src.table("products")
    lake = _lake(spark, "late")
    landing = f"{lake.root}/landing"
    for f in sorted(model.FILE_ARRIVED_AT, key=lambda k: model.FILE_ARRIVED_AT[k]):
        _write_landing(spark, sf, landing, [f])
        run_files_table(lake, src, cfg, landing)
    return _wall_clock(read_silver(lake, src.name, cfg))


def _wall_clock(out: DataFrame) -> DataFrame:
    # file times are zoned timestamps; shown as wall-clock UTC like the other tables
    ntz = ["_file_modification_time", "__START_AT", "__END_AT"]
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ntz else F.col(c) for c in out.columns])


def q_file_formats_read(spark, sf):
    """The same rows written and read back as csv, json and parquet."""
    lake = _lake(spark, "formats")
    cols = ["product_code", "product_name", "category", "price", "valid_from"]
    rows = model.products_changes(spark, sf).select(*cols)
    out = None
    for fmt, opts in (("csv", {"header": "true", "delimiter": ";"}), ("json", {}), ("parquet", {})):
        path = f"{lake.root}/{fmt}"
        # half of the rows in files with the columns the other way round
        half = F.pmod(F.xxhash64(*cols), F.lit(2)) == 0
        rows.where(half).write.format(fmt).options(**(CSV_OUT if fmt == "csv" else opts)).save(path)
        rows.where(~half).select(*reversed(cols)).write.mode("append").format(fmt).options(**(CSV_OUT if fmt == "csv" else opts)).save(path)
        got = read_files(spark, path, fmt, opts, pattern=f"*.{fmt}", with_lineage=False).select(
            F.lit(fmt).alias("format"), *[F.col(c).cast("string") for c in rows.columns]
        )
        out = got if out is None else out.unionByName(got)
    return out


def q_file_lineage_columns(spark, sf):
    """Every row read with its file, the file's modification time and the load time.

    The export number is taken from the file name (absolute paths differ per run); the load
    time is only checked to be present.
    """
    lake = _lake(spark, "lineage")
    landing = f"{lake.root}/landing"
    _write_landing(spark, sf, landing)
    df = read_files(spark, landing, "csv", {"header": "true", "delimiter": ";"}, pattern="products_*.csv")
    return df.select(
        "product_code",
        F.regexp_extract("_file_path", r"products_(\d+)_\d+\.csv$", 1).cast("int").alias("export_no"),
        F.col("_file_modification_time").cast("timestamp_ntz").alias("_file_modification_time"),
        F.col("_ingested_at").isNotNull().alias("has_load_time"),
    )


def q_multi_table_full_load(spark, sf):
    """The full-load tables of a source, loaded four at a time, audited from Bronze."""
    src = read_source(SALESDB)
    lake = _lake(spark, "multi")
    derive = {"customers": model.customers_snapshots, "orders": model.orders_snapshots}
    full = [t["name"] for t in bz.full_load_tables(SALESDB["tables"])]
    jobs = [
        (name, (lambda d=derive[name]: d(spark, sf, snapshots=(1,)).drop("_snapshot_id", "_ingested_at")), lake.bronze_path(src.name, name))
        for name in full
    ]
    bz.load_many(jobs, spark, parallel=4, ingested_at=model.SNAPSHOT_LOADED_AT[1])
    return _audit(spark, lake, src, full)


def _audit(spark: SparkSession, lake: Lake, src: SourceConfig, tables) -> DataFrame:
    out = None
    for name in tables:
        rows = bz.load_audit(spark, lake.bronze_path(src.name, name), name)
        out = rows if out is None else out.unionByName(rows)
    return out


def _bronze(spark: SparkSession, sf: str, name: str, tables=("customers",)) -> tuple[Lake, SourceConfig]:
    """A lake whose Bronze tables hold the three snapshots."""
    src, lake = read_source(SALESDB), _lake(spark, name)
    for table in tables:
        derive = model.customers_snapshots if table == "customers" else model.orders_snapshots
        for k in (1, 2, 3):
            raw = derive(spark, sf, snapshots=(k,)).drop("_snapshot_id", "_ingested_at")
            load_source_table(lake, src, src.table(table), raw, model.SNAPSHOT_LOADED_AT[k])
    return lake, src


def q_bronze_snapshot_load(spark, sf):
    """Three full loads, side by side in Bronze."""
    lake, src = _bronze(spark, sf, "bronze")
    return bz.read_loads(spark, lake.bronze_path(src.name, "customers"))


def q_bronze_current_snapshot(spark, sf):
    """The newest load."""
    lake, src = _bronze(spark, sf, "bronze_current")
    return bz.read_current(spark, lake.bronze_path(src.name, "customers"))


def q_snapshot_as_of(spark, sf):
    """The load that was the newest at a time."""
    lake, src = _bronze(spark, sf, "bronze_as_of")
    return bz.read_as_of(spark, lake.bronze_path(src.name, "customers"), timestamp=SNAPSHOT_AS_OF)


def q_load_audit(spark, sf):
    """S3: rows of each load, from the load log."""
    lake, src = _bronze(spark, sf, "bronze_audit", ("customers", "orders"))
    return _audit(spark, lake, src, ("customers", "orders"))


def _empty_in_between(spark: SparkSession, sf: str, table: str) -> tuple[Lake, SourceConfig]:
    """Snapshot 1, an empty one, and snapshot 3, through the pipeline."""
    src, lake = read_source(SALESDB), _lake(spark, f"empty_{table}")
    derive = model.customers_snapshots if table == "customers" else model.orders_snapshots
    for k in (1, 2, 3):
        raw = derive(spark, sf, snapshots=(k,)).drop("_snapshot_id", "_ingested_at")
        load_source_table(lake, src, src.table(table), raw.where("false") if k == 2 else raw, model.SNAPSHOT_LOADED_AT[k])
        run_snapshot_table(lake, src, src.table(table))
    return lake, src


def q_empty_snapshot_scd1(spark, sf):
    """An empty snapshot deletes every key; rows of each published version."""
    lake, src = _empty_in_between(spark, sf, "orders")
    out = None
    for v in (1, 2, 3):
        n = read_silver(lake, src.name, src.table("orders"), v).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(v).alias("version"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def q_empty_snapshot_scd2(spark, sf):
    """An empty snapshot closes every version; the next one opens new ones."""
    lake, src = _empty_in_between(spark, sf, "customers")
    return read_silver(lake, src.name, src.table("customers"))


def q_duplicate_key_snapshot(spark, sf):
    """A snapshot that holds keys twice is refused; its doubled keys, and that nothing was published."""
    src, lake = read_source(SALESDB), _lake(spark, "duplicates")
    cfg = src.table("customers")
    raw = model.customers_snapshots(spark, sf, snapshots=(1, 2)).drop("_snapshot_id", "_ingested_at")
    load_source_table(lake, src, cfg, raw, model.SNAPSHOT_LOADED_AT[1])
    try:
        run_snapshot_table(lake, src, cfg)
        refused = False
    except ValueError:
        refused = True
    view = snapshot_view(bz.read_current(spark, lake.bronze_path(src.name, "customers")), cfg).df
    published = lake.silver(src.name, cfg).exists()
    return unique_key_check(view, cfg.keys).select("*", F.lit(refused).alias("refused"), F.lit(published).alias("published"))


def q_gold_materialized(spark, sf):
    """The revenue table replaced twice, read back from its newest version."""
    lake = _lake(spark, "gold")
    path = f"{lake.root}/gold/revenue"
    rows = registry.QUERIES["revenue_by_customer_month"](spark, sf)
    gold.materialize(rows.limit(0), path)
    return gold.materialize(rows, path)


def q_gold_persistent_view(spark, sf):
    """The price history as a view in the catalog over a registered Silver table."""
    lake = _lake(spark, "view")
    name = f"strata_products_{uuid.uuid4().hex[:10]}"
    registry.QUERIES["silver_products"](spark, sf).write.parquet(f"{lake.root}/products")
    bz.register_table(spark, name, f"{lake.root}/products")
    return spark.table(gold.create_persistent_view(spark, f"{name}_prices", gold.PRICE_HISTORY, products=name))


def q_table_properties(spark, sf):
    """Comment and properties of a registered Bronze table, next to its rows."""
    lake, src = _bronze(spark, sf, "properties")
    name = f"strata_customers_{uuid.uuid4().hex[:10]}"
    wanted = {"load_type": "full", "change_feed": "true"}
    bz.register_table(spark, name, lake.bronze_path(src.name, "customers"), "raw customers", wanted)
    props = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    comment = next(r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect() if r.col_name == "Comment")
    shown = F.lit(", ".join(f"{k}={props[k]}" for k in sorted(wanted)))
    return spark.table(name).groupBy(bz.SNAPSHOT_ID).agg(F.count(F.lit(1)).alias("rows")).select("*", F.lit(comment).alias("comment"), shown.alias("properties"))


def q_udf_versions(spark, sf):
    """Permanent functions carry the version in their comment; used on whole snapshots."""
    schema = f"strata_fn_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    register_functions(spark, schema, version="9.9.9")
    told = "\n".join(r[0] for r in spark.sql(f"DESCRIBE FUNCTION EXTENDED {schema}.lower_clean").collect())
    model.customers_snapshots(spark, sf).createOrReplaceTempView("strata_versions_raw")
    return spark.sql(
        f"SELECT {schema}.lower_clean(segment) AS segment, count(*) AS rows, {str('9.9.9' in told).lower()} AS versioned FROM strata_versions_raw GROUP BY 1"
    )


def q_metadata_health(spark, sf):
    """The metadata mirror joined to Bronze row counts per configured table."""
    lake, src = _bronze(spark, sf, "health", ("customers", "orders"))
    crm = read_source(CRM_FILES)
    _write_landing(spark, sf, f"{lake.root}/landing")
    run_files_table(lake, crm, crm.table("products"), f"{lake.root}/landing")
    metadata.publish(*metadata.mirror(spark, [SALESDB, CRM_FILES], git_sha="local", deployed_at=None), f"{lake.root}/metadata")
    tables = spark.read.parquet(f"{lake.root}/metadata/tables")
    counts = _audit(spark, lake, src, ("customers", "orders")).unionByName(_audit(spark, lake, crm, ("products",))).withColumnRenamed("table_name", "table")
    latest = counts.groupBy("table").agg(F.max_by("rows", "_snapshot_id").alias("latest_rows"), F.count(F.lit(1)).alias("loads"))
    return tables.join(latest, "table", "left").select("source", "table", "load_type", "scd_type", "keys", "latest_rows", "loads")


def q_dq_fail(spark, sf):
    """Q3: a ``fail`` rule stops the Silver update; the result shows the counters and that
    nothing was published."""
    src = read_source(SALESDB)
    base = src.table("orders")
    cfg = base.with_rules(Rule("has_date", "order_date IS NOT NULL", "fail"))
    lake = _lake(spark, "dq_fail")
    raw = model.orders_snapshots(spark, sf, snapshots=(1,)).drop("_snapshot_id", "_ingested_at")
    load_source_table(lake, src, cfg, raw, model.SNAPSHOT_LOADED_AT[1])
    try:
        run_snapshot_table(lake, src, cfg, snapshot_id=1)
        failed = False
    except ExpectationFailed:
        failed = True
    published = lake.silver(src.name, cfg).current_version() is not None
    metrics = expectation_metrics(apply_transforms(raw, cfg), cfg)
    return metrics.select("*", F.lit(failed).alias("update_failed"), F.lit(published).alias("published"))


def q_incremental_cursor_pipeline(spark, sf):
    """X1 through the pipeline: three cursor loads of the order source into Bronze/Silver."""
    base = SALESDB["tables"][1]
    cfg = read_table({**base, "load": {"type": "incremental", "cursor_column": "updated_at"}})
    src = SourceConfig(name="salesdb", type="sqlserver", tables=(cfg,))
    lake = _lake(spark, "cursor")
    for k in (1, 2, 3):
        raw = model.orders_snapshots(spark, sf, snapshots=(k,)).drop("_snapshot_id", "_ingested_at")
        run_cursor_table(lake, src, cfg, raw, model.SNAPSHOT_LOADED_AT[k])
    return read_silver(lake, src.name, cfg)


QUERIES_IO = {
    "silver_customers": q_silver_customers,
    "silver_orders": q_silver_orders,
    "change_feed_stored": q_change_feed_stored,
    "profile_from_log": q_profile_from_log,
    "rebucketed_load": q_rebucketed_load,
    "schema_added_column": q_schema_added_column,
    "schema_widened_json": q_schema_widened_json,
    "bronze_snapshot_load": q_bronze_snapshot_load,
    "bronze_current_snapshot": q_bronze_current_snapshot,
    "snapshot_as_of": q_snapshot_as_of,
    "load_audit": q_load_audit,
    "empty_snapshot_scd1": q_empty_snapshot_scd1,
    "empty_snapshot_scd2": q_empty_snapshot_scd2,
    "duplicate_key_snapshot": q_duplicate_key_snapshot,
    "gold_materialized": q_gold_materialized,
    "gold_persistent_view": q_gold_persistent_view,
    "table_properties": q_table_properties,
    "udf_versions": q_udf_versions,
    "scd2_late_arrival": q_scd2_late_arrival,
    "file_stream_ingest": q_file_stream_ingest,
    "file_formats_read": q_file_formats_read,
    "file_lineage_columns": q_file_lineage_columns,
    "multi_table_full_load": q_multi_table_full_load,
    "metadata_health": q_metadata_health,
    "dq_fail": q_dq_fail,
    "incremental_cursor_pipeline": q_incremental_cursor_pipeline,
}
