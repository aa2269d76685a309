"""Named queries over the driver's tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazily planned DataFrame over whole
tables.  Inputs are the reference's data model derived from the driver's tables
(:mod:`strata.sources.model`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.cleaning import (
    clean_string,
    lower_clean,
    mask_email,
    normalize_email,
    parse_date_multi,
    with_function,
)
from strata.functions.report import normalize_report
from strata.functions.sql import register_functions
from strata.operators.changes import dedupe_key_seq, key_collision_report, scd1_from_changes, scd2_from_changes, unique_key_check
from strata.operators.joins import current_versions
from strata.operators.quality import apply_drop, expectation_metrics
from strata.operators.snapshots import change_feed, scd2_apply_snapshot, scd2_start, snapshot_diff
from strata.operators.transforms import apply_transforms
from strata.plans import gold, ops, silver
from strata.plans.catalog import table_config
from strata.sources import model
from strata.sources.bronze import cursor_increment

AS_OF = "2024-01-31"
PROJECT_ENV = (model.PROJECT, "dev")
CUSTOMER_COLS = ["customer_id", "name", "email", "city", "segment", "updated_at"]
ORDER_COLS = ["order_id", "customer_id", "order_date", "amount", "status", "is_deleted", "updated_at"]


def _setup(spark: SparkSession) -> None:
    # the derivations and the oracle compare wall-clock timestamps; keep the session in UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def customers_cfg():
    return table_config("salesdb", "customers")


def orders_cfg():
    return table_config("salesdb", "orders")


def products_cfg():
    return table_config("crm_files", "products")


def load_log(spark: SparkSession) -> DataFrame:
    """The derived snapshots' load log: id and time, one row each."""
    rows = ", ".join(f"({k}, timestamp_ntz '{t}')" for k, t in model.SNAPSHOT_LOADED_AT.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(_snapshot_id, _ingested_at)")


def _customers_snapshot(spark, sf, k: int) -> DataFrame:
    return model.customers_snapshots(spark, sf, snapshots=(k,))


def _clean_customers(spark, sf, k: int) -> DataFrame:
    return silver.snapshot_view(_customers_snapshot(spark, sf, k), customers_cfg()).df


def _products_clean_changes(spark, sf) -> DataFrame:
    return silver.changes_view(model.products_changes(spark, sf), products_cfg()).df


def silver_customers(spark, sf) -> DataFrame:
    # Rebuilding from all snapshots at once: the set form scans the snapshots once and
    # shuffles once (window per key); the load-by-load form is what the pipeline runs.
    return silver.silver_from_snapshots(model.customers_snapshots(spark, sf), customers_cfg(), (1, 2, 3), incremental=False, loads=load_log(spark))


def silver_orders(spark, sf) -> DataFrame:
    # SCD1 needs the newest snapshot alone: derive no other
    return silver.silver_from_snapshots(model.orders_snapshots(spark, sf, snapshots=(3,)), orders_cfg(), (3,))


def silver_products(spark, sf) -> DataFrame:
    return silver.scd_from_changes(_products_clean_changes(spark, sf), products_cfg())


# ---- functions ------------------------------------------------------------------------------


def q_clean_string(spark, sf):
    d = model.table(spark, sf, "documents")
    return d.select("doc_id", clean_string("text").alias("text_clean"))


def q_normalize_email(spark, sf):
    c = model.customers_snapshots(spark, sf).select("customer_id", "email")
    return with_function(c, "email", normalize_email)


def q_parse_date_multi(spark, sf):
    o = model.orders_snapshots(spark, sf).select("order_id", "order_date")
    return with_function(o, "order_date", parse_date_multi)


def q_mask_email(spark, sf):
    c = model.customers_snapshots(spark, sf)
    return c.select("customer_id", mask_email(normalize_email("email")).alias("masked"))


def q_lower_clean(spark, sf):
    o = model.orders_snapshots(spark, sf).select("order_id", "status")
    return with_function(o, "status", lower_clean)


def q_normalize_report(spark, sf):
    docs = model.table(spark, sf, "documents")
    conv = model.table(spark, sf, "conversations")
    cust = model.customers_snapshots(spark, sf)
    orders = model.orders_snapshots(spark, sf)
    return (
        normalize_report(docs, "text", clean_string, "clean_string:documents")
        .unionByName(normalize_report(conv, "text", clean_string, "clean_string:conversations"))
        .unionByName(normalize_report(cust, "email", normalize_email, "normalize_email:customers"))
        .unionByName(normalize_report(orders, "order_date", parse_date_multi, "parse_date_multi:orders"))
    )


def q_apply_transforms(spark, sf):
    return apply_transforms(model.customers_snapshots(spark, sf), customers_cfg()).select(*CUSTOMER_COLS)


def q_udf_sql_surface(spark, sf):
    register_functions(spark)
    model.customers_snapshots(spark, sf).createOrReplaceTempView("strata_customers_raw")
    return spark.sql(
        "SELECT customer_id, clean_string(name) AS name, normalize_email(email) AS email, "
        "mask_email(normalize_email(email)) AS masked, lower_clean(segment) AS segment "
        "FROM strata_customers_raw"
    )


def q_udf_sql_dates(spark, sf):
    register_functions(spark)
    model.orders_snapshots(spark, sf).createOrReplaceTempView("strata_orders_raw")
    return spark.sql(
        "SELECT order_id, parse_date_multi(order_date) AS order_date, clean_string(status) AS status FROM strata_orders_raw"
    )


def q_param_sql(spark, sf):
    silver_orders(spark, sf).createOrReplaceGlobalTempView("strata_silver_orders")
    return spark.sql(
        "SELECT status, count(*) AS orders FROM IDENTIFIER(:schema || '.' || :table) GROUP BY status",
        args={"schema": "global_temp", "table": "strata_silver_orders"},
    )


# ---- data quality ---------------------------------------------------------------------------


def q_dq_drop(spark, sf):
    cfg = orders_cfg()
    cleaned = apply_transforms(model.orders_snapshots(spark, sf), cfg)
    return apply_drop(cleaned, cfg).select(*ORDER_COLS)


def q_dq_metrics(spark, sf):
    o_cfg, c_cfg = orders_cfg(), customers_cfg()
    o = apply_transforms(model.orders_snapshots(spark, sf), o_cfg)
    c = apply_transforms(model.customers_snapshots(spark, sf), c_cfg)
    return (
        expectation_metrics(o, o_cfg)
        .select(F.lit("orders").alias("table_name"), "*")
        .unionByName(expectation_metrics(c, c_cfg).select(F.lit("customers").alias("table_name"), "*"))
    )


# ---- snapshots ------------------------------------------------------------------------------


def q_snapshot_diff(spark, sf):
    return snapshot_diff(_clean_customers(spark, sf, 1), _clean_customers(spark, sf, 2), ["customer_id"])


def q_change_feed(spark, sf):
    return change_feed(_clean_customers(spark, sf, 2), _clean_customers(spark, sf, 3), ["customer_id"], 3)


def q_scd1_from_snapshots(spark, sf):
    return silver_orders(spark, sf)


def q_scd2_from_snapshots(spark, sf):
    cfg = customers_cfg()
    b = model.customers_snapshots(spark, sf)
    state = None
    for k in (1, 2, 3):
        view = silver.snapshot_view(b.where(F.col("_snapshot_id") == k), cfg).df
        at = model.SNAPSHOT_LOADED_AT[k]
        state = scd2_start(view, at) if state is None else scd2_apply_snapshot(state, view, cfg.keys, at)
    return state


def q_scd2_tracked_columns(spark, sf):
    return silver_customers(spark, sf)


def q_scd2_current(spark, sf):
    return current_versions(silver_customers(spark, sf))


# ---- change streams -------------------------------------------------------------------------


def q_dedupe_key_seq(spark, sf):
    return dedupe_key_seq(model.products_changes(spark, sf), ["product_code"], "_file_modification_time").drop(
        "_ingested_at"
    )


def q_unique_key_check(spark, sf):
    return unique_key_check(model.products_changes(spark, sf), ["product_code"], "_file_modification_time")


def q_key_collision_report(spark, sf):
    return key_collision_report(model.products_changes(spark, sf), "product_code", clean_string("product_code"))


def q_scd1_from_changes(spark, sf):
    cfg = products_cfg()
    return scd1_from_changes(_products_clean_changes(spark, sf), cfg.keys, cfg.sequence_by, silver.STREAM_EXCEPT)


def _orders_change_stream(spark, sf) -> DataFrame:
    """Order snapshots read as a change stream ordered by ``updated_at`` (a CDC export)."""
    cfg = orders_cfg()
    raw = model.orders_snapshots(spark, sf).drop("_snapshot_id", "_ingested_at")
    return apply_transforms(dedupe_key_seq(raw, cfg.keys, "updated_at"), cfg)


def q_scd1_soft_delete(spark, sf):
    return scd1_from_changes(_orders_change_stream(spark, sf), ["order_id"], "updated_at", apply_as_deletes="is_deleted")


def q_scd2_soft_delete(spark, sf):
    """A change marked as a delete closes its key's version and is no version itself."""
    return scd2_from_changes(_orders_change_stream(spark, sf), ["order_id"], "updated_at", apply_as_deletes="is_deleted")


def q_scd2_from_changes(spark, sf):
    return silver_products(spark, sf)


def q_incremental_cursor_load(spark, sf):
    cfg = orders_cfg()
    snaps = model.orders_snapshots(spark, sf).drop("_ingested_at")
    loaded = None
    for k in (1, 2, 3):
        src = snaps.where(F.col("_snapshot_id") == k).drop("_snapshot_id")
        inc = cursor_increment(src, loaded, "updated_at")
        loaded = inc if loaded is None else loaded.unionByName(inc)
    cleaned = apply_transforms(loaded, cfg)
    return scd1_from_changes(apply_drop(cleaned, cfg), cfg.keys, "updated_at")


# ---- gold / ops -----------------------------------------------------------------------------


def q_revenue_by_customer_month(spark, sf):
    return gold.revenue_by_customer_month(silver_orders(spark, sf), silver_customers(spark, sf))


def q_price_history(spark, sf):
    return gold.price_history(silver_products(spark, sf))


def q_cost_by_day(spark, sf):
    project, env = PROJECT_ENV
    return ops.cost_by_day(model.usage(spark, sf), model.list_prices(spark, sf), project, env)


def q_job_runs_recent(spark, sf):
    return ops.job_runs_recent(model.job_runs(spark, sf), model.jobs(spark, sf), AS_OF)


def q_top_products(spark, sf):
    return gold.top_products(model.table(spark, sf, "lineitem"), model.table(spark, sf, "part"), 10)


def q_masked_view(spark, sf):
    return gold.masked_view(current_versions(silver_customers(spark, sf)), "building")


USAGE_RULES = {"min_quantity": "usage_quantity >= 1", "tagged_env": "custom_tags['env'] IS NOT NULL"}


def q_ops_failures_by_day(spark, sf):
    return ops.failures_by_day(model.job_runs(spark, sf), model.usage(spark, sf), "usage_date", USAGE_RULES)


def q_table_profile(spark, sf):
    return ops.table_profile(model.customers_snapshots(spark, sf), ["name", "email", "city", "segment"], "updated_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_string": q_clean_string,
    "normalize_email": q_normalize_email,
    "parse_date_multi": q_parse_date_multi,
    "mask_email": q_mask_email,
    "lower_clean": q_lower_clean,
    "normalize_report": q_normalize_report,
    "apply_transforms": q_apply_transforms,
    "udf_sql_surface": q_udf_sql_surface,
    "udf_sql_dates": q_udf_sql_dates,
    "param_sql": q_param_sql,
    "dq_drop": q_dq_drop,
    "dq_metrics": q_dq_metrics,
    "snapshot_diff": q_snapshot_diff,
    "change_feed": q_change_feed,
    "scd1_from_snapshots": q_scd1_from_snapshots,
    "scd2_from_snapshots": q_scd2_from_snapshots,
    "scd2_tracked_columns": q_scd2_tracked_columns,
    "scd2_current": q_scd2_current,
    "dedupe_key_seq": q_dedupe_key_seq,
    "unique_key_check": q_unique_key_check,
    "key_collision_report": q_key_collision_report,
    "scd1_from_changes": q_scd1_from_changes,
    "scd1_soft_delete": q_scd1_soft_delete,
    "scd2_from_changes": q_scd2_from_changes,
    "scd2_soft_delete": q_scd2_soft_delete,
    "incremental_cursor_load": q_incremental_cursor_load,
    "revenue_by_customer_month": q_revenue_by_customer_month,
    "price_history": q_price_history,
    "cost_by_day": q_cost_by_day,
    "job_runs_recent": q_job_runs_recent,
    "top_products": q_top_products,
    "masked_view": q_masked_view,
    "ops_failures_by_day": q_ops_failures_by_day,
    "table_profile": q_table_profile,
}


QUERIES["silver_products"] = silver_products


def _io_queries():
    from strata.plans.registry_io import QUERIES_IO

    return QUERIES_IO


def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _setup(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **_io_queries()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: wrap(v) for k, v in all_queries().items()}
