"""Gold: business aggregates and views on top of Silver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.cleaning import mask_email
from strata.operators.joins import current_versions
from strata.operators.keys import END, START
from strata.sources import files_store as store


def revenue_by_customer_month(orders: DataFrame, customers_scd2: DataFrame) -> DataFrame:
    """Order count and revenue per customer and month, against the customer's current version.

    Orders are soft-deleted, cancelled or undated rows are left out.  The orders are
    aggregated per (customer, month) *before* the join -- the customer side holds one open
    version per key, so the result is the same, and a customer owning a large share of the
    orders costs one row per task in the shuffle instead of all its orders.
    """
    o = orders.where(~F.col("is_deleted") & (F.lower("status") != "cancelled"))
    # Undated orders form the NULL-month group, dropped after aggregating: a row filter on
    # the date would be pushed below the cleaning and parse every date a second time.
    per_month = (
        o.groupBy("customer_id", F.trunc("order_date", "MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("revenue"))
        .where(F.col("month").isNotNull())
    )
    current = current_versions(customers_scd2).select("customer_id", F.col("name").alias("customer_name"), "segment")
    return per_month.join(current, "customer_id").select(
        "customer_id", "customer_name", "segment", "month", "orders", F.col("revenue").cast("decimal(22,2)").alias("revenue")
    )


def price_history(products_scd2: DataFrame) -> DataFrame:
    """Price history per product from the SCD2 table (bad price text -> NULL)."""
    return products_scd2.select(
        "product_code",
        "product_name",
        "category",
        F.col("price").try_cast("decimal(12,2)").alias("price"),
        F.col(START).alias("valid_since"),
        F.col(END).alias("valid_until"),
        F.col(END).isNull().alias("is_current"),
    )


def top_products(lineitem: DataFrame, part: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` parts with the highest net revenue (exact decimals; ties broken by key).

    Revenue is aggregated per part (map-side combined), the top ``n`` are taken per task and
    merged (no global sort), and only those ``n`` rows meet ``part`` -- a bounded broadcast.
    """
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    rev = lineitem.groupBy("l_partkey").agg(F.sum(net).alias("revenue"), F.count(F.lit(1)).alias("lines"))
    top = rev.orderBy(F.col("revenue").desc(), F.col("l_partkey")).limit(n)
    named = part.select("p_partkey", "p_name").join(F.broadcast(top), F.col("p_partkey") == F.col("l_partkey"))
    return named.select("p_partkey", "p_name", F.col("revenue").cast("decimal(38,4)").alias("revenue"), "lines")


def masked_view(customers: DataFrame, segment: str) -> DataFrame:
    """Column mask (e-mail) plus row filter (one segment) over a customer table."""
    return customers.where(F.lower("segment") == segment.lower()).select(
        "customer_id", "name", mask_email("email").alias("email"), "segment"
    )


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Replace a Gold table as a whole and return it read back.

    The rows go to a folder of their own; readers follow the newest entry of ``_commits``, so
    they see the old table or the new one and never a mixture.
    """
    spark = df.sparkSession
    version = max(store.entries(spark, f"{path}/_commits"), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/ver-{version}")
    store.write_entry(spark, f"{path}/_commits/{version}.json", {"version": version, "schema": df.schema.jsonValue()})
    return read_materialized(spark, path)


def read_materialized(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a Gold table."""
    log = store.entries(spark, f"{path}/_commits")
    if not log:
        raise FileNotFoundError(f"{path}: no Gold table")
    version, entry = max(log.items())
    return spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{path}/ver-{version}")


def create_view(df: DataFrame, name: str, global_view: bool = False) -> str:
    """Publish a Gold/ops query as a named view of the session (re-evaluated on every read)."""
    if global_view:
        df.createOrReplaceGlobalTempView(name)
        return f"global_temp.{name}"
    df.createOrReplaceTempView(name)
    return name


def create_persistent_view(spark: SparkSession, name: str, query: str, **names: str) -> str:
    """Publish SQL text as a view in the catalog; ``{name}`` in the text is replaced by a quoted table name."""
    quoted = {k: ".".join(f"`{part}`" for part in v.split(".")) for k, v in names.items()}
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query.format(**quoted)}")
    return name


#: The price history as SQL text, for a view in the catalog; see :func:`price_history`.
PRICE_HISTORY = f"""
    SELECT product_code, product_name, category, try_cast(price AS DECIMAL(12,2)) AS price,
           {START} AS valid_since, {END} AS valid_until, {END} IS NULL AS is_current
    FROM {{products}}"""
